"""Connective and cognitive marker classes, counted by a join of word counts with a small class table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES: dict[str, list[str]] = {
    "additive": ["moreover", "also", "and"], "adversative": ["yet", "however", "but"], "causal": ["since", "therefore", "because"], "temporal": ["after", "when", "then"],
    "causation": ["cause", "reason", "result", "consequently", "hence", "effect", "because"], "insight": ["believe", "understand", "realize", "consider", "know", "think"],
    "discrepancy": ["unless", "if", "must", "ought", "could", "would", "should"], "certainty": ["truly", "certainly", "definitely", "never", "always"],
}


def class_counts(counted: DataFrame, by: list[str]) -> DataFrame:
    """``by, class, n, per_1000``; a word may belong to several classes, and a class without hits has a row of 0."""
    spark = counted.sparkSession
    terms = spark.createDataFrame([(c, w) for c, words in CLASSES.items() for w in words], "class string, word string")
    tokens = counted.groupBy(*by).agg(F.sum("n").alias("tokens"))
    hits = counted.join(F.broadcast(terms), "word").groupBy(*by, "class").agg(F.sum("n").alias("n"))
    grid = tokens.crossJoin(F.broadcast(terms.select("class").distinct()))
    full = grid.join(hits, [*by, "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*by, "class", "n", (F.col("n") / F.col("tokens") * 1000).alias("per_1000"))
