"""Typical passages of a register, and others held out for verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from penstroke.functions import counts, segment

LEAST_WORDS, MOST_WORDS = 60, 150
#: Markup, citations or code make a paragraph unclean.
_UNCLEAN = r"(?m)^#|^\s*[-*+]\s|`|\[\d+\]|<[^>]+>|\||https?:"


def candidates(docs: DataFrame, register: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Clean, complete paragraphs of a usable length, with the distance of their measures from the register's means."""
    each = docs.where(F.col(text).isNotNull()).select(F.col(register).alias(register), F.col(key).alias(key), F.posexplode(segment.paragraphs(F.col(text))).alias("place", "paragraph"))
    sized = each.withColumn("n_words", F.size(segment.words(F.col("paragraph")))).withColumn("n_sentences", F.greatest(F.size(segment.sentences(F.col("paragraph"))), F.lit(1)))
    sized = sized.withColumn("commas", counts.occurrences(F.col("paragraph"), ",")).where(F.col("n_words") > 0)
    length, comma = F.col("n_words") / F.col("n_sentences"), F.col("commas") / F.col("n_words")
    means = sized.groupBy(register).agg(F.avg(length).alias("__l"), F.avg(comma).alias("__c"), F.stddev_pop(length).alias("__ls"), F.stddev_pop(comma).alias("__cs"))
    whole = F.col("paragraph").rlike(r"(?s)^[A-Z\"'(].*[.!?][\"')]?$") & ~F.col("paragraph").rlike(_UNCLEAN)
    kept = sized.where(F.col("n_words").between(LEAST_WORDS, MOST_WORDS) & whole).join(means, register)
    distance = F.abs(length - F.col("__l")) / F.when(F.col("__ls") > 0, F.col("__ls")).otherwise(1.0) + F.abs(comma - F.col("__c")) / F.when(F.col("__cs") > 0, F.col("__cs")).otherwise(1.0)
    return kept.select(register, key, "place", "paragraph", "n_words", F.round(distance, 6).alias("distance"))


def choose(found: DataFrame, register: str, exemplars: int = 5, held_out: int = 3, key: str = "doc_id") -> DataFrame:
    """``register, role, rank, key, place, n_words, distance``: the most typical paragraphs, one a document at most;
    the next ones are held out, so no document serves as both."""
    one = found.withColumn("__r", F.row_number().over(Window.partitionBy(register, key).orderBy("distance", "place"))).where("__r = 1")
    rank = one.withColumn("rank", F.row_number().over(Window.partitionBy(register).orderBy("distance", key, "place"))).where(F.col("rank") <= exemplars + held_out)
    return rank.select(register, F.when(F.col("rank") <= exemplars, "exemplar").otherwise("held out").alias("role"), "rank", key, "place", "n_words", "distance")
