"""Measures of parsed text: dependency depth, passives, nominalisations and tag pairs.

The input is one row a token: ``by``, ``sentence``, ``at`` (place in its sentence, from 0), ``head`` (the place of its
head; its own for the root), ``tag``, ``dep`` and ``lemma``. White space is no token.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOMINAL_SUFFIXES = ["tion", "ness", "ment", "ity", "ism", "ance", "ence"]
PASSIVE = ["nsubjpass", "auxpass"]
#: Steps to the root are counted up to this many.
MOST_HOPS = 50


def nominal(word: Column) -> Column:
    return reduce(or_, [F.endswith(word, F.lit(s)) for s in NOMINAL_SUFFIXES])


def _depth(tokens: Column, start: Column) -> Column:
    def step(acc: Column, _: Column) -> Column:
        head = F.get(tokens, acc["at"])["head"]
        root = (head == acc["at"]) | head.isNull()
        return F.struct(F.when(root, acc["at"]).otherwise(head).alias("at"), F.when(root, acc["hops"]).otherwise(acc["hops"] + 1).alias("hops"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_HOPS)), F.struct(start.alias("at"), F.lit(0).alias("hops")), step)["hops"]


def deep_syntax(tokens: DataFrame, by: list[str]) -> DataFrame:
    """``by, avg_dependency_depth, passive_ratio, nominalization_per_1000w``: one shuffle, by sentence."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("head").cast("int").alias("head"), "tag", "dep", "lemma")))
    each = tokens.groupBy(*by, "sentence").agg(listed.alias("tokens"))
    t = F.col("tokens")
    depth = F.array_max(F.transform(t, lambda x: _depth(t, x["at"])))
    passive = F.size(F.filter(t, lambda v: (v["tag"] == "VERB") & F.exists(t, lambda c: (c["head"] == v["at"]) & (c["at"] != v["at"]) & c["dep"].isin(PASSIVE))))
    nouns = F.size(F.filter(t, lambda x: (x["tag"] == "NOUN") & nominal(x["lemma"])))
    rows = each.select(*by, depth.alias("depth"), passive.alias("passive"), nouns.alias("nouns"), F.size(t).alias("n"))
    return rows.groupBy(*by).agg(
        F.avg("depth").alias("avg_dependency_depth"), (F.sum("passive") / F.count("*")).alias("passive_ratio"), (F.sum("nouns") / F.sum("n") * 1000).alias("nominalization_per_1000w")
    )


def tag_pairs(tokens: DataFrame, by: list[str], limit: int = 20) -> DataFrame:
    """``by, rank, pos_bigram, n``: the most frequent pairs of neighbouring tags within a sentence; ties go to the pair
    that occurs first."""
    following = F.lead("tag").over(Window.partitionBy(*by, "sentence").orderBy("at"))
    pairs = tokens.select(*by, "sentence", "at", F.concat_ws("+", "tag", following).alias("pos_bigram"), following.isNotNull().alias("__both")).where("__both")
    counted = pairs.groupBy(*by, "pos_bigram").agg(F.count("*").alias("n"), F.min(F.struct("sentence", "at")).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "__first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit).select(*by, "rank", "pos_bigram", "n")
