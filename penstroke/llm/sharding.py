"""Shards balanced by bytes, tokens and rows at once: vector bin packing by dot product with residual capacity.

A group is one source's documents. A group too large for fine balancing (over 1 / ``PIECES`` of a shard in any
dimension) is split by hash of the id into pieces of about that size, and the many small groups are gathered by hash
into at most ``PIECES * shards`` bundles, so the items to place are bounded by ``PIECES`` and the number of shards,
never by the data. Items go, largest first, to the shard with room at which the dot product of their load and the
shard's residual capacity (each dimension as a share of the whole) is highest.

One pass over the text makes (id, bytes, tokens); the rest works on those. The placement map is bounded, so it is
broadcast.

Defined cases: a null source is the group ''; a null text counts as 0 bytes and 0 tokens and is still placed; a row
without an id is placed with id null; ties go to the lowest shard; where no shard has room, the item goes to where the
dot product is highest all the same; repeated rows go together; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import token_count
from .runtime import materialise

SHARDS = 64
PIECES = 16
#: Capacity of a shard in each dimension, as a multiple of its even share.
SLACK = 1.02


def place(loads: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """Shard of each item; ``loads``: items by dimensions, any units."""
    total = np.maximum(loads.sum(0), 1e-300)
    share = loads / total
    residual = np.full((shards, loads.shape[1]), slack / shards)
    out = np.zeros(len(loads), np.int64)
    for item in np.lexsort((np.arange(len(loads)), -share.max(1))):
        fits = (residual >= share[item] - 1e-12).all(1)
        dot = residual @ share[item]
        out[item] = int(np.argmax(np.where(fits, dot, -np.inf) if fits.any() else dot))
        residual[out[item]] -= share[item]
    return out


_LOADS = ["n_bytes", "n_tokens", "n_rows"]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, source, n_bytes, n_tokens, shard`` of every row."""
    spark = docs.sparkSession
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    tokens = F.coalesce(token_count(F.col("text")), F.lit(0)).cast("long")
    stats = materialise(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), bytes_.alias("n_bytes"), tokens.alias("n_tokens")))
    loads = [F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    groups = materialise(stats.groupBy("source").agg(*loads))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _LOADS]).first()
    limit = {c: max(total[c], 1) / (shards * PIECES) for c in _LOADS}
    share = F.greatest(*[F.col(c) / F.lit(limit[c]) for c in _LOADS])
    # at most 3 * shards * PIECES groups can exceed the limit
    large = groups.withColumn("pieces", F.ceil(share).cast("long")).where("pieces > 1").select("source", "pieces")
    keyed = stats.join(F.broadcast(large), "source", "left").withColumn(
        "item",
        F.when(F.col("pieces").isNull(), F.concat(F.lit("~"), F.pmod(F.xxhash64("source"), F.lit(shards * PIECES)).cast("string")))
        .otherwise(F.concat(F.lit("="), F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("string"), F.lit(":"), F.col("source"))),
    )
    items = keyed.groupBy("item").agg(*loads).orderBy("item").collect()
    where = place(np.array([[r[c] for c in _LOADS] for r in items], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, where)], "item string, shard int")
    return keyed.join(F.broadcast(placed), "item").select("doc_id", "source", "n_bytes", "n_tokens", "shard")
