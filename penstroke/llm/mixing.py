"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are put into shards by hash, and within shard and source, in a seeded order, cut into blocks of about
``BLOCK_TOKENS`` tokens. Each shard's budget of blocks goes to sources by highest quotients weight / (2 q + 1), a source
taking no more than its tokens make up; this gives each source an integer quota of blocks. Blocks then enter in a seeded
order until their tokens make up the quota, so that a document longer than a block counts as all the blocks it fills:
first all that fit, then, for what an oversized one left open, blocks of usual size.

Weights are given, or follow token counts to the power ``TEMPERATURE``. The budget is the largest at which every source
gets its weight to within rounding, but for scarce sources of at most ``TOLERANCE`` of the weight together: these give all
they have, and the others go on. The mixture is as large as the target allows, and a rare source doesn't limit it.

Everything but the document list itself is an aggregate by (shard, source); quotas are a window over at most as many
rows as there are blocks in a shard. The number of shards is given, or follows the number of documents, so no window grows
with the corpus.

Defined cases: a null source is a source of its own (''); a null, empty or blank text has no tokens and is never
selected, nor is a row without an id; rows with one id are one document (that of the least source and number of tokens);
repeated rows stay together; ties of quotients go to the source that comes first; an empty table gives an empty result;
further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise, sized_hint, unused

BLOCK_TOKENS = 1024
TEMPERATURE = 0.7
#: Share of the weight whose sources may be short of it.
TOLERANCE = 0.02
SEED = "7"
#: Documents a shard holds, about.
SHARD_DOCS = 50_000

_TOKEN = r"[^ \t\n\r\f\x0B]+"


def token_count(text):
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long")


def _hash(*parts):
    """32 bits of the MD5 of the parts, which any engine computes alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def blocks(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, shard, block`` of every document with tokens."""
    stats = materialise(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count("text").alias("n_tokens")).where("n_tokens > 0"))
    # one row an id, so that a repeated row neither counts twice nor is split
    one = stats.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("doc_id", "s.source", "s.n_tokens")
    shards = shards or max(1, -(-stats.count() // SHARD_DOCS))
    placed = one.withColumn("shard", F.pmod(_hash(F.lit("shard"), F.col("doc_id")), F.lit(shards)).cast("int")).withColumn("__o", _hash(F.lit("order"), F.col("doc_id")))
    before = F.sum("n_tokens").over(Window.partitionBy("shard", "source").orderBy("__o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return placed.withColumn("block", F.floor(before / F.lit(BLOCK_TOKENS)).cast("long")).drop("__o")


def quotas(cut: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``shard, source, available, quota`` in blocks of ``BLOCK_TOKENS`` tokens, for the documents of ``cut``."""
    spark = cut.sparkSession
    tokens = cut.groupBy("shard", "source").agg(F.sum("n_tokens").alias("tokens"))
    by_source = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if weights is None:
        target = by_source.select("source", F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE)).alias("weight"))
    else:
        given = spark.createDataFrame(sorted(weights.items()), "source string, weight double")
        target = by_source.join(given, "source").where("weight > 0").select("source", "weight")
    have = tokens.select("shard", "source", F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)).alias("available")).join(target, "source")
    shard = Window.partitionBy("shard")
    have = have.withColumn("__ratio", F.col("available") / F.col("weight"))
    # the scarcest sources, as far as the tolerance goes, don't set the budget
    scarce = F.sum("weight").over(shard.orderBy("__ratio", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.sum("weight").over(shard) * F.lit(TOLERANCE)
    have = have.withColumn("__scarce", scarce)
    least = F.min(F.when(~F.col("__scarce"), F.col("__ratio"))).over(shard)
    budget = F.floor(F.sum(F.when(F.col("__scarce"), F.col("available")).otherwise(0)).over(shard) + least * F.sum(F.when(~F.col("__scarce"), F.col("weight")).otherwise(0.0)).over(shard) + F.lit(1e-9))
    have = have.withColumn("__budget", budget)
    seats = have.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("available") - 1)))
    rank = F.row_number().over(shard.orderBy((F.col("weight") / (2 * F.col("q") + 1)).desc(), "source", "q"))
    won = seats.withColumn("__rank", rank).where("__rank <= __budget").groupBy("shard", "source").agg(F.count("*").alias("quota"))
    return have.join(won, ["shard", "source"], "left").select("shard", "source", "available", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))


def selected(docs: DataFrame, weights: dict[str, float] | None = None, shards: int | None = None) -> DataFrame:
    """``doc_id, source, shard, block, n_tokens`` of the documents in the mixture."""
    cut = materialise(blocks(docs, shards))
    quota = materialise(quotas(cut, weights))
    key = ["shard", "source"]
    group = Window.partitionBy(*key)
    seeded = group.orderBy("__h", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = cut.groupBy(*key, "block").agg(F.sum("n_tokens").alias("__n")).withColumn("__h", _hash(F.lit("block"), F.col("shard"), F.col("source"), F.col("block")))
    each = each.join(quota.select(*key, (F.col("quota") * BLOCK_TOKENS).alias("__want")), key)
    each = each.withColumn("__in", F.sum("__n").over(seeded) <= F.col("__want"))
    usual = F.when(~F.col("__in") & (F.col("__n") <= 2 * BLOCK_TOKENS), F.col("__n")).otherwise(0)
    each = each.withColumn("__usual", usual).withColumn("__open", F.col("__want") - F.sum(F.when(F.col("__in"), F.col("__n")).otherwise(0)).over(group))
    more = (F.col("__usual") > 0) & (2 * F.sum("__usual").over(seeded) - F.col("__n") <= 2 * F.col("__open"))
    chosen = materialise(each.withColumn("__more", more).where("__in OR __more").select(*key, "block"))
    return cut.join(sized_hint(chosen, chosen.count(), 64), [*key, "block"]).select("doc_id", "source", "shard", "block", "n_tokens")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, shards: int | None = None) -> DataFrame:
    """Those rows of ``docs`` that are in the mixture."""
    key = unused(docs, "__in")
    ids = materialise(selected(docs, weights, shards).select(F.col("doc_id").alias(key)))
    return docs.join(sized_hint(ids, ids.count(), 32), F.col("doc_id") == F.col(key), "left_semi")


def selected_sql(shards: int | None = None) -> str:
    """``selected`` over the table ``documents``, with weights by token counts."""
    number = str(shards) if shards else f"greatest(1, CAST(ceil(count(*) / {SHARD_DOCS}.0) AS BIGINT))"
    return f"""
WITH stats AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), one AS (
  SELECT doc_id, s[1] AS source, CAST(s[2] AS BIGINT) AS n_tokens FROM (SELECT doc_id, min((source, n)) AS s FROM stats WHERE n > 0 GROUP BY doc_id)
), shards AS (
  SELECT {number} AS n FROM stats WHERE n > 0
), placed AS (
  SELECT doc_id, source, n_tokens,
    CAST(CAST('0x' || left(md5('{SEED}|shard|' || doc_id), 8) AS BIGINT) % (SELECT max(n) FROM shards) AS INTEGER) AS shard,
    CAST('0x' || left(md5('{SEED}|order|' || doc_id), 8) AS BIGINT) AS o
  FROM one
), cut AS (
  SELECT doc_id, source, shard, n_tokens,
    CAST(floor((sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens) / {BLOCK_TOKENS}) AS BIGINT) AS block
  FROM placed
), target AS (
  SELECT source, pow(CAST(sum(n_tokens) AS DOUBLE), {TEMPERATURE}) AS weight FROM cut GROUP BY source
), have AS (
  SELECT c.shard, c.source, CAST(ceil(sum(c.n_tokens) / {BLOCK_TOKENS}.0) AS BIGINT) AS available, any_value(t.weight) AS weight
  FROM cut c JOIN target t ON c.source = t.source GROUP BY c.shard, c.source
), marked AS (
  SELECT *, sum(weight) OVER (PARTITION BY shard ORDER BY available / weight, source ROWS UNBOUNDED PRECEDING) <= sum(weight) OVER (PARTITION BY shard) * {TOLERANCE} AS scarce
  FROM have
), budget AS (
  SELECT shard, floor(coalesce(sum(available) FILTER (WHERE scarce), 0) + min(available / weight) FILTER (WHERE NOT scarce) * sum(weight) FILTER (WHERE NOT scarce) + 1e-9) AS total
  FROM marked GROUP BY shard
), seats AS (
  SELECT h.shard, h.source, row_number() OVER (PARTITION BY h.shard ORDER BY h.weight / (2 * q + 1) DESC, h.source, q) AS r
  FROM have h, unnest(range(h.available)) AS u(q)
), quota AS (
  SELECT s.shard, s.source, count(*) * {BLOCK_TOKENS} AS want FROM seats s JOIN budget b ON s.shard = b.shard WHERE s.r <= b.total GROUP BY s.shard, s.source
), each AS (
  SELECT c.shard, c.source, c.block, sum(c.n_tokens) AS n, any_value(q.want) AS want,
    CAST('0x' || left(md5('{SEED}|block|' || c.shard || '|' || c.source || '|' || c.block), 8) AS BIGINT) AS h
  FROM cut c JOIN quota q ON c.shard = q.shard AND c.source = q.source GROUP BY c.shard, c.source, c.block
), fitting AS (
  SELECT *, sum(n) OVER (PARTITION BY shard, source ORDER BY h, block ROWS UNBOUNDED PRECEDING) <= want AS fits FROM each
), rest AS (
  SELECT *, CASE WHEN NOT fits AND n <= {2 * BLOCK_TOKENS} THEN n ELSE 0 END AS usual,
    want - coalesce(sum(n) FILTER (WHERE fits) OVER (PARTITION BY shard, source), 0) AS open
  FROM fitting
), chosen AS (
  SELECT *, usual > 0 AND 2 * sum(usual) OVER (PARTITION BY shard, source ORDER BY h, block ROWS UNBOUNDED PRECEDING) - n <= 2 * open AS more FROM rest
)
SELECT c.doc_id, c.source, c.shard, c.block, c.n_tokens
FROM cut c JOIN chosen r ON c.shard = r.shard AND c.source = r.source AND c.block = r.block WHERE r.fits OR r.more
"""


SELECTED_SQL = selected_sql()
