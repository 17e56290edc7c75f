"""Exact nearest neighbours by columnar branch and bound.

Queries are the rows whose id is divisible by ``EVERY``; every row is a candidate. Vectors are laid out vertically, one
run of values a dimension. Candidates are cut into tiles of at most ``TILE_BYTES``, each of which one task holds, while
the queries come to it in blocks. A query brings a first bound with it: its k-th distance within a bounded sample of the
candidates. For a block of queries against a tile inner products are accumulated ``BLOCK`` dimensions at a time. After
each block the mass that remains (the norms over the dimensions not yet read) bounds every distance from below by
Cauchy-Schwarz; what exceeds the query's bound is pruned, and once fewer than half of the candidates survive they are
compacted to lists and only those go on (after de Vries et al., SIGMOD 2002). The survivors' distances are computed once
more in double precision. Each tile yields at most k rows a query, merged by a ranked window. Every answer is exact; the
work is that of the queries times the rows. Candidates are shuffled once, queries once a tile.

Defined cases: null vectors, and vectors holding a null, NaN or infinite value, are no query and no candidate; vectors of different
lengths are not compared; a vector is no neighbour of itself; rows with one id are one vector (the least); ties go to
the smaller id; fewer than k others give fewer rows; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialise, shuffle_partitions

K = 10
#: Rows whose id is a multiple of this are queries.
EVERY = 50
BLOCK = 16
#: Bytes of vectors in a tile, at most, and rows in one, at least.
TILE_BYTES = 64 << 20
TILE_ROWS = 1024
#: Candidates that give every query its first bound: so many, and no more bytes than these.
SAMPLE_ROWS = 4096
SAMPLE_BYTES = 8 << 20
#: Queries in a block.
QUERIES = 1024
#: Queries handled at once against a candidate tile.
_QUERIES = 128
#: Candidates of a tile that tighten a query's bound.
_SEED_ROWS = 1024
#: Slack on single-precision bounds, as a share of the norms.
_SLACK = 1e-5


def _tails(vertical: np.ndarray) -> np.ndarray:
    """Norm of what remains after each block, by vector: row b is over the dimensions from block b on."""
    square = (vertical.astype(float) ** 2).cumsum(0)
    total = square[-1]
    cuts = range(0, len(vertical) + BLOCK, BLOCK)
    return np.sqrt(np.maximum([total - (square[min(c, len(vertical)) - 1] if c else 0) for c in cuts], 0)).astype(np.float32)


def search(q_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, neighbour id and squared distance of those of each query's k nearest in the tile that its limit (a squared
    distance) admits; both sides dimensions-first."""
    dims = len(vertical)
    blocks = -(-dims // BLOCK)
    tails, q_tails = _tails(vertical), _tails(queries)
    norm, q_norm = tails[0] ** 2, q_tails[0] ** 2
    out = []
    for lo in range(0, queries.shape[1], _QUERIES):
        q, own = queries[:, lo : lo + _QUERIES], q_ids[lo : lo + _QUERIES]
        m = q.shape[1]
        qn, qt = q_norm[lo : lo + m], q_tails[:, lo : lo + m]
        slack = _SLACK * (qn + norm.max(initial=0)) + 1e-30
        # the bound it comes with, or the k-th distance among the first candidates
        seed = qn[:, None] + norm[:_SEED_ROWS] - 2 * (q.T @ vertical[:, :_SEED_ROWS])
        seed[own[:, None] == ids[:_SEED_ROWS]] = np.inf
        limit = (np.partition(seed, k - 1, axis=1)[:, k - 1] if seed.shape[1] >= k else np.full(m, np.inf, np.float32))
        limit = np.minimum(limit, limits[lo : lo + m]) + slack
        # blocks over all candidates, while most survive
        part = np.zeros((m, len(ids)), np.float32)
        done = 0
        while True:
            part += q[done * BLOCK : (done + 1) * BLOCK].T @ vertical[done * BLOCK : (done + 1) * BLOCK]
            done += 1
            bound = qn[:, None] + norm - 2 * (part + qt[done][:, None] * tails[done])
            alive = bound <= limit[:, None]
            if done == blocks or np.count_nonzero(alive) * 2 < alive.size:
                break
        row, col = np.nonzero(alive)
        inner = part[row, col]
        # survivors only, compacted after each block
        while done < blocks:
            step = slice(done * BLOCK, (done + 1) * BLOCK)
            for d in range(*step.indices(dims)):
                inner += q[d][row] * vertical[d][col]
            done += 1
            keep = qn[row] + norm[col] - 2 * (inner + qt[done][row] * tails[done][col]) <= limit[row]
            row, col, inner = row[keep], col[keep], inner[keep]
        keep = own[row] != ids[col]
        row, col = row[keep], col[keep]
        # exact distances of the survivors, then the k best
        exact = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            gap = q[:, r].astype(float) - vertical[:, c]
            exact[at : at + (1 << 16)] = np.add.reduce(gap * gap, axis=0)
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        out.append((own[row[best]], ids[col[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def bounds(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vertical: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th squared distance within the candidates given, infinite where they are fewer."""
    out = np.full(len(q_ids), np.inf)
    if len(ids) >= k:
        norm = (vertical.astype(float) ** 2).sum(0)
        for lo in range(0, len(q_ids), _QUERIES):
            q, own = queries[:, lo : lo + _QUERIES].astype(float), q_ids[lo : lo + _QUERIES]
            d = (q * q).sum(0)[:, None] + norm - 2 * (q.T @ vertical)
            d[own[:, None] == ids] = np.inf
            out[lo : lo + len(own)] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and vertical values of the vectors of each length."""
    values = np.asarray(batch.column("embedding").flatten(), np.float32)
    dims = np.asarray(batch.column("dims"))
    starts = np.cumsum(dims) - dims
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        if d:
            yield d, at, values[starts[at][None, :] + np.arange(d)[:, None]]


_PACKED = "tile int, base boolean, dims int, ids binary, limits binary, packed binary"
_NAMES = ["tile", "base", "dims", "ids", "limits", "packed"]
_TYPES = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], _NAMES)


def _pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one batch by tile and length, vertical."""
    for batch in batches:
        tile, ids = np.asarray(batch.column("tile")), np.asarray(batch.column("vec_id"))
        rows = []
        for d, at, vertical in _by_length(batch):
            for t in np.unique(tile[at]).tolist():
                some = np.flatnonzero(tile[at] == t)
                rows.append((t, True, d, ids[at[some]].astype("<i8").tobytes(), b"", np.ascontiguousarray(vertical[:, some]).tobytes()))
        yield _rows(rows)


def _pack_queries(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Blocks of queries with their first bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            rows = []
            for d, at, vertical in _by_length(batch):
                limits = bounds(ids[at], vertical, *sample[d], k) if d in sample else np.full(len(at), np.inf)
                for lo in range(0, len(at), QUERIES):
                    w = slice(lo, lo + QUERIES)
                    rows.append((-1, False, d, ids[at[w]].astype("<i8").tobytes(), limits[w].tobytes(), np.ascontiguousarray(vertical[:, w]).tobytes()))
            yield _rows(rows)

    return run


def _match(k: int):
    """A tile's candidates come first, and stay; the blocks of queries then pass one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunks, base = None, {}, {}
        for batch in batches:
            for t, candidates, d, ids, limits, packed in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if t != tile:
                    tile, chunks, base = t, {}, {}
                if candidates:
                    chunks.setdefault(d, []).append((ids, packed))
                    continue
                if d in chunks:
                    base[d] = _unpacked(chunks.pop(d), d)
                if d in base:
                    own = np.frombuffer(ids, "<i8")
                    columns = search(own, np.frombuffer(packed, np.float32).reshape(d, -1), np.frombuffer(limits), *base[d], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "neighbour_id", "d2"])

    return run


def _unpacked(rows: list[tuple[bytes, bytes]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(i, "<i8") for i, _ in rows])
    vertical = np.concatenate([np.frombuffer(v, np.float32).reshape(dims, -1) for _, v in rows], axis=1)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(vertical[:, order])


def _sampled(one: DataFrame, rows: int, dims: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sample by length of the vectors, chosen by hash of the id."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * max(dims, 1))))
    share = min(1.0, most / max(rows, 1))
    some = one.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).withColumn("dims", F.size("embedding")).toArrow()
    if not some.num_rows:
        return {}
    batch = some.combine_chunks().to_batches()[0]
    ids = np.asarray(batch.column("vec_id"))
    return {d: (ids[at], vertical) for d, at, vertical in _by_length(batch)}


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``vec_id, rank, neighbour_id, distance`` (Euclidean, 6 places): the k nearest of every vector whose id is divisible
    by ``every``, among all vectors."""
    spark = vectors.sparkSession
    broken = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~broken)
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    one = materialise(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    size = one.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dims"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).first()
    rows, dims, queries = size.rows, size.dims or 1, size.queries or 0
    # as many tiles as tasks, unless they would be small, or larger than a task should hold
    tiles = max(1, -(-rows * dims * 4 // TILE_BYTES), min(2 * shuffle_partitions(spark), rows // TILE_ROWS))
    placed = one.withColumn("dims", F.size("embedding"))
    base = placed.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")).mapInArrow(_pack_candidates, _PACKED)
    asked = placed.where(F.col("vec_id") % every == 0).repartition(max(1, -(-queries // QUERIES)), "vec_id")
    blocks = materialise(asked.mapInArrow(_pack_queries(_sampled(one, rows, dims), k), _PACKED))
    sent = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(*_NAMES)
    met = base.union(sent).repartitionById(tiles, "tile").sortWithinPartitions("tile", F.desc("base"))
    found = met.mapInArrow(_match(k), "vec_id long, neighbour_id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.round(F.sqrt("d2"), 6).alias("distance"))


NEAREST_SQL = f"""
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id,
    list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
  FROM embeddings a JOIN embeddings b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour_id) AS rank FROM pairs
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(sqrt(d2), 6) AS distance FROM ranked WHERE rank <= {K}
"""
