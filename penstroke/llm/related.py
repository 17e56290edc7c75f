"""The documents nearest to each document by the cosine of their tf-idf word vectors, and one order along the graph.

Texts with equal bags of words form a class, which is one node of the graph: copies are neither compared nor gathered
in one place. A node's vector holds log count times idf of every distinct word (24-bit hash), at unit length; document
frequencies are counted over all documents in ``BUCKETS`` buckets of the hash.

Nodes go to the leaves of their nearest centres (spherical k-means of a bounded sample), on ``SKETCH`` hashed dimensions or
on the ``OFTEN`` most frequent words. Where a centre stands for more than its share (there are ``MOST_CENTRES`` at most)
signs of projections split it into leaves. Every node is indexed. Leaves hold about ``LEAF`` nodes; where that loses too
many of the true neighbours of ``QUERIES`` nodes, found by comparing these with all, ``fitted`` takes the leaves and bands
of the least work that hold ``RECALL`` of them. One leaf of all with all bands is exact. So the work a node grows with the
corpus where its texts have no groups.

Bands are by a node's number of words. Pairs of the bands that ``fitted`` chose are compared by the full vectors: frequent
words as a matrix, the others by their postings. The other pairs of a leaf are summed up by rare words only, and by the full
vectors where that reaches ``HINT`` of the least cosine held; neighbours there that share few rare words are lost, which
the fit counts. Without bands, and in leaves of ``SPAN`` nodes or less, every pair is compared by the full vectors. A larger
leaf is compared tile by tile. One of more than ``PART`` is cut by hash of the id into parts, and each pair of parts meets
in a cell, so the memory of a task doesn't grow with the leaf.

Centres of about ``LEAF`` nodes that lie together form a home of about as many nodes as asked for. Each home is walked by itself; then the ends
of paths are joined over the homes of a region (``REGION`` homes that lie together), shortest edge first. Edges that leave
a region are not used: what they would have joined lies in two stretches of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import discard, materialise, shuffle_partitions
from .substrings import _batch, _by_part, _pack, _planes, _unpack, _unpack_all
from .text import Words, bounds, mix64, slices, sum_runs

#: Bits of a word's hash, and buckets of document frequencies.
WORD_BITS = 24
BUCKETS = 1 << 20
_CHUNKS = 16
SKETCH = 512
#: The most frequent words, which tell languages and kinds of text apart.
OFTEN = 256
MOST_KINDS = 6
LEAF = 1500
COPIES = 2
#: Share of the true neighbours of so many sampled nodes that leaves have to hold.
RECALL = 0.92
QUERIES = 512
#: Nodes of a leaf that meet the others of it in one task.
PART = 28_000
DENSE = 2048
SPAN = 4000
#: Bands of nodes by their number of words, and in less than one document in how many a word is rare.
BANDS = 20
RARE = 400
#: Share of the least cosine held so far from which on a pair's rare words make it a candidate.
HINT = 0.5
#: Sampled nodes a centre, and most centres; both bound the driver's memory.
SAMPLE = 16
MOST_CENTRES = 8192
ROUNDS = 5
#: Groups of centres looked into, where centres are so many that they are grouped.
PROBED = 6
#: Homes whose paths are joined at their ends, in one task.
REGION = 64
#: Copies of one class are numbered in so many parts.
SALTS = 256
#: Nodes that are routed at once, and rows compared at once.
_HELD = 4096
_ROWS = 256
#: Words of a block looked up at once, and products of postings that cost as much as the product of a column.
_TERMS = 16_384
COLUMN = 250


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each row's words, their hashes (ascending in a row) and counts (255 at most), each row's number of
    tokens, and 128 bits of its bag of words."""
    words = Words(texts)
    row, term, count, hashes = words.terms()
    starts = bounds(row, words.rows)
    full = hashes[term] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    bag = np.stack([sum_runs(mix64(full ^ np.uint64(k)).view(np.int64), starts) for k in (0x2545F491, 0xD1B54A32D192ED03)], axis=1)
    key = (row.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes[term] >> np.uint64(64 - WORD_BITS))
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    count = np.add.reduceat(count, first) if len(first) else count
    row, h = (key[first] >> np.uint64(WORD_BITS)).astype(np.int64), (key[first] & np.uint64((1 << WORD_BITS) - 1)).astype(np.uint32)
    return bounds(row, words.rows), h, np.minimum(count, 255).astype(np.uint8), np.diff(words.starts), bag


def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            starts, h, c, tokens, bag = word_counts(part.column("text"))
            keep = np.flatnonzero(tokens)
            packed = (h << np.uint32(8)) | c
            words = [packed[starts[i] : starts[i + 1]].tobytes() for i in keep]
            columns = [part.column("doc_id").take(pa.array(keep)), pa.array(tokens[keep]), pa.array(bag[keep, 0]), pa.array(bag[keep, 1]), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "bag1", "bag2", "words"])


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows, and their words with counts."""
    raw = batch.column("words").to_pylist()
    return np.array([len(r) // 4 for r in raw], np.int32), np.frombuffer(b"".join(raw), "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of this partition, in chunks of the buckets."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount((_words(batch)[1] >> 8) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total.astype(np.int32), _CHUNKS)], pa.binary())], ["chunk", "n"])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist()):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(n, np.int32).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "n"])


def inverse_frequencies(table: DataFrame, docs: int) -> np.ndarray:
    """idf by bucket, over all documents: ``BUCKETS`` numbers, whatever the corpus."""
    parts = table.select("words").mapInArrow(_frequencies, "chunk int, n binary").repartitionById(_CHUNKS, "chunk").mapInArrow(_sum_chunks, "chunk int, n binary").collect()
    found = np.zeros((_CHUNKS, BUCKETS // _CHUNKS))
    for r in parts:
        found[r.chunk] = np.frombuffer(r.n, np.int64)
    return np.log1p(docs / np.maximum(found.ravel(), 1)).astype(np.float16)


def weights(n: np.ndarray, v: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each word, every row at unit length."""
    h = v >> np.uint32(8)
    w = np.log1p((v & np.uint32(255)).astype(np.float32)) * idf[h & np.uint32(BUCKETS - 1)].astype(np.float32)
    row = np.repeat(np.arange(len(n)), n)
    return h, (w / np.sqrt(np.maximum(np.bincount(row, w * w, len(n)), 1e-12))[row]).astype(np.float32)


def sketches(n: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = mix64(h.astype(np.uint64))
    at = np.repeat(np.arange(len(n)) * SKETCH, n) + (x % np.uint64(SKETCH)).astype(np.int64)
    return np.bincount(at, np.where(x >> np.uint64(63), w, -w), len(n) * SKETCH).reshape(len(n), SKETCH).astype(np.float32)


def frequent(idf: np.ndarray) -> np.ndarray:
    """Buckets of the ``OFTEN`` most frequent words, ascending."""
    return np.sort(np.argsort(idf.astype(np.float32), kind="stable")[:OFTEN]).astype(np.uint32)


def features(n: np.ndarray, v: np.ndarray, idf: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Sketches, and the weights of the most frequent words behind them."""
    h, w = weights(n, v, idf)
    bucket = h & np.uint32(BUCKETS - 1)
    to = np.minimum(np.searchsorted(often, bucket), len(often) - 1)
    at = np.flatnonzero(often[to] == bucket)
    x = np.bincount(np.repeat(np.arange(len(n)) * OFTEN, n)[at] + to[at], w[at], len(n) * OFTEN).reshape(len(n), OFTEN)
    return np.concatenate([sketches(n, h, w), x.astype(np.float32)], axis=1)


def _sketched(idf: np.ndarray, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, v = _words(batch)
                x = features(n, v, idf, often).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("bag1"), pa.array(n), pa.array([r.tobytes() for r in x], pa.binary())], ["bag1", "n", "x"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _closest(x: np.ndarray, centres: np.ndarray, copies: int) -> np.ndarray:
    """Indices of each row's ``copies`` closest centres, closest first."""
    out = []
    for lo in range(0, len(x), 2048):
        out.append(np.argsort(-(x[lo : lo + 2048].astype(np.float32) @ centres.T), axis=1, kind="stable")[:, :copies])
    return np.concatenate(out) if out else np.zeros((0, copies), np.int64)


def _means(sample: np.ndarray, at: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of spherical k-means from the given centres; an empty one stays where it is."""
    for _ in range(rounds):
        to = _closest(sample, at, 1)[:, 0]
        order = np.argsort(to, kind="stable")
        some, first = np.unique(to[order], return_index=True)
        new = at.copy()
        new[some] = np.add.reduceat(sample[order].astype(np.float32), first, axis=0)
        at = _unit(new)
    return at


class Centres:
    """Centres, the leaves of each, and the home of each leaf."""

    def __init__(self, sample: np.ndarray, docs: int, home_docs: int, size: int = 0, copies: int = 0, kinds: int = 0):
        """With ``kinds``, so many centres by the most frequent words."""
        self.view = slice(SKETCH, None) if kinds else slice(0, SKETCH)
        size, self.copies = docs // kinds if kinds else size or LEAF, copies or COPIES
        sample = _unit(sample[:, self.view].astype(np.float32)) if kinds else sample[:, self.view]
        k = max(1, min(kinds or docs // size, MOST_CENTRES, len(sample)))
        self.at = _unit(sample[:k].astype(np.float32)) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
        self.at = _means(sample, self.at, (2 * ROUNDS if kinds else ROUNDS) if k > 1 else 0)
        for _ in range(ROUNDS if k > 1 and not kinds else 0):
            # a centre of far more than its share becomes two
            to = _closest(sample, self.at, 1)[:, 0]
            new = []
            for i in np.flatnonzero(np.bincount(to, minlength=len(self.at)) * docs > 1.5 * size * len(sample)).tolist():
                x = sample[to == i].astype(np.float32)
                side = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0] > 0
                if side.any() and not side.all() and len(self.at) + len(new) < MOST_CENTRES:
                    self.at[i] = x[side].mean(0)
                    new.append(x[~side].mean(0))
            if not new:
                break
            self.at = _unit(np.concatenate([self.at, new]))
        k = len(self.at)
        # centres in groups, so that a node is compared with far fewer than all
        self.groups = _means(self.at, self.at[:: int(k**0.5)], ROUNDS) if k > 4 * PROBED**2 else None
        self.members = [np.flatnonzero(_closest(self.at, self.groups, 1)[:, 0] == g) for g in range(len(self.groups))] if self.groups is not None else []
        near = self.closest(sample, self.copies)
        each = docs / max(len(sample), 1)
        # signs of projections: as many as make leaves of about their share, none while centres are enough; a centre may
        # be the second choice of very many
        held = np.bincount(near.ravel(), minlength=k) * each
        self.bits = np.clip(np.ceil(np.log2(np.maximum(held / (4 * size), 1))), 0, 16).astype(np.int64)
        self.planes = np.random.default_rng(17).normal(size=(sample.shape[1], int(self.bits.max(initial=0)))).astype(np.float32)
        self.shift = self.at @ self.planes
        # a leaf that is still too large is cut by hash into parts, which meet in pairs
        leaf = np.concatenate([(near[:, j] << 16) | self._signs(sample.astype(np.float32), near[:, j]) for j in range(near.shape[1])])
        value, count = np.unique(leaf, return_counts=True)
        most = min(4 * size, PART)
        self.salts = {v: int(np.ceil(n * each / most)) for v, n in zip(value.tolist(), count.tolist()) if n > 4 and n * each > 1.5 * most}
        self.first = np.concatenate(([0], np.cumsum(1 << self.bits)))
        self.plain = int(self.first[-1])
        self.salted = np.array(sorted(self.salts), np.int64)
        self.times = np.array([self.salts[v] for v in self.salted.tolist()], np.int64)
        self.extra = np.concatenate(([0], np.cumsum(self.times)))
        self.count = self.plain + int(self.extra[-1])
        self.pairs = np.concatenate(([0], np.cumsum(self.times * (self.times - 1) // 2)))
        self.cells = self.plain + int(self.pairs[-1])
        self.compared = float(((count * each) ** 2).sum())
        self._homes(np.bincount(near[:, 0], minlength=k) * each, home_docs)
        self.finer: Centres | None = None
        self.bands: Bands | None = None

    def _homes(self, share: np.ndarray, home_docs: int) -> None:
        """Homes of centres that lie together; a centre of more than one home has several of its own."""
        self.home, self.own_homes = np.zeros(len(share), np.int64), np.ones(len(share), np.int64)
        self.homes = 0
        left = [np.arange(len(share))]
        while left:
            part = left.pop()
            if len(part) == 1 or share[part].sum() <= home_docs:
                self.home[part] = self.homes
                if len(part) == 1:
                    self.own_homes[part] = max(1, int(np.ceil(share[part[0]] / (1.5 * home_docs))))
                self.homes += int(self.own_homes[part].max())
                continue
            x = self.at[part] - self.at[part].mean(0)
            side = x @ np.linalg.svd(x, full_matrices=False)[2][0]
            part = part[np.argsort(side, kind="stable")]
            cut = int(np.clip(np.searchsorted(np.cumsum(share[part]), share[part].sum() / 2), 1, len(part) - 1))
            left += [part[cut:], part[:cut]]

    def closest(self, x: np.ndarray, copies: int) -> np.ndarray:
        copies = min(copies, len(self.at))
        if self.groups is None:
            return _closest(x, self.at, copies)
        out = np.zeros((len(x), copies), np.int64)
        for lo in range(0, len(x), 2048):
            y = x[lo : lo + 2048].astype(np.float32)
            probed = _closest(y, self.groups, PROBED)
            score = np.full((len(y), copies), -np.inf, np.float32)
            best = np.zeros((len(y), copies), np.int64)
            for g, members in enumerate(self.members):
                rows = np.flatnonzero((probed == g).any(1))
                if len(rows) and len(members):
                    near = np.concatenate([score[rows], y[rows] @ self.at[members].T], axis=1)
                    which = np.concatenate([best[rows], np.broadcast_to(members, (len(rows), len(members)))], axis=1)
                    top = np.argsort(-near, axis=1, kind="stable")[:, :copies]
                    score[rows], best[rows] = np.take_along_axis(near, top, 1), np.take_along_axis(which, top, 1)
            out[lo : lo + 2048] = best
        return out

    def _signs(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        if not self.planes.shape[1]:
            return np.zeros(len(x), np.int64)
        used = np.arange(self.planes.shape[1]) < self.bits[to][:, None]
        return (((x @ self.planes > self.shift[to]) & used) << np.arange(self.planes.shape[1])).sum(1)

    def with_homes_of(self, other: Centres) -> Centres:
        if other is not self:
            self.finer, self.home, self.own_homes, self.homes = other, other.home, other.own_homes, other.homes
        return self

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaves of each node, nearest first, before they are cut into parts."""
        x = x[:, self.view]
        near = self.closest(x, self.copies)
        return np.stack([(near[:, j] << 16) | self._signs(x, near[:, j]) for j in range(near.shape[1])], axis=1)

    def meet(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells to which nodes of the given parts go: index of the node, cell, and side there. An uncut leaf is its own cell.
        The parts of one that is cut meet in pairs; the lower is on side 0 or 1, the other on 2 or 3. Nodes on an even side
        are compared among each other too; each part is on one such side only."""
        own = np.flatnonzero(part < self.plain)
        at, cell, side = [own], [part[own]], [np.zeros(len(own), np.int64)]
        cut = part - self.plain
        slot = np.searchsorted(self.extra, cut, side="right") - 1
        for i in np.unique(slot[cut >= 0]).tolist():
            some, m = np.flatnonzero((slot == i) & (cut >= 0)), int(self.times[i])
            s = cut[some] - self.extra[i]
            for step in range(1, m):
                t = (s + step) % m
                low, high = np.minimum(s, t), np.maximum(s, t)
                at.append(some)
                cell.append(self.plain + self.pairs[i] + low * (2 * m - low - 1) // 2 + high - low - 1)
                side.append(2 * (s > t) + (step > 1))
        return np.concatenate(at), np.concatenate(cell), np.concatenate(side)

    def route(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of each node, or its parts of them, nearest first, and its home."""
        full, x = x, x[:, self.view]
        cells = self.closest(x, self.copies)
        salt = mix64(ids.view(np.uint64) ^ np.uint64(0x5A17))
        leaves = np.zeros(cells.shape, np.int64)
        for j in range(cells.shape[1]):
            to = cells[:, j]
            signs = self._signs(x, to)
            leaf = self.first[to] + signs
            if len(self.salted):
                key = (to << 16) | signs
                slot = np.minimum(np.searchsorted(self.salted, key), len(self.salted) - 1)
                hot = np.flatnonzero(self.salted[slot] == key)
                leaf[hot] = self.plain + self.extra[slot[hot]] + (salt[hot] % self.times[slot[hot]].astype(np.uint64)).astype(np.int64)
            leaves[:, j] = leaf
        to = self.finer.closest(full[:, self.finer.view], 1)[:, 0] if self.finer else cells[:, 0]
        return leaves, (self.home[to] + (salt % self.own_homes[to].astype(np.uint64)).astype(np.int64)).astype(np.int32)


def _best_of(count: int, query: np.ndarray, bag: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of the ``count`` highest of each query, a bag once."""
    order = np.lexsort((-score, bag, query))
    order = order[np.concatenate(([True], (np.diff(query[order]) != 0) | (np.diff(bag[order]) != 0)))] if len(order) else order
    order = order[np.lexsort((bag[order], -score[order], query[order]))]
    return order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < count]


_SCORED = "query int, bag long, score float"


def _scored(n: np.ndarray, v: np.ndarray, bags: np.ndarray, idf: np.ndarray, count: int):
    """The nodes nearest to each query, of all in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Tile(n, *weights(n, v, idf))
        best = [np.zeros(0, t) for t in (np.int32, np.int64, np.float32)]
        for batch in batches:
            bag, first = np.unique(np.asarray(batch.column("bag1")), return_index=True)
            m, u = _words(batch.take(pa.array(first)))
            for lo, (part, words) in zip(range(0, len(m), SPAN // 2), _runs(m, u, SPAN // 2)):
                g = cross(queries, Tile(part, *weights(part, words, idf)))
                own = bag[lo : lo + len(part)]
                g[bags[:, None] == own] = -1
                near = np.argsort(-g, axis=1, kind="stable")[:, :count]
                new = (np.repeat(np.arange(len(n), dtype=np.int32), near.shape[1]), own[near.ravel()], np.take_along_axis(g, near, 1).ravel())
                best = [np.concatenate(c) for c in zip(best, new)]
                keep = _best_of(count, *best)
                best = [c[keep] for c in best]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query", "bag", "score"])

    return run


def true_neighbours(table: DataFrame, idf: np.ndarray, queries: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of the ``count`` nodes nearest to each of the queries, by comparing these with all; whose they are, their
    numbers of words, and whether the rare words alone hint at them."""
    batch = queries.combine_chunks().to_batches()[0]
    found = table.select("bag1", "words").mapInArrow(_scored(*_words(batch), np.asarray(batch.column("bag1")), idf, count), _SCORED).toArrow()
    query, bag, score = (np.asarray(found.column(c)) for c in ("query", "bag", "score"))
    keep = _best_of(count, query, bag, score)
    keep = keep[score[keep] > 0]
    query, bag, score = query[keep], bag[keep], score[keep]
    few = table.where(F.col("bag1").isin(np.unique(bag).tolist())).groupBy("bag1").agg(F.max("words").alias("words")).toArrow()
    if not few.num_rows:
        return np.zeros((0, SKETCH + OFTEN), np.float32), query, np.zeros(0, np.int32), np.zeros(0, bool)
    own = np.asarray(few.column("bag1"))
    order = np.argsort(own)
    few = few.combine_chunks().to_batches()[0].take(pa.array(order[np.searchsorted(own[order], bag)]))
    m, u = _words(few)
    often = frequent(idf)
    x = np.concatenate([features(k, z, idf, often) for k, z in _runs(m, u, 1024)])
    worst = np.full(batch.num_rows, np.inf, np.float32)
    np.minimum.at(worst, query, score)
    n, v = _words(batch.take(pa.array(query)))
    h, w = weights(n, v, idf)
    partial = pair_cosines(n, h, np.where(rare(h, idf), w, 0), m, *weights(m, u, idf))
    return x, query, m, partial >= HINT * worst[query]


def fitted(sample: np.ndarray, sizes: np.ndarray, docs: int, home_docs: int, queries: np.ndarray, own: np.ndarray, near: np.ndarray, of: np.ndarray, size_of: np.ndarray, hint: np.ndarray) -> Centres:
    """Centres and bands of the least work that hold ``RECALL`` of the true neighbours ``near`` of the queries ``of``. Bands
    are chosen by one half of the queries and have to hold it of the other's too. ``sizes``, ``own`` and ``size_of``: numbers
    of words of the sample, the queries and the neighbours; ``hint``: the neighbours that rare words find."""
    fine = Centres(sample, docs, home_docs)

    def holds(at: Centres) -> np.ndarray:
        x, y = at.leaves(queries)[of], at.leaves(near)
        return (x[:, :, None] == y[:, None, :]).any((1, 2))

    if not len(of) or holds(fine).mean() >= RECALL:
        return fine
    bands = Bands(np.unique(np.quantile(sizes, np.arange(1, BANDS) / BANDS)), np.ones((1, 1), bool))
    n = len(bands.edges) + 1
    at = bands.of(sizes)
    mean, share = np.bincount(at, sizes, n) / np.maximum(np.bincount(at, minlength=n), 1), np.bincount(at, minlength=n) / len(sizes)
    # nanoseconds a pair, as measured: fixed, matrix, postings; by rare words
    words = np.outer(mean, mean)
    whole, part = 6 + np.minimum(105, 1.2e-3 * words) + 2e-4 * words, 6 + 2e-5 * words
    pairs, i, j = np.outer(share, share), bands.of(own[of]), bands.of(size_of)
    low, high = np.minimum(i, j), np.maximum(i, j)
    low_of, high_of = np.triu_indices(n)
    chosen = of % 2 == 0
    best, least = Centres(sample, docs, home_docs, docs, 1), np.inf
    size = 2 * LEAF
    options = [best, *(Centres(sample, docs, home_docs, copies=1, kinds=k) for k in range(2, MOST_KINDS + 1))]
    while size < docs:
        options += [Centres(sample, docs, home_docs, size, copies) for copies in range(1, COPIES + 1)]
        size *= 2
    for option in options:
        shared = holds(option)
        gain = np.zeros((n, n))
        np.add.at(gain, (low, high), chosen & shared & ~hint)
        even = (gain + gain.T) / 2
        # what bands of as many neighbours would share by chance, for those that the sample says little about
        even = even + np.outer(even.sum(1), even.sum(0)) / max(even.sum(), 1) + 1e-9
        order = np.argsort(-(even / (whole - part) / pairs.clip(1e-9))[low_of, high_of], kind="stable")
        turn = np.empty((n, n), np.int64)
        turn[low_of[order], high_of[order]] = np.arange(len(order))
        needed = np.where(hint, -1, turn[low, high])
        found = [np.sort(needed[shared & half]) for half in (chosen, ~chosen)]
        most = [int(np.ceil(RECALL * half.sum())) for half in (chosen, ~chosen)]
        if any(len(f) < m for f, m in zip(found, most)):
            continue
        last = max(f[m - 1] if m else -1 for f, m in zip(found, most))
        wanted = np.zeros((n, n), bool)
        wanted[low_of[order[: last + 1]], high_of[order[: last + 1]]] = True
        wanted |= wanted.T
        work = option.compared * float((pairs * np.where(wanted, whole, part)).sum()) / 2 + docs * option.copies * 2e5
        if work < least:
            best, least, best.bands = option, work, None
            best.bands = Bands(bands.edges, wanted)
    return best.with_homes_of(fine)


def centres(table: DataFrame, idf: np.ndarray, docs: int, home_docs: int, count: int = 6) -> Centres:
    """From a sample by the hash of the bag, so the same whatever the partitions, and of different bags."""
    want = SAMPLE * max(1, min(docs // LEAF, MOST_CENTRES))
    share = min(1.0, (1.2 * want + 1.2 * QUERIES) / max(docs, 1))
    few = table.where(F.pmod(F.xxhash64("bag1"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).groupBy("bag1").agg(F.max("words").alias("words"))
    found = few.mapInArrow(_sketched(idf, frequent(idf)), "bag1 long, n int, x binary").toArrow()
    bag, n = np.asarray(found.column("bag1")), np.asarray(found.column("n"))
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, SKETCH + OFTEN)
    order = np.argsort(mix64(bag.astype(np.uint64)), kind="stable")
    if docs < 2 * LEAF:
        return Centres(x[order], docs, home_docs)
    # queries from the end of the order, since the first are the initial centres
    chosen = order[-QUERIES:]
    asked = table.where(F.col("bag1").isin(bag[chosen].tolist())).groupBy("bag1").agg(F.max("words").alias("words")).toArrow()
    place = {b: i for i, b in enumerate(bag.tolist())}
    own = [place[b] for b in asked.column("bag1").to_pylist()]
    return fitted(x[order], n[order], docs, home_docs, x[own].astype(np.float32), n[own], *true_neighbours(table, idf, asked, count))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROUTED = "part int, side int, head binary, words binary"
PACKED = "part int, block boolean, payload binary"


def route(at: Centres, idf: np.ndarray):
    """Nodes with their word vectors to their leaves."""
    often = frequent(idf)

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, tokens, copies = (np.asarray(batch.column(c)) for c in ("doc_id", "all_tokens", "n_copies"))
        n, v = _words(batch)
        starts = np.cumsum(n) - n
        leaves, home = at.route(np.concatenate([features(m, u, idf, often) for m, u in _runs(n, v, 1024)]), ids)
        at_, cell, side = at.meet(leaves.ravel())
        # told to its home once: by its nearest leaf, where its part is compared within
        own = (at_ % leaves.shape[1] == 0) & (side % 2 == 0)
        key = cell * 4 + side
        order = np.argsort(key, kind="stable")
        d, own, key = at_[order] // leaves.shape[1], own[order], key[order]
        end = np.cumsum(n[d], dtype=np.int64)
        edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        rows = []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            w = slice(x, y)
            begin = end[x] - n[d[x]]
            body = v[np.repeat(starts[d[w]] - end[w] + n[d[w]], n[d[w]]) + np.arange(begin, end[y - 1])]
            head = _pack(ids[d[w]], np.where(own[w], tokens[d[w]], 0), np.where(own[w], copies[d[w]], 0), home[d[w]], np.where(own[w], n[d[w]], -n[d[w]]).astype(np.int32))
            rows.append((int(key[x]) >> 2, int(key[x]) & 3, head, squeeze(body)))
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "side", "head", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= _HELD:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def squeeze(v: np.ndarray) -> bytes:
    """Words with counts as planes of differences, which take about half in the shuffle; rows are ascending."""
    h = v >> np.uint32(8)
    return _planes((np.diff(h, prepend=np.uint32(0)) << np.uint32(8)) | (v & np.uint32(255)))


def unsqueeze(raw: bytes) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return (np.cumsum(v >> np.uint32(8), dtype=np.uint32) << np.uint32(8)) | (v & np.uint32(255))


def _runs(n: np.ndarray, v: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.concatenate(([0], np.cumsum(n)))
    for lo in range(0, len(n), rows):
        hi = min(lo + rows, len(n))
        yield n[lo:hi], v[starts[lo] : starts[hi]]


class Tile:
    """Vectors of some nodes by word, and by row where asked for."""

    def __init__(self, n: np.ndarray, h: np.ndarray, w: np.ndarray, by_row: bool = True):
        self.docs = len(n)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort((h.astype(np.int64) << 32) | row)
        self.row, self.w, h = row[order].astype(np.int16 if len(n) < 1 << 15 else np.int32), w[order], h[order]
        first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint32(1)))
        self.word, self.start = h[first], np.append(first, len(h))
        if not by_row:
            return
        self.code = np.empty(len(h), np.int32)
        self.code[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.start))
        self.by_row, self.starts = w, np.concatenate(([0], np.cumsum(n)))

    def matrix(self, words: np.ndarray) -> np.ndarray:
        """The given words, by place, as columns."""
        times = np.diff(self.start)[words]
        at = np.repeat(self.start[words] - np.cumsum(times) + times, times) + np.arange(times.sum())
        x = np.zeros((self.docs, len(words)), np.float32)
        x[self.row[at], np.repeat(np.arange(len(words)), times)] = self.w[at]
        return x


def cross(a: Tile, b: Tile, only=None) -> np.ndarray:
    """Cosine of each node of ``a`` and each of ``b``, or the part of it by the words that ``only`` takes."""
    if not len(a.word) or not len(b.word):
        return np.zeros((a.docs, b.docs), np.float32)
    to = np.minimum(np.searchsorted(b.word, a.word), len(b.word) - 1)
    both = np.flatnonzero(b.word[to] == a.word)
    if only is not None:
        both = both[only(a.word[both])]
    meet = np.diff(a.start)[both] * np.diff(b.start)[to[both]]
    # a column of the matrices costs as much as so many products of postings
    heavy = np.argsort(-meet, kind="stable")[:DENSE]
    heavy = heavy[meet[heavy] * COLUMN > a.docs * b.docs]
    x, y = a.matrix(both[heavy]), b.matrix(to[both[heavy]])
    light = np.ones(len(both), bool)
    light[heavy] = False
    place = np.full(len(a.word), -1, np.int64)
    place[both[light]] = to[both[light]]
    times_of = np.diff(b.start)
    g = np.empty((a.docs, b.docs), np.float32)
    for lo in range(0, a.docs, _ROWS):
        hi = min(lo + _ROWS, a.docs)
        block = x[lo:hi] @ y.T
        flat = block.reshape(-1)
        c = place[a.code[a.starts[lo] : a.starts[hi]]]
        some = np.flatnonzero(c >= 0)
        c, weight = c[some], a.by_row[a.starts[lo] : a.starts[hi]][some]
        line = (np.repeat(np.arange(hi - lo), np.diff(a.starts[lo : hi + 1])) * b.docs)[some]
        for at in range(0, len(c), _TERMS):
            t = slice(at, at + _TERMS)
            times = times_of[c[t]]
            of = np.repeat(b.start[c[t]] - np.cumsum(times) + times, times)
            of += np.arange(len(of))
            np.add.at(flat, np.repeat(line[t], times) + b.row[of], np.repeat(weight[t], times) * b.w[of])
        g[lo:hi] = block
    return g


def rare(h: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[h & np.uint32(BUCKETS - 1)] >= np.float16(np.log1p(RARE))


def pair_cosines(n: np.ndarray, h: np.ndarray, w: np.ndarray, m: np.ndarray, k: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Cosine of each row of one table and the same row of another; words ascend in a row."""
    x, y = ((np.repeat(np.arange(len(c), dtype=np.int64), c) << WORD_BITS) | t for c, t in ((n, h), (m, k)))
    if not len(x) or not len(y):
        return np.zeros(len(n), np.float32)
    to = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.flatnonzero(y[to] == x)
    return np.bincount(x[both] >> WORD_BITS, w[both] * z[to[both]], len(n)).astype(np.float32)


class Bands:
    """Which bands of nodes, by their number of words, are compared by all words; the others are by their rare words, and
    by all where these hint at a neighbour."""

    def __init__(self, edges: np.ndarray, wanted: np.ndarray):
        self.edges, self.wanted = edges, wanted

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right")


class Nearest:
    """The ``count`` nearest of each node among those offered, the smaller rank first among equals."""

    def __init__(self, docs: int, count: int):
        self.at, self.d = np.full((docs, count), docs, np.int64), np.full((docs, count), np.inf, np.float32)

    def offer(self, rows: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        at, d = np.concatenate([self.at[rows], at], axis=1), np.concatenate([self.d[rows], d], axis=1)
        order = np.lexsort((at, d), axis=1)[:, : self.at.shape[1]]
        self.at[rows], self.d[rows] = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)

    def improve(self, rows: np.ndarray, others: np.ndarray, cosine: np.ndarray) -> None:
        """Offers those that are as near as the worst so far; all where there are too few."""
        k = min(self.at.shape[1], len(others))
        if np.isinf(self.d[rows, -1]).any():
            near = np.argpartition(cosine, len(others) - k, axis=1)[:, len(others) - k :]
            self.offer(rows, others[near], np.maximum(2 - 2 * np.take_along_axis(cosine, near, 1), 0))
            return
        of, at = np.nonzero(cosine >= (1 - self.d[rows, -1] / 2)[:, None])
        self.pairs(rows[of], others[at], cosine[of, at])

    def pairs(self, of: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> None:
        """Offers single pairs."""
        k = self.at.shape[1]
        d = np.maximum(2 - 2 * cosine, 0)
        order = np.lexsort((at, d, of))
        of, at, d = of[order], at[order], d[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < k
        some, to = np.unique(of[keep], return_inverse=True)
        near, far = np.full((len(some), k), len(self.at), np.int64), np.full((len(some), k), np.inf, np.float32)
        near[to, place[keep]], far[to, place[keep]] = at[keep], d[keep]
        self.offer(some, near, far)

    def hinted(self, rows: np.ndarray, partial: np.ndarray) -> np.ndarray:
        """Least partial cosine of a candidate of each row: a share of the worst so far, or what the best have."""
        least = HINT * (1 - self.d[rows, -1] / 2)
        open_ = np.flatnonzero(np.isinf(self.d[rows, -1]))
        if len(open_):
            k = min(self.at.shape[1], partial.shape[1])
            least[open_] = np.partition(partial[open_], partial.shape[1] - k, axis=1)[:, partial.shape[1] - k]
        return np.maximum(least, 1e-6)


def cell_neighbours(ids: np.ndarray, n: np.ndarray, h: np.ndarray, w: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (index, neighbour's index, squared distance of the vectors): the ``count`` nearest of each in a cell, of all."""
    if len(ids) <= SPAN:
        return _piece_neighbours(np.argsort(ids, kind="stable"), n, h, w, count)
    starts = np.concatenate(([0], np.cumsum(n)))

    def vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = _places(starts, n, r)
        return n[r], h[of], w[of]

    return tiled_neighbours(ids, vectors, count)


def _places(starts: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Words of the rows ``r``."""
    return np.repeat(starts[r] - np.cumsum(n[r]) + n[r], n[r]) + np.arange(n[r].sum())


def tiled_neighbours(ids: np.ndarray, vectors, count: int, first: int = -1, inner: tuple[bool, bool] = (True, True), bands=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, tile by tile; ``vectors`` gives those of some rows. With ``first``, nodes from there on are another part,
    and ``inner`` tells which parts are compared within. ``bands``: each node's, which are compared by all words, and
    which words are rare."""
    docs = len(ids)
    first = docs if first < 0 else first
    step = max(SPAN // 2, 1)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(docs, np.int64)
    rank[by_id] = np.arange(docs)
    band, wanted, few = bands or (np.zeros(docs, np.int64), np.ones((1, 1), bool), None)
    rows = []
    for lo, hi, within in ((0, first, inner[0]), (first, docs, inner[1])):
        some = lo + np.lexsort((ids[lo:hi], band[lo:hi]))
        for part in np.split(some, np.flatnonzero(np.diff(band[some])) + 1):
            rows += [(part[k : k + step], lo, within) for k in range(0, len(part), step)]
    best = Nearest(docs, count)
    tiles = [Tile(*vectors(r), by_row=False) for r, _, _ in rows]
    of = [int(band[r[0]]) for r, _, _ in rows]
    for (r, _, within), own in zip(rows, of):
        if within and len(r) > 1 and wanted[own, own]:
            a, b, d = _piece_neighbours(np.arange(len(r)), *vectors(r), count)
            order = np.argsort(a, kind="stable")
            best.offer(r, rank[r[b[order]]].reshape(len(r), -1), d[order].reshape(len(r), -1))

    def against(i: int, whole: bool) -> list[int]:
        """Tiles that this one meets, by all words or by rare ones."""
        _, part, within = rows[i]
        return [j for j in range(i if not whole else i + 1, len(rows)) if (part != rows[j][1] or within) and wanted[of[i], of[j]] == whole]

    for i, (r, _, _) in enumerate(rows):
        others = against(i, True)
        tile = Tile(*vectors(r)) if others else None
        for j in others:
            g, q = cross(tile, tiles[j]), rows[j][0]
            best.improve(r, rank[q], g)
            best.improve(q, rank[r], g.T)
        if few is None:
            tiles[i] = None
    for i, (r, _, _) in enumerate(rows if few is not None else ()):
        others = against(i, False)
        tile = Tile(*vectors(r)) if others else None
        for j in others:
            g, q = cross(tile, tiles[j], few), rows[j][0]
            if i == j:
                np.fill_diagonal(g, 0)
            x, y = np.nonzero((g >= best.hinted(r, g)[:, None]) | (g >= best.hinted(q, g.T)))
            if i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), _HELD):
                s, t = r[x[k : k + _HELD]], q[y[k : k + _HELD]]
                c = pair_cosines(*vectors(s), *vectors(t))
                best.pairs(np.concatenate([s, t]), rank[np.concatenate([t, s])], np.concatenate([c, c]))
        tiles[i] = None
    a, k = np.nonzero(best.at < docs)
    return a, by_id[best.at[a, k]], best.d[a, k]


def _piece_neighbours(order: np.ndarray, n: np.ndarray, h: np.ndarray, w: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = len(order)
    if docs < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    place = np.empty(docs, np.int32)
    place[order] = np.arange(docs, dtype=np.int32)
    row = np.repeat(place, n)
    # by word, rows ascending; a word of one document is only in its own vector
    sort = np.argsort((h.astype(np.int64) << 32) | row)
    h, p_row, p_w = h[sort], row[sort], w[sort]
    first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint32(1)))
    df = np.diff(np.append(first, len(h)))
    many = df > 1
    keep = np.repeat(many, df)
    p_row, p_w, df = p_row[keep], p_w[keep], df[many]
    p_start = np.concatenate(([0], np.cumsum(df)))
    code = np.repeat(np.arange(len(df), dtype=np.int32), df)
    # a column of the matrix costs as much as the postings of a word in so many documents
    heavy = np.argsort(-df, kind="stable")[:DENSE]
    heavy = heavy[df[heavy] ** 2 > 5 * docs]
    column = np.full(len(df), -1, np.int32)
    column[heavy] = np.arange(len(heavy))
    at = column[code]
    dense = at >= 0
    x = np.zeros((docs, max(len(heavy), 1)), np.float32)
    x[p_row[dense], at[dense]] = p_w[dense]
    # the other words by row, each with its place among its postings: it meets those behind it, and so each pair once
    place = np.flatnonzero(~dense)
    r_row = p_row[place]
    sort = np.argsort(r_row, kind="stable")
    place, r_row = place[sort], r_row[sort]
    behind = np.repeat(p_start[1:], df)[place] - place - 1
    r_w = p_w[place]
    del row, at, dense, code, sort
    g = np.empty((docs, docs), np.float32)
    for lo in range(0, docs, _ROWS):
        hi = min(lo + _ROWS, docs)
        block = x[lo:hi] @ x[lo:].T
        flat = block.ravel()
        begin_row, end_row = np.searchsorted(r_row, (lo, hi))
        for at in range(begin_row, end_row, _TERMS):
            t = slice(at, min(at + _TERMS, end_row))
            times = behind[t]
            to = np.repeat(place[t] + 1 - np.cumsum(times) + times, times) + np.arange(times.sum())
            np.add.at(flat, np.repeat((r_row[t].astype(np.int64) - lo) * (docs - lo) - lo, times) + p_row[to], np.repeat(r_w[t], times) * p_w[to])
        own = np.triu(block[:, : hi - lo], 1)
        block[:, : hi - lo] = own + own.T
        g[lo:hi, lo:] = block
        g[hi:, lo:hi] = block[:, hi - lo :].T
    np.fill_diagonal(g, -np.inf)
    near_x, near_y, near_d = [], [], []
    k = min(count, docs - 1)
    for lo in range(0, docs, _ROWS):
        hi = min(lo + _ROWS, docs)
        near = np.argpartition(g[lo:hi], docs - k, axis=1)[:, docs - k :]
        near_x.append(np.repeat(order[lo:hi], k))
        near_y.append(order[near.ravel()])
        near_d.append(np.maximum(2 - 2 * np.take_along_axis(g[lo:hi], near, 1).ravel(), 0).astype(np.float32))
    return np.concatenate(near_x), np.concatenate(near_y), np.concatenate(near_d)


def match(at: Centres, idf: np.ndarray, count: int):
    """Nodes, and the neighbours found in each leaf, sent to the home of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "head", "words"))):
                found.setdefault(part, []).append(tuple(row))
        batch = row = None
        for part in sorted(found):
            sides, heads, bodies = zip(*sorted(found.pop(part), key=lambda r: r[0]))
            ids, tokens, copies, home, n = _unpack_all(heads, np.int64, np.int64, np.int64, np.int32, np.int32)
            bodies = list(bodies)
            v, at_word = np.empty(sum(map(len, bodies)) // 4, np.uint32), 0
            for i, body in enumerate(bodies):
                bodies[i] = None
                v[at_word : at_word + len(body) // 4] = unsqueeze(body)
                at_word += len(body) // 4
            first = sum(int.from_bytes(x[:8], "little") for s, x in zip(sides, heads) if s < 2) if sides[-1] > 1 else -1
            inner = (sides[0] == 0, sides[-1] == 2 if sides[-1] > 1 else True)
            del heads, bodies, body
            own, n = n > 0, np.abs(n)
            yield _batch([(p, True, _pack(ids[own][w], tokens[own][w], copies[own][w])) for p, w in _by_part(home[own], at.homes)])
            if len(ids) <= SPAN and (first < 0 or all(inner)):
                a, b, d = cell_neighbours(ids, n, *weights(n, v, idf), count)
            else:
                starts = np.concatenate(([0], np.cumsum(n)))
                bands = at.bands and (at.bands.of(n), at.bands.wanted, lambda h: rare(h, idf))
                a, b, d = tiled_neighbours(ids, lambda r: (n[r], *weights(n[r], v[_places(starts, n, r)], idf)), count, first, inner, bands)
            yield _batch([(p, False, _pack(ids[a[w]], ids[b[w]], home[b[w]], d[w])) for p, w in _by_part(home[a], at.homes)])

    return run


def link(cells: np.ndarray, numbers: np.ndarray, head: np.ndarray, tail: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins paths by the edges between their ends, shortest first. Paths in their final order (indices), whether each
    is turned round, and its chain. An end is joined once; the only document of a path has two ends."""
    paths = len(head)
    ends, owner = np.concatenate([head, tail]), np.concatenate([np.arange(paths), np.arange(paths)])
    sort = np.argsort(ends, kind="stable")
    ends, owner = ends[sort], owner[sort]
    if len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low, d))
        a, b = low[order], high[order]
        p, q = owner[np.searchsorted(ends, a)].tolist(), owner[np.searchsorted(ends, b)].tolist()
    else:
        p, q = [], []
    root = list(range(paths))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    single = (head == tail).tolist()
    heads = head.tolist()
    # what follows the head (0) and the tail (1) of each path
    joined = [[-1] * paths, [-1] * paths]

    def free(i: int, doc: int) -> int:
        if single[i]:
            return 0 if joined[0][i] < 0 else 1 if joined[1][i] < 0 else -1
        side = 0 if heads[i] == doc else 1
        return side if joined[side][i] < 0 else -1

    for x, y, i, j in zip(a.tolist(), b.tolist(), p, q):
        if i == j:
            continue
        s, t = free(i, x), free(j, y)
        if s < 0 or t < 0:
            continue
        u, v = top(i), top(j)
        if u != v:
            root[u] = v
            joined[s][i], joined[t][j] = 2 * j + t, 2 * i + s
    out, turned, chain = [], [], []
    seen = bytearray(paths)
    number = -1
    for start in np.lexsort((numbers, cells)).tolist():
        if seen[start] or (joined[0][start] >= 0 and joined[1][start] >= 0):
            continue
        number += 1
        at, side = start, 0 if joined[0][start] < 0 else 1
        while True:
            seen[at] = 1
            out.append(at)
            turned.append(side)
            chain.append(number)
            then = joined[1 - side][at]
            if then < 0:
                break
            at, side = divmod(then, 2)
    return np.array(out, np.int64), np.array(turned, np.int32), np.array(chain, np.int64)


WALKED = "part int, kind int, payload binary"
_PATH = [np.int32, np.int32, np.int64, np.int64, np.int64, np.int64]
_EDGE = [np.int64, np.int64, np.float32]


def _walked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "kind", "payload"])


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[bytes]]]:
    found: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload"))):
            found.setdefault(part, {}).setdefault(kind, []).append(payload)
    return found


def _unique_pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of one edge a pair, that of the least distance, whatever the rounding in its leaves."""
    order = np.lexsort((d, b, a))
    return order[np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))] if len(order) else order


def walk_homes(walk, best, homes_count: int):
    """Paths of each home. Kind 0: its nodes along them; 1: the paths; 2: edges from an end to another home of its region,
    sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, block, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
                found.setdefault(part, ([], []))[0 if block else 1].append(payload)
        for part in sorted(found):
            nodes, edges = found.pop(part)
            ids, tokens, copies = _unpack_all(nodes, np.int64, np.int64, np.int64)
            a, b, home, d = _unpack_all(edges, np.int64, np.int64, np.int32, np.float32)
            where = np.unique(b, return_index=True)
            order = _unique_pairs(a, b, d)
            a, b, d = best(a[order], b[order], d[order])
            to = home[where[1][np.searchsorted(where[0], b)]] if len(b) else np.zeros(0, np.int32)
            order, path = (np.asarray(v, np.int64) for v in walk(ids, a, b, d))
            by_id = np.argsort(ids)
            of = by_id[np.searchsorted(ids[by_id], order)]
            tokens, copies = tokens[of], copies[of]
            first = np.flatnonzero(np.diff(path, prepend=-1))
            last = np.append(first[1:], len(path)) - 1
            head, tail = order[first], order[last]
            out = np.flatnonzero((to != part) & (to // REGION == part // REGION) & np.isin(a, np.concatenate([head, tail])))
            rows = [(part, 0, _pack(order, tokens, copies, path)), (part, 1, _pack(np.full(len(first), part, np.int32), np.arange(len(first), dtype=np.int32), head, tail, np.add.reduceat(copies, first), np.add.reduceat(tokens, first)))]
            rows += [(p, 2, _pack(a[out[w]], b[out[w]], d[out[w]])) for p, w in _by_part(to[out], homes_count)]
            yield _walked(rows)

    return run


def _both_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths, and those edges from other homes that lead to an end, to the region."""
    found = _gather(batches)
    for part in sorted(found):
        kinds = found.pop(part)
        rows = [(part // REGION, 1, p) for p in kinds.get(1, [])]
        a, b, d = _unpack_all(kinds.get(2, []), *_EDGE)
        _, _, head, tail, *_ = _unpack_all(kinds.get(1, []), *_PATH)
        keep = np.isin(b, np.concatenate([head, tail]))
        yield _walked([*rows, (part // REGION, 2, _pack(a[keep], b[keep], d[keep]))])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each home, its paths with chain, direction, first place and first token in the order of its region (kind 3);
    and the region's chains, nodes and tokens (kind 4)."""
    found = _gather(batches)
    for region in sorted(found):
        kinds = found.pop(region)
        cells, numbers, head, tail, docs, tokens = _unpack_all(kinds.get(1, []), *_PATH)
        order, turned, chain = link(cells, numbers, head, tail, *_unpack_all(kinds.get(2, []), *_EDGE))
        if len(order):
            place, token = np.cumsum(docs[order]) - docs[order], np.cumsum(tokens[order]) - tokens[order]
            total = np.array([region, chain.max() + 1, docs.sum(), tokens.sum()], np.int64)
            yield _walked([(region, 4, total.tobytes()), *((p, 3, _pack(numbers[order[w]].astype(np.int64), turned[w], chain[w], place[w], token[w])) for p, w in _by_part(cells[order], int(cells.max()) + 1))])


def _ordered(offsets: dict[int, tuple[int, int, int]]):
    """Every node's path, and its place and first token in the whole order, where its copies follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gather(batches)
        for part in sorted(found):
            kinds = found.pop(part)
            ids, tokens, copies, path = _unpack(kinds[0][0], np.int64, np.int64, np.int64, np.int64)
            number, turned, chain, place, token = _unpack_all(kinds[3], np.int64, np.int32, np.int64, np.int64, np.int64)
            chains, places, start = offsets[part // REGION]
            sort = np.argsort(number)
            turned, chain, place, token = turned[sort], chain[sort] + chains, place[sort] + places, token[sort] + start
            at = np.arange(len(ids))
            order = np.lexsort((np.where(turned[path] == 1, -at, at), path))
            ids, tokens, copies, path = ids[order], tokens[order], copies[order], path[order]
            first = np.searchsorted(path, np.arange(len(number)))[path]
            docs, before = np.cumsum(copies) - copies, np.cumsum(tokens) - tokens
            columns = [ids, chain[path], docs - docs[first] + place[path], before - before[first] + token[path]]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["rep", "path", "first", "start"])

    return run


def _pieces(size: int, fill):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, copy, path, ids, tokens, start = (np.asarray(batch.column(c)) for c in ("first", "copy", "path", "doc_id", "n_tokens", "start"))
            doc, window, lo, n = fill(tokens, size, start + copy * tokens)
            columns = [window, (first + copy)[doc], path[doc], ids[doc], lo, n]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["window_id", "place", "path", "doc_id", "first_token", "n_tokens"])

    return run


def word_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, bag1, bag2, words`` of every row with words."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return materialise(texts.mapInArrow(vectorise, "doc_id long, n_tokens long, bag1 long, bag2 long, words binary"))


def members(table: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, bag1, bag2, salt`` of every document: of rows with one id, that of most tokens counts."""
    one = table.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "bag1", "bag2")).alias("v")).select("doc_id", "v.*")
    return materialise(one.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))


def nodes(table: DataFrame, member: DataFrame) -> DataFrame:
    """``doc_id, all_tokens, n_copies, words`` of every class, under its least id; ``all_tokens``: of all its copies."""
    classes = member.groupBy("bag1", "bag2").agg(F.min("doc_id").alias("doc_id"), F.sum("n_tokens").alias("all_tokens"), F.count("*").alias("n_copies"))
    return table.groupBy("bag1", "bag2").agg(F.max("words").alias("words")).join(classes, ["bag1", "bag2"]).select("doc_id", "all_tokens", "n_copies", "words")


def copies(member: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, rep, copy`` of every document: the least id of its class, and its number within the class,
    counted in ``SALTS`` parts so that no task holds a class."""
    part = member.groupBy("bag1", "bag2", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    of_class = Window.partitionBy("bag1", "bag2")
    before = F.sum("n").over(of_class.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select("bag1", "bag2", "salt", F.coalesce(before, F.lit(0)).alias("before"), F.min("least").over(of_class).alias("rep"))
    inner = F.row_number().over(Window.partitionBy("bag1", "bag2", "salt").orderBy("doc_id")) - 1
    return member.withColumn("inner", inner).join(part, ["bag1", "bag2", "salt"]).select("doc_id", "n_tokens", "rep", (F.col("before") + F.col("inner")).alias("copy"))


def candidates(node: DataFrame, at: Centres, idf: np.ndarray, count: int) -> DataFrame:
    """Nodes and their neighbours, packed by home."""
    parts = max(1, min(at.cells, max(4 * shuffle_partitions(node.sparkSession), at.cells // 4)))
    return node.mapInArrow(route(at, idf), ROUTED).repartitionById(parts, "part").mapInArrow(match(at, idf, count), PACKED)


def windows(docs: DataFrame, size: int, count: int, home_docs: int, walk, best, fill) -> DataFrame:
    """Pieces of windows of ``size`` tokens along the joined paths."""
    table = word_table(docs)
    member = members(table)
    idf = inverse_frequencies(table, table.count())
    number = member.select("bag1", "bag2").distinct().count()
    at = centres(table, idf, number, home_docs, count)
    parts = max(1, min(at.homes, max(2 * shuffle_partitions(docs.sparkSession), at.homes // 4)))
    conf = docs.sparkSession.conf
    before = conf.get(_BATCH, None)
    # a row is some megabytes of words, and a batch is held beside a task's cell
    conf.set(_BATCH, str(8 << 20))
    try:
        walked = materialise(candidates(nodes(table, member), at, idf, count).repartitionById(parts, "part").mapInArrow(walk_homes(walk, best, at.homes), WALKED))
    finally:
        conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)
    discard(table)
    ends = walked.where("kind > 0").repartitionById(parts, "part").mapInArrow(_both_ends, WALKED)
    linked = materialise(ends.repartitionById(max(1, min(parts, -(-at.homes // REGION))), "part").mapInArrow(_link, WALKED))
    # a row a region, of some million nodes
    totals = np.array([np.frombuffer(r.payload, np.int64) for r in linked.where("kind = 4").collect()], np.int64).reshape(-1, 4)
    totals = totals[np.argsort(totals[:, 0])]
    offsets = {int(r): tuple(map(int, o)) for r, o in zip(totals[:, 0], np.cumsum(totals[:, 1:], axis=0) - totals[:, 1:])}
    order = walked.where("kind = 0").union(linked.where("kind = 3")).repartitionById(parts, "part").mapInArrow(_ordered(offsets), "rep long, path long, first long, start long")
    placed = copies(member).join(order, "rep").select("first", "copy", "path", "doc_id", "n_tokens", "start")
    return placed.mapInArrow(_pieces(size, fill), "window_id long, place long, path long, doc_id long, first_token long, n_tokens long")
