"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint has 128 bits: the sign, bit by bit, of the sum over its distinct normalised words. Two texts are
near duplicates when their fingerprints differ in at most ``RADIUS`` bits, and a group is a connected component of
that relation. Texts of one fingerprint are one class, and only classes are compared. The bits form segments, so within
the radius at least one of m segments differs in at most radius // m bits: every table match of the ball of that radius
around each segment is fetched, and the whole distance verified. The search is exact for the radius; nothing is capped.

``plan`` takes the number of segments of least work for the number of fingerprints: more of them call for wider segments,
whose tables hold fewer by chance, with larger balls. A fingerprint then costs m balls of lookups and as many comparisons
as chance puts there. For radius 21 that is about 3,000 for 230,000 fingerprints, 37,000 for 14 million and 940,000 for
a billion, all of them the power 1.6 of the number, as the ball of so large a radius grows with the segment; for radius 11
it is 140, 500, 2,400, and 14,000 for 5e10 (power 1.4). Corpora of billions of texts should be given the smaller ``radius``.

A pair is counted at the first of its segments that match, so each link counts once, and no cell hands on more edges
than it has fingerprints.

Defined cases: a null, empty or blank text has no fingerprint and belongs to no group; texts with equal words (in any
order, case or end punctuation) have equal fingerprints and share a group; the kept member is the smallest id; rows with
one id are one document, that of the least fingerprint; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialise, shuffle_partitions, sized_hint, unused
from .text import Words, bounds, mix64, slices, sum_runs

BITS = 128
RADIUS = 21
#: Fingerprints that one table cell holds, about; the number of cells follows the data.
CELL_ROWS = 100_000
#: Pairs compared at once.
_TILE = 1 << 20
#: Tables of segments up to so many bits are addressed directly.
_DIRECT = 22


class Plan:
    """Segments of the fingerprint: their first bits and widths, and the radius of the ball around each."""

    def __init__(self, segments: int, radius: int):
        self.radius, self.segments, self.ball = radius, segments, radius // segments
        self.width = [BITS // segments + (i < BITS % segments) for i in range(segments)]
        self.start = [sum(self.width[:i]) for i in range(segments)]

    def work(self, rows: int) -> float:
        """Lookups and comparisons a fingerprint, on average."""
        return sum(sum(comb(w, j) for j in range(self.ball + 1)) * (1 + rows / 2 ** (w + 1)) for w in self.width)


def plan(rows: int, radius: int = RADIUS) -> Plan:
    """The segments of least work for so many fingerprints."""
    return min((Plan(m, radius) for m in range(2, 25)), key=lambda p: p.work(rows))


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low 64 bits of each text's fingerprint, and whether it has one."""
    words = Words(texts)
    row, term, _, hashes = words.terms()
    starts = bounds(row, words.rows)
    bits = np.unpackbits(np.stack([hashes, mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8), axis=1)
    lanes = np.ascontiguousarray(bits).view(np.uint64)  # 16 words of eight byte-wide counters
    # byte counters hold 255 terms, so longer rows are summed in pieces
    position = np.arange(len(row)) - starts[row]
    piece = np.flatnonzero(position % 255 == 0)
    sums = np.add.reduceat(lanes[term], piece, axis=0) if len(piece) else np.zeros((0, 16), np.uint64)
    ones = sum_runs(np.ascontiguousarray(sums).view(np.uint8), bounds(row[piece], words.rows))
    count = np.diff(starts)
    packed = np.packbits(ones * 2 > count[:, None], axis=1).view(np.uint64)
    return packed[:, 0].copy(), packed[:, 1].copy(), count > 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            high, low, known = fingerprint(part.column("text"))
            ids = np.asarray(part.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(high[known].view(np.int64)), pa.array(low[known].view(np.int64))], ["doc_id", "high", "low"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, high, low`` of every text that has a word; rows without an id are ignored."""
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_fingerprints, "doc_id long, high long, low long")


def segment(high: np.ndarray, low: np.ndarray, at: int, width: int) -> np.ndarray:
    """``width`` bits from bit ``at`` on; bit 0 is the lowest bit of ``low``."""
    if at >= 64:
        value = high >> np.uint64(at - 64)
    elif at + width <= 64:
        value = low >> np.uint64(at)
    else:
        value = (low >> np.uint64(at)) | (high << np.uint64(64 - at))
    return value & np.uint64((1 << width) - 1)


@cache
def _masks(bits: int, most: int) -> list[int]:
    """Numbers of ``bits`` bits with 1 to ``most`` of them set."""
    return [sum(1 << i for i in c) for n in range(1, min(bits, most) + 1) for c in combinations(range(bits), n)]


_RECORD = np.dtype([("id", "<i8"), ("high", "<u8"), ("low", "<u8")])


def _route(plan: Plan, prefix: int):
    """Send each fingerprint to the cell of each segment's top ``prefix`` bits, and as a visitor to those cells that differ
    by bits whose highest it has set (the pair's other member has it clear, so each pair meets once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = np.empty(batch.num_rows, _RECORD)
            records["id"] = np.asarray(batch.column("doc_id"))
            records["high"] = np.asarray(batch.column("high")).view(np.uint64)
            records["low"] = np.asarray(batch.column("low")).view(np.uint64)
            cells, own, payload = [], [], []
            for index in range(plan.segments):
                top = (segment(records["high"], records["low"], plan.start[index], plan.width[index]) >> np.uint64(plan.width[index] - prefix)).astype(np.int64)
                for mask in [0, *_masks(prefix, plan.ball)]:
                    visits = slice(None) if not mask else np.flatnonzero((top >> (mask.bit_length() - 1)) & 1)
                    chosen, key = records[visits], top[visits] ^ mask
                    order = np.argsort(key, kind="stable")
                    chosen, key = chosen[order], key[order]
                    edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        cells.append((index << prefix) + int(key[a]))
                        own.append(not mask)
                        payload.append(chosen[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(own, pa.bool_()), pa.array(payload, pa.binary())], ["cell", "own", "payload"])

    return run


def _expand(x_at: np.ndarray, x_n: np.ndarray, y_at: np.ndarray, y_n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the runs ``x_at .. x_at+x_n`` and ``y_at .. y_at+y_n``, run by run, about ``_TILE`` at once."""
    # each x with its run of y
    run = np.repeat(np.arange(len(x_n)), x_n)
    x = np.arange(len(run)) + (x_at - np.cumsum(x_n) + x_n)[run]
    at, n = y_at[run], y_n[run]
    upto = np.cumsum(n)
    lo = 0
    while lo < len(run):
        before = int(upto[lo] - n[lo])
        hi = max(lo + 1, int(np.searchsorted(upto, before + _TILE, side="right")))
        some = n[lo:hi]
        yield np.repeat(x[lo:hi], some), np.arange(int(upto[hi - 1]) - before) + np.repeat(at[lo:hi] - (upto[lo:hi] - some - before), some)
        lo = hi


def link(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (each node's least node of its component) after joining x to y."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


class Cell:
    """The fingerprints of one cell of one segment's table, by id, with their links there."""

    def __init__(self, plan: Plan, index: int, prefix: int, own: np.ndarray, visitors: np.ndarray):
        self.plan, self.index = plan, index
        self.compared = self.looked_up = 0
        records = np.concatenate([own, visitors])
        order = np.argsort(records["id"], kind="stable")
        self.ids, self.high, self.low = (np.ascontiguousarray(records[c][order]) for c in ("id", "high", "low"))
        value = segment(self.high, self.low, plan.start[index], plan.width[index]).astype(np.int64)
        rest = plan.width[index] - prefix
        bottom, top = value & ((1 << rest) - 1), value >> rest
        mine = np.empty(len(records), bool)
        mine[:] = (order < len(own))
        here = int(top[mine][0]) if mine.any() else -1
        self.links = np.zeros(len(records), np.int64)
        self.root = np.arange(len(records))
        self.rest = rest
        # runs of equal values among the cell's own
        self.order, self.value, self.at, self.n = self._runs(np.flatnonzero(mine), bottom)
        self.sorted_high = self.high[self.order]
        self.slot = None
        if rest <= _DIRECT:
            self.slot = np.full(1 << rest, -1, np.int32)
            self.slot[self.value] = np.arange(len(self.value))
        self._meet(self.order, self.value, self.at, self.n, plan.ball, True)
        away = np.bitwise_count((top ^ here).astype(np.uint64))
        for far in range(1, plan.ball + 1):
            some = np.flatnonzero(~mine & (away == far))
            if len(some):
                self._meet(*self._runs(some, bottom), plan.ball - far, False)

    @staticmethod
    def _runs(some: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = some[np.argsort(bottom[some], kind="stable")]
        value, at = np.unique(bottom[order], return_index=True)
        return order, value, at, np.diff(np.append(at, len(order)))

    def _find(self, value: np.ndarray) -> np.ndarray:
        """Run of the cell's own with each value, or -1."""
        self.looked_up += len(value)
        if self.slot is not None:
            return self.slot[value]
        if not len(self.value):
            return np.full(len(value), -1)
        slot = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        return np.where(self.value[slot] == value, slot, -1)

    def _meet(self, order: np.ndarray, value: np.ndarray, at: np.ndarray, n: np.ndarray, ball: int, same: bool) -> None:
        """Compare runs with the cell's own whose value is within ``ball`` bits; of a pair among the cell's own, the one
        with the highest differing bit set comes to the other."""
        high = self.high[order]
        for mask in [0, *_masks(self.rest, ball)]:
            if mask and same:
                come = np.flatnonzero((value >> (mask.bit_length() - 1)) & 1)
            else:
                come = np.arange(len(value))
            to = self._find(value[come] ^ mask)
            come, to = come[to >= 0], to[to >= 0]
            for x, y in _expand(at[come], n[come], self.at[to], self.n[to]):
                if same and not mask:
                    keep = x < y
                    x, y = x[keep], y[keep]
                self.compared += len(x)
                near = np.flatnonzero(np.bitwise_count(high[x] ^ self.sorted_high[y]) <= self.plan.radius)
                if len(near):
                    self._verify(order[x[near]], self.order[y[near]])

    def _verify(self, x: np.ndarray, y: np.ndarray) -> None:
        high, low = self.high[x] ^ self.high[y], self.low[x] ^ self.low[y]
        near = np.flatnonzero(np.bitwise_count(high) + np.bitwise_count(low) <= self.plan.radius)
        if not len(near):
            return
        x, y, high, low = x[near], y[near], high[near], low[near]
        first = np.ones(len(x), bool)
        for i in range(self.index):
            first &= np.bitwise_count(segment(high, low, self.plan.start[i], self.plan.width[i])) > self.plan.ball
        x, y = x[first], y[first]
        self.links += np.bincount(x, minlength=len(self.links)) + np.bincount(y, minlength=len(self.links))
        self.root = link(self.root, x, y)


def _match(plan: Plan, prefix: int):
    """``node, root, n``: the fingerprints that have links in a cell, the least id they hang together with there, and the
    number of links that are counted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for cell, own, payload in zip(*(batch.column(c).to_pylist() for c in ("cell", "own", "payload"))):
                cells.setdefault(cell, ([], []))[0 if own else 1].append(payload)
        for number in sorted(cells):
            cell = Cell(plan, number >> prefix, prefix, *(np.frombuffer(b"".join(x), _RECORD) for x in cells.pop(number)))
            some = np.flatnonzero(cell.links)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[some]), pa.array(cell.ids[cell.root[some]]), pa.array(cell.links[some])], ["node", "root", "n"])

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` other than the roots; the root is the component's smallest id.

    Alternating large-star and small-star rounds. A node's least neighbour is a partial aggregate that is joined back, so
    a hub's edges needn't be in one task; each round is written to the shared folder, so a lost executor repeats one
    round at most.
    """
    current = materialise(edges.where("a <> b").distinct())
    state = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        before, current = current, materialise(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a <> b").distinct())
        discard(before)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, kept_doc_id, n_links``: one row for each document that a smaller id of its group stands for; ``n_links``
    is the number of other fingerprints within the radius of its own. What isn't listed stands for itself."""
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs).groupBy("doc_id").agg(F.min(F.struct("high", "low")).alias("p")).select("doc_id", "p.*"))
    classes = materialise(prints.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    rows = classes.count()
    chosen = plan(rows, radius)
    prefix = min(max(0, int(np.ceil(np.log2(max(rows, 1) / CELL_ROWS)))), min(chosen.width))
    cells = chosen.segments << prefix
    routed = classes.mapInArrow(_route(chosen, prefix), "cell int, own boolean, payload binary")
    found = materialise(routed.repartitionById(min(cells, 4 * shuffle_partitions(spark)), "cell").mapInArrow(_match(chosen, prefix), "node long, root long, n long"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    # classes with copies or links; the others stand for themselves
    linked = links.join(roots, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("root", "node").alias("kept_doc_id"), "n_links")
    listed = classes.join(linked, "doc_id", "left").where("copies > 1 OR n_links IS NOT NULL")
    listed = materialise(listed.select("high", "low", F.coalesce("kept_doc_id", "doc_id").alias("kept_doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    discard(classes, found)
    joined = prints.join(sized_hint(listed, listed.count(), 48), ["high", "low"])
    return joined.where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id", "n_links")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without those rows that another document of their group stands for.

    Rows with a null id, or a text without words, stay. Of rows that share one id, all stay or all go.
    """
    key = unused(docs, "__gone")
    gone = materialise(near_duplicates(docs, radius).select(F.col("doc_id").alias(key)))
    return docs.join(sized_hint(gone, gone.count(), 32), F.col("doc_id") == F.col(key), "left_anti")
