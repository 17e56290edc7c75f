"""Document fingerprints by consistent weighted sampling.

A text is its bag of normalised words, each weighted by its count. For every one of ``SAMPLES`` positions each word
draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its hash; with t = floor(ln w / r + b) and ln a = ln c - r (t + 1 -
b) the word of least a gives the sample (word, t), stored as 32 hash bits. Two texts agree at a position with
probability sum(min) / sum(max) of their weights: the generalised Jaccard similarity (Ioffe, ICDM 2010).

One pass, no shuffle: rows go through in Arrow batches, and a word's draws are kept in a bounded table per worker.

Defined cases: a null, empty or blank text has a null signature; equal bags have equal signatures; ties of a (equal
hashes) fall to the first word by hash; rows are neither merged nor dropped; an empty table stays empty; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, bounds, mix64, slices

SAMPLES = 64
SEED = 0x5EED
#: Words whose draws a worker keeps, at 12 bytes a sample.
KEPT_WORDS = 1 << 16
#: Draws made or compared at once.
_BLOCK = 1 << 11


def _uniform(hashes: np.ndarray, samples: int, stream: int) -> np.ndarray:
    """Uniforms in (0, 1) for each hash and sample, one independent stream a purpose."""
    step = (np.arange(samples, dtype=np.uint64) + np.uint64(1 + samples * stream)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)
    bits = mix64(hashes[:, None] ^ mix64(step)[None, :])
    return ((bits >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)


def draws(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """r, ln c and b of each word: shape (words, 3, samples)."""
    out = np.empty((len(hashes), 3, samples), np.float32)
    u = [_uniform(hashes, samples, i) for i in range(5)]
    out[:, 0] = -np.log(u[0] * u[1])
    out[:, 1] = np.log(-np.log(u[2] * u[3]))
    out[:, 2] = u[4]
    return out


class _Drawn:
    """Draws of the words seen first, by sorted hash; others are drawn when met."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.values = np.zeros((0, 3, SAMPLES), np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), 3, SAMPLES), np.float32)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        for lo in range(0, len(new), _BLOCK):
            out[new[lo : lo + _BLOCK]] = draws(hashes[new[lo : lo + _BLOCK]])
        return out

    def keep(self, hashes: np.ndarray, values: np.ndarray, often: np.ndarray) -> None:
        room = KEPT_WORDS - len(self.hashes)
        if room <= 0:
            return
        new = np.flatnonzero(~np.isin(hashes, self.hashes) & often)[:room]
        merged = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(merged)
        self.values = np.concatenate([self.values, values[new]])[order]
        self.hashes = merged[order]


def signatures(texts: pa.Array, drawn: _Drawn | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each text (int32), and whether it has one."""
    words = Words(texts)
    row, term, count, hashes = words.terms()
    starts = bounds(row, words.rows)
    known = np.diff(starts) > 0
    out = np.zeros((words.rows, SAMPLES), np.int32)
    if not len(row):
        return out, known
    drawn = drawn or _Drawn()
    used, times = np.unique(term, return_counts=True)
    if len(used) != len(hashes):
        term = np.searchsorted(used, term)
        hashes = hashes[used]
    # by hash within a row, so that ties don't depend on the batch
    by_hash = np.argsort(hashes, kind="stable")
    rank = np.empty(len(hashes), np.int64)
    rank[by_hash] = np.arange(len(hashes))
    hashes, times = hashes[by_hash], times[by_hash]
    key = row * len(hashes) + rank[term]
    order = np.argsort(key, kind="stable")
    term, count = (key % len(hashes))[order], count[order]
    # draws of all words at once where they are few, else block by block
    few = len(hashes) <= KEPT_WORDS
    values = drawn.of(hashes) if few else None
    log_weight = np.log(count).astype(np.float32)[:, None]
    texts_at = np.flatnonzero(known)
    at = 0
    while at < len(texts_at):
        # as many whole rows as make up a block, one at least
        end = max(at + 1, int(np.searchsorted(starts[texts_at], starts[texts_at[at]] + _BLOCK, side="right")) - 1)
        rows = texts_at[at:end]
        lo, hi = int(starts[rows[0]]), int(starts[rows[-1] + 1])
        local = starts[rows] - lo
        best = np.full((len(rows), SAMPLES), np.inf, np.float32)
        pick = np.zeros((len(rows), SAMPLES), np.int64)
        level = np.zeros((len(rows), SAMPLES), np.float32)
        for part in range(lo, hi, _BLOCK):
            stop = min(part + _BLOCK, hi)
            v = values[term[part:stop]] if few else drawn.of(hashes[term[part:stop]])
            t = np.floor(log_weight[part:stop] / v[:, 0] + v[:, 2])
            log_a = v[:, 1] - v[:, 0] * (t + 1 - v[:, 2])
            if len(rows) == 1:
                i = np.argmin(log_a, axis=0)[None, :]
                least = np.take_along_axis(log_a, i, 0)
            else:
                least = np.minimum.reduceat(log_a, local, axis=0)
                hit = log_a == np.repeat(least, np.diff(np.append(local, stop - part)), axis=0)
                where = np.where(hit, np.arange(stop - part, dtype=np.int32)[:, None], np.int32(1 << 30))
                i = np.minimum.reduceat(where, local, axis=0)
            less = least < best
            best = np.where(less, least, best)
            pick = np.where(less, i + part, pick)
            level = np.where(less, np.take_along_axis(t, i, 0), level)
        sample = hashes[term[pick]] ^ mix64(level.astype(np.int64).view(np.uint64) + np.uint64(SEED))
        out[rows] = mix64(sample).astype(np.uint32).view(np.int32)
        at = end
    if few:
        drawn.keep(hashes, values, times > 1)
    return out, known


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drawn = _Drawn()
    for batch in batches:
        for part in slices(batch):
            values, known = signatures(part.column("text"), drawn)
            offsets = np.arange(0, values.size + 1, SAMPLES, dtype=np.int32)
            mask = pa.array(~known)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=mask)], ["doc_id", "signature"])


def weighted_signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, signature array<int>`` of every row; null where the text has no word."""
    return docs.select("doc_id", "text").mapInArrow(_rows, "doc_id long, signature array<int>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the generalised Jaccard similarity of two signatures."""
    return float(np.mean(np.asarray(a) == np.asarray(b)))
