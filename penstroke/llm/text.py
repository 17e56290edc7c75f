"""Arrow/numpy text kernels: whole texts to word ids and hashes, one bounded slice at a time.

Everything here is deterministic across workers and runs (no salted hashing).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from penstroke.functions.batches import SLICE_BYTES, slices  # noqa: F401

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_MUL_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of uint64 with full avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand and kept for the worker's life."""

    up = _powers(1024, _MUL)
    down = _powers(1024, _MUL_INV)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(size, _MUL), _powers(size, _MUL_INV)
        return cls.up[:n], cls.down[:n]


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array without nulls."""
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hash_strings(array: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string: a polynomial over its bytes, by prefix sums modulo 2**64, then mixed."""
    data, offsets = string_parts(array)
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    start, end = offsets[:-1], offsets[1:]
    poly = (sums[end] - sums[start]) * down[start]
    return mix64(poly + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0xA0761D6478BD642F & (1 << 64) - 1))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive word hashes; element i covers i .. i+width-1."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: n - width + 1])


class Words:
    """Whitespace-separated words of a string array, dictionary-encoded.

    ``row``: the row of each word, in order; ``code``: its index in ``vocab``; ``starts``: first word of each row
    (one element more than rows). A null text has no words.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        # ascii_split treats only the six ASCII white-space bytes as separators, so U+00A0 stays inside a word
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten()
        offsets = np.asarray(parts.offsets, np.int64)
        keep = np.asarray(pc.binary_length(words), np.int64) > 0
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
        if not keep.all():
            words, row = words.filter(pa.array(keep)), row[keep]
        coded = words.dictionary_encode()
        self.row = row
        self.code = np.asarray(coded.indices, np.int32)
        self.vocab = coded.dictionary
        self.starts = np.searchsorted(row, np.arange(len(texts) + 1, dtype=np.int32)).astype(np.int64)
        self.rows = len(texts)

    def hashes(self) -> np.ndarray:
        """Hash of every word, as written."""
        return hash_strings(self.vocab)[self.code]

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct normalised words by row: row, index into ``hashes``, count, ``hashes``.

        Normalised: lower case, without punctuation at both ends; what is only punctuation keeps its form.
        """
        lowered = pc.utf8_lower(self.vocab)
        bare = pc.utf8_trim(lowered, characters=_PUNCT)
        bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), lowered, bare)
        coded = bare.dictionary_encode()
        hashes = hash_strings(coded.dictionary)
        norm = np.asarray(coded.indices, np.int64)
        n = max(len(hashes), 1)
        keys = self.row.astype(np.int64) * n + norm[self.code]
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return (keys // n).astype(np.int64), keys % n, counts, hashes


def bounds(sorted_rows: np.ndarray, rows: int) -> np.ndarray:
    """Start of each row's run in a sorted row column, one element more than rows."""
    return np.searchsorted(sorted_rows, np.arange(rows + 1))


def sum_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[i]:starts[i+1]]`` along axis 0, empty runs giving 0."""
    rows = len(starts) - 1
    out = np.zeros((rows, *values.shape[1:]), np.result_type(values.dtype, np.int32))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out
