"""Related documents packed into the same training windows.

The graph joins every text to its ``NEIGHBOURS`` nearest by the cosine of full tf-idf word vectors, as found within the
leaves of ``related``; texts with equal bags of words are one node, whose copies stay together. Within a home of about
``HOME_DOCS`` nodes paths start at the unvisited node of least degree and go on to the nearest unvisited neighbour until
there is none (Shi et al., In-Context Pretraining, 2024); paths of different homes are joined at their ends by the edges
between homes of one region. Windows of ``WINDOW`` tokens are filled along the paths, all but the last one full, and a
document that doesn't fit continues in the next.

Defined cases: a null, empty or blank text and a row without an id have no tokens and no piece; rows with one id are
one document; where more are equally near than the graph holds, any of them are taken; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import related

NEIGHBOURS = 6
HOME_DOCS = 32_000
WINDOW = 8192


def best(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each a's ``NEIGHBOURS`` nearest b, nearest first, smaller ids first among equals."""
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    if not len(a):
        return a, b, d
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])))
    a, b, d = a[fresh], b[fresh], d[fresh]
    new = np.concatenate(([True], a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = rank < NEIGHBOURS
    return a[keep], b[keep], d[keep]


def walk(ids: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[list[int], list[int]]:
    """Order of the documents along greedy paths, and each one's path number; the edges are undirected."""
    ids = np.sort(ids)
    inside = np.isin(a, ids) & np.isin(b, ids)
    a, b, d = np.searchsorted(ids, a[inside]), np.searchsorted(ids, b[inside]), d[inside]
    x, y, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    order = np.lexsort((y, d, x))
    x, y = x[order], y[order]
    if len(x):
        _, first = np.unique(x * len(ids) + y, return_index=True)
        first.sort()
        x, y = x[first], y[first]
    degree = np.bincount(x, minlength=len(ids))
    starts = np.concatenate(([0], np.cumsum(degree))).tolist()
    near = y.tolist()
    seen = bytearray(len(ids))
    out, path, number = [], [], -1
    for start in np.lexsort((ids, degree)).tolist():
        if seen[start]:
            continue
        number += 1
        at = start
        while at >= 0:
            seen[at] = 1
            out.append(at)
            path.append(number)
            for other in near[starts[at] : starts[at + 1]]:
                if not seen[other]:
                    at = other
                    break
            else:
                at = -1
    return ids[out].tolist(), path


def fill(tokens: np.ndarray, size: int = WINDOW, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``tokens`` tokens laid end to end, or from ``start``: document, window, first token in the
    document, length."""
    start = np.cumsum(tokens) - tokens if start is None else start
    end = start + tokens
    pieces = np.where(tokens > 0, (end - 1) // size - start // size + 1, 0)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    window = start[doc] // size + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo, hi = np.maximum(start[doc], window * size), np.minimum(end[doc], (window + 1) * size)
    return doc, window, lo - start[doc], hi - lo


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window_id, place, path, doc_id, first_token, n_tokens``: every token of every document once, related ones together."""
    return related.windows(docs, window, NEIGHBOURS, HOME_DOCS, walk, best, fill)
