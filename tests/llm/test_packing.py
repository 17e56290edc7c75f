import random

import numpy as np
from pyspark.sql import functions as F

from penstroke.llm import packing as P

from .conftest import words


def pieces(df):
    return sorted(((r.window_id, r.place, r.doc_id, r.first_token, r.n_tokens) for r in df.collect()))


def whole(found, want, size):
    """Every token of every document once; windows full but for the last of each cell."""
    at = {}
    for _, _, d, first, n in found:
        at.setdefault(d, []).append((first, n))
    assert at.keys() == want.keys()
    for d, parts in at.items():
        end = 0
        for first, n in sorted(parts):
            assert first == end and n > 0
            end += n
        assert end == want[d]
    fill = {}
    for w, *_, n in found:
        fill[w] = fill.get(w, 0) + n
    for w, n in fill.items():
        assert n <= size and (n == size or w + 1 not in fill)


def test_every_token_is_packed_once(make_docs):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(words(rng, rng.choice([1, 5, 60, 400])))) for i in range(200)]
    rows += [(1000, "word " * 30_000), (1001, None), (1002, ""), (1003, " \n"), (None, "a b c"), rows[0], rows[0]]
    want = {d: len(t.split()) for d, t in rows if d is not None and t and t.split()}
    docs = make_docs(rows)
    for name in ("part", "block", "payload", "x", "n_tokens", "path"):
        docs = docs.withColumn(name, F.lit("c"))
    whole(pieces(P.pack(docs)), want, P.WINDOW)
    whole(pieces(P.pack(docs, 100)), want, 100)
    assert P.pack(make_docs([])).count() == 0 and P.pack(make_docs([(1, "one")])).count() == 1


def test_several_cells_give_the_same_guarantees(make_docs, monkeypatch):
    monkeypatch.setattr(P, "HOME_DOCS", 60)
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 40, 300))) for i in range(400)]
    whole(pieces(P.pack(make_docs(rows), 256)), {d: 40 for d, _ in rows}, 256)


def test_walk_follows_the_nearest_unvisited_neighbour():
    ids = np.array([10, 20, 30, 40, 50])
    a = np.array([10, 20, 20, 30, 40])
    b = np.array([20, 10, 30, 40, 30])
    d = np.array([1.0, 1.0, 2.0, 3.0, 3.0])
    order, path = P.walk(ids, a, b, d)
    assert order == [50, 10, 20, 30, 40] and path == [0, 1, 1, 1, 1]


def test_related_documents_share_windows(make_docs):
    rng = random.Random(4)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(8)]
    rows = [(i, " ".join(rng.choices(topics[i % 8], k=60))) for i in range(320)]
    windows = {}
    for w, _, d, _, _ in pieces(P.pack(make_docs(rows), 600)):
        windows.setdefault(w, []).append(d % 8)
    same = np.mean([max(x.count(k) for k in range(8)) / len(x) for x in windows.values()])
    assert same > 0.7
