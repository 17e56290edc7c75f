import random

import numpy as np
from pyspark.sql import functions as F

from penstroke.llm import sharding as S
from penstroke.llm.runtime import table

from .conftest import words


def greedy(loads, shards, slack):
    """Placement item by item with plain loops."""
    total = [max(sum(r[k] for r in loads), 1e-300) for k in range(3)]
    share = [[r[k] / total[k] for k in range(3)] for r in loads]
    left = [[slack / shards] * 3 for _ in range(shards)]
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-max(share[i]), i)):
        dots = [sum(a * b for a, b in zip(share[i], left[s])) for s in range(shards)]
        room = [s for s in range(shards) if all(left[s][k] >= share[i][k] - 1e-12 for k in range(3))] or list(range(shards))
        best = max(dots[s] for s in room)
        out[i] = next(s for s in room if dots[s] >= best - 1e-15)
        left[out[i]] = [a - b for a, b in zip(left[out[i]], share[i])]
    return out


def test_placement_equals_plain_loops():
    rng = np.random.default_rng(2)
    for shards in (1, 3, 8):
        loads = rng.pareto(1.5, size=(60, 3)) + 0.01
        assert S.place(loads, shards).tolist() == greedy(loads.tolist(), shards, S.SLACK)
    assert S.place(np.zeros((0, 3)), 4).tolist() == [] and S.place(np.zeros((5, 3)), 4).tolist() == greedy([[0, 0, 0]] * 5, 4, S.SLACK)


def test_shards_are_balanced_and_sums_right(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = S.assign(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    load = np.zeros((8, 3))
    for r in rows:
        assert r.n_bytes == len(text[r.doc_id].encode()) and r.n_tokens == len(text[r.doc_id].split())
        load[r.shard] += [r.n_bytes, r.n_tokens, 1]
    largest = max(r.n_bytes for r in rows) / load[:, 0].sum()
    assert (load / load.sum(0)).max() <= 1.06 / 8 + largest


def test_the_whole_query_equals_plain_loops(spark):
    """Groups, pieces and bundles by plain loops (their hashes are Spark's own), then greedy placement."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    shards = 3
    rows = docs.selectExpr("doc_id", "coalesce(source, '') AS source", "text", "xxhash64(doc_id) AS h", "xxhash64(coalesce(source, '')) AS g").collect()
    load = [(len((r.text or "").encode()), len((r.text or "").split()), 1) for r in rows]
    total = [max(sum(x[k] for x in load), 1) for k in range(3)]
    group = {}
    for r, x in zip(rows, load):
        group[r.source] = [a + b for a, b in zip(group.get(r.source, [0, 0, 0]), x)]
    pieces = {s: int(np.ceil(max(x[k] / (total[k] / (shards * S.PIECES)) for k in range(3)))) for s, x in group.items()}
    item = [f"={r.h % pieces[r.source]}:{r.source}" if pieces[r.source] > 1 else f"~{r.g % (shards * S.PIECES)}" for r in rows]
    items = sorted(set(item))
    loads = [[sum(x[k] for i, x in zip(item, load) if i == name) for k in range(3)] for name in items]
    where = dict(zip(items, greedy(loads, shards, S.SLACK)))
    got = {r.doc_id: r.shard for r in S.assign(docs, shards).collect()}
    assert got == {r.doc_id: where[i] for r, i in zip(rows, item)} and len(set(got.values())) == shards


def test_small_groups_stay_together(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 20)), f"tiny{i % 300}") for i in range(900)]
    shard = {}
    for r in S.assign(make_docs(rows), 2).collect():
        shard.setdefault(r.source, set()).add(r.shard)
    assert all(len(x) == 1 for x in shard.values())


def test_defined_cases(make_docs):
    rows = [(1, "a b", None), (2, None, "s"), (3, "", "s"), (None, "no id", "s"), (4, "w " * 200_000, "s"), (5, "x y", ""), (5, "x y", "")]
    docs = make_docs(rows)
    for name in ("item", "pieces", "shard", "n_bytes", "n_rows", "n_tokens"):
        docs = docs.withColumn(name, F.lit("c"))
    out = S.assign(docs, 4).collect()
    assert len(out) == len(rows) and all(0 <= r.shard < 4 for r in out)
    assert {(r.doc_id, r.source, r.n_bytes, r.n_tokens) for r in out} == {(1, "", 3, 2), (2, "s", 0, 0), (3, "s", 0, 0), (None, "s", 5, 2), (4, "s", 400_000, 200_000), (5, "", 3, 2)}
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    assert S.assign(make_docs([])).count() == 0
