import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penstroke.llm import simhash as S

from .conftest import words


def groups(rows):
    """Smallest id of each id's group, by comparing all pairs of fingerprints."""
    rows = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    high, low, known = S.fingerprint(pa.array([t for _, t in rows]))
    at = np.flatnonzero(known)
    far = np.bitwise_count(high[at][:, None] ^ high[at]) + np.bitwise_count(low[at][:, None] ^ low[at])
    near = far <= S.RADIUS
    ids = np.array([rows[i][0] for i in at])
    root = ids.copy()
    while True:
        least = np.array([root[n].min() for n in near])
        by_id = {d: least[ids == d].min() for d in set(ids.tolist())}
        least = np.array([by_id[d] for d in ids.tolist()])
        if (least == root).all():
            return {int(d): int(r) for d, r in zip(ids, root) if d != r}
        root = least


def corpus(n=150):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        base = words(rng, rng.choice([3, 30, 120, 400]))
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 4))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((i * 10 + k + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows + [(5000, ""), (5001, None), (5002, " \n\t"), (5003, "Same Words here."), (5004, "here same words"), (None, rows[0][1]), rows[3], rows[3]]


def links(rows):
    """Number of other fingerprints within the radius of each id's own, from all pairs."""
    rows = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    high, low, known = S.fingerprint(pa.array([t for _, t in rows]))
    prints = {r[0]: (int(h), int(x)) for r, h, x, k in zip(rows, high, low, known) if k}
    every = set(prints.values())
    return {d: sum(q != p and (q[0] ^ p[0]).bit_count() + (q[1] ^ p[1]).bit_count() <= S.RADIUS for q in every) for d, p in prints.items()}


def found(df):
    out = df.collect()
    assert len(out) == len({r.doc_id for r in out})
    return {r.doc_id: r.kept_doc_id for r in out}


@pytest.mark.parametrize("cell_rows", [100_000, 40])
def test_groups_equal_those_of_all_pairs(make_docs, monkeypatch, cell_rows):
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    rows = corpus()
    want = groups(rows)
    assert len(want) > 50 and want[5004] == 5003
    got = S.near_duplicates(make_docs(rows))
    assert found(got) == want
    number = links(rows)
    assert {r.doc_id: r.n_links for r in got.collect()} == {d: number[d] for d in want}


def test_one_large_group_and_one_large_cell(make_docs):
    rng = random.Random(1)
    base = words(rng, 200)
    rows = [(i, " ".join(base[:190] + words(rng, 2))) for i in range(700)] + [(1000 + i, " ".join(words(rng, 60))) for i in range(50)]
    assert found(S.near_duplicates(make_docs(rows))) == {i: 0 for i in range(1, 700)}


@pytest.mark.parametrize("segments, cell_rows", [(11, 40), (8, 60), (6, 50), (5, 100), (4, 500)])
def test_every_number_of_segments_finds_the_same(make_docs, monkeypatch, segments, cell_rows):
    monkeypatch.setattr(S, "plan", lambda rows, radius=S.RADIUS: S.Plan(segments, radius if segments > 5 else 11))
    monkeypatch.setattr(S, "RADIUS", S.RADIUS if segments > 5 else 11)
    monkeypatch.setattr(S, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(S, "_DIRECT", 14)
    rows = corpus(60)
    assert found(S.near_duplicates(make_docs(rows))) == groups(rows)


def test_work_is_as_planned_and_far_from_quadratic():
    """Lookups and comparisons that a search does, counted, against the plan; and the plan's growth over seven decades.

    Multi-index hashing can't be linear for a radius that is a large share of the bits; a smaller one comes near it.
    """
    rng = np.random.default_rng(1)

    def work(n, radius):
        plan = S.plan(n, radius)
        records = np.zeros(n, S._RECORD)
        records["id"], records["high"], records["low"] = np.arange(n), *rng.integers(0, 1 << 64, (2, n), np.uint64)
        cells = [S.Cell(plan, i, 0, records, records[:0]) for i in range(plan.segments)]
        return sum(c.compared + c.looked_up for c in cells)

    for radius, power in ((7, 1.3), (11, 1.4), (21, 1.65)):
        for n in (4_000, 40_000):
            assert work(n, radius) < 1.1 * n * S.plan(n, radius).work(n)
        small, large = (n * S.plan(n, radius).work(n) for n in (4e3, 5e10))
        assert np.log(large / small) / np.log(5e10 / 4e3) < power
    assert np.log(work(40_000, 7) / work(4_000, 7)) / np.log(10) < 1.2


def test_a_hot_fingerprint_and_a_hub_of_near_copies(make_docs):
    """A third of all rows under one fingerprint, and a third within the radius of one text."""
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, "one text that very many rows have") for i in range(2000)]
    rows += [(5000 + i, " ".join(base[:148] + [f"v{i}", f"u{i}"])) for i in range(2000)]
    rows += [(9000 + i, " ".join(words(rng, 80))) for i in range(500)]
    out = found(S.near_duplicates(make_docs(rows)))
    assert out == {**dict.fromkeys(range(1, 2000), 0), **dict.fromkeys(range(5001, 7000), 5000)}


def test_rows_of_one_id_are_one_document(make_docs):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "something else altogether here"), (3, "something else altogether here")]
    out = found(S.near_duplicates(make_docs(rows)))
    assert out in ({2: 1}, {3: 2})


def test_deduplicate_keeps_one_row_a_group_and_every_row_without_a_word(make_docs):
    rows = corpus(40)
    gone = set(groups(rows))
    kept = [(r.doc_id, r.text) for r in S.deduplicate(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted(((d, t) for d, t in rows if d not in gone), key=repr)


def test_long_rows_sum_like_short_ones():
    rng = random.Random(2)
    text = " ".join(words(rng, 3000, 100_000))
    terms = {w.strip() for w in text.split()}
    from penstroke.llm.text import hash_strings, mix64

    h = hash_strings(pa.array(sorted(terms)))
    bits = np.unpackbits(np.stack([h, mix64(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8), axis=1)
    want = np.packbits(bits.sum(0) * 2 > len(terms)).view(np.uint64)
    high, low, _ = S.fingerprint(pa.array(["a b", text, None]))
    assert (high[1], low[1]) == (want[0], want[1])


def test_empty_table_and_clashing_columns(make_docs):
    assert S.near_duplicates(make_docs([])).count() == 0
    docs = make_docs([(1, "a b c"), (2, "c b a"), (3, None)])
    for name in ("high", "low", "cell", "payload", "first_id", "kept_doc_id", "node", "root", "__gone"):
        docs = docs.withColumn(name, F.lit(7))
    assert found(S.near_duplicates(docs)) == {2: 1}
    out = S.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
