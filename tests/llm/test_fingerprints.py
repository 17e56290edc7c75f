import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from penstroke.llm import fingerprints as P
from penstroke.llm.text import hash_strings, mix64

from .conftest import words


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum(min(a[w], b[w]) for w in a | b) / sum(max(a[w], b[w]) for w in a | b)


def signature(df):
    return {r.doc_id: r.signature for r in df.collect()}


def one_by_one(text):
    """The definition, sample by sample and word by word."""
    import pyarrow as pa

    bag = Counter(text.split())
    terms = sorted(bag)
    hashes = hash_strings(pa.array(terms))
    d = P.draws(hashes)
    out = []
    for s in range(P.SAMPLES):
        best = None
        for i in np.argsort(hashes):
            r, c, b = d[i, :, s]
            t = np.floor(np.log(np.array(bag[terms[i]])).astype(np.float32) / r + b)
            a = c - r * (t + 1 - b)
            if best is None or a < best[0]:
                best = (a, hashes[i], t)
        level = mix64(np.array([int(best[2])], np.int64).view(np.uint64) + np.uint64(P.SEED))
        out.append(int(mix64(np.array([best[1]], np.uint64) ^ level).astype(np.uint32).view(np.int32)[0]))
    return out


def test_equal_to_the_definition(make_docs):
    rng = random.Random(0)
    rows = [(i, " ".join(words(rng, n, 60))) for i, n in enumerate([1, 2, 7, 40, 300])]
    got = signature(P.weighted_signatures(make_docs(rows)))
    for d, t in rows:
        assert got[d] == one_by_one(t)


def test_collisions_estimate_the_generalised_jaccard_similarity(make_docs):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(60):
        base = words(rng, 200, 80)
        other = base[: rng.randrange(0, 200)] + words(rng, rng.randrange(1, 200), 80)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        want.append(jaccard(rows[-2][1], rows[-1][1]))
    got = signature(P.weighted_signatures(make_docs(rows)))
    error = np.array([P.similarity(got[2 * i], got[2 * i + 1]) - w for i, w in enumerate(want)])
    assert abs(error.mean()) < 0.03 and np.sqrt((error**2).mean()) < 0.09


def test_defined_cases(make_docs):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, "b a, A b"), (2, "A a b b."), (3, ""), (4, None), (5, " \n"), (6, long), (7, long), (None, "b a a b"), (1, "b a, A b")]
    docs = make_docs(rows).withColumn("signature", F.lit("x")).withColumn("term", F.lit(None))
    out = P.weighted_signatures(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.signature)
    assert by[1][0] == by[1][1] == by[2][0] == by[None][0] and by[6] == by[7]
    assert by[3] == by[4] == by[5] == [None] and len(by[6][0]) == P.SAMPLES
    assert P.weighted_signatures(make_docs([])).count() == 0


def test_a_text_of_very_many_words_is_drawn_block_by_block(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([" ".join(f"v{i}" for i in range(200_000)), "a b b"])
    few = P.signatures(texts)[0]
    monkeypatch.setattr(P, "KEPT_WORDS", 0)
    tracemalloc.start()
    assert (P.signatures(texts)[0] == few).all() and (few[1] == P.signatures(pa.array(["a b b"]))[0][0]).all()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20  # all draws at once take 154 MB


def test_batches_do_not_matter(make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 50, 300))) for i in range(200)]
    docs = make_docs(rows)
    assert signature(P.weighted_signatures(docs.coalesce(1))) == signature(P.weighted_signatures(docs.repartition(4)))
