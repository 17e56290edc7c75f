import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penstroke.llm import quality as Q
from penstroke.llm.runtime import table

from .conftest import words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_labelled_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) == 0
    scored = Q.score(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").collect()
    right = [r.accepted == (r.quality == 1) for r in scored]
    good = [r.accepted for r in scored if r.quality == 1]
    assert len(right) > 80 and np.mean(right) >= 0.95 and np.mean(good) >= 0.97


def test_isotonic_fit_is_the_best_monotone_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(0, 12, 30).astype(float)
        y = (rng.random(30) < x / 12).astype(float)
        knots = Q.isotonic(x, y)
        fitted = np.interp(x, *knots)
        # min-max formula of isotonic regression over the sorted distinct values
        value = np.unique(x)
        want = [max(min(y[(x >= a) & (x <= b)].mean() for b in value if b >= v) for a in value if a <= v) for v in value]
        assert np.allclose(fitted, np.array(want)[np.searchsorted(value, x)])
        assert (np.diff(knots[1]) >= -1e-12).all()


def test_partition_sums_solve_the_ridge_problem(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 40)).upper() if i % 2 else " ".join(words(rng, 40)) + ".") for i in range(200)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(Q.SEED), "doc_id"), F.lit(Q._HELD_OUT)) == 0).collect()}
    train = [r for r in rows if r[0] not in held]
    x = Q.features(pa.array([t for _, t in train]))
    y = np.array([d % 2 for d, _ in train], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6, atol=1e-5)
    z = model.basis(x)
    penalty = np.full(z.shape[1], Q.RIDGE * len(y) / Q.COMPONENTS)
    penalty[-1] = 0
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y), atol=1e-4)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    model = Q.Model(np.zeros(18), np.ones(18))
    x = rng.normal(size=(200, 18)) * 0.7
    z = model.basis(x)[:, :-1]
    gap = ((x[:, None] - x) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-gap / 18)).mean() < 0.06


@pytest.mark.parametrize("labels, want", [([], 1.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(None, 1), (1, None), (99, 0)], 1.0)])
def test_labels_of_one_class_or_none(spark, make_docs, labels, want):
    docs = make_docs([(1, "some words here"), (2, "and other words"), (3, ""), (4, None), (5, " \n")])
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: (r.quality_probability, r.accepted) for r in Q.score(docs, frame).collect()}
    assert got == {1: (want, want >= 0.5), 2: (want, want >= 0.5), 3: (0.0, False), 4: (0.0, False), 5: (0.0, False)}


def test_repeats_long_texts_empty_table_and_clashing_columns(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 40)) + ("!!" if i % 2 else ".")) for i in range(60)] + [(7, "w " * 300_000), (7, "w " * 300_000), (None, "a text without an id")]
    docs = make_docs(rows)
    for name in ("y", "x", "quality", "quality_probability", "accepted", "__id"):
        docs = docs.withColumn(name, F.lit(3))
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)] + [(0, 1)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = Q.score(docs, labels).collect()
    assert len(got) == len(rows) and len({r.quality_probability for r in got if r.doc_id == 7}) <= 2
    assert kept.count() == sum(r.accepted for r in got)
    assert Q.score(make_docs([]), labels).count() == 0 and Q.keep_good(make_docs([]), labels).count() == 0
