import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from penstroke.llm import mixing, packing, quality, simhash  # noqa: E402
from penstroke.llm.substrings import cut  # noqa: E402

from . import test_mixing, test_packing, test_related, test_simhash, test_substrings  # noqa: E402
from .conftest import DOC_SCHEMA, words  # noqa: E402


def corpus():
    rng = random.Random(12)
    passage = words(rng, 70)
    rows, labels = [], []
    for i in range(160):
        w = words(rng, rng.choice([20, 60, 150]))
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        elif i % 5 == 1:
            w[len(w) // 2 : len(w) // 2] = passage
        rows.append((i, " ".join(w) + ("" if bad else "."), f"s{i % 3}"))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    for i in (1, 2, 3, 5, 6):
        near = rows[i][1].split()
        near[0] = "changed"
        rows.append((500 + i, " ".join(near), rows[i][2]))
        rows.append((600 + i, rows[i][1], rows[i][2]))
    return rows + [(700, None, "s0"), (701, "", "s1"), (702, "  ", None)], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_equal_a_plain_computation(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]

    def texts(name):
        return {r.doc_id: r.text for r in out[name].collect()}

    rows, labels = corpus()
    good = {i for i, t, _ in rows if t and t.strip() and not t.isupper() and "!!" not in t}
    assert texts("quality").keys() == good
    scored = quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in scored.collect() if r.accepted} == good

    kept = list(texts("quality").items())
    gone = test_simhash.groups(kept)
    assert {501, 601, 602, 603, 605, 606} <= set(gone)
    assert texts("near_duplicates") == {d: t for d, t in kept if d not in gone}

    before = list(texts("near_duplicates").items())
    cover = test_substrings.brute(before)
    want = {}
    for d, t in before:
        left = cut(t, [(k, 1) for e, k in sorted(cover) if e == d])
        if left.strip():
            want[d] = left
    assert cover and texts("repeated_passages") == want

    source = {r.doc_id: r.source for r in out["repeated_passages"].collect()}
    mixed = test_mixing.brute([(d, t, source[d]) for d, t in want.items()])
    assert texts("mixing") == {x[0]: want[x[0]] for x in mixed}
    test_packing.whole(test_packing.pieces(out["packing"]), {x[0]: x[4] for x in mixed}, packing.WINDOW)
    bag = {x[0]: test_related.bag_of(want[x[0]]) for x in mixed}
    found = [(w, p, bag[d], f, n) for w, p, d, f, n in test_packing.pieces(out["packing"])]
    plain = test_related.plain([(x[0], want[x[0]]) for x in mixed], packing.WINDOW)
    assert sorted(found) == sorted((w, p, bag[d], f, n) for w, p, d, f, n in plain)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["window_id", "place", "path", "doc_id", "first_token", "n_tokens"] and got.count() > 0


def test_columns_of_clashing_names_are_carried(spark, sf_dir, tmp_path):
    """Rows with nulls, repeated rows and columns that the stages use themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.where("doc_id IN (1, 700)")).union(docs.where("doc_id = 2").selectExpr("CAST(NULL AS LONG)", "text", "lang", "source", "n_chars"))
    names = ["high", "low", "part", "block", "payload", "words", "anchors", "shard", "quota", "bag1", "rep", "copy", "__id", "__in", "__gone", "__cut", "y"]
    docs.withColumns({n: F.lit("c") for n in names}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)))
        assert name == "packing" or now.columns == columns
    assert now.where("doc_id IS NULL").count() == 0 and now.count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_radius_is_shared():
    assert simhash.plan(1000).radius == simhash.RADIUS


def test_packing_loses_no_pair_to_small_leaves_and_parts(spark, make_docs, sf_dir, monkeypatch):
    """Leaves far smaller than the table, and parts smaller than a leaf: still the graph over all pairs."""
    monkeypatch.setattr(test_related.R, "LEAF", 15)
    monkeypatch.setattr(test_related.R, "PART", 40, raising=False)
    monkeypatch.setattr(test_related.R, "RECALL", 1.0, raising=False)
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 40, 150))) for i in range(110)]
    out = corpus_pipeline.packing_stage(spark, make_docs(rows), sf_dir)
    got = sorted((r.window_id, r.place, r.doc_id, r.first_token, r.n_tokens) for r in out.collect())
    assert got == test_related.plain(rows, packing.WINDOW)
