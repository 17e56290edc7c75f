import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from penstroke.llm import substrings as S

from .conftest import words


def brute(rows):
    """Word positions (doc_id, i) in a window of MIN_WORDS words that has an earlier occurrence, by direct comparison."""
    places = defaultdict(list)
    for doc, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        w = text.split()
        for i in range(len(w) - S.MIN_WORDS + 1):
            places[tuple(w[i : i + S.MIN_WORDS])].append((doc, i))
    out = set()
    for at in places.values():
        first = min(at)
        for doc, i in at:
            if doc != first[0] or i - first[1] >= S.MIN_WORDS:
                out |= {(doc, k) for k in range(i, i + S.MIN_WORDS)}
    return out


def covered(df):
    return {(r.doc_id, k) for r in df.collect() for k in range(r.start_word, r.start_word + r.n_words)}


def corpus():
    rng = random.Random(3)
    passages = [words(rng, n) for n in (49, 50, 51, 55, 80, 200)]
    boiler = words(rng, 25)
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = p
        if i % 4 == 0:
            w += boiler
        rows.append((i * 7, " ".join(w)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, ""), (1003, None), (1004, "x " * 300), (1005, "a b c " * 90), (None, rows[5][1])]
    rows.append((1006, " ".join(boiler + words(rng, 30) + boiler)))
    rows.append(rows[9])
    return rows


def test_same_words_as_brute_force(make_docs):
    rows = corpus()
    assert covered(S.repeats(make_docs(rows))) == brute(rows)


@pytest.mark.parametrize("pack, part", [(2_000, 5_000), (40, 300), (1 << 23, 1 << 24)])
def test_same_words_whatever_is_read_together(make_docs, monkeypatch, pack, part):
    monkeypatch.setattr(S, "PACK_BYTES", pack)
    monkeypatch.setattr(S, "PART_BYTES", part)
    monkeypatch.setattr(S, "OFTEN", 2)
    rows = corpus()
    assert covered(S.repeats(make_docs(rows).repartition(5))) == brute(rows)


def test_a_hot_passage_has_one_record_a_pack_and_a_task():
    """A passage of 120 words in 3,000 texts read together: its windows go to the index, and to the search for the first
    place, once each."""
    rng = random.Random(4)
    passage = words(rng, 120)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [" ".join([f"u{i}", *passage, f"v{i}"]) for i in range(3000)]})
    sent = [(b, S._unpack(p, np.int64, np.uint32, np.uint8)[0]) for x in S._probe(4)([batch]) for b, p in zip(x.column("block").to_pylist(), x.column("payload").to_pylist()) if b is not None]
    assert sum(len(ids) for _, ids in sent) <= 96 + 2 * 3000
    anchors = {}
    for x in S._live(S._probe(4)([batch])):
        for d, some in zip(x.column("doc_id").to_pylist(), x.column("anchors").to_pylist()):
            anchors.setdefault(d, set()).update(some)
    assert len(anchors) == 3000 and len(anchors[7]) == 96


def test_a_passage_in_very_many_texts(spark, make_docs):
    """200,000 texts with one passage; no task holds its occurrences."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    docs = spark.range(200_000).selectExpr("id AS doc_id", f"concat('a', id, ' {passage} b', id) AS text").repartition(8)
    out = S.repeats(docs).selectExpr("count(*) AS n", "min(first_doc_id) AS a", "max(first_doc_id) AS b", "min(n_words) AS w", "max(n_words) AS v", "max(start_word) AS s").first()
    assert tuple(out) == (199_999, 0, 0, 60, 60, 1)


def test_spans_are_equal_and_maximal(make_docs):
    rows = corpus()
    text = {d: t.split() for d, t in rows if d is not None and t is not None}
    for r in S.repeats(make_docs(rows)).collect():
        a, b = text[r.doc_id], text[r.first_doc_id]
        i, j, n = r.start_word, r.first_start_word, r.n_words
        assert n >= S.MIN_WORDS and a[i : i + n] == b[j : j + n]
        assert (r.first_doc_id, j) < (r.doc_id, i)


def test_all_alignments_of_the_shortest_repeat(make_docs):
    rng = random.Random(8)
    passage = words(rng, 50)
    rows = [(i, " ".join(words(rng, i % 25) + passage + words(rng, 3))) for i in range(26)]
    found = {r.doc_id: (r.start_word, r.n_words) for r in S.repeats(make_docs(rows)).collect()}
    assert found == {i: (i % 25, 50) for i in range(1, 26)}


def test_removal(make_docs):
    rows = corpus()
    out = {(r.doc_id, r.text): r.n_chars for r in S.remove_repeats(make_docs(rows)).collect()}
    gone = brute(rows)
    want = set()
    for d, t in rows:
        if t is None or d is None:
            want.add((d, t))
            continue
        if any(g[0] == d for g in gone):
            kept = [w for i, w in enumerate(t.split()) if (d, i) not in gone]
            if kept:
                want.add((d, " ".join(kept)))
        else:
            want.add((d, t))
    assert {(d, t.strip() if t is not None and any(g[0] == d for g in gone) else t) for d, t in out} == want
    assert all(n == len(t) for (d, t), n in out.items() if t is not None)


def test_sql_says_the_same(make_docs, tmp_path):
    docs = make_docs(corpus())
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id, start_word, n_words, first_doc_id, first_start_word FROM ({S.REPEATS_SQL})").fetchall()
    assert sorted(map(tuple, S.repeats(docs).collect())) == sorted(want)


def test_cut_keeps_layout():
    assert S.cut("a b\nc d\n\ne", [(1, 2)]) == "a d\n\ne"
    assert S.cut("a b\nc d\n\ne", [(3, 2)]) == "a b\nc "
    assert S.cut(" a b", [(0, 1), (0, 1)]) == " b"


def test_empty_table_and_extra_columns(spark, make_docs):
    from pyspark.sql import functions as F

    assert S.repeats(make_docs([])).count() == 0
    docs = make_docs([(1, "w " * 10), (2, None)]).withColumn("anchors", F.lit(1)).withColumn("part", F.lit("x")).withColumn("payload", F.lit(None)).withColumn("__id", F.lit(5)).withColumn("__cut", F.lit("c"))
    assert S.repeats(docs).count() == 0
    assert S.remove_repeats(docs).columns == docs.columns and S.remove_repeats(docs).count() == 2
