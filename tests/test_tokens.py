"""The Arrow kernels: the same counts as the column functions, whatever the cuts, in bounded memory."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penstroke.operators import concatenated, profile, tokens
from penstroke.plans import analysis
from penstroke.plans.measures import CASES

ODD = [
    "K think. İ think. I thinK so, I thinkI think.", "A. B. Cé. D! 　E? x", "- -- --- ---- -----", "'-' -'a'- '' -b-c- 'tis", "One.\n\nTwo.\n \nThree.\n\n  \n\nFour", "Ja. Äh. (So.) \"No.\" 'Go'", "étc. Aa etc. B zetc. C _etc. D 1etc. E",
    "e.g. A i.e. B xe.g. C éi.e. D", "...... .... .. – — —- “x” ‘y’", "", "  ", "é", "ab.", "abcd", "éé. Éé. éé. Aé", "to some extento some extent", "Although. But yet, however. Ab.", "x" * 4000, "!", "? A", "a" + " " * 500 + "B. " + " " * 40 + "C.",
]


def odd_texts(n=60):
    rng = random.Random(3)
    pieces = [*ODD, "Dr.", "fig.", "é", "\n\n", "\n", " ", " ", "A", "b", ".", "!", "'", "-", "we", "but", "I think", "K", "(", ";", "—"]
    return [*ODD, *CASES, *("".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(n))]


def test_counts_are_those_of_the_columns(spark):
    texts = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    names = ["doc_id", *profile.COUNTS, "hapax"]
    m = profile.measure(texts, ["doc_id"])
    assert profile.counted(m, ["doc_id"]).select(names).orderBy("doc_id").collect() == m.select(names).orderBy("doc_id").collect()


def test_sizes_of_facts_are_those_of_the_columns(spark):
    texts = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    m = profile.measure(texts, ["doc_id"])
    found = {(r.doc_id, r.kind, r.key): r.n for r in profile._facts(m, ["doc_id"]).where("kind <> 'count'").collect()}
    want: Counter = Counter()
    for r in m.collect():
        want.update((r.doc_id, "word", w) for w in r.words)
        want.update((r.doc_id, "sentence", str(len(s))) for s in r.sentence_words if s)
        want.update((r.doc_id, "paragraph", str(n)) for n in r.paragraph_sizes if n)
    assert found == dict(want)


_SCHEMA = pa.schema([("s", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("ord", pa.int64()), ("pos", pa.int32())])


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([None if i % 3 == 0 else str(i % 2) for i in range(len(texts))]), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["s", "ord", "prose"])


@pytest.mark.parametrize("places", [True, False])
def test_cuts_and_held_rows_change_no_count(monkeypatch, places):
    schema = _SCHEMA if places else pa.schema(list(_SCHEMA)[:3])

    def counted():
        out: dict = {}
        for batch in tokens.count_words(["s"], schema, True, None, places)(iter([_batch(odd_texts())] * 2)):
            for r in batch.to_pylist():
                n, first = out.get((r["s"], r["word"]), (0, None))
                place = (r["ord"], r["pos"]) if places and r["word"] else None
                out[r["s"], r["word"]] = n + r["n"], min(filter(None, (first, place)), default=None)
        return out

    whole = counted()
    monkeypatch.setattr(tokens, "SLICE", 50)
    monkeypatch.setattr(tokens, "HELD", 40)
    monkeypatch.setattr(tokens, "LEAVING", 7)
    monkeypatch.setattr(tokens, "_DENSE", 0)
    assert counted() == whole and (None, "etc") in whole


def test_words_take_no_copy_of_their_text():
    """Each word once took its row with the whole text: 1,000 words of 100 texts of 8 KB came to 800 MB."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(1000)) for _ in range(100)]
    kept, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        assert sum(b.num_rows for b in tokens.count_words(["s"], _SCHEMA)(iter([_batch(texts)]))) > 90_000
    finally:
        pa.set_memory_pool(kept)
    assert pool.max_memory() < 60 << 20


def test_final_aggregation_sees_no_word(spark):
    """As many rows as there are words used to go through the aggregation by scope."""
    texts = spark.createDataFrame([(i, "s", f"w{chr(97 + i)} a a. Bb {chr(97 + i)}c!") for i in range(20)], "doc_id long, source string, text string")
    m = profile.measure(texts, ["source"])
    row = profile.scalars(m, ["source"]).first()
    n = Counter(w for r in m.select(F.explode("words").alias("w")).collect() for w in [r.w])
    assert row.hapax_ratio == sum(v == 1 for v in n.values()) / sum(n.values())


#: Marks that reach over the ends of documents, and ends that take or give white space.
SPANNING = [
    "a < b. Open", "c > d and on.", "```", "code", "``` after", "[name", "— what it is", "till ] here", "{#", "} closed", "[text", "more](u", "rl) end", "# ", "Heading", "| a |", "|", "---", "***", "*", "x*", "ends\n", "\nbegins", " ",
    "`a`", "<b>", "etc.", "A", "no end", "and but", "Yet. Then", "(x)", "Done!", "\"Q\"", "- item", "---\nt: a", "---", "\\[1\\]", "plain text here.", "Plain again", "But. Yet", "I think",
]


def test_corpus_counts_are_those_of_one_row(spark, monkeypatch):
    """Whatever the cuts: the counts of a scope in segments are those of its documents in one row."""
    rng = random.Random(8)
    rows = [(i, f"s{i % 40}" if i % 40 else None, rng.choice(SPANNING) if rng.random() < 0.6 else rng.choice(SPANNING[-14:])) for i in range(1200)]
    rows += [(2000 + i, "plain", rng.choice(["It goes on", "and on.", "Then but", "yet. Ends.", "etc.", "No!"])) for i in range(300)] + [(1, "front", "---"), (2, "front", "a: b\n---"), (3, "front", "Text.")]
    texts = spark.createDataFrame(rows, "doc_id long, source string, text string")
    names = ["source", *[c for c in profile.COUNTS if not c.startswith("window")]]
    want = profile.measure(profile.corpus(texts, ["source"]), ["source"]).select(names).orderBy("source").collect()
    inputs = texts.where(F.col("text") != " ").orderBy("source", "doc_id", "text").toArrow().to_batches()
    for size in (1, 25):
        monkeypatch.setattr(concatenated, "SEGMENT", size)
        cuts = [(k, s) for k, xs in concatenated._by_scope(iter(inputs), ["source"], "text") for s in concatenated.cut(xs)]
        assert len(cuts) > 42 + 100
        segments = spark.createDataFrame([(k[0], t, f) for k, (t, f) in cuts], "source string, text string, first boolean").coalesce(1)
        found = concatenated.added_up(segments, ["source"]).orderBy("source").collect()
        assert [r.asDict() for r in found] == [r.asDict() for r in want]
    monkeypatch.undo()
    assert concatenated.corpus_counts(texts, ["source"]).orderBy("source").collect() == want


def test_segments_of_plain_texts_are_short():
    """One row held a scope; 1 GB ended executors."""
    texts = ["Some plain words, and more. Then others -- of them."] * 20_000
    found = list(concatenated.cut(iter(texts)))
    assert max(len(t) for t, _ in found) < 2 * concatenated.SEGMENT and "\n\n".join(t for t, _ in found) == "\n\n".join(texts)


def test_baseline_measures_the_documents_once(spark):
    plan = analysis.baseline_rules(spark, "/root/testdata/sf0.001")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1
