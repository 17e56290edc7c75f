"""Sources and sinks on files, the command line, and streams."""

import datetime
import json

import pytest

from penstroke import cli
from penstroke.operators import profile, turns
from penstroke.sinks import report, texts
from penstroke.sources import exports, parsed, profiles
from penstroke.sources.text import read_corpus, read_texts
from penstroke.streaming import running


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_bytes("# Head\r\nFirst text here. It goes on.\r\n".encode())
    (tmp_path / "sub" / "a.md").write_text("Second text. Perhaps it is longer, but not much.")
    (tmp_path / "a.txt").write_bytes(b"Third, with a bad byte \xff in it.")
    (tmp_path / "blank.md").write_text("  \n")
    (tmp_path / "c.rst").write_text("never read")
    return tmp_path


def test_corpus_order_line_ends_and_bad_bytes(spark, corpus):
    rows = read_corpus(spark, str(corpus)).orderBy("ord").collect()
    assert [r.stem for r in rows] == ["b", "a", "a"] and rows[0].text == "# Head\nFirst text here. It goes on.\n" and "�" in rows[2].text
    assert read_texts(spark, str(corpus / "c.rst")).first().text == "never read"


def test_numbered_copies_and_small_files(spark, tmp_path):
    for name, size in (("talk_2.md", 600), ("notes_2024.md", 600), ("talk.md", 600), ("small.md", 499), ("even.md", 500)):
        (tmp_path / name).write_text("x" * size)
    assert sorted(r.stem for r in exports.markdown_files(spark, str(tmp_path)).collect()) == ["even", "talk"]
    assert exports.markdown_files(spark, str(tmp_path), 1, True).count() == 5


def test_json_discovery(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.json").write_text("[]")
    (tmp_path / "two.json").write_text("[]")
    assert exports.json_files(spark, str(tmp_path)).count() == 2
    (tmp_path / "conversations.json").write_text("[]")
    assert [r.stem for r in exports.json_files(spark, str(tmp_path)).collect()] == ["conversations"]
    with pytest.raises(ValueError):
        exports.json_files(spark, str(tmp_path / "x" / ".." / "a.txt")) if (tmp_path / "a.txt").write_text("") is not None else None


def test_a_broken_file_is_skipped_with_a_warning(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"chat_messages": [{"sender": "human", "text": "A message that is long enough."}]}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"chat_messages": [{"sender": "human", "text": "A message that is long enough."}, {"sender": "human", "text": None}]}]))
    (tmp_path / "worse.json").write_text("{")
    messages = exports.messages_by_sender(exports.json_files(spark, str(tmp_path)))
    assert exports.extracted(messages).count() == 1
    assert sorted(r.warning for r in exports.warnings(messages).collect()) == ["Error reading bad.json", "Error reading worse.json"]


def test_parts_that_are_no_strings(spark, tmp_path):
    node = {"message": {"author": {"role": "user"}, "content": {"parts": ["a long enough user message", {"image": 1}, "tail"]}}}
    (tmp_path / "c.json").write_text(json.dumps([{"mapping": {"k": node}}]))
    assert exports.extracted(exports.messages_by_mapping(exports.json_files(spark, str(tmp_path)))).first().cleaned == "a long enough user message tail"


def test_profile_command(spark, corpus, capsys):
    out, md = corpus / "out" / "p.json", corpus / "out" / "p.mdown"
    assert cli.main(["profile", str(corpus), "--register", "essay", "--output", str(out), "--report", str(md)], spark) == 0
    found = json.loads(out.read_text())
    assert found["register"] == "essay" and list(found)[:7] == ["register", "corpus_stats", "lexical", "syntactic", "punctuation", "hedging_booster", "pronouns"]
    assert found["corpus_stats"]["word_count"] == 23 and found["structural"]["heading_lines"] == 1 and found["lexical"]["function_word_profile"]["it"] > 0
    assert "| Words (filtered prose) | 23 |" in md.read_text() and "fewer than 20,000 words" in md.read_text()
    assert "20,000 are recommended" in capsys.readouterr().err
    documents = cli.corpus_profile(read_corpus(spark, str(corpus)), "essay", "documents")
    assert documents["corpus_stats"]["word_count"] == 23
    assert cli.main(["profile", str(corpus / "nowhere")], spark) == 1
    assert cli.main(["profile", str(corpus / "blank.md")], spark) == 1


def test_extract_command(spark, tmp_path, capsys):
    talk = "## Ana\n\nThis is a long enough message.\n\n## Reply\n\nReply here.\n\n## Ana\n\nok\n\n## ana again\n\nThe last message of this talk, " + "and more words of it, " * 30
    (tmp_path / "talk.md").write_text(talk)
    out = tmp_path / "turns.txt"
    assert cli.main(["extract", str(tmp_path), "--marker", "## Ana", "--output", str(out)], spark) == 0
    assert out.read_text().startswith("This is a long enough message.\n\nThe last message of this talk,")
    assert cli.main(["extract", str(tmp_path), "--marker", "## Ana", "--preview", "3"], spark) == 0
    assert "[1 of 1]" in capsys.readouterr().out
    assert cli.main(["extract", str(tmp_path)], spark) == 1
    assert cli.main(["extract", str(tmp_path / "talk.md")], spark) == 1
    assert cli.main(["extract", str(tmp_path / "none")], spark) == 1
    (tmp_path / "conversations.json").write_text(json.dumps({"chat_messages": [{"sender": "human", "text": "One bare conversation, no list."}]}))
    assert cli.main(["extract", str(tmp_path), "--format", "claude", "--output", str(out)], spark) == 0 and out.read_text() == "One bare conversation, no list."


def test_report_command(tmp_path):
    a = {"register": "a", "corpus_stats": {"word_count": 30000, "sentence_count": 9, "paragraph_count": 3}, "syntactic": {"sentence_stats": {"mean_words": 12.25, "pct_short_le5": 0.1225}}}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps({"register": "b"}))
    out = tmp_path / "deep" / "r.md"
    assert cli.main(["report", f"first:{tmp_path}/a.json", f"{tmp_path}/b.json", "--output", str(out), "--author", "X"]) == 0
    text = out.read_text()
    assert "| Mean sentence length | 12.25 | — |" in text and "| % short (≤5 words) | 12.2% | — |" in text and "| Words | 30,000 | — |" in text and "| Feature | first | b |" in text
    assert cli.main(["report", f"{tmp_path}/none.json", "--output", str(out)]) == 1
    assert profiles.load_profile(f"{tmp_path}/b.json")[0] == "b"


def test_reports_take_their_date(tmp_path):
    text = report.combined_report([("a", {"register": "a"})], today=datetime.date(2024, 2, 3))
    assert "**Generated:** 2024-02-03" in text
    assert report.fill("{{a}} and {{b}}", {"a": 1}) == "1 and {{b}}"


def test_turns_as_text(spark, tmp_path):
    rows = spark.createDataFrame([("f", 1, "two"), ("f", 0, "one")], "path string, turn int, cleaned string")
    texts.write_turns(rows.coalesce(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value <> ''").count() == 2
    assert texts.joined(rows, "path", "turn") == "one\n\ntwo"


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, raw_bytes long, extracted_bytes long, turns_extracted long, low_yield boolean, warn boolean")
    row = turns.extraction_summary(empty).first()
    assert (row.files, row.raw_bytes, row.overall_yield) == (0, 0, 0.0)


def test_a_missing_parser_is_named(spark):
    if not parsed.available():
        with pytest.raises(ModuleNotFoundError):
            parsed.parse(spark.createDataFrame([(1, "x")], "doc_id long, text string"))


def test_running_totals_equal_those_of_the_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string, source string", 1)
    query = running.start(running.running_totals(stream, ["source"]), "running", f"file://{tmp_path}/state")
    query.awaitTermination(120)
    want = profile.totals(profile.measure(docs, ["source"]), ["source"])
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, want.collect()))
    assert query.lastProgress is not None
