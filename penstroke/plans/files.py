"""Queries of the file sources and sinks, over a folder of small files that each of them writes first.

The folder lies in the shared folder of ``spark.checkpoint.dir``, so that executors can read it; a session without one
gets a folder of its own.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.operators import profile, turns
from penstroke.sinks import report, texts
from penstroke.sources import exports
from penstroke.sources.text import read_corpus, read_texts

from . import sql
from .measures import BY, profile_sql, table
from .turns import _CLEAN, _mine

_LONG = "And so on, and on, with more words of it. " * 14
#: Path to bytes: line ends, bad bytes, blank files, other suffixes, copies, small files, subfolders, exports.
FILES: dict[str, bytes] = {
    "b.md": b"# Head\r\nFirst text here. It goes on.\r\n", "sub/a.md": "Second text, naïve. Perhaps it is longer, but not much.".encode(), "a.txt": b"Third, with a bad byte \xff in it. Fine!",
    "blank.md": b"  \n", "c.rst": b"Never read in a folder.\rBut alone.", "talk.md": f"## Ana\n\nThis is a long enough message.\n\n## Reply\n\nReply here.\n\n## Ana\n\nok\n\n## ana again\n\n{_LONG}".encode(),
    "talk_2.md": f"## Ana\n\nThe second export of it. {_LONG}".encode(), "notes_2024.md": f"## Notes\n\nNobody speaks. {_LONG}".encode(), "sub/even.md": b"x" * 500, "small.md": b"x" * 499,
}


def _message(text: object) -> dict:
    return {"sender": "human", "text": text}


EXPORTS: dict[str, bytes] = {
    "x/one.json": json.dumps([{"chat_messages": [_message("A message that is long enough."), _message("short")]}]).encode(),
    "two.json": json.dumps({"chat_messages": [_message("One bare conversation, and no list."), {"sender": "assistant", "text": "An answer that is long enough."}]}).encode(),
    "bad.json": json.dumps([{"chat_messages": [_message("Lost with its file, for a bad one follows."), _message(None), _message(3)]}]).encode(), "worse.json": b"{", "notes.txt": b"no export",
}
MAIN = EXPORTS | {"conversations.json": json.dumps([{"chat_messages": [_message("Of the main file alone, long enough.")]}]).encode()}
MARKER = "## Ana"


@cache
def _base(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = f"{shared.rstrip('/') if shared else 'file://' + tempfile.gettempdir()}/penstroke-files-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    atexit.register(lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return base


def folder(spark: SparkSession, files: dict[str, bytes]) -> str:
    """Write the files into a new folder."""
    base = f"{_base(spark)}/{uuid.uuid4().hex}"
    for name, data in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        stream.write(bytearray(data))
        stream.close()
    return base


def corpus_files(spark, sf_dir):
    """Markdown files by path, then text files by path, without blank ones."""
    found = read_corpus(spark, folder(spark, FILES))
    place = F.size(F.filter(F.sort_array(F.lit(sorted(_order(n) for n in FILES))), lambda x: x < F.concat(F.substring("ord", 1, 1), F.regexp_extract("path", r"/[0-9a-f]{32}/(.*)$", 1))))
    return found.select("stem", place.alias("place"), F.col("size").cast("long").alias("size"), F.md5("text").alias("digest"))


def _order(name: str) -> str:
    return ("0" if name.endswith(".md") else "1") + name


def single_file(spark, sf_dir):
    """A file named by itself is read whatever its name."""
    return read_texts(spark, folder(spark, FILES) + "/c.rst").select("stem", F.col("size").cast("long").alias("size"), "text")


def text_files(spark, sf_dir):
    return read_texts(spark, folder(spark, FILES)).select("stem", F.col("size").cast("long").alias("size"), "text")


def markdown_exports(spark, sf_dir):
    """Large enough, and no numbered copies."""
    return exports.markdown_files(spark, folder(spark, FILES)).select("stem", F.col("size").cast("long").alias("size"))


def markdown_exports_with_copies(spark, sf_dir):
    return exports.markdown_files(spark, folder(spark, FILES), 1, True).select("stem", F.col("size").cast("long").alias("size"))


def markdown_export_turns(spark, sf_dir):
    """The author's turns of the Markdown exports."""
    found = turns.headed_turns(exports.markdown_files(spark, folder(spark, FILES), numbered_copies=True), MARKER)
    return found.select("stem", F.col("turn").cast("long").alias("turn"), "cleaned")


def json_exports_of_a_folder(spark, sf_dir):
    """Without a conversations.json every JSON file counts."""
    return exports.json_files(spark, folder(spark, EXPORTS)).select("stem", "text")


def json_exports_by_main_file(spark, sf_dir):
    return exports.json_files(spark, folder(spark, MAIN)).select("stem", "text")


def json_export_turns(spark, sf_dir):
    """Turns of the files that can be read."""
    messages = exports.messages_by_sender(exports.json_files(spark, folder(spark, EXPORTS)))
    name = F.substring_index("path", "/", -1)
    return exports.extracted(messages).select(name.alias("name"), F.col("turn").cast("long").alias("turn"), "cleaned")


def json_export_warnings(spark, sf_dir):
    """Files that were skipped."""
    messages = exports.messages_by_sender(exports.json_files(spark, folder(spark, EXPORTS)))
    return exports.warnings(messages).select("warning")


def corpus_file_counts(spark, sf_dir):
    """The measures of every text of the folder."""
    return profile.measure(read_corpus(spark, folder(spark, FILES)), ["stem"], "ord").groupBy("stem").agg(*[F.sum(c).alias(c) for c in profile.COUNTS])


def written_turns(spark, sf_dir):
    """Lines of the author's turns as the text sink writes them."""
    path = f"{folder(spark, {'empty': b''})}/turns"
    texts.write_turns(turns.author_turns(table(spark, sf_dir, "conversations")), path)
    return spark.read.text(path).groupBy(F.md5("value").alias("digest")).agg(F.count("*").alias("n"))


#: Leaves of the nested profile: name to path.
LEAVES = {
    "word_count": "corpus_stats.word_count", "mattr_window100": "lexical.mattr_window100", "mean_words": "syntactic.sentence_stats.mean_words", "paragraphs": "syntactic.paragraph_stats.paragraph_count",
    "concession_rate": "syntactic.concession_rate", "comma_per_sentence": "punctuation.comma_per_sentence", "hedge_per_100w": "hedging_booster.hedge_per_100w", "third_per_100w": "pronouns.third_per_100w",
    "bullet_ratio": "structural.bullet_ratio",
}


def nested_profiles(spark, sf_dir):
    """Leaves of every source's nested profile, and its ranked lists as one string each."""
    found = profile.profiles(table(spark, sf_dir, "documents"), BY)
    listed = {
        "content": F.transform("lexical.distinctive_content_words", lambda x: F.concat_ws(":", x["word"], x["count"])),
        "functional": F.transform("lexical.function_word_profile", lambda x: x["word"]),
        "initials": F.transform("syntactic.sentence_initial_patterns", lambda x: F.concat_ws(":", x["word"], x["count"])),
    }
    return found.select("source", *[F.round(F.col(p).cast("double"), 6).alias(n) for n, p in LEAVES.items()], *[F.concat_ws(" ", c).alias(n) for n, c in listed.items()])


def reported_profiles(spark, sf_dir):
    """Each source's profile through the JSON sink and back, and its row of the Markdown table of words."""
    rows = []
    for found in report.as_dicts(profile.profiles(table(spark, sf_dir, "documents"), BY), "source"):
        back = json.loads(report.as_json(found))
        shown = next(line for line in report.single_report(back, "s").split("\n") if line.startswith("| Words"))
        rows.append((back["register"], back["corpus_stats"]["word_count"], back["lexical"]["mattr_window100"], back["syntactic"]["sentence_stats"]["mean_words"], shown.split("|")[2].strip()))
    return spark.createDataFrame(rows, "source string, word_count long, mattr double, mean_words double, shown string")


def register_words(spark, sf_dir):
    """Words of every source as the cross table of the reports shows them."""
    found = report.as_dicts(profile.profiles(table(spark, sf_dir, "documents"), BY), "source")
    lines = report.cross_table([(p["register"], p) for p in found])
    head, words = (next(line for line in lines if line.startswith(x)).split("|")[2:-1] for x in ("| Feature", "| Words"))
    return spark.createDataFrame([(a.strip(), b.strip()) for a, b in zip(head, words)], "source string, words string")


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def _values(files: dict[str, bytes]) -> str:
    rows = ", ".join(f"({sql.lit(n)}, CAST({len(b)} AS BIGINT), {sql.lit(_decoded(b))})" for n, b in files.items())
    stem = "regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')"
    return f"(SELECT path, {stem} AS stem, size, text FROM (VALUES {rows}) v(path, size, text))"


_MD = f"{_values(FILES)} WHERE path LIKE '%.md'"
_TURNS = f"""WITH f AS (SELECT * FROM {_values(EXPORTS)} WHERE path LIKE '%.json'),
c AS (SELECT path, CASE WHEN json_type(CAST(text AS JSON)) = 'ARRAY' THEN json_extract(CAST(text AS JSON), '$[*]') ELSE [CAST(text AS JSON)] END AS convs FROM f WHERE json_valid(text)),
m AS (SELECT path, flatten(list_transform(convs, lambda x: json_extract(x, '$.chat_messages[*]'))) AS ms FROM c),
e AS (SELECT path, unnest(ms) AS x, unnest(range(len(ms))) AS turn FROM m),
r AS (SELECT path, turn, x->>'sender' AS sender, coalesce(x->>'text', '') AS text, x->>'sender' = 'human' AND json_type(x, '$.text') <> 'VARCHAR' AS bad FROM e),
broken AS (SELECT path FROM f WHERE NOT json_valid(text) UNION SELECT path FROM r WHERE bad)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        corpus_files, single_file, text_files, markdown_exports, markdown_exports_with_copies, markdown_export_turns, json_exports_of_a_folder, json_exports_by_main_file, json_export_turns,
        json_export_warnings, corpus_file_counts, written_turns, nested_profiles, reported_profiles, register_words,
    )
}

_COUNTED = ", ".join(f"{v} AS {k}" for k, v in (sql.count_columns() | sql.window_columns()).items())


def _top(words: str, shown: str, limit: int, ranked: str) -> str:
    return f"(SELECT source, string_agg({shown}, ' ' ORDER BY rank) AS {words} FROM ({ranked}) WHERE rank <= {limit} GROUP BY source)"


def _nested_sql() -> str:
    from penstroke.functions import lexicons

    function = sql.items(lexicons.FUNCTION_WORDS)
    ranked = "SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM"
    content = f"{ranked} wc WHERE NOT list_contains({function}, word) AND length(word) > 2"
    functional = f"{ranked} wc WHERE list_contains({function}, word)"
    scalar = {"paragraphs": "counted_paragraphs"}
    leaves = ", ".join(f"round(CAST({scalar.get(n, n)} AS DOUBLE), 6) AS {n}" for n in LEAVES)
    return f"""WITH {profile_sql("source")},
wc AS MATERIALIZED (SELECT source, word, count(*) AS n, min((doc_id, pos)) AS first FROM (SELECT source, doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d) GROUP BY source, word),
ic AS (SELECT source, word, count(*) AS n, min((doc_id, pos)) AS first FROM (SELECT source, doc_id, unnest(list_transform(list_filter(sw, lambda s: len(s) > 0), lambda s: s[1])) AS word, unnest(range(len(list_filter(sw, lambda s: len(s) > 0)))) AS pos FROM d) GROUP BY source, word)
SELECT source, {leaves}, coalesce(content, '') AS content, coalesce(functional, '') AS functional, coalesce(initials, '') AS initials FROM scalar
LEFT JOIN {_top("content", "word || ':' || n", 30, content)} USING (source) LEFT JOIN {_top("functional", "word", 50, functional)} USING (source)
LEFT JOIN {_top("initials", "word || ':' || n", 20, ranked + " ic")} USING (source)"""


SQL: dict[str, str] = {
    "corpus_files": f"""WITH f AS (SELECT *, CASE WHEN path LIKE '%.md' THEN '0' ELSE '1' END || path AS ord FROM {_values(FILES)}), o AS (SELECT ord FROM (SELECT CASE WHEN path LIKE '%.md' THEN '0' ELSE '1' END || path AS ord FROM {_values(FILES)}))
SELECT stem, CAST((SELECT count(*) FROM o WHERE o.ord < f.ord) AS INTEGER) AS place, size, md5(text) AS digest FROM f WHERE (path LIKE '%.md' OR path LIKE '%.txt') AND regexp_matches(text, '\\S')""",
    "single_file": f"SELECT stem, size, text FROM {_values(FILES)} WHERE path = 'c.rst'",
    "text_files": f"SELECT stem, size, text FROM {_values(FILES)} WHERE path LIKE '%.md' OR path LIKE '%.txt'",
    "markdown_exports": f"SELECT stem, size FROM {_MD} AND size >= 500 AND NOT regexp_matches(stem, '_[0-9]+$')",
    "markdown_exports_with_copies": f"SELECT stem, size FROM {_MD}",
    "markdown_export_turns": rf"""WITH cut AS (SELECT stem, string_split(regexp_replace(text, '(?m)^(#+\s+.+)$', chr(57344) || '\1' || chr(57345), 'g'), chr(57344))[2:] AS parts FROM {_MD} AND size >= 500),
each AS (SELECT stem, unnest(parts) AS part, unnest(range(len(parts))) AS turn FROM cut),
c AS (SELECT stem, turn, {sql.turn("split_part(part, chr(57345), 2)")} AS cleaned FROM each WHERE starts_with(lower({sql.strip("split_part(part, chr(57345), 1)")}), {sql.lit(MARKER.lower())}))
SELECT stem, turn, cleaned FROM c WHERE length(cleaned) > 20 AND {_CLEAN}""",
    "json_exports_of_a_folder": f"SELECT stem, text FROM {_values(EXPORTS)} WHERE path LIKE '%.json'",
    "json_exports_by_main_file": f"SELECT stem, text FROM {_values(MAIN)} WHERE path = 'conversations.json'",
    "json_export_turns": f"""{_TURNS}, mine AS (SELECT path, turn, {sql.turn(sql.strip("text"))} AS cleaned FROM r WHERE sender = 'human' AND length({sql.strip("text")}) > 20 AND path NOT IN (SELECT path FROM broken))
SELECT regexp_extract(path, '[^/]*$') AS name, turn, cleaned FROM mine WHERE cleaned <> '' AND {_CLEAN}""",
    "json_export_warnings": f"{_TURNS} SELECT 'Error reading ' || regexp_extract(path, '[^/]*$') AS warning FROM broken",
    "corpus_file_counts": f"""WITH {sql.base(f"SELECT path AS doc_id, stem, text AS raw FROM {_values(FILES)} WHERE (path LIKE '%.md' OR path LIKE '%.txt') AND regexp_matches(text, '[^ ' || chr(10) || ']')")}, c AS (SELECT stem, {_COUNTED} FROM d)
SELECT stem, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in profile.COUNTS)} FROM c GROUP BY stem""",
    "written_turns": f"""WITH {_mine("conversations")}, lines AS (SELECT unnest(string_split(cleaned || chr(10), chr(10))) AS line FROM mine) SELECT md5(line) AS digest, count(*) AS n FROM lines GROUP BY line""",
    "nested_profiles": _nested_sql(),
    "reported_profiles": f"""WITH {profile_sql("source")} SELECT source, word_count, round(mattr_window100, 4) AS mattr, round(mean_words, 2) AS mean_words, format('{{:,}}', word_count) AS shown FROM scalar""",
    "register_words": f"""WITH {sql.base()} SELECT source, format('{{:,}}', CAST(sum(len(words)) AS BIGINT)) AS words FROM d GROUP BY source""",
}
