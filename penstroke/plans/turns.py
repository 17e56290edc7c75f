"""Queries of extraction: turns of the conversations, and fixtures of the export formats that the tables lack."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import lexicons
from penstroke.operators import profile, turns
from penstroke.sources import exports

from . import sql
from .measures import BY, by_source, table


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def author_turns(spark, sf_dir):
    """Cleaned turns of the author, as digests."""
    mine = turns.author_turns(_conversations(spark, sf_dir))
    return mine.select("conv_id", "turn", F.length("cleaned").cast("long").alias("n_chars"), F.md5("cleaned").alias("digest"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conversations(spark, sf_dir)
    files = rows.groupBy("conv_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("raw"))
    return turns.extraction_stats(files, turns.author_turns(rows), "conv_id", F.col("raw"))


def extraction_yield(spark, sf_dir):
    """What each conversation gives, against what it holds."""
    return _stats(spark, sf_dir)


def extraction_summary(spark, sf_dir):
    return turns.extraction_summary(_stats(spark, sf_dir))


def extraction_flags(spark, sf_dir):
    rows = _conversations(spark, sf_dir)
    raw = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).scalar()
    return turns.sanity_flags(turns.author_turns(rows), raw)


def turn_preview(spark, sf_dir):
    """Five sample paragraphs; the limit is the operator."""
    return turns.preview(turns.author_turns(_conversations(spark, sf_dir)))


def corpus_tiers(spark, sf_dir):
    total = profile.totals(by_source(spark, sf_dir), BY)
    words = F.col("word_count")
    return total.select("source", "word_count", turns.size_tier(words).alias("tier"), (words < 20000).alias("small_corpus"))


MARKER = "## Ana"
#: Headed exports: short turns, leaks, subheadings, prefixes and cases of the marker, code, no heading at all.
HEADED = [
    "## Ana\n\nThis is a long enough message.\n\n## Reply\n\nReply here.\n\n## Ana\n\nok\n",
    "**User:** hello there, this is no heading\n\nand goes on for a while",
    "## Anabel\n\nThe marker is a prefix of this heading.\n\n# ana\n\nAnother level, so it does not match at all.",
    "## ANA\nCertainly, I agree with the whole idea.\n## Ana\nI agree with the whole idea, of course.",
    "## Ana 12:30\n\nSome text before a subheading here.\n\n### Sub\n\nThis part belongs to nobody in particular.\n\n## Ana\n\n```\n# no comment\n```\nWhat follows the fence is a turn of its own.",
    "preamble\n\n## Ana\n\nSee ![pic](x.png) and `code` and <b>bold</b> [3], then \\[4\\] the end.   \n\n\n\nLast paragraph.",
    "##\nAna speaks here but the mark stands alone in its line.\n\n## Ana\nThis block is not supported on your current device yet.\nStill here, after the notice.",
    "",
]

#: Exports whose messages have a sender: a list, a bare object, a null text in an author's message, several
#: conversations, no messages, no JSON.
BY_SENDER = [
    json.dumps([{"chat_messages": [{"sender": "human", "text": "  A first message, long enough.  "}, {"sender": "assistant", "text": "An answer that is long enough too."}, {"sender": "human", "text": "short"}]}]),
    json.dumps({"chat_messages": [{"sender": "human", "text": "One bare conversation instead of a list."}]}),
    json.dumps([{"chat_messages": [{"sender": "human", "text": "A good message in a file with a bad one."}, {"sender": "human", "text": None}]}]),
    json.dumps([{"chat_messages": [{"sender": "human", "text": "`thirty characters of code here` ok"}, {"sender": "human", "text": "As an AI I would say this differently."}]}, {"name": "empty"}, {"chat_messages": [{"sender": "human", "text": "From the third conversation of the file."}]}]),
    "no json at all",
    "[]",
]

_PARTS = {"a": ["a long enough user message", {"image": 1}, "tail"], "b": ["the assistant's answer is not counted"], "c": ["tiny"], "d": ["a second branch of the same conversation"]}
#: Exports whose messages are nodes of a mapping.
BY_MAPPING = [
    json.dumps([{"mapping": {k: {"message": {"author": {"role": "assistant" if k == "b" else "user"}, "content": {"parts": p}}} for k, p in _PARTS.items()} | {"root": {"message": None}}}]),
    json.dumps([{"title": "without a mapping"}, {"mapping": {"z": {"message": {"author": {"role": "user"}, "content": {"parts": ["keys keep the order of the file, z"]}}}, "a": {"message": {"author": {"role": "user"}, "content": {"parts": ["keys keep the order of the file, a"]}}}}}]),
    "{",
]


def _texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def headed_turn_cases(spark, sf_dir):
    found = turns.headed_turns(_texts(spark, HEADED), MARKER)
    return found.select("doc_id", F.col("turn").cast("long").alias("turn"), "cleaned")


def sender_export_cases(spark, sf_dir):
    found = exports.extracted(exports.messages_by_sender(_texts(spark, BY_SENDER), "doc_id"))
    return found.select("doc_id", F.col("turn").cast("long").alias("turn"), "cleaned")


def mapping_export_cases(spark, sf_dir):
    found = exports.extracted(exports.messages_by_mapping(_texts(spark, BY_MAPPING), "doc_id"))
    return found.select("doc_id", F.col("turn").cast("long").alias("turn"), "cleaned")


def _values(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {sql.lit(t)})" for i, t in enumerate(texts)) + ") v(doc_id, text)"


_CLEAN = "NOT (" + " OR ".join(f"contains(lower(cleaned), {sql.lit(p)})" for p in lexicons.ASSISTANT_PHRASES) + ")"


def _mine(source: str) -> str:
    """CTE ``mine`` from a source of ``role, text``: the raw stripped text counts for its length."""
    return f"""stripped AS (SELECT *, {sql.strip("text")} AS s FROM {source} WHERE role = 'user' AND text IS NOT NULL),
turned AS (SELECT *, {sql.turn("s")} AS cleaned FROM stripped WHERE length(s) > 20),
mine AS (SELECT * FROM turned WHERE cleaned <> '' AND {_CLEAN})"""


_BREAK = "chr(10) || chr(10)"
_YIELD = f"""{_mine("conversations")},
joined AS (SELECT conv_id, string_agg(cleaned, {_BREAK} ORDER BY turn, cleaned) AS whole FROM mine GROUP BY conv_id),
files AS (SELECT conv_id, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS raw_bytes FROM conversations GROUP BY conv_id),
sized AS (SELECT conv_id, raw_bytes, strlen(coalesce(whole, '')) AS extracted_bytes, len(list_filter(string_split(coalesce(whole, ''), {_BREAK}), lambda p: {sql.strip("p")} <> '')) AS turns_extracted FROM files LEFT JOIN joined USING (conv_id)),
shared AS (SELECT *, CAST(extracted_bytes AS DOUBLE) / greatest(raw_bytes, 1) AS yield_fraction FROM sized),
stats AS (SELECT *, yield_fraction < 0.05 AS low_yield, yield_fraction < 0.05 AND raw_bytes > 5000 AS warn FROM shared)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (author_turns, extraction_yield, extraction_summary, extraction_flags, turn_preview, corpus_tiers, headed_turn_cases, sender_export_cases, mapping_export_cases)
}

SQL: dict[str, str] = {
    "author_turns": f"WITH {_mine('conversations')} SELECT conv_id, turn, length(cleaned) AS n_chars, md5(cleaned) AS digest FROM mine",
    "extraction_yield": f"WITH {_YIELD} SELECT * FROM stats",
    "extraction_summary": f"""WITH {_YIELD}
SELECT count(*) AS files, CAST(coalesce(sum(raw_bytes), 0) AS BIGINT) AS raw_bytes, CAST(coalesce(sum(extracted_bytes), 0) AS BIGINT) AS extracted_bytes, CAST(coalesce(sum(turns_extracted), 0) AS BIGINT) AS turns,
  count_if(low_yield)::BIGINT AS low_yield_files, count_if(warn)::BIGINT AS warnings, CAST(coalesce(sum(extracted_bytes), 0) AS DOUBLE) / greatest(coalesce(sum(raw_bytes), 0), 1) AS overall_yield FROM stats""",
    "extraction_flags": f"""WITH {_mine("conversations")},
t AS (SELECT count(*) AS turns, CAST(coalesce(sum(len({sql.words("cleaned")})), 0) AS BIGINT) AS words, coalesce(sum(strlen(cleaned)), 0) AS bytes FROM mine)
SELECT turns, words, CASE WHEN words < 5000 THEN 'extreme caution' WHEN words <= 20000 THEN 'directional' WHEN words <= 100000 THEN 'reliable' ELSE 'high confidence' END AS tier,
  bytes * 10 < (SELECT coalesce(sum(strlen(text)), 0) FROM conversations) AS low_yield, false AS leaked, words < 20000 AS small_corpus, words < turns * 30 AS short_turns FROM t""",
    "turn_preview": f"""WITH {_mine("conversations")}, p AS (SELECT unnest({sql.paragraphs("cleaned")}) AS p FROM mine)
SELECT CASE WHEN length(p) > 500 THEN substring(p, 1, 500) || '...' ELSE p END AS sample FROM (SELECT p FROM p WHERE length(p) > 100 ORDER BY md5('0|' || p), p LIMIT 5)""",
    "corpus_tiers": f"""WITH {sql.base()}, t AS (SELECT source, CAST(sum(len(words)) AS BIGINT) AS word_count FROM d GROUP BY source)
SELECT source, word_count, CASE WHEN word_count < 5000 THEN 'extreme caution' WHEN word_count <= 20000 THEN 'directional' WHEN word_count <= 100000 THEN 'reliable' ELSE 'high confidence' END AS tier, word_count < 20000 AS small_corpus FROM t""",
    "headed_turn_cases": rf"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#+\s+.+)$', chr(57344) || '\1' || chr(57345), 'g'), chr(57344))[2:] AS parts FROM {_values(HEADED)}),
each AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS turn FROM cut),
c AS (SELECT doc_id, turn, {sql.turn("split_part(part, chr(57345), 2)")} AS cleaned FROM each WHERE starts_with(lower({sql.strip("split_part(part, chr(57345), 1)")}), {sql.lit(MARKER.lower())}))
SELECT doc_id, turn, cleaned FROM c WHERE length(cleaned) > 20 AND {_CLEAN}""",
    "sender_export_cases": f"""WITH f AS (SELECT doc_id, CAST(text AS JSON) AS j FROM {_values(BY_SENDER)} WHERE json_valid(text)),
c AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS convs FROM f),
m AS (SELECT doc_id, flatten(list_transform(convs, lambda x: json_extract(x, '$.chat_messages[*]'))) AS ms FROM c),
e AS (SELECT doc_id, unnest(ms) AS x, unnest(range(len(ms))) AS turn FROM m),
r AS (SELECT doc_id, turn, CASE WHEN x->>'sender' = 'human' THEN 'user' ELSE x->>'sender' END AS role, coalesce(x->>'text', '') AS text, x->>'sender' = 'human' AND json_type(x, '$.text') <> 'VARCHAR' AS bad FROM e),
good AS (SELECT * FROM r WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE bad)), {_mine("good")} SELECT doc_id, turn, cleaned FROM mine""",
    "mapping_export_cases": f"""WITH f AS (SELECT doc_id, CAST(text AS JSON) AS j FROM {_values(BY_MAPPING)} WHERE json_valid(text)),
m AS (SELECT doc_id, flatten(list_transform(json_extract(j, '$[*]'), lambda x: json_extract(x, '$.mapping.*'))) AS ms FROM f),
e AS (SELECT doc_id, unnest(ms) AS x, unnest(range(len(ms))) AS turn FROM m),
r AS (SELECT doc_id, turn, x->>'$.message.author.role' AS role, array_to_string(list_transform(list_filter(json_extract(x, '$.message.content.parts[*]'), lambda p: json_type(p) = 'VARCHAR'), lambda p: p->>'$'), ' ') AS text FROM e),
{_mine("r")} SELECT doc_id, turn, cleaned FROM mine""",
}
