"""Queries of the measures: by document, by source, and over fixtures with the markup that the tables lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import clean, counts, lexicons, segment
from penstroke.operators import concatenated, markers, profile

from . import sql

BY = ["source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is spread over them, for measuring is work of the CPU."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.measure(table(spark, sf_dir, "documents"), BY)


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.measure(table(spark, sf_dir, "documents"), ["doc_id"])


def tokens_per_doc(spark, sf_dir):
    prose = clean.strip_markdown(F.col("text"))
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", segment.words(prose).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct("words")).cast("long").alias("n_types"))


def word_counts(spark, sf_dir):
    return profile.word_counts(by_source(spark, sf_dir), BY, places=False).select("source", "word", "n")


def top_content_words(spark, sf_dir):
    return profile.content_words(by_source(spark, sf_dir), BY)


def function_word_profile(spark, sf_dir):
    return profile.function_words(by_source(spark, sf_dir), BY)


def sentence_initials(spark, sf_dir):
    return profile.sentence_initials(by_source(spark, sf_dir), BY)


def hapax_by_source(spark, sf_dir):
    return profile.hapax(profile.word_counts(by_source(spark, sf_dir), BY, places=False), BY).withColumn("hapax_ratio", F.col("hapaxes") / F.col("tokens"))


def mattr_by_doc(spark, sf_dir):
    m = profile.counted(by_document(spark, sf_dir), ["doc_id"])
    return m.select("doc_id", "window_types", "window_places", (F.col("window_types") / F.greatest("window_places", F.lit(1))).alias("mattr"), "hapax")


def document_counts(spark, sf_dir):
    return profile.counted(by_document(spark, sf_dir), ["doc_id"]).select("doc_id", *profile.COUNTS)


def document_rates(spark, sf_dir):
    return profile.rates(profile.counted(by_document(spark, sf_dir), ["doc_id"]), ["doc_id"])


def register_rates(spark, sf_dir):
    return profile.rates(profile.totals(by_source(spark, sf_dir), BY), BY)


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev")})


def sentence_length_stats(spark, sf_dir):
    return _rounded(profile.sentence_stats(by_source(spark, sf_dir), BY))


def sentence_length_stats_by_doc(spark, sf_dir):
    return _rounded(profile.sentence_stats(by_document(spark, sf_dir), ["doc_id"]))


def paragraph_stats(spark, sf_dir):
    return _rounded(profile.paragraph_stats(by_source(spark, sf_dir), BY))


def readability(spark, sf_dir):
    r = profile.readability(by_source(spark, sf_dir), BY)
    return r.select("source", "syllables", "complex", *[F.round(c, 6).alias(c) for c in r.columns if c.endswith("_approx")])


def marker_classes(spark, sf_dir):
    return markers.class_counts(profile.word_counts(by_source(spark, sf_dir), BY, places=False), BY)


def register_profile(spark, sf_dir):
    """Every scalar feature of every source."""
    s = profile.scalars(by_source(spark, sf_dir), BY)
    return s.select("source", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in s.columns if c != "source"])


def corpus_scope(spark, sf_dir):
    """Counts of each source as one concatenated corpus."""
    return concatenated.corpus_counts(table(spark, sf_dir, "documents"), BY)


def pages_prose(spark, sf_dir):
    """Markup removal over the raw pages, as digests."""
    text = clean.strip_markdown(F.col("html"))
    return table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


#: Texts with what the tables lack: marks, markup, abbreviations, stance words, pronouns, several paragraphs.
CASES = [
    'Dr. Smith left. He said "No." Then e.g. Nothing happened! ok.', "Don't -- stop'n go- 'x' café well-being", "I’m here. It's we're you'd.",
    "Wait... really -- yes—no; a: (b), c? It is – so!", "I think it might work. Fiji thinks so. Perhaps, in some sense, it could.", "We like my book. They told her that you never must.",
    "It rained. But we went. However, although it poured, they stayed. Nothing else.", "# T\n\n- a\n- b\n```\nx\n```", "2*3*4 **b** and ***both*** and *one*",
    "see [1](u) and [x](u) and ![i](pic.png) or \\[12\\] [7]", "---\nt: a\n---\nAlpha beta. Gamma.", "| a | b |\n|---|---|\nAfter the table.\n\n\n\nNext one here.",
    "Text <b>bold</b> and {#anchor} and `code here` end.\n***\nLast.", "[tag-name — description] kept? Yes. Always clearly.", "", "   ", "a b a c a b", "One.\n\nTwo words.\n\n\nThree words here, i.e. Some more. Mr. Jones vs. Dr. No.",
    "zebra apple zebra apple mango", "Because we think. Therefore, if it must. Moreover, then always.",
]


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")


_CASES_SQL = "SELECT doc_id, text AS raw FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {sql.lit(t)})" for i, t in enumerate(CASES)) + ") v(doc_id, text)"


def fixture_cleaning(spark, sf_dir):
    t = F.col("text")
    p = clean.strip_markdown(t)
    return _cases(spark).select("doc_id", p.alias("prose"), clean.clean_turn(t).alias("turn"), F.concat_ws(" ", segment.words(p)).alias("words"), F.concat_ws("|", segment.sentences(p)).alias("sentences"), F.concat_ws("|", segment.paragraphs(p)).alias("paragraphs"))


def fixture_counts(spark, sf_dir):
    return profile.measure(_cases(spark), ["doc_id"]).select("doc_id", *profile.COUNTS, "hapax")


def fixture_lexicon_rates(spark, sf_dir):
    return profile.rates(profile.measure(_cases(spark), ["doc_id"]), ["doc_id"])


def _ranked(words: str, limit: int) -> str:
    return f"""
WITH {sql.base()}, placed AS (
  SELECT source, doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d
), tokens AS (SELECT source, count(*) AS tokens FROM placed GROUP BY source
), counted AS (SELECT source, word, count(*) AS n, min((doc_id, pos)) AS first FROM placed WHERE {words} GROUP BY source, word
), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM counted)
SELECT source, CAST(rank AS INTEGER) AS rank, word, n, CAST(n AS DOUBLE) / tokens * 1000 AS per_1000 FROM ranked JOIN tokens USING (source) WHERE rank <= {limit}"""


_ALL = ", ".join(f"{v} AS {k}" for k, v in (sql.count_columns() | sql.window_columns()).items())
_STAT = "n, round(mean, 6) AS mean, round(median, 6) AS median, round(stdev, 6) AS stdev"
_SYLLABLES = "list_transform(words, lambda w: greatest(len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN regexp_matches(w, '[^aeiouyl]e$') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1))"
_HAPAX = "len(list_filter(map_values(map_from_entries(list_transform(list_distinct(words), lambda w: (w, len(list_filter(words, lambda x: x = w)))))), lambda n: n = 1))"
_FUNCTION = sql.items(lexicons.FUNCTION_WORDS)
_WORDS_BY_SOURCE = "w AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(words) AS word FROM d) GROUP BY source, word)"
_SCALAR_COUNTS = ["word_count", "sentence_count", "paragraph_count", "char_count", "total_lines", "bullet_lines", "heading_lines", "code_fences"]


def profile_sql(by: str, source: str | None = None) -> str:
    """CTEs up to ``scalar``: every scalar feature, unrounded."""
    start = sql.base(source) if source else sql.base()
    rename = "mean AS mean_words, median AS median_words, stdev AS stdev_words, q1 AS q1_words, q3 AS q3_words, min AS min_words, max AS max_words, share_short AS pct_short_le5, share_long AS pct_long_ge30"
    return f"""{start}, {sql.counted(by)}, total AS ({sql.totals(by)}), rate AS ({sql.rates(by)}),
hapax AS (SELECT {by}, CAST(count_if(n = 1) AS DOUBLE) / sum(n) AS hapax_ratio FROM (SELECT {by}, word, count(*) AS n FROM (SELECT {by}, unnest(words) AS word FROM d) GROUP BY {by}, word) GROUP BY {by}),
ss AS (SELECT {by}, n AS counted_sentences, {rename} FROM ({sql.stats(by, sql.SENTENCE_SIZES)})),
pp AS (SELECT {by}, n AS counted_paragraphs, mean AS paragraph_mean_words, median AS paragraph_median_words, stdev AS paragraph_stdev_words FROM ({sql.stats(by, "ps")})),
scalar AS (SELECT {by}, {", ".join("total." + c for c in _SCALAR_COUNTS)}, rate.* EXCLUDE ({by}), coalesce(hapax_ratio, 0.0) AS hapax_ratio, ss.* EXCLUDE ({by}), pp.* EXCLUDE ({by})
  FROM total JOIN rate USING ({by}) LEFT JOIN hapax USING ({by}) LEFT JOIN ss USING ({by}) LEFT JOIN pp USING ({by}))"""


SCALARS = [
    *_SCALAR_COUNTS, *sql.rate_columns(), "hapax_ratio", "counted_sentences", "mean_words", "median_words", "stdev_words", "q1_words", "q3_words", "min_words", "max_words",
    "pct_short_le5", "pct_long_ge30", "counted_paragraphs", "paragraph_mean_words", "paragraph_median_words", "paragraph_stdev_words",
]

_JOINED = "SELECT source, array_to_string(list(text ORDER BY doc_id), chr(10) || chr(10)) AS raw FROM documents WHERE regexp_matches(text, '\\S') GROUP BY source"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_per_doc, word_counts, top_content_words, function_word_profile, sentence_initials, hapax_by_source, mattr_by_doc, document_counts, document_rates, register_rates,
        sentence_length_stats, sentence_length_stats_by_doc, paragraph_stats, readability, marker_classes, register_profile, corpus_scope, pages_prose, fixture_cleaning, fixture_counts, fixture_lexicon_rates,
    )
}

SQL: dict[str, str] = {
    "tokens_per_doc": f"WITH {sql.base()} SELECT doc_id, len(words) AS n_tokens, len(list_distinct(words)) AS n_types FROM d",
    "word_counts": f"WITH {sql.base()}, {_WORDS_BY_SOURCE} SELECT source, word, n FROM w",
    "top_content_words": _ranked(f"NOT list_contains({_FUNCTION}, word) AND length(word) > 2", 30),
    "function_word_profile": _ranked(f"list_contains({_FUNCTION}, word)", 50),
    "sentence_initials": f"""
WITH {sql.base()}, opened AS (
  SELECT source, doc_id, unnest(list_transform(list_filter(sw, lambda s: len(s) > 0), lambda s: s[1])) AS word, unnest(range(len(list_filter(sw, lambda s: len(s) > 0)))) AS pos FROM d
), ranked AS (SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min((doc_id, pos))) AS rank FROM opened GROUP BY source, word)
SELECT source, CAST(rank AS INTEGER) AS rank, word, n FROM ranked WHERE rank <= 20""",
    "hapax_by_source": f"WITH {sql.base()}, {_WORDS_BY_SOURCE} SELECT source, CAST(count_if(n = 1) AS BIGINT) AS hapaxes, CAST(sum(n) AS BIGINT) AS tokens, CAST(count_if(n = 1) AS DOUBLE) / sum(n) AS hapax_ratio FROM w GROUP BY source",
    "mattr_by_doc": f"""
WITH {sql.base()}, c AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in sql.window_columns().items())} FROM d),
h AS (SELECT doc_id, count_if(n = 1) AS hapax FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word) GROUP BY doc_id)
SELECT doc_id, window_types, window_places, CAST(window_types AS DOUBLE) / greatest(window_places, 1) AS mattr, CAST(coalesce(hapax, 0) AS BIGINT) AS hapax FROM c LEFT JOIN h USING (doc_id)""",
    "document_counts": f"WITH {sql.base()} SELECT doc_id, {_ALL} FROM d",
    "document_rates": f"WITH {sql.base()}, {sql.counted('doc_id')} {sql.rates('doc_id', 'counted')}",
    "register_rates": f"WITH {sql.base()}, {sql.counted('source')}, total AS ({sql.totals('source')}) {sql.rates('source')}",
    "sentence_length_stats": f"WITH {sql.base()} SELECT source, {_STAT}, q1, q3, min, max, share_short, share_long FROM ({sql.stats('source', sql.SENTENCE_SIZES)})",
    "sentence_length_stats_by_doc": f"WITH {sql.base()} SELECT doc_id, {_STAT}, q1, q3, min, max, share_short, share_long FROM ({sql.stats('doc_id', sql.SENTENCE_SIZES)})",
    "paragraph_stats": f"WITH {sql.base()} SELECT source, {_STAT} FROM ({sql.stats('source', 'ps')})",
    "readability": f"""
WITH {sql.base()}, y AS (SELECT source, len(words) AS w, len(sents) AS s, list_sum({_SYLLABLES}) AS syl, len(list_filter({_SYLLABLES}, lambda x: x >= 3)) AS hard FROM d),
t AS (SELECT source, sum(w) AS w, sum(s) AS s, CAST(coalesce(sum(syl), 0) AS BIGINT) AS syllables, CAST(sum(hard) AS BIGINT) AS complex FROM y GROUP BY source),
r AS (SELECT *, CAST(w AS DOUBLE) / greatest(s, 1) AS ws, CAST(syllables AS DOUBLE) / greatest(w, 1) AS sw, CAST(complex AS DOUBLE) / greatest(w, 1) AS cw FROM t)
SELECT source, syllables, complex, round(0.39::DOUBLE * ws + 11.8::DOUBLE * sw - 15.59::DOUBLE, 6) AS flesch_kincaid_grade_approx, round(0.4::DOUBLE * (ws + 100 * cw), 6) AS gunning_fog_approx,
  round(206.835::DOUBLE - 1.015::DOUBLE * ws - 84.6::DOUBLE * sw, 6) AS flesch_reading_ease_approx, round(sw, 6) AS avg_syllables_per_word_approx FROM r""",
    "marker_classes": f"""
WITH {sql.base()}, {_WORDS_BY_SOURCE}, terms AS (SELECT * FROM (VALUES {", ".join(f"({sql.lit(c)}, {sql.lit(x)})" for c, xs in markers.CLASSES.items() for x in xs)}) v(class, word)),
tokens AS (SELECT source, sum(n) AS tokens FROM w GROUP BY source)
SELECT source, class, CAST(coalesce(sum(w.n), 0) AS BIGINT) AS n, CAST(coalesce(sum(w.n), 0) AS DOUBLE) / any_value(tokens) * 1000 AS per_1000
FROM tokens CROSS JOIN terms LEFT JOIN w USING (source, word) GROUP BY source, class""",
    "register_profile": f"WITH {profile_sql('source')} SELECT source, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in SCALARS)} FROM scalar",
    "corpus_scope": f"WITH {sql.base(_JOINED)} SELECT source, {', '.join(f'{v} AS {k}' for k, v in sql.count_columns().items())} FROM d",
    "pages_prose": f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {sql.prose('html')} AS t FROM pages WHERE html IS NOT NULL)",
    "fixture_cleaning": f"WITH {sql.base(_CASES_SQL)} SELECT doc_id, prose, {sql.turn('raw')} AS turn, array_to_string(words, ' ') AS words, array_to_string(sents, '|') AS sentences, array_to_string(paras, '|') AS paragraphs FROM d",
    "fixture_counts": f"WITH {sql.base(_CASES_SQL)} SELECT doc_id, {_ALL}, CAST(len(list_filter(list_distinct(words), lambda w: len(list_filter(words, lambda x: x = w)) = 1)) AS BIGINT) AS hapax FROM d",
    "fixture_lexicon_rates": f"WITH {sql.base(_CASES_SQL)}, {sql.counted('doc_id')} {sql.rates('doc_id', 'counted')}",
}
assert counts.WINDOW == 100
