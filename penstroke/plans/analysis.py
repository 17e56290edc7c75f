"""Queries over profiles: comparison, diffs, rules, bans, verification, exemplars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions import lexicons
from penstroke.operators import compare, exemplars, parsed, profile, rules

from . import sql
from .measures import BY, CASES, SCALARS, by_document, by_source, profile_sql, table

LANGS = ["de", "en", "es", "fr"]


def _long(measured: DataFrame, by: list[str] = BY) -> DataFrame:
    return profile.features_long(profile.scalars(measured, by), by)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def features_long(spark, sf_dir):
    """Every scalar feature of every source, one a row."""
    return _rounded(_long(by_source(spark, sf_dir)), "value")


def register_pivot(spark, sf_dir):
    """The compared features, one column a language."""
    long = _long(profile.measure(table(spark, sf_dir, "documents"), ["lang"]), ["lang"])
    return _rounded(compare.side_by_side(long, "lang", LANGS), *LANGS)


def _two(spark: SparkSession, sf_dir: str, register: str) -> DataFrame:
    """``feature, value`` of all documents or of the benchmark's texts."""
    if register == "documents":
        texts = table(spark, sf_dir, "documents").select("doc_id", F.lit(register).alias("source"), "text")
    else:
        texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(register).alias("source"), "text")
    return _long(profile.measure(texts, BY)).select("feature", "value")


def profile_diff(spark, sf_dir):
    changes = compare.diff(_two(spark, sf_dir, "documents"), _two(spark, sf_dir, "benchmark"))
    return _rounded(changes, "old_value", "new_value", "change")


def unsupported_rules(spark, sf_dir):
    """Rules resting on a zero in the benchmark that is none in the documents."""
    old, new = _two(spark, sf_dir, "benchmark"), _two(spark, sf_dir, "documents")
    mined = rules.mine(old.withColumn("source", F.lit("benchmark")), BY).where("value = 0").select(F.col("rule").alias("rule_id"), "feature")
    return _rounded(compare.unsupported_rules(mined, compare.diff(old, new)), "new_value")


def mined_rules(spark, sf_dir):
    return _rounded(rules.mine(_long(by_source(spark, sf_dir)), BY), "value")


def baseline_rules(spark, sf_dir):
    """Features of a source that are rare or frequent against the whole corpus."""
    each, whole = profile.scalars_and_whole(by_source(spark, sf_dir), BY)
    return _rounded(rules.mine_against(profile.features_long(each, BY), profile.features_long(whole, BY), BY), "value", "baseline")


REJECTED = [f"src{i}:em_dash_per_1000w" for i in range(5)] + ["nowhere:boost_per_100w"]


def approved_rules(spark, sf_dir):
    mined = rules.mine(_long(by_source(spark, sf_dir)), BY).select(F.concat_ws(":", "source", "feature").alias("rule_id"), "rule", "confidence")
    return rules.approved(mined, spark.createDataFrame([(r,) for r in REJECTED], "rule_id string"))


def negative_space(spark, sf_dir):
    return rules.negative_space(by_source(spark, sf_dir), BY)


def ban_scan(spark, sf_dir):
    """All documents, and the drafts under negative ids, since invented prose holds none of the banned phrases."""
    drafts = _drafts(spark).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    return rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text").union(drafts), "doc_id")


#: Drafts with what the bans name, and near misses of it.
DRAFTS = [
    "Clearly, this is a novel and robust approach. It is clearly written.", "We delve into it — and leverage, utilizes, fostered it. Deliver novels!",
    "Needless to say, not only is it fast but also small. In conclusion, it works.\nTo summarize: done.", "It is worth noting that nothing is banned here. Honestly? obviously.",
    "State-of-the-art, cutting-edge: significant, exceptional and important. In recent years\n  in summary it was underscored.", "A plain sentence. Another one.", "",
]


def _drafts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DRAFTS)), "doc_id long, text string")


def ban_scan_cases(spark, sf_dir):
    return rules.scan(_drafts(spark), "doc_id")


TARGETS = [("em dash", "—", 0), ("semicolon", ";", 0), ("double hyphen", "--", 0), ("colon", ":", 1), ("and", " and ", 3)]


def corrective_targets(spark, sf_dir):
    return rules.targets(table(spark, sf_dir, "documents"), "doc_id", TARGETS)


def soft_checks(spark, sf_dir):
    return rules.soft_checks(by_document(spark, sf_dir), "doc_id")


def soft_check_cases(spark, sf_dir):
    cases = spark.createDataFrame(list(enumerate([*DRAFTS, *CASES])), "doc_id long, text string")
    return rules.soft_checks(profile.measure(cases, ["doc_id"]), "doc_id")


RULE_TEXTS = [
    "Never use em dashes.\nPrefer short words.\nThis line has no cue.\n  Always close the loop.  ",
    "Instead of 'utilize', write it plainly.\nDo not hedge; use facts.\nThis is wrong: twice.\nMake sure it ends.",
    "nothing here\nWe user useful things.", "",
]


def cue_rule_cases(spark, sf_dir):
    found = rules.cue_rules(spark.createDataFrame(list(enumerate(RULE_TEXTS)), "doc_id long, text string"), "doc_id")
    return found.withColumn("line", F.col("line").cast("long"))


def verification_absolute(spark, sf_dir):
    return _rounded(compare.verify(_two(spark, sf_dir, "documents"), _two(spark, sf_dir, "benchmark")), "target", "produced")


def verification_relative(spark, sf_dir):
    return _rounded(compare.verify(_two(spark, sf_dir, "documents"), _two(spark, sf_dir, "benchmark"), "relative"), "target", "produced")


STATED = [("hedge_per_100w", 0.5), ("em_dash_per_1000w", 0.0), ("unheard_of", 1.0)]


def stated_preferences(spark, sf_dir):
    stated = spark.createDataFrame(STATED, "feature string, value double")
    return _rounded(compare.prefer_stated(_two(spark, sf_dir, "documents"), stated), "value")


SNAPSHOTS = [("essay", "2024-01-05"), ("essay", "2024-03-01"), ("essay", "2023-11-30"), ("chat", "2024-02-02"), ("chat", "2022-02-02"), ("chat", "2024-02-01"), ("lone", "2020-01-01")]


def latest_snapshots(spark, sf_dir):
    rows = spark.createDataFrame(SNAPSHOTS, "voice string, day string").select("voice", F.to_date("day").alias("snapshot_date"))
    return compare.latest_snapshots(rows).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


STATES = [("essay", 5001, "2024-05-01", 0), ("chat", 5000, "2024-01-31", 3), ("mail", 10, "2023-12-31", 2), ("notes", 0, "2024-06-30", 0)]
TODAY = "2024-07-01"


def regeneration_triggers(spark, sf_dir):
    rows = spark.createDataFrame(STATES, "voice string, new_words long, day string, corrections long").withColumn("analysed_on", F.to_date("day")).drop("day")
    return compare.regeneration_due(rows, F.to_date(F.lit(TODAY))).drop("analysed_on")


def typical_registers(spark, sf_dir):
    means = profile.sentence_stats(by_source(spark, sf_dir), BY).select("source", F.round("mean", 6).alias("mean_words"))
    return compare.typical_registers(means).select("source", "mean_words", "band")


def burrows_delta(spark, sf_dir):
    measured = profile.measure(table(spark, sf_dir, "documents"), ["lang"])
    words = profile.ranked_words(measured, ["lang"], lexicons.FUNCTION_WORDS, len(lexicons.FUNCTION_WORDS))
    rates = words.select("lang", "word", (F.col("n") / F.col("tokens") * 1000).alias("rate"))
    return _rounded(compare.burrows_delta(rates, "lang"), "delta")


def exemplar_passages(spark, sf_dir):
    """The most typical passages of every source, and those held out."""
    return exemplars.choose(exemplars.candidates(table(spark, sf_dir, "documents"), "source"), "source")


def nominal_suffixes(spark, sf_dir):
    """Words with a nominal suffix: what is left of nominalisations without a parser."""
    words = by_source(spark, sf_dir).select("source", F.size(F.filter("words", parsed.nominal)).cast("long").alias("k"), "word_count")
    total = words.groupBy("source").agg(F.sum("k").alias("nominal"), F.sum("word_count").alias("word_count"))
    return total.select("source", "nominal", (F.col("nominal") / F.greatest("word_count", F.lit(1)) * 1000).alias("nominal_suffix_per_1000w"))


#: Two parsed sentences: by, sentence, at, head, tag, dep, lemma.
PARSED = [
    ("a", 0, 0, 1, "DET", "det", "the"), ("a", 0, 1, 3, "NOUN", "nsubjpass", "decision"), ("a", 0, 2, 3, "AUX", "auxpass", "be"), ("a", 0, 3, 3, "VERB", "ROOT", "make"), ("a", 0, 4, 3, "PUNCT", "punct", "."),
    ("a", 1, 0, 1, "PRON", "nsubj", "she"), ("a", 1, 1, 1, "VERB", "ROOT", "like"), ("a", 1, 2, 4, "DET", "det", "the"), ("a", 1, 3, 4, "ADJ", "amod", "quiet"), ("a", 1, 4, 1, "NOUN", "dobj", "moment"),
    ("b", 0, 0, 0, "NOUN", "ROOT", "table"),
]
_PARSED = "source string, sentence int, at int, head int, tag string, dep string, lemma string"


def deep_syntax_cases(spark, sf_dir):
    return _rounded(parsed.deep_syntax(spark.createDataFrame(PARSED, _PARSED), BY), "avg_dependency_depth", "passive_ratio", "nominalization_per_1000w")


def tag_pair_cases(spark, sf_dir):
    return parsed.tag_pairs(spark.createDataFrame(PARSED, _PARSED), BY)


def _values(rows: list[tuple], *names: str) -> str:
    def one(x) -> str:
        return sql.lit(x) if isinstance(x, str) else f"CAST({x} AS {'DOUBLE' if isinstance(x, float) else 'BIGINT'})"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({', '.join(names)})"


def long_sql(by: str = "source", source: str | None = None) -> str:
    """A query for ``by, feature, value``, unrounded."""
    wide = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SCALARS)
    return f"(WITH {profile_sql(by, source)}, wide AS (SELECT {by}, {wide} FROM scalar) SELECT {by}, feature, value FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(SCALARS)})))"


def _r(column: str, name: str | None = None) -> str:
    return f"round({column}, 6) + 0.0 AS {name or column}"


_DOCS = "SELECT doc_id, 'documents' AS source, lang, text AS raw FROM documents WHERE text IS NOT NULL"
_BENCH = "SELECT item_id AS doc_id, 'benchmark' AS source, 'en' AS lang, text AS raw FROM benchmark WHERE text IS NOT NULL"
_ALL = "SELECT doc_id, 'all' AS source, lang, text AS raw FROM documents WHERE text IS NOT NULL"
_MINED = f"""lf AS MATERIALIZED {{lf}}, bounds AS (SELECT * FROM {_values(rules.EXTREMES, "feature", "op", "bound", "rule")}),
mined AS (SELECT source, feature, value, rule, CASE WHEN value = 0 THEN 'high' ELSE 'medium' END AS confidence FROM lf JOIN bounds USING (feature) WHERE (op = '=' AND value = bound) OR (op = '<' AND value < bound))"""


def _diff(old: str, new: str) -> str:
    tests = " ".join(f"WHEN '{f}' THEN {'appeared' if t is None else f'abs(change) > {t}'}" for f, t in compare.DIFF_THRESHOLDS.items())
    return f"""o AS MATERIALIZED {long_sql(source=old)}, n AS MATERIALIZED {long_sql(source=new)},
b AS (SELECT feature, o.value AS old_value, n.value AS new_value, n.value - o.value AS change, coalesce(o.value = 0 AND n.value <> 0, false) AS appeared FROM o FULL JOIN n USING (feature)),
diff AS (SELECT feature, old_value, new_value, change, coalesce(CASE feature {tests} END, false) AS significant, appeared FROM b)"""


def _verify(preset: str) -> str:
    def test(kind: str, limit: float) -> str:
        return {"zero": "target <> 0 OR produced = 0", "within": f"abs(produced - target) <= {limit}", "share": f"abs(produced - target) <= abs(target) * {limit}", "present_above": f"target <= {limit} OR produced > 0"}[kind]

    tests = " ".join(f"WHEN '{f}' THEN {test(*rule)}" for f, rule in compare.CHECKS[preset].items())
    names = ", ".join(f"'{f}'" for f in compare.CHECKS[preset])
    return f"""WITH b AS (SELECT feature, t.value AS target, p.value AS produced FROM {long_sql(source=_DOCS)} t FULL JOIN {long_sql(source=_BENCH)} p USING (feature) WHERE feature IN ({names}))
SELECT feature, {_r("target")}, {_r("produced")}, coalesce(CASE feature {tests} END, false) AS passed FROM b"""


def _scan(source: str) -> str:
    return f"""WITH low AS (SELECT doc_id, lower(text) AS low FROM {source} WHERE text IS NOT NULL), bans AS (SELECT * FROM {_values(rules.BANS, "ban", "class", "pattern")}),
hits AS (SELECT doc_id, ban, class, CAST(len(regexp_extract_all(low, pattern)) AS BIGINT) AS hits FROM low CROSS JOIN bans) SELECT * FROM hits WHERE hits > 0"""


_TRICOLON = "len(regexp_extract_all(prose, '[A-Za-z]+, [A-Za-z]+, (and|or) [A-Za-z]+'))"
_SIZES = "list_filter(list_transform(sw, lambda s: len(s)), lambda n: n > 0)"
_NEGATIVE = ["staccato", "tricolon", "questions", "second_person", "announcement_colon"]


def _soft(source: str | None = None) -> str:
    return f"""WITH {sql.base(source) if source else sql.base()}, s AS (SELECT doc_id, prose, sents, {_SIZES} AS z FROM d)
SELECT doc_id, CAST(len(list_filter(range(1, greatest(len(z), 1)), lambda i: z[i] <= 5 AND z[i + 1] <= 5)) AS BIGINT) AS short_pairs, CAST({_TRICOLON} AS BIGINT) AS tricolons,
  regexp_matches(lower(coalesce(sents[1], '')), '\\b(is|are|was|were|be|been|being) [a-z]+(ed|en)\\b') AS passive_opening FROM s"""


_CASE_TEXTS = f"SELECT doc_id, 's' AS source, 'en' AS lang, text AS raw FROM {_values(list(enumerate([*DRAFTS, *CASES])), 'doc_id', 'text')}"
_CUES = " ".join(f"WHEN regexp_matches(lower(rule), {sql.lit(p)}) THEN '{k}'" for k, p in rules._CUES)
_BANDS = _values(compare.BANDS, "band", "low", "high")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        features_long, register_pivot, profile_diff, unsupported_rules, mined_rules, baseline_rules, approved_rules, negative_space, ban_scan, ban_scan_cases, corrective_targets, soft_checks,
        soft_check_cases, cue_rule_cases, verification_absolute, verification_relative, stated_preferences, latest_snapshots, regeneration_triggers, typical_registers, burrows_delta, exemplar_passages,
        nominal_suffixes, deep_syntax_cases, tag_pair_cases,
    )
}

_UNCLEAN = sql.lit(exemplars._UNCLEAN)
SQL: dict[str, str] = {
    "features_long": f"SELECT source, feature, round(value, 6) AS value FROM {long_sql()}",
    "register_pivot": f"""WITH lf AS {long_sql("lang")} SELECT feature, {", ".join(f"round(max(value) FILTER (lang = '{x}'), 6) AS {x}" for x in LANGS)} FROM lf
WHERE feature IN ({", ".join(f"'{f}'" for f in compare.COMPARED)}) GROUP BY feature""",
    "profile_diff": f"WITH {_diff(_DOCS, _BENCH)} SELECT feature, {_r('old_value')}, {_r('new_value')}, {_r('change')}, significant, appeared FROM diff",
    "unsupported_rules": f"""WITH {_diff(_BENCH, _DOCS)}, {_MINED.format(lf="(SELECT 'benchmark' AS source, feature, value FROM o)")}
SELECT feature, rule AS rule_id, {_r("new_value")} FROM mined JOIN diff USING (feature) WHERE value = 0 AND appeared""",
    "mined_rules": f"WITH {_MINED.format(lf=long_sql())} SELECT source, feature, round(value, 6) AS value, rule, confidence FROM mined",
    "baseline_rules": f"""WITH j AS (SELECT a.source, a.feature, a.value, b.value AS baseline FROM {long_sql()} a JOIN {long_sql(source=_ALL)} b USING (feature) WHERE b.value > 0)
SELECT source, feature, round(value, 6) AS value, round(baseline, 6) AS baseline, CASE WHEN value / baseline < {rules.RARE} THEN 'rarely' ELSE 'frequently' END AS verdict
FROM j WHERE value / baseline < {rules.RARE} OR value / baseline > {rules.FREQUENT}""",
    "approved_rules": f"""WITH {_MINED.format(lf=long_sql())}
SELECT source || ':' || feature AS rule_id, rule, confidence FROM mined WHERE source || ':' || feature NOT IN ({", ".join(map(sql.lit, REJECTED))})""",
    "negative_space": f"""WITH {sql.base()}, t AS (SELECT source, sum(len(list_filter({_SIZES}, lambda n: n < 8))) AS staccato, sum({_TRICOLON}) AS tricolon, sum({sql.occurrences("prose", "?")}) AS questions,
  sum({sql.among("words", lexicons.SECOND_PERSON)}) AS second_person, sum({sql.occurrences("prose", ":")}) AS announcement_colon FROM d GROUP BY source)
SELECT source, {", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in _NEGATIVE)}, {", ".join(f"{n} = 0 AS no_{n}" for n in _NEGATIVE)} FROM t""",
    "ban_scan": _scan(f"(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM {_values(list(enumerate(DRAFTS)), 'doc_id', 'text')})"),
    "ban_scan_cases": _scan(_values(list(enumerate(DRAFTS)), "doc_id", "text")),
    "corrective_targets": " UNION ALL ".join(
        f"SELECT doc_id, {sql.lit(n)} AS pattern, CAST({sql.occurrences('lower(text)', p)} AS BIGINT) AS found, CAST({t} AS INTEGER) AS target, {sql.occurrences('lower(text)', p)} <= {t} AS passed FROM documents WHERE text IS NOT NULL"
        for n, p, t in TARGETS
    ),
    "soft_checks": _soft(),
    "soft_check_cases": _soft(_CASE_TEXTS),
    "cue_rule_cases": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS rule, unnest(range(len(string_split(text, chr(10))))) AS line FROM {_values(list(enumerate(RULE_TEXTS)), "doc_id", "text")}),
k AS (SELECT doc_id, line, trim(rule) AS rule, CASE {_CUES} END AS kind FROM l) SELECT * FROM k WHERE kind IS NOT NULL""",
    "verification_absolute": _verify("absolute"),
    "verification_relative": _verify("relative"),
    "stated_preferences": f"""WITH s AS (SELECT * FROM {_values(STATED, "feature", "stated")})
SELECT feature, round(coalesce(stated, value), 6) AS value, CASE WHEN stated IS NULL THEN 'measured' ELSE 'stated' END AS origin FROM {long_sql(source=_DOCS)} LEFT JOIN s USING (feature)""",
    "latest_snapshots": f"""WITH r AS (SELECT voice, snapshot_date, CAST(row_number() OVER (PARTITION BY voice ORDER BY snapshot_date DESC) AS INTEGER) AS rank FROM {_values(SNAPSHOTS, "voice", "snapshot_date")})
SELECT * FROM r WHERE rank <= 2""",
    "regeneration_triggers": f"""WITH s AS (SELECT voice, new_words, corrections, new_words > 5000 AS grown, CAST(day AS DATE) + INTERVAL 6 MONTH < DATE '{TODAY}' AS old, corrections > 2 AS wrong FROM {_values(STATES, "voice", "new_words", "day", "corrections")})
SELECT *, grown OR old OR wrong AS due FROM s""",
    "typical_registers": f"""WITH {sql.base()}, m AS (SELECT source, round(mean, 6) AS mean_words FROM ({sql.stats("source", sql.SENTENCE_SIZES)}))
SELECT source, mean_words, band FROM m LEFT JOIN {_BANDS} ON mean_words BETWEEN low AND high""",
    "burrows_delta": f"""WITH {sql.base()}, w AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM d) GROUP BY lang, word), t AS (SELECT lang, sum(n) AS tokens FROM w GROUP BY lang),
f AS (SELECT lang, word, n::DOUBLE / tokens * 1000 AS rate FROM w JOIN t USING (lang) WHERE list_contains({sql.items(lexicons.FUNCTION_WORDS)}, word)),
g AS (SELECT l.lang, x.word, coalesce(f.rate, 0) AS rate FROM (SELECT DISTINCT lang FROM f) l CROSS JOIN (SELECT DISTINCT word FROM f) x LEFT JOIN f ON f.lang = l.lang AND f.word = x.word),
s AS (SELECT word, avg(rate) AS m, stddev_pop(rate) AS sd FROM g GROUP BY word), z AS (SELECT lang, word, (rate - m) / sd AS z FROM g JOIN s USING (word) WHERE sd > 0)
SELECT a.lang AS register_a, b.lang AS register_b, round(avg(abs(a.z - b.z)), 6) AS delta FROM z a JOIN z b ON a.word = b.word AND a.lang < b.lang GROUP BY a.lang, b.lang""",
    "exemplar_passages": f"""WITH p AS (SELECT source, doc_id, unnest({sql.paragraphs("text")}) AS p, unnest(range(len({sql.paragraphs("text")}))) AS place FROM documents WHERE text IS NOT NULL),
z AS (SELECT source, doc_id, p, place, len({sql.words("p")}) AS n_words, greatest(len({sql.sentences("p")}), 1) AS n_sentences, {sql.occurrences("p", ",")} AS commas FROM p),
q AS (SELECT *, n_words::DOUBLE / n_sentences AS l, commas::DOUBLE / n_words AS c FROM z WHERE n_words > 0),
m AS (SELECT source, avg(l) AS ml, avg(c) AS mc, stddev_pop(l) AS sl, stddev_pop(c) AS sc FROM q GROUP BY source),
k AS (SELECT source, doc_id, place, n_words, round(abs(l - ml) / CASE WHEN sl > 0 THEN sl ELSE 1 END + abs(c - mc) / CASE WHEN sc > 0 THEN sc ELSE 1 END, 6) AS distance FROM q JOIN m USING (source)
  WHERE n_words BETWEEN {exemplars.LEAST_WORDS} AND {exemplars.MOST_WORDS} AND regexp_matches(p, '(?s)^[A-Z"''(].*[.!?]["'')]?$') AND NOT regexp_matches(p, {_UNCLEAN})),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY distance, place) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, doc_id, place) AS rank FROM o)
SELECT source, CASE WHEN rank <= 5 THEN 'exemplar' ELSE 'held out' END AS role, CAST(rank AS INTEGER) AS rank, doc_id, CAST(place AS INTEGER) AS place, CAST(n_words AS INTEGER) AS n_words, distance FROM r WHERE rank <= 8""",
    "nominal_suffixes": f"""WITH {sql.base()}, t AS (SELECT source, CAST(sum(len(list_filter(words, lambda w: regexp_matches(w, '({"|".join(parsed.NOMINAL_SUFFIXES)})$')))) AS BIGINT) AS nominal, sum(len(words)) AS n FROM d GROUP BY source)
SELECT source, nominal, CAST(nominal AS DOUBLE) / greatest(n, 1) * 1000 AS nominal_suffix_per_1000w FROM t""",
    "deep_syntax_cases": f"""WITH RECURSIVE t AS (SELECT * FROM {_values(PARSED, "source", "sentence", "pos", "head", "tag", "dep", "lemma")}),
walk AS (SELECT source, sentence, pos AS start, pos, 0 AS hops FROM t UNION ALL SELECT w.source, w.sentence, w.start, t.head, w.hops + 1 FROM walk w JOIN t ON t.source = w.source AND t.sentence = w.sentence AND t.pos = w.pos WHERE t.head <> t.pos AND w.hops < 50),
depth AS (SELECT source, sentence, max(hops) AS depth FROM walk GROUP BY source, sentence), average AS (SELECT source, avg(depth) AS depth, count(*) AS sentences FROM depth GROUP BY source),
passive AS (SELECT source, count(*) AS k FROM t v WHERE tag = 'VERB' AND EXISTS (SELECT 1 FROM t c WHERE c.source = v.source AND c.sentence = v.sentence AND c.head = v.pos AND c.pos <> v.pos AND c.dep IN ('nsubjpass', 'auxpass')) GROUP BY source),
nouns AS (SELECT source, count(*) AS n, count_if(tag = 'NOUN' AND regexp_matches(lemma, '({"|".join(parsed.NOMINAL_SUFFIXES)})$')) AS k FROM t GROUP BY source)
SELECT source, round(depth, 6) AS avg_dependency_depth, round(coalesce(passive.k, 0) / sentences, 6) AS passive_ratio, round(nouns.k / nouns.n * 1000, 6) AS nominalization_per_1000w FROM average JOIN nouns USING (source) LEFT JOIN passive USING (source)""",
    "tag_pair_cases": f"""WITH t AS (SELECT * FROM {_values(PARSED, "source", "sentence", "pos", "head", "tag", "dep", "lemma")}),
p AS (SELECT a.source, a.tag || '+' || b.tag AS pos_bigram, count(*) AS n, min((a.sentence, a.pos)) AS first FROM t a JOIN t b ON a.source = b.source AND a.sentence = b.sentence AND b.pos = a.pos + 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM p) SELECT source, CAST(rank AS INTEGER) AS rank, pos_bigram, n FROM r WHERE rank <= 20""",
}
