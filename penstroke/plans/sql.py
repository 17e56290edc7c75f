"""DuckDB SQL for the semantics of the measures, written with other means than the Spark plans where possible: words by
trimming wider runs, sentences by masking and marking, windows by brute force."""

from __future__ import annotations

from functools import reduce

from penstroke.functions import clean, counts, lexicons


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(words: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def _pattern(java: str) -> str:
    return java.replace("(?sU)", "(?s)").replace("(?mdU)", "(?m)").replace("(?md)", "(?m)").replace("(?U)", "").replace("(?mU)", "(?m)")


def chain(x: str, steps: list[tuple[str, str]]) -> str:
    return strip(reduce(lambda c, s: f"regexp_replace({c}, {lit(_pattern(s[0]))}, {lit(s[1].replace('$1', chr(92) + '1'))}, 'g')", steps, x))


def prose(x: str) -> str:
    return chain(x, clean.MARKDOWN_STEPS)


def turn(x: str) -> str:
    return chain(x, clean.TURN_STEPS)


def words(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z''-]+'), lambda w: lower(trim(w, '''-'))), lambda w: w <> '')"


def sentences(x: str) -> str:
    dot = "chr(57344)"
    x = f"replace(replace({x}, 'e.g.', 'e' || {dot} || 'g' || {dot}), 'i.e.', 'i' || {dot} || 'e' || {dot})"
    x = rf"regexp_replace({x}, '\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|fig|al|cf)[.]', '\1' || {dot}, 'g')"
    x = rf"""string_split(regexp_replace({x}, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
    return f"list_filter(list_transform({x}, lambda s: {strip(f'replace(s, {dot}, {lit(chr(46))})')}), lambda s: length(s) > 3)"


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '\n{{2,}}', chr(1), 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def occurrences(x: str, literal: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(literal)}, ''))) // {len(literal)}"


def among(x: str, terms: list[str]) -> str:
    return f"len(list_filter({x}, lambda w: list_contains({items(terms)}, w)))"


def base(source: str = "SELECT doc_id, source, lang, text AS raw FROM documents WHERE text IS NOT NULL") -> str:
    """CTEs up to ``d``: raw, prose, words, sents (as word lists: sw), paras."""
    return f"""
raw_docs AS ({source}),
prosed AS (SELECT *, {prose("raw")} AS prose FROM raw_docs),
cut AS (SELECT *, {words("prose")} AS words, {sentences("prose")} AS sents, {paragraphs("prose")} AS paras FROM prosed),
d AS MATERIALIZED (SELECT *, list_transform(sents, lambda s: {words("s")}) AS sw, list_transform(paras, lambda p: len({words("p")})) AS ps FROM cut)"""


def count_columns() -> dict[str, str]:
    """The additive counts over ``d``, without the window measures."""
    out = {"word_count": "len(words)", "sentence_count": "len(sents)", "paragraph_count": "len(paras)", "char_count": "length(prose)"}
    out |= {name: " + ".join(occurrences("prose", x) for x in literals) for name, literals in counts.MARKS.items()}
    hedges = " + ".join(occurrences("lower(prose)", p) for p in lexicons.HEDGE_PHRASES)
    out["hedge"] = f"{among('words', lexicons.HEDGES)} + {hedges}"
    for name, terms in (("boost", lexicons.BOOSTERS), ("first_sg", lexicons.FIRST_SINGULAR), ("first_pl", lexicons.FIRST_PLURAL), ("second", lexicons.SECOND_PERSON), ("third", lexicons.THIRD_PERSON)):
        out[name] = among("words", terms)
    out["concession"] = f"len(list_filter(sw, lambda s: list_has_any(s, {items(lexicons.CONCESSIONS)})))"
    lines = r"string_split(raw, chr(10))"
    out |= {
        "total_lines": f"len({lines})", "bullet_lines": rf"len(list_filter({lines}, lambda x: regexp_matches(x, '^\s*[-*+]\s')))",
        "heading_lines": rf"len(list_filter({lines}, lambda x: regexp_matches(x, '^#{{1,6}}\s')))", "code_fences": "len(regexp_extract_all(raw, '(?s)```.*?```'))",
    }
    return {k: f"CAST({v} AS BIGINT)" for k, v in out.items()}


def window_columns(width: int = counts.WINDOW) -> dict[str, str]:
    """Window measures over ``d`` by brute force."""
    w = f"least(len(words), {width})"
    types = f"list_sum(list_transform(range(0, len(words) - {w} + 1), lambda i: len(list_distinct(list_slice(words, i + 1, i + {w})))))"
    return {"window_types": f"CAST(CASE WHEN len(words) = 0 THEN 0 ELSE {types} END AS BIGINT)", "window_places": f"CAST({w} * (len(words) - {w} + 1) AS BIGINT)"}


def totals(by: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in [*count_columns(), *window_columns()]) + f" FROM counted GROUP BY {by}"


def counted(keep: str) -> str:
    """CTE ``counted``: every count of every document."""
    return "counted AS MATERIALIZED (SELECT " + keep + ", " + ", ".join(f"{v} AS {k}" for k, v in (count_columns() | window_columns()).items()) + " FROM d)"


def rate_columns() -> dict[str, str]:
    def per(a: str, b: str, times: int = 1) -> str:
        share = f"CAST({a} AS DOUBLE) / greatest({b}, 1)"
        return f"{share} * {times}" if times != 1 else share

    out = {"mattr_window100": per("window_types", "window_places"), "concession_rate": per("concession", "sentence_count"), "comma_per_sentence": per("comma", "sentence_count")}
    out |= {f"{m}_per_1000w": per(m, "word_count", 1000) for m in counts.MARKS}
    out |= {"hedge_per_100w": per("hedge", "word_count", 100), "boost_per_100w": per("boost", "word_count", 100), "hedge_boost_ratio": per("hedge", "boost")}
    out |= {f"{p}_per_100w": per(p, "word_count", 100) for p in ("first_sg", "first_pl", "second", "third")}
    out |= {"first_pl_to_sg_ratio": per("first_pl", "first_sg"), "bullet_ratio": per("bullet_lines", "total_lines"), "heading_density_per_1000_words": per("heading_lines", "word_count", 1000)}
    return out


def rates(by: str, total: str = "total") -> str:
    return f"SELECT {by}, " + ", ".join(f"{v} AS {k}" for k, v in rate_columns().items()) + f" FROM {total}"


def stats(by: str, sizes: str, table: str = "d") -> str:
    """Length statistics by sorting each scope's whole list."""
    return f"""
SELECT {by}, len(x) AS n, CAST(list_sum(x) AS DOUBLE) / len(x) AS mean,
  (x[(len(x) - 1) // 2 + 1] + x[len(x) // 2 + 1]) / 2 AS median,
  CASE WHEN len(x) > 1 THEN sqrt(CAST(list_sum(list_transform(x, lambda v: v * v)) * len(x) - list_sum(x) * list_sum(x) AS DOUBLE) / (len(x) * (len(x) - 1))) ELSE 0.0 END AS stdev,
  x[len(x) // 4 + 1] AS q1, x[3 * len(x) // 4 + 1] AS q3, x[1] AS min, x[-1] AS max,
  CAST(len(list_filter(x, lambda v: v <= 5)) AS DOUBLE) / len(x) AS share_short, CAST(len(list_filter(x, lambda v: v >= 30)) AS DOUBLE) / len(x) AS share_long
FROM (SELECT {by}, list_sort(list(v)) AS x FROM (SELECT {by}, CAST(unnest({sizes}) AS BIGINT) AS v FROM {table}) WHERE v > 0 GROUP BY {by})"""


SENTENCE_SIZES = "list_transform(sw, lambda s: len(s))"
