"""Style measures and profiles of any scope: a document, a register (any grouping), or a concatenated corpus.

``measure`` is narrow: one row a document with its arrays and counts. Counts add up, so a scope's totals are one
partial aggregation; length statistics come from histograms, word lists from (scope, word) counts, both summed up within
Arrow batches before they meet. Nothing is shuffled but these aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, IntegerType, LongType, StringType, StructType
from pyspark.sql.window import Window

from penstroke.functions import clean, counts, lexicons, segment

from . import tokens

#: Word lists that are counted by their name.
LISTS = {
    "hedge": lexicons.HEDGES, "boost": lexicons.BOOSTERS, "first_sg": lexicons.FIRST_SINGULAR,
    "first_pl": lexicons.FIRST_PLURAL, "second": lexicons.SECOND_PERSON, "third": lexicons.THIRD_PERSON,
}

_MARKED = sorted({w for terms in LISTS.values() for w in terms})

#: Additive counts of a document, in the order of ``totals``.
COUNTS = [
    "word_count", "sentence_count", "paragraph_count", "char_count", "window_types", "window_places",
    *counts.MARKS, *LISTS, "concession", "total_lines", "bullet_lines", "heading_lines", "code_fences",
]


def corpus(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a scope: its texts joined by blank lines, in order. Blank texts are left out.

    Sentences and windows then cross document ends, and only the first front matter is stripped. A scope must fit one
    row; use it for parity on single authors, and the additive scopes for everything else.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")
    return docs.where(clean.strip(F.col(text)) != "").groupBy(*by).agg(F.min(order).alias(order), joined.alias(text))


def measure(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """``by, ord, prose, words, sentences, sentence_words, paragraph_sizes`` and ``COUNTS`` of every document with a text."""
    scope = [F.col(c).alias(c) for c in by]
    base = docs.where(F.col(text).isNotNull()).select(*scope, F.col(order).alias("ord"), F.col(text).alias("raw"), clean.strip_markdown(F.col(text)).alias("prose"))
    prose = F.col("prose")
    cut = base.select("*", segment.words(prose).alias("words"), segment.pieces(prose).alias("pieces"), segment.paragraphs(prose).alias("paragraphs"), segment.lines(F.col("raw")).alias("raw_lines"))
    cut = cut.withColumn("sentences", segment.long_enough(F.col("pieces"))).select(
        "*", F.transform("sentences", segment.words).alias("sentence_words"), F.transform("paragraphs", lambda p: F.size(segment.words(p))).alias("paragraph_sizes"),
        counts.window_types(F.col("words")).alias("__w"),
    )
    # one pass over all words, then one over the few marked ones for each class
    cut = cut.withColumn("marked", F.filter("words", lambda w: w.isin(_MARKED)))
    lists = {name: counts.in_list(F.col("marked"), terms) for name, terms in LISTS.items()}
    cut = cut.withColumn("hedge_phrases", counts.hedge_phrases(prose))
    lists["hedge"] = lists["hedge"] + F.col("hedge_phrases")
    concession = F.size(F.filter("sentence_words", lambda s: F.exists(s, lambda w: w.isin(lexicons.CONCESSIONS))))
    values = {
        "word_count": F.size("words"), "sentence_count": F.size("sentences"), "paragraph_count": F.size("paragraphs"), "char_count": F.length("prose"),
        "window_types": F.col("__w.types"), "window_places": F.col("__w.places"), **counts.marks(prose), **lists, "concession": concession,
        **given(F.col("raw"), F.col("raw_lines")),
    }
    kept = [*by, "ord", "prose", "words", "sentences", "sentence_words", "pieces", "paragraphs", "paragraph_sizes", "hedge_phrases"]
    return cut.select(*kept, F.col("__w.hapax").alias("hapax"), *[v.cast("long").alias(k) for k, v in values.items()])


#: Counts of ``measure`` that the kernels take as they are; they find the others in the prose.
_GIVEN = ["total_lines", "bullet_lines", "heading_lines", "code_fences"]


def given(raw: Column, lines: Column | None = None) -> dict[str, Column]:
    """The counts that need the raw text."""
    lines = segment.lines(raw) if lines is None else lines
    return {"total_lines": F.size(lines).cast("long"), "bullet_lines": counts.bullet_lines(lines), "heading_lines": counts.heading_lines(lines), "code_fences": counts.fences(raw)}


def counted(measured: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``COUNTS`` and ``hapax`` of every document, by the Arrow kernel: as those of ``measure``, in far less time."""
    texts = measured.select(*by, "prose", *_GIVEN)
    out = StructType([texts.schema[c] for c in by])
    for name in [*COUNTS, "hapax"]:
        out = out.add(name, LongType())
    return texts.mapInArrow(tokens.count_documents(LISTS, counts.WINDOW, to_arrow_schema(out)), out)


def totals(measured: DataFrame, by: list[str]) -> DataFrame:
    """``COUNTS`` summed by scope."""
    return counted(measured, by).groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])


def _per(part: str, whole: str, times: int = 1) -> Column:
    share = F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return share * times if times != 1 else share


def rate_columns() -> dict[str, Column]:
    """Every rate and ratio that follows from the totals, as Columns over ``COUNTS``."""
    return {
        "mattr_window100": _per("window_types", "window_places"),
        "concession_rate": _per("concession", "sentence_count"),
        "comma_per_sentence": _per("comma", "sentence_count"),
        **{f"{m}_per_1000w": _per(m, "word_count", 1000) for m in counts.MARKS},
        "hedge_per_100w": _per("hedge", "word_count", 100), "boost_per_100w": _per("boost", "word_count", 100), "hedge_boost_ratio": _per("hedge", "boost"),
        **{f"{p}_per_100w": _per(p, "word_count", 100) for p in ("first_sg", "first_pl", "second", "third")}, "first_pl_to_sg_ratio": _per("first_pl", "first_sg"),
        "bullet_ratio": _per("bullet_lines", "total_lines"), "heading_density_per_1000_words": _per("heading_lines", "word_count", 1000),
    }


def rates(total: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the rates; an empty scope gives 0, never null."""
    return total.select(*by, *[c.alias(n) for n, c in rate_columns().items()])


def _place(rows: DataFrame) -> Column:
    """``ord`` and ``pos`` as one value in their order: a number for an integral ``ord``, which a hash aggregation can
    take the least of; else a struct."""
    if not isinstance(rows.schema["ord"].dataType, IntegralType):
        return F.struct("ord", "pos")
    return (F.col("ord").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")).cast("decimal(38,0)")


def _counted(measured: DataFrame, by: list[str], totals: bool = False, among: list[str] | None = None, places: bool = True) -> DataFrame:
    """``by, word, n``, of the words ``among`` if given, and ``first`` with ``places``; with ``totals`` also a row without a
    word for all words of a scope.

    Words are counted within Arrow batches first.
    """
    texts = measured.select(*by, *["ord"] * places, "prose")
    kinds = texts.schema
    out = StructType([*[kinds[c] for c in by]]).add("word", StringType()).add("n", LongType())
    if places:
        out = out.add("ord", kinds["ord"].dataType).add("pos", IntegerType())
    counted = texts.mapInArrow(tokens.count_words(by, to_arrow_schema(out), totals, among, places), out)
    return counted.groupBy(*by, "word").agg(F.sum("n").alias("n"), *([F.min(_place(counted)).alias("first")] if places else []))


def word_counts(measured: DataFrame, by: list[str], places: bool = True) -> DataFrame:
    """``by, word, n, first``: occurrences, and the place of the first one, which settles ties, unless it isn't wanted."""
    return _counted(measured, by, places=places)


def hapax(word_count: DataFrame, by: list[str]) -> DataFrame:
    """``by, hapaxes, tokens``: words that occur once, and all tokens."""
    return word_count.groupBy(*by).agg(F.sum((F.col("n") == 1).cast("long")).alias("hapaxes"), F.sum("n").alias("tokens"))


def _top(counted: DataFrame, by: list[str], limit: int) -> DataFrame:
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= limit)


def ranked_words(measured: DataFrame, by: list[str], chosen: Column | list[str], limit: int) -> DataFrame:
    """``by, rank, word, n, tokens`` of the most frequent words among the chosen (a condition, or the words themselves); the
    row of the total ranks first, so that one aggregation and one window hold both. Scopes of which a part is null are left
    out."""
    among = chosen if isinstance(chosen, list) else None
    counted = _counted(measured.dropna(subset=by), by, True, among)
    if among is None:
        counted = counted.where(F.col("word").isNull() | chosen)
    scope = Window.partitionBy(*by)
    ranked = counted.withColumn("rank", F.row_number().over(scope.orderBy(F.col("word").isNull().desc(), F.desc("n"), "first"))).where(F.col("rank") <= limit + 1)
    ranked = ranked.withColumn("tokens", F.max(F.when(F.col("word").isNull(), F.col("n"))).over(scope))
    return ranked.where("word IS NOT NULL").select(*by, (F.col("rank") - 1).alias("rank"), "word", "n", "tokens")


def _rated(ranked: DataFrame, by: list[str]) -> DataFrame:
    return ranked.select(*by, "rank", "word", "n", (F.col("n") / F.col("tokens") * 1000).alias("per_1000"))


def function_words(measured: DataFrame, by: list[str], limit: int = 50) -> DataFrame:
    return _rated(ranked_words(measured, by, lexicons.FUNCTION_WORDS, limit), by)


def content_words(measured: DataFrame, by: list[str], limit: int = 30) -> DataFrame:
    """Most frequent words longer than two letters that aren't function words; rates are over all tokens."""
    return _rated(ranked_words(measured, by, ~F.col("word").isin(lexicons.FUNCTION_WORDS) & (F.length("word") > 2), limit), by)


def sentence_initials(measured: DataFrame, by: list[str], limit: int = 20) -> DataFrame:
    opened = measured.select(*by, "ord", F.posexplode(F.transform(F.filter("sentence_words", lambda s: F.size(s) > 0), lambda s: s[0])).alias("pos", "word"))
    counted = opened.groupBy(*by, "word").agg(F.count("*").alias("n"), F.min(_place(opened)).alias("first"))
    return _top(counted, by, limit).select(*by, "rank", "word", "n")


def length_stats(measured: DataFrame, by: list[str], sizes: Column) -> DataFrame:
    """Statistics of the positive sizes in an array column, from their histogram by scope.

    Quartiles are the elements at n / 4 and 3 n / 4 of the sorted list, without interpolation; the deviation is that of
    a sample, 0 for a single value.
    """
    histogram = measured.select(*by, F.explode(sizes).alias("x")).where("x > 0").groupBy(*by, "x").agg(F.count("*").alias("k"))
    scope = Window.partitionBy(*by)
    run = histogram.withColumn("upto", F.sum("k").over(scope.orderBy("x"))).withColumn("n", F.sum("k").over(scope))
    x, k, n = F.col("x"), F.col("k"), F.col("n")

    def at(index: str) -> Column:
        return F.min(F.when(F.col("upto") > F.expr(index), x))

    stats = run.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(x * k).alias("total"), F.sum(x * x * k).alias("squares"), at("(n - 1) div 2").alias("low"), at("n div 2").alias("high"),
        at("n div 4").alias("q1"), at("3 * n div 4").alias("q3"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(F.when(x <= 5, k).otherwise(0)).alias("short"), F.sum(F.when(x >= 30, k).otherwise(0)).alias("long"),
    )
    spread = F.greatest(F.col("squares") * n - F.col("total") * F.col("total"), F.lit(0)) / (n * (n - 1))
    return stats.select(
        *by, n.alias("n"), (F.col("total") / n).alias("mean"), ((F.col("low") + F.col("high")) / 2).alias("median"),
        F.when(n > 1, F.sqrt(F.when(n > 1, spread))).otherwise(0.0).alias("stdev"), "q1", "q3", "min", "max", (F.col("short") / n).alias("share_short"), (F.col("long") / n).alias("share_long"),
    )


def sentence_stats(measured: DataFrame, by: list[str]) -> DataFrame:
    return length_stats(measured, by, F.transform("sentence_words", F.size))


def paragraph_stats(measured: DataFrame, by: list[str]) -> DataFrame:
    return length_stats(measured, by, F.col("paragraph_sizes")).select(*by, "n", "mean", "median", "stdev")


def readability(measured: DataFrame, by: list[str]) -> DataFrame:
    """Published readability formulas over approximate syllables (vowel groups)."""
    counted = measured.select(
        *by, "word_count", "sentence_count", F.aggregate("words", F.lit(0), lambda a, w: a + counts.syllables(w)).alias("syllables"),
        F.size(F.filter("words", lambda w: counts.syllables(w) >= 3)).alias("complex"),
    )
    t = counted.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("word_count", "sentence_count", "syllables", "complex")])
    per_sentence, per_word, hard = _per("word_count", "sentence_count"), _per("syllables", "word_count"), _per("complex", "word_count")
    return t.select(
        *by, "syllables", "complex", (0.39 * per_sentence + 11.8 * per_word - 15.59).alias("flesch_kincaid_grade_approx"),
        (0.4 * (per_sentence + 100 * hard)).alias("gunning_fog_approx"), (206.835 - 1.015 * per_sentence - 84.6 * per_word).alias("flesch_reading_ease_approx"),
        per_word.alias("avg_syllables_per_word_approx"),
    )


def _stats_of(histogram: Column, prefix: str) -> dict[str, Column]:
    """Length statistics from a sorted ``array<struct<x, k>>``; null for an empty one."""
    n = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, h: a + h["k"])
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, h: a + h["x"] * h["k"])
    squares = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, h: a + h["x"] * h["x"] * h["k"])

    def share(test: Callable[[Column], Column]) -> Column:
        return F.aggregate(histogram, F.lit(0).cast("long"), lambda a, h: a + F.when(test(h["x"]), h["k"]).otherwise(0)) / F.col(f"{prefix}n")

    def at(index: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("x"))
        step = F.aggregate(histogram, start, lambda a, h: F.struct((a["upto"] + h["k"]).alias("upto"), F.when(a["x"].isNull() & (a["upto"] + h["k"] > index), h["x"]).otherwise(a["x"]).alias("x")))
        return step["x"]

    count = F.col(f"{prefix}n")
    spread = F.greatest(F.col(f"{prefix}squares") * count - F.col(f"{prefix}total") * F.col(f"{prefix}total"), F.lit(0)) / (count * (count - 1))
    return {
        f"{prefix}n": F.when(n > 0, n), f"{prefix}total": total, f"{prefix}squares": squares, f"{prefix}mean": F.col(f"{prefix}total") / count,
        f"{prefix}median": (at(F.expr(f"({prefix}n - 1) div 2")) + at(F.expr(f"{prefix}n div 2"))) / 2,
        f"{prefix}stdev": F.when(count > 1, F.sqrt(F.when(count > 1, spread))).when(count == 1, 0.0),
        f"{prefix}q1": at(F.expr(f"{prefix}n div 4")), f"{prefix}q3": at(F.expr(f"3 * {prefix}n div 4")), f"{prefix}min": F.get(histogram, 0)["x"], f"{prefix}max": F.get(F.reverse(histogram), 0)["x"],
        f"{prefix}short": share(lambda x: x <= 5), f"{prefix}long": share(lambda x: x >= 30),
    }


def _facts(measured: DataFrame, by: list[str]) -> DataFrame:
    """``by, kind, key, n``: counts by name, words, sentence and paragraph sizes of a scope, all from one pass, summed up
    within Arrow batches first."""
    texts = measured.select(*by, "prose", *_GIVEN)
    out = StructType([*[texts.schema[c] for c in by]]).add("kind", StringType()).add("key", StringType()).add("n", LongType())
    found = texts.mapInArrow(tokens.profile_facts(by, _GIVEN, LISTS, counts.WINDOW, to_arrow_schema(out)), out)
    return found.groupBy(*by, "kind", "key").agg(F.sum("n").alias("n"))


def scalars(measured: DataFrame, by: list[str]) -> DataFrame:
    """Every scalar feature of a scope in one row.

    The documents are read and measured once, see ``_scalars``.
    """
    return _scalars(_facts(measured, by), by)


def scalars_and_whole(measured: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``scalars`` of every scope, and of all of them as one under the same columns, which are null there. Both come from
    one table of facts, so that the documents are measured once."""
    facts = _facts(measured, by)
    whole = facts.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return _scalars(facts, by), _scalars(whole.select(*[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in by], "kind", "key", "n"), by)


def _scalars(facts: DataFrame, by: list[str]) -> DataFrame:
    """Every scalar feature of a scope from its facts.

    All counts meet in one aggregation by (scope, kind, key), whose result is as large as the vocabulary. Of its words only the number of those that occur once goes on, to the aggregation by scope.
    """
    kind, key, n = F.col("kind"), F.col("key"), F.col("n")
    word = kind == "word"
    found = facts.where(~word | (n == 1))
    found = found.select(*by, F.when(word, "count").otherwise(kind).alias("kind"), F.when(word, "hapaxes").otherwise(key).alias("key"), "n")
    found = found.groupBy(*by, "kind", "key").agg(F.sum("n").alias("n"))

    def histogram(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(kind == name, F.struct(key.try_cast("long").alias("x"), n.alias("k")))))

    total = found.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when((kind == "count") & (key == c), n)), F.lit(0)).alias(c) for c in [*COUNTS, "hapaxes"]], histogram("sentence").alias("__s"), histogram("paragraph").alias("__p"),
    )
    for prefix, hist in (("s_", "__s"), ("p_", "__p")):
        found = _stats_of(F.col(hist), prefix)
        for step in (["n"], ["total", "squares"], ["mean", "median", "stdev", "q1", "q3", "min", "max", "short", "long"]):
            total = total.select("*", *[found[prefix + c].alias(prefix + c) for c in step])
    basic = ["word_count", "sentence_count", "paragraph_count", "char_count", "total_lines", "bullet_lines", "heading_lines", "code_fences"]
    sentence = {"n": "counted_sentences", "mean": "mean_words", "median": "median_words", "stdev": "stdev_words", "q1": "q1_words", "q3": "q3_words", "min": "min_words", "max": "max_words", "short": "pct_short_le5", "long": "pct_long_ge30"}
    paragraph = {"n": "counted_paragraphs", "mean": "paragraph_mean_words", "median": "paragraph_median_words", "stdev": "paragraph_stdev_words"}
    return total.select(
        *by, *basic, *[c.alias(name) for name, c in rate_columns().items()], _per("hapaxes", "word_count").alias("hapax_ratio"),
        *[F.col(f"s_{k}").alias(v) for k, v in sentence.items()], *[F.col(f"p_{k}").alias(v) for k, v in paragraph.items()],
    )


def features_long(scalar: DataFrame, by: list[str]) -> DataFrame:
    """``by, feature, value``: one row a scalar."""
    names = [c for c in scalar.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return scalar.select(*by, F.inline(pairs))


def profiles(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """Nested profile of every scope, with its ranked word lists."""
    measured = measure(docs, by, order, text)

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        ranked = F.sort_array(F.collect_list(F.struct("rank", *columns)))
        return df.groupBy(*by).agg(F.transform(ranked, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))

    row = scalars(measured, by)
    for part in (
        listed(content_words(measured, by), "content", "word", "n", "per_1000"),
        listed(function_words(measured, by), "functional", "word", "per_1000"),
        listed(sentence_initials(measured, by), "initials", "word", "n"),
    ):
        row = row.join(part, by, "left")

    def group(name: str, *columns: str, **renamed: Column) -> Column:
        return F.struct(*[F.col(c).alias(c) for c in columns], *[v.alias(k) for k, v in renamed.items()]).alias(name)

    count_list = F.transform("content", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("count"), x["per_1000"].alias("per_1000")))
    initials = F.transform("initials", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("count")))
    return row.select(
        *by,
        group("corpus_stats", "word_count", "sentence_count", "paragraph_count", "char_count"),
        group("lexical", "mattr_window100", "hapax_ratio", distinctive_content_words=count_list, function_word_profile=F.col("functional")),
        group(
            "syntactic",
            sentence_stats=F.struct(F.col("counted_sentences").alias("sentence_count"), *["mean_words", "median_words", "stdev_words", "q1_words", "q3_words", "min_words", "max_words", "pct_short_le5", "pct_long_ge30"]),
            sentence_initial_patterns=initials,
            paragraph_stats=F.struct(F.col("counted_paragraphs").alias("paragraph_count"), F.col("paragraph_mean_words").alias("mean_words"), F.col("paragraph_median_words").alias("median_words"), F.col("paragraph_stdev_words").alias("stdev_words")),
            concession_rate=F.col("concession_rate"),
        ),
        group("punctuation", "comma_per_sentence", *[f"{m}_per_1000w" for m in counts.MARKS]),
        group("hedging_booster", "hedge_per_100w", "boost_per_100w", "hedge_boost_ratio"),
        group("pronouns", "first_sg_per_100w", "first_pl_per_100w", "second_per_100w", "third_per_100w", "first_pl_to_sg_ratio"),
        group("structural", "total_lines", "bullet_lines", "heading_lines", "code_fences", "bullet_ratio", "heading_density_per_1000_words"),
    )
