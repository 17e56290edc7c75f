"""Counts and per-text measures as Columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons

WINDOW = 100


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    gone = F.length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.length(text) - gone) / len(literal)).cast("long")


def in_list(words: Column, terms: list[str]) -> Column:
    """Number of words that are among ``terms``."""
    return F.size(F.filter(words, lambda w: w.isin(terms))).cast("long")


#: Mark classes of prose: name to literals.
MARKS = {
    "comma": [","], "em_dash": ["—", "--"], "semicolon": [";"], "colon": [":"], "parenthetical": ["("],
    "question": ["?"], "exclamation": ["!"], "ellipsis": ["..."], "en_dash": ["–"],
}


def marks(prose: Column) -> dict[str, Column]:
    return {name: reduce(add, [occurrences(prose, x) for x in literals]) for name, literals in MARKS.items()}


def hedge_phrases(prose: Column) -> Column:
    """Occurrences of the hedge phrases as substrings of the lower-cased prose; word boundaries don't count."""
    low = F.lower(prose)
    return reduce(add, [occurrences(low, p) for p in lexicons.HEDGE_PHRASES])


def bullet_lines(raw_lines: Column) -> Column:
    return F.size(F.filter(raw_lines, lambda x: x.rlike(r"(?U)^\s*[+*-]\s"))).cast("long")


def heading_lines(raw_lines: Column) -> Column:
    return F.size(F.filter(raw_lines, lambda x: x.rlike(r"(?U)^#{1,6}\s"))).cast("long")


def fences(raw: Column) -> Column:
    return F.regexp_count(raw, F.lit("(?s)`{3}.*?`{3}")).cast("long")


def window_types(words: Column, width: int = WINDOW) -> Column:
    """``struct<types, windows, hapax>`` of a word array: distinct words summed over all windows of ``width`` words (one
    window if there are fewer), the number of window places (width times windows), and words occurring once.

    A word at position p with its previous occurrence at q is new to the windows that start in (q, p], so one ordered
    pass over (word, position) suffices; there is no work for each window.
    """
    n = F.size(words)
    w = F.least(n, F.lit(width))
    last = n - w

    def step(acc: Column, x: Column) -> Column:
        same = acc["word"] == x["word"]
        before = F.when(same, acc["at"]).otherwise(F.lit(-1))
        gain = F.greatest(F.lit(0), F.least(x["at"], last) - F.greatest(before + 1, x["at"] - w + 1, F.lit(0)) + 1)
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1))
        once = acc["once"] + F.when(same & (acc["run"] == 1), F.lit(-1)).when(same, F.lit(0)).otherwise(F.lit(1))
        return F.struct(x["word"].alias("word"), x["at"].alias("at"), run.alias("run"), once.alias("once"), (acc["types"] + gain).alias("types"))

    placed = F.sort_array(F.transform(words, lambda x, i: F.struct(x.alias("word"), i.alias("at"))))
    start = F.struct(F.lit("").alias("word"), F.lit(-1).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("once"), F.lit(0).cast("long").alias("types"))
    total = F.aggregate(placed, start, step)
    return F.struct(total["types"].alias("types"), (w.cast("long") * (last + 1)).alias("places"), total["once"].cast("long").alias("hapax"))


def syllables(word: Column) -> Column:
    """Approximate syllables: vowel groups, without a final silent e, one at least."""
    groups = F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), F.lit(0)))
    silent = (word.rlike("[^aeiouyl]e$") & (groups > 1)).cast("int")
    return F.greatest(groups - silent, F.lit(1))
