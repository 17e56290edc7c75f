"""One author's turns: from a table of turns, headed Markdown exports, or JSON exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penstroke.functions import clean, lexicons, segment

LEAST_CHARS = 20


def leaked(text: Column) -> Column:
    """Whether the text holds an assistant's phrase: one pass for all phrases."""
    return F.lower(text).rlike("|".join(rf"\Q{p}\E" for p in lexicons.ASSISTANT_PHRASES))


def _kept(rows: DataFrame, cleaned: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with ``cleaned``, where it is kept. The test runs on a generated row, for a filter would be pushed below
    the cleaning and repeat it at each mention."""
    return rows.select("*", F.explode(F.filter(F.array(cleaned), keep)).alias("cleaned"))


def author_turns(turns: DataFrame, role: str = "user") -> DataFrame:
    """Turns of one role with their cleaned text. The raw stripped length is tested, as in JSON exports; what is blank
    after cleaning, or leaked from an assistant, is dropped."""
    mine = turns.where((F.col("role") == role) & (F.length(clean.strip(F.col("text"))) > LEAST_CHARS))
    return _kept(mine, clean.clean_turn(clean.strip(F.col("text"))), lambda c: (c != "") & ~leaked(c))


def headed_turns(files: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """``*, turn, cleaned``: sections whose heading begins with the marker, whatever its case. Here the cleaned length
    is tested."""
    wanted = marker.strip().lower()
    each = files.select("*", F.posexplode(segment.sections(F.col(text))).alias("turn", "__s"))
    mine = each.where(F.startswith(F.lower(clean.strip(F.col("__s.heading"))), F.lit(wanted)))
    return _kept(mine, clean.clean_turn(F.col("__s.body")), lambda c: (F.length(c) > LEAST_CHARS) & ~leaked(c)).drop("__s")


def extraction_stats(files: DataFrame, turns: DataFrame, key: str, raw_size: Column, order: str = "turn", threshold: float = 0.05) -> DataFrame:
    """``key, raw_bytes, extracted_bytes, turns_extracted, yield_fraction, low_yield, warn`` of every file.

    Turns are counted as blocks between blank lines of what was extracted. A file below the threshold is a warning
    from 5000 bytes on.
    """
    joined = turns.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "cleaned"))), lambda x: x["cleaned"]), "\n\n").alias("__all"))
    both = files.select(key, raw_size.cast("long").alias("raw_bytes")).join(joined, key, "left").withColumn("__all", F.coalesce("__all", F.lit("")))
    size = F.octet_length("__all").cast("long")
    blocks = F.size(F.filter(F.split("__all", "\n\n"), lambda p: clean.strip(p) != "")).cast("long")
    share = size / F.greatest(F.col("raw_bytes"), F.lit(1))
    return both.select(key, "raw_bytes", size.alias("extracted_bytes"), blocks.alias("turns_extracted"), share.alias("yield_fraction"), (share < threshold).alias("low_yield"), ((share < threshold) & (F.col("raw_bytes") > 5000)).alias("warn"))


def extraction_summary(stats: DataFrame) -> DataFrame:
    """Totals over all files, in one row."""
    total = stats.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("extracted_bytes"), F.lit(0)).alias("extracted_bytes"),
        F.coalesce(F.sum("turns_extracted"), F.lit(0)).alias("turns"), F.count_if("low_yield").alias("low_yield_files"), F.count_if("warn").alias("warnings"),
    )
    return total.withColumn("overall_yield", F.col("extracted_bytes") / F.greatest(F.col("raw_bytes"), F.lit(1)))


def preview(turns: DataFrame, n: int = 5, seed: int = 0, text: str = "cleaned") -> DataFrame:
    """``n`` paragraphs longer than 100 characters in a seeded order, cut at 500 characters."""
    each = turns.select(F.explode(segment.paragraphs(F.col(text))).alias("paragraph")).where(F.length("paragraph") > 100)
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("paragraph")))
    shown = F.when(F.length("paragraph") > 500, F.concat(F.substring("paragraph", 1, 500), F.lit("..."))).otherwise(F.col("paragraph"))
    return each.orderBy(order, "paragraph").limit(n).select(shown.alias("sample"))


def size_tier(words: Column) -> Column:
    """How far a corpus of so many words may be trusted."""
    return F.when(words < 5000, "extreme caution").when(words <= 20000, "directional").when(words <= 100000, "reliable").otherwise("high confidence")


def sanity_flags(turns: DataFrame, raw_bytes: int | Column, text: str = "cleaned") -> DataFrame:
    """Flags on an extraction: low yield (10 %), leaks, fewer than 20,000 words, short turns (30 words on average)."""
    t = turns.agg(
        F.count("*").alias("turns"), F.coalesce(F.sum(F.size(segment.words(F.col(text)))), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"), F.count_if(leaked(F.col(text))).alias("leaks"),
    )
    raw = raw_bytes if isinstance(raw_bytes, Column) else F.lit(raw_bytes)
    return t.select(
        "turns", "words", size_tier(F.col("words")).alias("tier"), (F.col("bytes") * 10 < raw).alias("low_yield"), (F.col("leaks") > 0).alias("leaked"),
        (F.col("words") < 20000).alias("small_corpus"), (F.col("words") < F.col("turns") * 30).alias("short_turns"),
    )
