"""Profiles as JSON and Markdown. Profiles are small; they are rendered on the driver, rounded here and only here."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

MISSING = "—"
SMALL_CORPUS = 20_000
_PLACES = {"mattr_window100": 4, "hapax_ratio": 4, "bullet_ratio": 4, "mean_words": 2, "median_words": 2, "stdev_words": 2}


def _rounded(value: Any, name: str = "") -> Any:
    if isinstance(value, float):
        return round(value, _PLACES.get(name, 3))
    if isinstance(value, dict):
        return {k: _rounded(v, k) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_rounded(v) for v in value]
    return value


def as_dicts(profiles: DataFrame, register: str) -> list[dict]:
    """Collected profiles with rounded leaves; the function words as a mapping in rank order, missing leaves left out."""
    out = []
    for row in profiles.orderBy(register).collect():
        profile = _rounded(row.asDict(recursive=True))
        lexical = profile.get("lexical", {})
        lexical["function_word_profile"] = {x["word"]: x["per_1000"] for x in lexical.get("function_word_profile", [])}
        if not profile.get("syntactic", {}).get("sentence_stats", {}).get("mean_words"):
            profile.get("syntactic", {})["sentence_stats"] = {}
        out.append({"register": profile.pop(register), **profile})
    return out


def as_json(profile: dict) -> str:
    return json.dumps(profile, indent=2, ensure_ascii=False)


def write_json(profile: dict, path: str) -> None:
    write_text(as_json(profile), path)


def _table(head: tuple[str, ...], rows: Iterable[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|", *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), ""]


def _section(level: int, title: str, head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    return [f"{'#' * level} {title}", "", *_table(head, rows)]


def _number(value: Any) -> str:
    return MISSING if value is None else f"{value:,}"


def sections(profile: dict, level: int = 2, combined: bool = False) -> list[str]:
    """The report's sections of one profile. A combined report shows 20 function words and neither en dashes nor the
    plural ratio nor parsed features; a single one 10 and all."""
    stats, lexical, syntax = (profile.get(k) or {} for k in ("corpus_stats", "lexical", "syntactic"))
    out = _section(level, "Corpus Overview", ("Metric", "Value"), [(n, _number(stats.get(k))) for n, k in (("Words (filtered prose)", "word_count"), ("Sentences", "sentence_count"), ("Paragraphs", "paragraph_count"))])
    if (stats.get("word_count") or 0) < SMALL_CORPUS:
        out += [f"> **Warning:** fewer than {SMALL_CORPUS:,} words are left after filtering; distributional features may be unreliable.", ""]

    def shown(group: dict, pairs: list[tuple[str, str]]) -> list[tuple]:
        return [(title, group.get(key, MISSING)) for title, key in pairs]

    if length := syntax.get("sentence_stats"):
        rows = shown(length, [("Mean words", "mean_words"), ("Median words", "median_words"), ("Std dev", "stdev_words")])
        rows += [(f"{a} / {b}", f"{length.get(x, MISSING)} / {length.get(y, MISSING)}") for a, b, x, y in (("Q1", "Q3", "q1_words", "q3_words"), ("Min", "Max", "min_words", "max_words"))]
        rows += [(title, f"{(length.get(key) or 0) * 100:.1f}%") for title, key in (("% short (≤5 words)", "pct_short_le5"), ("% long (≥30 words)", "pct_long_ge30"))]
        out += _section(level, "Sentence Length", ("Metric", "Value"), rows)
    if marks := profile.get("punctuation"):
        names = ["em_dash", "en_dash", "semicolon", "colon", "parenthetical", "question", "exclamation", "ellipsis"]
        pairs = [("Comma per sentence", "comma_per_sentence")] + [(n.replace("_", " ").capitalize(), f"{n}_per_1000w") for n in names if not (combined and n == "en_dash")]
        out += _section(level, "Punctuation (per 1000 words)", ("Mark", "Rate"), shown(marks, pairs))
    if stance := profile.get("hedging_booster"):
        out += _section(level, "Hedges and Boosters (per 100 words)", ("Metric", "Rate"), shown(stance, [("Hedges", "hedge_per_100w"), ("Boosters", "boost_per_100w"), ("Ratio", "hedge_boost_ratio")]))
    if pronouns := profile.get("pronouns"):
        pairs = [("First person singular", "first_sg_per_100w"), ("First person plural", "first_pl_per_100w"), ("Second person", "second_per_100w"), ("Third person", "third_per_100w")]
        out += _section(level, "Pronouns (per 100 words)", ("Class", "Rate"), shown(pronouns, pairs + ([] if combined else [("Plural to singular", "first_pl_to_sg_ratio")])))
    if first := syntax.get("sentence_initial_patterns"):
        out += _section(level, "First Words of Sentences", ("Word", "Count"), [(x["word"], x["count"]) for x in first[:20]])
    if content := lexical.get("distinctive_content_words"):
        out += _section(level, "Content Words", ("Word", "Per 1000 words"), [(x["word"], x["per_1000"]) for x in content[:30]])
    if functional := lexical.get("function_word_profile"):
        best = sorted(functional.items(), key=lambda x: -x[1])[: 20 if combined else 10]
        out += _section(level, "Function Words", ("Word", "Per 1000 words"), best)
    out += _section(level, "Lexical Richness", ("Metric", "Value"), [("MATTR (window 100)", lexical.get("mattr_window100", MISSING)), ("Hapax ratio", lexical.get("hapax_ratio", MISSING)), ("Concession rate", syntax.get("concession_rate", MISSING))])
    if paragraphs := syntax.get("paragraph_stats"):
        out += _section(level, "Paragraphs", ("Metric", "Value"), shown(paragraphs, [("Count", "paragraph_count"), ("Mean words", "mean_words"), ("Median words", "median_words"), ("Std dev", "stdev_words")]))
    return out


def single_report(profile: dict, source: str = "", today: datetime.date | None = None) -> str:
    day = (today or datetime.date.today()).isoformat()
    head = ["# Style Profile", "", f"**Source:** {source or 'unknown'}  ", f"**Register:** {profile.get('register', 'default')}  ", f"**Date:** {day}", ""]
    return "\n".join(head + sections(profile))


#: Rows of the cross table: title, path to the leaf, form.
CROSS = [
    ("Mean sentence length", "syntactic.sentence_stats.mean_words", ""), ("Median sentence length", "syntactic.sentence_stats.median_words", ""), ("Std dev", "syntactic.sentence_stats.stdev_words", ""),
    ("% short (≤5 words)", "syntactic.sentence_stats.pct_short_le5", "%"), ("% long (≥30 words)", "syntactic.sentence_stats.pct_long_ge30", "%"),
    ("Em dashes per 1000 words", "punctuation.em_dash_per_1000w", ""), ("Semicolons per 1000 words", "punctuation.semicolon_per_1000w", ""),
    ("Hedges per 100 words", "hedging_booster.hedge_per_100w", ""), ("Boosters per 100 words", "hedging_booster.boost_per_100w", ""),
    ("First person singular per 100 words", "pronouns.first_sg_per_100w", ""), ("First person plural per 100 words", "pronouns.first_pl_per_100w", ""), ("Second person per 100 words", "pronouns.second_per_100w", ""),
    ("MATTR (window 100)", "lexical.mattr_window100", ""), ("Hapax ratio", "lexical.hapax_ratio", ""), ("Concession rate", "syntactic.concession_rate", ""), ("Words", "corpus_stats.word_count", ","),
]


def _leaf(profile: dict, path: str, form: str) -> str:
    value: Any = profile
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    if value is None:
        return MISSING
    return f"{value * 100:.1f}%" if form == "%" else f"{int(value):,}" if form == "," else str(value)


def cross_table(profiles: list[tuple[str, dict]]) -> list[str]:
    """One row a feature, one column a register; a missing leaf is a dash."""
    rows = [(title, *(_leaf(p, path, form) for _, p in profiles)) for title, path, form in CROSS]
    return ["## Registers Compared", "", *_table(("Feature", *(label for label, _ in profiles)), rows)]


def combined_report(profiles: list[tuple[str, dict]], author: str = "", today: datetime.date | None = None) -> str:
    day = (today or datetime.date.today()).isoformat()
    out = [f"# Style Profile{' — ' + author if author else ''}", "", f"**Generated:** {day}  ", f"**Registers:** {', '.join(label for label, _ in profiles)}", ""]
    out += cross_table(profiles)
    for label, profile in profiles:
        out += [f"## Register: {profile.get('register', 'unknown')}", "", f"**Source:** {label}", "", *sections(profile, 3, combined=True)]
    return "\n".join([*out, "## Notes", "", "Features differ between registers of one writer. A rate of zero is a finding, not an error.", f"Below {SMALL_CORPUS:,} words take values as ranges.", ""])


def write_text(text: str, path: str) -> None:
    """Write a report or an extracted text, making its folder."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def fill(template: str, values: dict[str, Any]) -> str:
    """A template with its {{name}} places filled; a name without a value keeps its place."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", str(value))
    return template
