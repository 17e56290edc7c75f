"""Markup removal as one Column expression each; every step is a JVM regex, so Catalyst keeps them in one projection.

Flags: (?U) Unicode classes, (?d) only a line feed ends a line, (?s) dot matches it, (?m) anchors at lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = "(?s)`{3}.*?`{3}"
_CODE = "`[^\n`]+`"
_FRONT = r"(?sU)\A\s*-{3}.*?-{3}\s*"
_CITATION = r"[\\]\[\p{Nd}+[\\]\]|\[\p{Nd}+\]"
_IMAGE = r"!\[[^\n]*?\]\([^\n]*?\)"
_TAG = "<[^>]+>"

#: (pattern, replacement) in the order of application.
MARKDOWN_STEPS: list[tuple[str, str]] = [
    (_FRONT, ""),
    (_FENCE, " "),
    (_CODE, " "),
    (r"(?U)\[[\w-]+\s*—[^\]]*\]", " "),
    (_CITATION, " "),
    (r"(?mdU)^\s*[|].*[|]\s*$", ""),
    (_IMAGE, " "),
    (_TAG, " "),
    (r"[{]#[^}]+[}]", ""),
    (r"(?mdU)^#{1,6}\s+", ""),
    (r"\*\*{0,2}([^\n]*?)\*\*{0,2}", "$1"),
    (r"(?mdU)^\s*[_*-]{3,}\s*$", ""),
    (r"\[([^\]]{1,})\][(][^)]{1,}[)]", "$1"),
    ("\n{3,}", "\n\n"),
]

#: A conversation turn is cleaned by another chain: what is removed leaves no space, and headings, tables and links stay.
TURN_STEPS: list[tuple[str, str]] = [
    (_FRONT, ""),
    (_FENCE, ""),
    (_CODE, ""),
    (r"\[[^\n]*?—[^\n]*?\]", ""),
    (_CITATION, ""),
    (_IMAGE, ""),
    (_TAG, ""),
    (r"(?i)this block is not supported on your current device yet[.]?", ""),
    (r"(?md)[\t ]+$", ""),
    ("\n{3,}", "\n\n"),
]


_SPACES = [chr(x) for x in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only). The pattern, which tries every space of a
    text, runs only where an end is one; the text is bound as the element of an array, to be computed once."""

    def run(t: Column) -> Column:
        ends = F.substring(t, 1, 1).isin(_SPACES) | F.substring(t, -1, 1).isin(_SPACES)
        return F.when(ends, F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")).otherwise(t)

    return F.get(F.transform(F.array(text), run), F.lit(0))


#: What a text must hold for a step to find anything: most texts pass most steps without running their pattern.
_NEEDED: dict[str, list[str]] = {
    _FRONT: ["---"], _FENCE: ["```"], _CODE: ["`"], _CITATION: ["[", "\\"], _IMAGE: ["!["], _TAG: ["<"],
    r"(?U)\[[\w-]+\s*—[^\]]*\]": ["—"], r"(?mdU)^\s*[|].*[|]\s*$": ["|"], r"[{]#[^}]+[}]": ["{#"], r"(?mdU)^#{1,6}\s+": ["#"],
    r"\*\*{0,2}([^\n]*?)\*\*{0,2}": ["*"], r"(?mdU)^\s*[_*-]{3,}\s*$": ["-", "*", "_"], r"\[([^\]]{1,})\][(][^)]{1,}[)]": ["]("], "\n{3,}": ["\n\n\n"],
    r"\[[^\n]*?—[^\n]*?\]": ["—"],
}


def _step(pattern: str, replacement: str) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        replaced = F.regexp_replace(text, pattern, replacement)
        if pattern not in _NEEDED:
            return replaced
        return F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in _NEEDED[pattern]]), replaced).otherwise(text)

    return run


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    # a step names its input several times, so it is bound as the element of an array and computed once
    bound = reduce(lambda c, step: F.transform(c, _step(*step)), steps, F.array(text))
    return strip(F.get(bound, F.lit(0)))


def strip_markdown(text: Column, front: bool = True) -> Column:
    """Prose of a Markdown text: marks removed, heading and link texts kept. Without ``front`` it has no front matter."""
    return _chain(text, MARKDOWN_STEPS if front else MARKDOWN_STEPS[1:])


def clean_turn(text: Column) -> Column:
    """A conversation turn without code, images, tags, citations and export notices."""
    return _chain(text, TURN_STEPS)


def unix_lines(text: Column) -> Column:
    """Line ends as one line feed."""
    return F.regexp_replace(text, "\r\n?", "\n")
