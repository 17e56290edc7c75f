"""Main text of HTML pages by tag-path ratios.

A page is read as its sequence of text nodes, each with its root-to-leaf tag path. Per path, text length and number of
punctuation marks are summed and divided by the number of nodes; these two ratios, laid out along the page, are
smoothed by a Gaussian over neighbouring nodes, scaled to their maximum and fused by geometric mean. A path whose mean
fused value reaches the threshold (``SPREAD`` standard deviations of the page's path values) is content, and all its
nodes are kept (after Wu, Li, Hu and Wu, Web news extraction via path ratios, CIKM 2013). One pass, no shuffle.

Paths are numbers in a trie, and tags are read by a scanner that never reads a stretch again, so a page of any shape
takes time and memory in proportion to its length.

Defined cases: a null page has a null text; an empty page, or one without text nodes, an empty text; tags that are
never closed are closed by their parents or by the next block; what no ``>`` follows is text; a quote that is never
closed does not hide the ``>`` behind it; a character number of 4000 digits or more is U+FFFD; script, style, template, noscript, title and comments
are no text; a single path is always content; rows are neither merged nor dropped; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices

#: Gaussian smoothing over this many nodes to either side, with this width.
REACH = 2
WIDTH = 0.6
SPREAD = 0.75

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_HIDDEN = re.compile(r"<(script|style|template|noscript|title|svg)\b", re.I)
_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript", "title", "svg")}
_STOP = re.compile("['\">]")
#: More digits than a number may have to be read; no such number is a character.
_LONG = re.compile("&#[0-9]{4000,};?")
_MARKS = re.compile(r"[.,;:!?…。，；：！？、()\"“”«»]")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body html".split()
)
#: A start tag closes these open elements, up to the nearest one of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P = ({"p"}, {"article", "aside", "blockquote", "body", "div", "dd", "footer", "header", "li", "main", "nav", "section", "td", "th"})


class _Tags:
    """Where tags of a page end. A quoted value may hold ``>``; where a quote is never closed the next ``>`` ends the tag.

    Positions of opening quotes from which no end was found are kept, so that every quote is followed once however many
    tags stand before it, and a page takes time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.lost: set[int] = set()

    def end(self, at: int) -> tuple[int, bool]:
        """Place of the ``>`` that ends the tag whose name ends at ``at``, and whether its quotes are closed."""
        page, pos, opened = self.page, at, []
        while (stop := _STOP.search(page, pos)) is not None:
            place = stop.start()
            if page[place] == ">":
                return place, True
            if place in self.lost:
                break
            opened.append(place)
            pos = page.find(page[place], place + 1) + 1
            if not pos:
                break
        self.lost.update(opened)
        return page.find(">", at), False


class _Open:
    """The open elements, with the number of their tag path: paths are nodes of a trie, never strings."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths = [0]
        self.children: dict[tuple[int, str], int] = {}
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        key = (self.paths[-1], name)
        self.paths.append(self.children.setdefault(key, len(self.children) + 1))
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()
            self.paths.pop()

    def close(self, name: str) -> None:
        if self.at.get(name):
            self.cut(self.at[name][-1])

    def close_before(self, closed: set[str], within: set[str]) -> None:
        """Close the open elements of ``closed`` above the innermost one of ``within``."""
        border = max((at[-1] for n in within if (at := self.at.get(n))), default=-1)
        first = [at[i] for n in closed if (at := self.at.get(n)) and (i := bisect_right(at, border)) < len(at)]
        if first:
            self.cut(min(first))


def scan(page: str) -> tuple[list[tuple[int, str, bool]], dict[tuple[int, str], int]]:
    """Text nodes in order: number of the tag path, text with single spaces, and whether a block or line begins before
    it; and the paths, as (number of the parent, tag) to number."""
    tags, stack = _Tags(page), _Open()
    found: list[tuple[int, str, bool]] = []
    fresh = True
    last = at = 0

    def text(upto: int) -> None:
        nonlocal fresh
        if upto <= last:
            return
        chunk = page[last:upto]
        value = _SPACE.sub(" ", html.unescape(_LONG.sub("\ufffd", chunk)) if "&" in chunk else chunk)
        if value.strip():
            found.append((stack.paths[-1], value, fresh))
            fresh = False

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            text(at)
            end = page.find("-->", at + 4)
            last = at = end + 3 if end >= 0 else len(page)
            continue
        if at > tags.last:
            # no tag ends after here, but a comment may begin
            if (at := page.find("<!--", at)) < 0:
                break
            continue
        if page.startswith(("<!", "<?"), at):
            text(at)
            last = at = page.find(">", at) + 1
            continue
        tag = _NAME.match(page, at)
        if tag is None:
            at += 1
            continue
        if hidden := _HIDDEN.match(page, at):
            text(at)
            close = _END[hidden[1].lower()].search(page, page.find(">", at) + 1)
            last = at = close.end() if close else len(page)
            continue
        text(at)
        end, closed = tags.end(tag.end())
        name = tag[2].lower()
        if name in _BLOCK or name == "br":
            fresh = True
        if tag[1]:
            stack.close(name)
        elif name not in _VOID:
            rule = _CLOSES.get(name) or (_P if name in _BLOCK else None)
            if rule:
                stack.close_before(*rule)
            if not (closed and page[end - 1] == "/"):
                stack.push(name)
        last = at = end + 1
    text(len(page))
    return found, stack.children


def nodes(page: str) -> list[tuple[str, str, bool]]:
    """Text nodes as of ``scan``, with their tag paths written out; a deep page's paths are long."""
    found, children = scan(page)
    names = {0: ""}
    for (parent, name), number in children.items():
        names[number] = f"{names[parent]}/{name}" if parent else name
    return [(names[path], value, fresh) for path, value, fresh in found]


def _smooth(values: np.ndarray) -> np.ndarray:
    at = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(at**2) / (2 * WIDTH**2))
    weight = np.convolve(np.ones(len(values)), kernel)[REACH : REACH + len(values)]
    return np.convolve(values, kernel)[REACH : REACH + len(values)] / weight


def content_paths(paths: list, lengths: list[int], marks: list[int]) -> set:
    """Paths (numbers or names) whose fused ratio reaches the threshold."""
    names, code = np.unique(paths, return_inverse=True)
    n = np.bincount(code)
    fused = np.ones(len(paths))
    for values in (lengths, marks):
        ratio = (np.bincount(code, values) + (values is marks)) / n  # one mark more a path: none isn't nothing
        smooth = _smooth(ratio[code])
        fused *= smooth / max(smooth.max(), 1e-12)
    score = np.bincount(code, np.sqrt(fused)) / n
    limit = min(SPREAD * score.std(), score.max())
    return set(names[score >= limit].tolist())


def extract(page: str | None) -> str | None:
    """The page's content text, one line a block."""
    if page is None:
        return None
    found, _ = scan(page)
    if not found:
        return ""
    lengths = [len(t.strip()) for _, t, _ in found]
    content = content_paths([p for p, _, _ in found], lengths, [len(_MARKS.findall(t)) for _, t, _ in found])
    out: list[str] = []
    skipped = True
    for path, value, fresh in found:
        if path not in content:
            skipped = True
            continue
        if fresh or skipped:
            out.append("\n" + value.lstrip())
        else:
            out.append(value)
        skipped = False
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([extract(p) for p in part.column("html").to_pylist()], pa.string())], ["page_id", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page."""
    return pages.select("page_id", "html").mapInArrow(_rows, "page_id long, text string")
