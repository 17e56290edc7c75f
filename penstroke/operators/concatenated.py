"""Counts of a scope as one text, its documents joined by blank lines, without that text in one row.

The documents of a scope pass a worker in order. They are cut into segments where no step of ``strip_markdown`` can reach
over the cut: plain texts by their characters, others by trying what would follow. Segments are cleaned and counted by
themselves, and their counts added up; only a sentence may go on over a cut. Where marks stay open (a "<" without any ">"
after it) there is no cut until they close, so that such a scope's segment may grow as it does in one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from penstroke.functions import clean, lexicons

from . import profile, tokens

#: Characters from which a segment is cut where it can be.
SEGMENT = 1 << 14
#: Segments of a batch that leaves a worker.
_LEAVING = 64

#: What a step of the cleaning needs, but for the one that takes blank lines away.
_SPECIAL = list("`[<|*#\\")
_RULE = re.compile("[_-]{3}")
#: What may follow a text: whatever could close or go on with a mark that it leaves open.
_PROBES = ["w ]( u) ] > } ) --- ``` w", "— x ]( u) ] w"]


def _python(java: str) -> re.Pattern:
    flags = (re.M if "m" in java[: java.find(")")] and java.startswith("(?") else 0) | (re.S if "s" in java[: java.find(")")] and java.startswith("(?") else 0)
    return re.compile(re.sub(r"\A\(\?[a-zA-Z]+\)", "", java).replace(r"\p{Nd}", r"\d"), flags)


_STEPS = [(_python(p), r.replace("$1", r"\1")) for p, r in clean.MARKDOWN_STEPS]
_FENCE = _python("(?s)`{3}.*?`{3}")


def _chain(text: str, first: bool) -> str:
    """The steps of ``strip_markdown`` without the last strip; only the first segment may have a front matter."""
    return reduce(lambda t, s: s[0].sub(s[1], t), _STEPS if first else _STEPS[1:], text)


def _plain(text: str) -> bool:
    """Whether the steps only take blank lines away, and none at its ends."""
    if text[0].isspace() or text[-1].isspace() or any(x in text for x in _SPECIAL):
        return False
    return not any(x in text for x in ("--", "__", "-_", "_-")) or not _RULE.search(text)


def _may_end(text: str, first: bool) -> bool:
    """Whether the text, before a cut, takes nothing from what follows."""
    alone = _chain(text, first)
    return (
        alone != "" and alone == alone.strip()
        and all(_chain(f"{text}\n\n{p}", first) == f"{alone}\n\n{_chain(p, False)}" for p in _PROBES)
        and len(_FENCE.findall(f"{text}\n\n{_PROBES[0]}")) == len(_FENCE.findall(text))
    )


def _may_begin(text: str) -> bool:
    """Whether the text, after a cut, takes nothing from what is before it, whatever follows."""
    return _may_end(text, False) and _chain("w\n\n" + text, False) == "w\n\n" + _chain(text, False)


def cut(texts: Iterator[str]) -> Iterator[tuple[str, bool]]:
    """Segments of the texts joined by blank lines, and whether each is the first."""
    parts: list[str] = []
    size, tried, plain, first = 0, 0, True, True
    for text in texts:
        simple = _plain(text)
        # a segment with open marks is tried again when it is twice as long
        if size >= max(SEGMENT, 2 * tried) and (simple or _may_begin(text)):
            whole = "\n\n".join(parts)
            if plain or _may_end(whole, first):
                yield whole, first
                parts, size, tried, plain, first = [], 0, 0, True, False
            else:
                parts, tried = [whole], size
        parts.append(text)
        size += len(text) + 2
        plain = plain and simple
    if parts:
        yield "\n\n".join(parts), first


def _by_scope(batches: Iterator[pa.RecordBatch], by: list[str], column: str) -> Iterator[tuple[tuple, Iterator]]:
    """Runs of rows of one scope, which lie together."""
    rows = ((tuple(k), x) for b in batches for *k, x in zip(*(b.column(c).to_pylist() for c in [*by, column])))
    now = next(rows, None)

    def run(scope: tuple) -> Iterator:
        nonlocal now
        while now is not None and now[0] == scope:
            x, now = now[1], None
            yield x
            now = next(rows, None)

    while now is not None:
        scope = now[0]
        yield scope, run(scope)


def _segments(by: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for scope, texts in _by_scope(batches, by, "raw"):
            for text, first in cut(texts):
                out.append((*scope, text, first))
                if len(out) >= _LEAVING:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _added(by: list[str], given: list[str], lists: dict[str, list[str]], names: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``by, first, prose`` of segments in order and the ``given`` counts: one row a scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, total, tail = None, {}, (False, False, False)
        for batch in tokens.sliced(batches):
            prose = tokens.Prose(batch.column("prose"))
            found = {c: np.asarray(batch.column(c)) for c in given} | tokens.document_counts(prose, 0, lists)
            told = np.zeros(len(prose.piece_row), bool)
            told[prose.piece[prose.among(lexicons.CONCESSIONS)[prose.code]]] = True
            head = np.searchsorted(prose.piece_row, np.arange(prose.rows))
            last = np.append(head[1:], len(prose.piece_row)) - 1
            opens, closes = prose.edges()
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            for i, first in enumerate(batch.column("first").to_pylist()):
                a, z = head[i], last[i]
                own = {n: int(found[n][i]) for n in names}
                piece = bool(prose.sentence[z]), bool(told[z])
                if first:
                    if scope is not None:
                        yield _batch([(*scope, *total.values())], schema)
                    scope, total = keys[i], own
                else:
                    total = {n: v + own[n] for n, v in total.items()}
                    total["char_count"] += 2
                    total["total_lines"] += 1
                    if not (tail[2] and opens[i]):  # the sentence goes on: its parts count as one, longer than three characters
                        either = bool(tail[1] or told[a])
                        total["sentence_count"] += 1 - tail[0] - bool(prose.sentence[a])
                        total["concession"] += either - (tail[0] and tail[1]) - bool(prose.sentence[a] and told[a])
                        piece = (True, either) if a == z else piece
                tail = (*piece, bool(closes[i]))
        if scope is not None:
            yield _batch([(*scope, *total.values())], schema)

    return run


def corpus_counts(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """``by`` and ``COUNTS`` but for those of windows of every scope, as ``measure`` gives them of ``corpus``: a scope is
    sorted and passes one worker, a segment at a time."""
    rows = docs.where(clean.strip(F.col(text)) != "").select(*by, F.col(order).alias("ord"), F.col(text).alias("raw"))
    out = StructType([rows.schema[c] for c in by]).add("text", StringType()).add("first", BooleanType())
    return added_up(rows.repartition(*by).sortWithinPartitions(*by, "ord", "raw").mapInArrow(_segments(by, to_arrow_schema(out)), out), by)


def added_up(segments: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every scope from ``by, text, first``: its segments in order, all in one partition."""
    names = [c for c in profile.COUNTS if not c.startswith("window")]
    prose = F.when(F.col("first"), clean.strip_markdown(F.col("text"))).otherwise(clean.strip_markdown(F.col("text"), False))
    given = profile.given(F.col("text"))
    out = StructType([segments.schema[c] for c in by])
    for name in names:
        out = out.add(name, LongType())
    cleaned = segments.select(*by, "first", prose.alias("prose"), *[c.alias(n) for n, c in given.items()])
    return cleaned.mapInArrow(_added(by, list(given), profile.LISTS, names, to_arrow_schema(out)), out)
