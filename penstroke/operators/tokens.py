"""Arrow kernels over texts: words by scope, counts of documents and the facts of a profile, from their prose.

A word is what ``segment.words`` finds: a run of ASCII letters, apostrophes and hyphens, trimmed to its letters, in lower
case. One pass over the bytes finds all words of a batch, and a dictionary stands for them from then on, so a token costs a
few array operations and what leaves a worker is one row a scope and word, not one a token. Sentences and paragraphs are
those of ``segment``, found as places between the words. A kernel holds ``SLICE`` bytes of text at once, a longer single
text whole, so that a worker's memory doesn't follow the batches or the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from penstroke.functions import lexicons, segment
from penstroke.functions.batches import slices

#: Text bytes handled at once.
SLICE = 2 << 20


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(of, np.uint8)] = True
    return out


_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_INNER = _LETTER | _table(b"'-")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = _table(b"\t\n\v\f\r ")
_CLOSING, _OPENING = _table(b"?!."), _LETTER & (np.arange(256) < 97) | _table(b"\"('")
_WORD = _LETTER | _table(b"_0123456789")
#: White space beyond ASCII, as UTF-8.
_SPACES = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ABBREVIATIONS = [np.frombuffer(a.replace("[.]", ".").encode(), np.uint8) for a in segment.ABBREVIATIONS]
_KELVIN = "K".encode()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ``SLICE`` bytes of prose."""
    for batch in batches:
        yield from slices(batch, "prose", SLICE)


class Text:
    """Bytes of a string array in one piece; row i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.rows = len(texts)
        self.ascii = not len(self.data) or int(self.data.max()) < 128

    def per_row(self, places: np.ndarray) -> np.ndarray:
        """Number of the ascending places that lie in each row."""
        return np.diff(np.searchsorted(places, self.offsets))

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.per_row(places))

    def find(self, literal: bytes) -> np.ndarray:
        """Places of a literal of a few bytes that isn't part of itself."""
        at = np.flatnonzero(self.data == literal[0])
        for i, byte in enumerate(literal[1:], 1):
            at = at[at < len(self.data) - i]
            at = at[self.data[at + i] == byte]
        return at

    def repeated(self, char: bytes, times: int) -> np.ndarray:
        """By row: occurrences of ``times`` equal characters, which don't overlap."""
        at = np.flatnonzero(self.data == char[0])
        row = self.row_of(at)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(row) != 0)))) if len(at) else at
        return np.bincount(row[new], np.diff(np.append(new, len(at))) // times, self.rows).astype(np.int64)

    def spaces(self) -> np.ndarray:
        """Whether each byte belongs to white space, of any kind."""
        out = _SPACE[self.data]
        if not self.ascii:
            for s in _SPACES:
                at = self.find(s)
                for i in range(len(s)):
                    out[at + i] = True
        return out


class Tokens(Text):
    """Words of a string array in order: the row of each, its first byte, its index in ``vocab``, and ``vocab``."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        data, offsets = self.data, self.offsets
        inside = _INNER[data]
        # runs end with their text
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        opens[first], closes[last] = inside[first], inside[last]
        head, tail = np.flatnonzero(opens), np.flatnonzero(closes)
        # the few runs with an apostrophe or a hyphen at an end are trimmed to their letters
        odd = np.flatnonzero(~(_LETTER[data[head]] & _LETTER[data[tail]]))
        if len(odd):
            letters = np.flatnonzero(_LETTER[data])
            start, end = head[odd], tail[odd]
            if len(letters):
                head[odd] = letters[np.minimum(np.searchsorted(letters, start), len(letters) - 1)]
                tail[odd] = letters[np.maximum(np.searchsorted(letters, end, side="right") - 1, 0)]
            none = (head[odd] < start) | (head[odd] > end) if len(letters) else np.ones(len(odd), bool)
            for a, b in ((start, np.where(none, end + 1, head[odd])), (np.where(none, end + 1, tail[odd] + 1), end + 1)):
                size = np.maximum(b - a, 0)
                inside[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
            word = np.ones(len(head), bool)
            word[odd[none]] = False
            head, tail = head[word], tail[word]
        ends = np.zeros(len(head) + 1, np.int64)
        np.cumsum(tail - head + 1, out=ends[1:])
        body = _LOWER[data[inside]]
        coded = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(ends), pa.py_buffer(body)).dictionary_encode()
        self.head = head
        self.row = self.row_of(head)
        self.code = np.asarray(coded.indices, np.int64)
        self.vocab = coded.dictionary

    def among(self, words: list[str]) -> np.ndarray:
        """Whether each entry of ``vocab`` is one of the words."""
        return np.asarray(pc.is_in(self.vocab, pa.array(words, pa.large_string())))


class Prose(Tokens):
    """Tokens of texts as ``strip_markdown`` leaves them, and their sentences and paragraphs.

    ``piece`` is the number of a token's piece between sentence breaks, ``piece_row`` the row of each piece, ``sentence``
    whether it is one (longer than three characters); ``part``, ``part_row`` and ``paragraph`` are the same for paragraphs.
    """

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        data, offsets = self.data, self.offsets
        space = self.spaces()
        run_ends = np.flatnonzero(space & ~np.append(space[1:], False)) + 1
        begins, stop = offsets[:-1], offsets[1:]

        def after(at: np.ndarray) -> np.ndarray:
            """First byte that is no white space, from places on."""
            if not len(run_ends):
                return at
            inside = np.append(space, False)[at]
            return np.where(inside, run_ends[np.minimum(np.searchsorted(run_ends, at, side="right"), len(run_ends) - 1)], at)

        # a break: a closing mark, white space, an opening character, all in one text
        mark = np.flatnonzero(_CLOSING[data[:-1]] & space[1:])
        row = self.row_of(mark)
        opening = after(mark + 1)
        fits = opening < stop[row]
        mark, opening = mark[fits], opening[fits]
        fits = _OPENING[data[opening]]
        mark, opening = mark[fits], opening[fits]
        fits = ~self._abbreviated(mark)
        mark, opening = mark[fits], opening[fits]
        start, self.piece_row, broken = self._starts(opening)
        # a piece ends at the mark before the next one, or with its text
        last = stop[self.piece_row]
        last[np.flatnonzero(broken) - 1] = mark + 1
        size = last - start
        if not self.ascii:
            later = np.zeros(len(data) + 1, np.int32)
            np.cumsum(data & 0xC0 == 0x80, out=later[1:])
            size -= later[last] - later[start]
        self.sentence = size > 3
        self.piece = np.searchsorted(start, self.head, side="right") - 1
        # paragraphs: parts between two line feeds or more that aren't blank
        line = np.flatnonzero(data == 10)
        row = self.row_of(line)
        double = np.flatnonzero((np.diff(line) == 1) & (np.diff(row) == 0)) if len(line) else line
        ends = line[double + 1] + 1
        ends = ends[ends < stop[row[double]]]
        ends = ends[data[ends] != 10]
        start, self.part_row, broken = self._starts(ends)
        last = stop[self.part_row]
        last[np.flatnonzero(broken) - 1] = ends
        self.paragraph = after(start) < last
        self.part = np.searchsorted(start, self.head, side="right") - 1

    def _starts(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes of the parts that begin with a row or at one of the ascending breaks, their rows, and whether at a
        break. An empty row has a part too, before that of the next row, so that no token falls into it."""
        row = np.concatenate((np.arange(self.rows), self.row_of(breaks)))
        start = np.concatenate((self.offsets[:-1], breaks))
        order = np.lexsort((start, row))
        return start[order], row[order], order >= self.rows

    def _abbreviated(self, mark: np.ndarray) -> np.ndarray:
        """Whether the mark is the dot of an abbreviation."""
        out = np.zeros(len(mark), bool)
        dots = np.flatnonzero(self.data[mark] == ord("."))
        begin = self.offsets[:-1][self.row_of(mark)[dots]]
        for word in _ABBREVIATIONS:
            first = mark[dots] - len(word)
            fits = first >= begin
            for i, byte in enumerate(word):
                fits &= self.data[np.maximum(first + i, 0)] == byte
            fits &= (first <= begin) | ~_WORD[self.data[np.maximum(first - 1, 0)]]
            out[dots[fits]] = True
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row begins with an opening character, and whether it ends with a mark that can end a sentence."""
        some = np.flatnonzero(np.diff(self.offsets))
        opens, closes = np.zeros(self.rows, bool), np.zeros(self.rows, bool)
        last = self.offsets[1:][some] - 1
        opens[some] = _OPENING[self.data[self.offsets[:-1][some]]]
        closes[some] = _CLOSING[self.data[last]] & ~self._abbreviated(last)
        return opens, closes

    def phrases(self, phrases: list[str]) -> np.ndarray:
        """By row: occurrences of the phrases as substrings in lower case."""
        low, out = _LOWER[self.data].tobytes(), np.zeros(self.rows, np.int64)
        for phrase in phrases:
            sought, at = phrase.encode(), low.find(phrase.encode())
            while at >= 0:
                row = int(np.searchsorted(self.offsets, at, side="right")) - 1
                within = at + len(sought) <= self.offsets[row + 1]
                out[row] += within
                at = low.find(sought, at + (len(sought) if within else 1))
        for row in {*self.row_of(self.find(_KELVIN)).tolist()}:  # its small letter is a k
            text = self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode().lower()
            out[row] = sum(text.count(p) for p in phrases)
        return out

    def chars(self) -> np.ndarray:
        size = np.diff(self.offsets)
        return size if self.ascii else size - self.per_row(np.flatnonzero(self.data & 0xC0 == 0x80))


def _scopes(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's scope, nulls included, and a row of each scope."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in by:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * (len(coded.dictionary) + 1) + np.asarray(coded.indices)
    _, row, number = np.unique(code, return_index=True, return_inverse=True)
    return number, row


#: Rows that a task holds to add them up before they leave it, and rows of a batch that leaves.
HELD, LEAVING = 1 << 20, 1 << 16


def _added(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """``n`` summed by the keys over as many batches as may be held; the rest is for Spark's aggregation."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def whole() -> list[pa.RecordBatch]:
        schema = held[0].schema
        total = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return total.rename_columns([c.removesuffix("_sum") for c in total.column_names]).select(schema.names).cast(schema).combine_chunks().to_batches(LEAVING)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            held = whole()
            rows = sum(b.num_rows for b in held)
            if rows * 2 > HELD:
                yield from held
                held, rows = [], 0
    if held:
        yield from whole()


#: Keys of at most so many times the tokens are counted in a table, others by sorting.
_DENSE = 16


def _distinct(key: np.ndarray, top: int, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct keys below ``top`` in order, the first place of each if wanted, and their counts."""
    if top > _DENSE * len(key):
        found = np.unique(key, return_index=places, return_counts=True)
        return found[0], found[1] if places else None, found[-1]
    n = np.bincount(key, minlength=top)
    some = np.flatnonzero(n)
    first = None
    if places:
        at = np.empty(top, np.int64)
        at[key[::-1]] = np.arange(len(key) - 1, -1, -1)
        first = at[some]
    return some, first, n[some]


def count_words(by: list[str], schema: pa.Schema, totals: bool = False, among: list[str] | None = None, places: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``by, ord, prose``: ``by, word, n, ord, pos`` (the last two only with ``places``), a word's occurrences in a scope and the first of them; with
    ``totals`` also a row without a word for all words of a scope, even where only those ``among`` a list are wanted."""

    kept = ["ord"] if places else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if places:
                batch = batch.take(pc.sort_indices(batch.column("ord")))
            tokens = Tokens(batch.column("prose"))
            batch = batch.select([*by, *kept])  # each word takes a row of it, which must not hold the text
            scope, row_of = _scopes(batch, by)
            code, row = tokens.code, tokens.row
            some = np.arange(len(code)) if among is None else np.flatnonzero(tokens.among(among)[code])
            base = max(len(tokens.vocab), 1)
            key, first, n = _distinct(scope[row[some]] * base + code[some], base * len(row_of), places)
            at = row_of[key // base]
            if places:
                first = some[first]
                at = row[first]
            rows = batch.take(pa.array(at))
            columns = [*(rows.column(c) for c in by), tokens.vocab.take(pa.array(key % base)).cast(pa.string()), pa.array(n), *(rows.column(c) for c in kept)]
            if places:
                columns.append(pa.array((first - np.searchsorted(row, at)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            if totals:
                n = np.bincount(scope[row], minlength=len(row_of))
                some = np.flatnonzero(n)
                whole = batch.take(pa.array(row_of[some]))
                none = [pa.nulls(len(some), f.type) for f in schema if f.name not in (*by, "n")]
                columns = [*(whole.column(c) for c in by), none[0], pa.array(n[some].astype(np.int64)), *none[1:]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    if not places:
        return lambda batches: _added(run(batches), [*by, "word"])
    return run


def _windows(row: np.ndarray, code: np.ndarray, rows: int, width: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: distinct words summed over all windows of ``width`` words, the number of window places, and words that occur
    once. A word at p, last seen at q, is new to the windows that start in (q, p]."""
    count = np.bincount(row, minlength=rows)
    start = np.cumsum(count) - count
    key = row * max(words, 1) + code
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    again = np.flatnonzero(same[:-1])
    before = np.full(len(row), -1)
    before[order[again]] = order[again - 1] - start[row[order[again]]]
    at = np.arange(len(row)) - start[row]
    w = np.minimum(count, width)
    last = (count - w)[row]
    gain = np.maximum(np.minimum(at, last) - np.maximum(np.maximum(before + 1, at - w[row] + 1), 0) + 1, 0)
    once = order[~(same[:-1] | same[1:])]
    return np.bincount(row, gain, rows), w * (count - w + 1), np.bincount(row[once], minlength=rows)


def document_counts(prose: Prose, width: int, lists: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """The counts of ``profile.COUNTS`` that follow from the prose, and ``hapax``, by row; without a ``width`` those of
    windows and ``hapax`` are left out."""
    row, rows = prose.row, prose.rows
    out = dict(zip(("window_types", "window_places", "hapax"), _windows(row, prose.code, rows, width, len(prose.vocab)))) if width else {}
    out |= {
        "word_count": np.bincount(row, minlength=rows), "sentence_count": np.bincount(prose.piece_row[prose.sentence], minlength=rows),
        "paragraph_count": np.bincount(prose.part_row[prose.paragraph], minlength=rows), "char_count": prose.chars(),
        "em_dash": prose.per_row(prose.find("—".encode())) + prose.repeated(b"-", 2), "en_dash": prose.per_row(prose.find("–".encode())), "ellipsis": prose.repeated(b".", 3),
    }
    for name, mark in (("comma", ","), ("semicolon", ";"), ("colon", ":"), ("parenthetical", "("), ("question", "?"), ("exclamation", "!")):
        out[name] = prose.per_row(prose.find(mark.encode()))
    for name, words in lists.items():
        out[name] = np.bincount(row[prose.among(words)[prose.code]], minlength=rows)
    out["hedge"] = out["hedge"] + prose.phrases(lexicons.HEDGE_PHRASES)
    told = np.unique(prose.piece[prose.among(lexicons.CONCESSIONS)[prose.code]])
    out["concession"] = np.bincount(prose.piece_row[told[prose.sentence[told]]], minlength=rows)
    return out


def count_documents(lists: dict[str, list[str]], width: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``prose`` and other columns: those without it, and the counts of each row, as ``schema`` names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = document_counts(Prose(batch.column("prose")), width, lists)
            columns = [pa.array(found[f.name].astype(np.int64)) if f.name in found else batch.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def profile_facts(by: list[str], given: list[str], lists: dict[str, list[str]], width: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From ``by, prose`` and the ``given`` additive counts: ``by, kind, key, n``, the counts by name, words, sentence and
    paragraph sizes of a scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scope, row_of = _scopes(batch, by)
            scopes = len(row_of)
            prose = Prose(batch.column("prose"))
            counts = {c: np.asarray(batch.column(c)) for c in given} | document_counts(prose, width, lists)
            del counts["hapax"]
            parts: list[tuple[np.ndarray, str, pa.Array, np.ndarray]] = []
            for name, values in counts.items():
                parts.append((np.arange(scopes), "count", pa.array([name] * scopes), np.bincount(scope, values, scopes)))
            base = max(len(prose.vocab), 1)
            key, _, n = _distinct(scope[prose.row] * base + prose.code, base * scopes)
            parts.append((key // base, "word", prose.vocab.take(pa.array(key % base)).cast(pa.string()), n))
            sizes = np.bincount(prose.piece, minlength=len(prose.piece_row)), np.bincount(prose.part, minlength=len(prose.part_row))
            for kind, length, owner in (("sentence", sizes[0][prose.sentence], prose.piece_row[prose.sentence]), ("paragraph", sizes[1], prose.part_row)):
                some = length > 0
                base = int(length.max(initial=0)) + 1
                key, n = np.unique(scope[owner[some]] * base + length[some], return_counts=True)
                parts.append((key // base, kind, pa.array((key % base).astype(str)), n))
            number = np.concatenate([p[0] for p in parts])
            own = batch.select(by).take(pa.array(row_of[number]))
            columns = [*(own.column(c) for c in by), pa.array([p[1] for p in parts]).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))), pa.concat_arrays([p[2].cast(pa.string()) for p in parts]), pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return lambda batches: _added(run(batches), [*by, "kind", "key"])
