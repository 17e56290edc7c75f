"""Exact repeats of at least ``MIN_WORDS`` words between (or within) texts, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``ANCHOR`` words, whose hashes form the index. The hash of
every window of ``ANCHOR`` words, at every word position of every text, probes it. A block that occurs at two places
or more is live. Since a repeat of ``MIN_WORDS`` = 2 * ``ANCHOR`` words holds a whole reference block, hits mark every
such repeat; around them windows of ``MIN_WORDS`` words are compared by 128-bit hash, and runs of equal windows joined,
which extends each hit to its maximal exact repeat. No text pair is formed, so a passage that n texts share costs n
records. The first occurrence, by (doc_id, position), stays; every other one is reported.

Hot passages don't meet in one task. A window that occurs again within the ``PACK_BYTES`` of text read together, once as a
block or more than ``OFTEN`` times, is live there without asking, and is sent to the index once. Of more than ``OFTEN`` equal long windows a task sends its first one
only, and the first of all comes back to each task that asked, where it meets the task's other occurrences. So a hash has
at most ``OFTEN`` records a pack, or a task, of text, however many texts hold it. The number of partitions follows the bytes of text.

Index and probes meet in one shuffle of five hash bytes and a delta-coded document id a window.

Defined cases: null, empty and short texts (under ``MIN_WORDS`` words) have no repeats; rows without an id are not
searched; words are runs without white space, compared exactly as written, by 64-bit hash; within one text an occurrence
counts only if it does not overlap the first; rows with one id are one document, so a repeated row is no repeat of itself;
an empty table gives an empty result; further columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .runtime import BROADCAST_BYTES, materialise, shuffle_partitions, unused
from .text import Words, mix64, rolling, slices

ANCHOR = 25
MIN_WORDS = 2 * ANCHOR
#: Text bytes whose windows go into one packed record a partition.
PACK_BYTES = 8 << 20
#: Places of a window in a pack that are sent to the index one by one, at most.
OFTEN = 16
#: Text bytes a partition, about.
PART_BYTES = 16 << 20

_PACKED = "part int, block boolean, payload binary"


def _planes(column: np.ndarray) -> bytes:
    """Byte planes of an integer column: constant high bytes then compress away in the shuffle."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), column.itemsize).T).tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    """Length, then each column's planes; a signed 64-bit column is stored as differences."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for column in columns:
        parts.append(_planes(np.diff(column, prepend=column.dtype.type(0)) if column.dtype == np.int64 else column))
    return b"".join(parts)


def _unpack(payload: bytes, *dtypes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for dtype in map(np.dtype, dtypes):
        size = n * dtype.itemsize
        column = np.ascontiguousarray(np.frombuffer(payload, np.uint8, size, at).reshape(dtype.itemsize, n).T).view(dtype).ravel()
        out.append(np.cumsum(column) if dtype == np.int64 else column)
        at += size
    return out


def _unpack_all(payloads: list[bytes], *dtypes) -> list[np.ndarray]:
    parts = [_unpack(p, *dtypes) for p in payloads]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(dtypes)]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each partition's records, in their order."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def _batch(rows: list[tuple[int, bool | None, bytes]]) -> pa.RecordBatch:
    part, block, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.bool_()), pa.array(payload, pa.binary())], ["part", "block", "payload"])


def _windows(batch: pa.RecordBatch, width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the batch, its ids, and for every in-row window of ``width`` words its start (over all words) and hash."""
    words = Words(batch.column("text"))
    hashes = rolling(words.hashes(), width)
    inside = np.flatnonzero(words.row[: len(hashes)] == words.row[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    return words, np.asarray(batch.column("doc_id")), inside, hashes[inside]


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            order = np.argsort(np.asarray(part.column("doc_id")), kind="stable")
            yield part.take(pa.array(order))


#: Hash bits that tell anchors of one partition apart.
_LOW = np.uint64((1 << 40) - 1)


def _anchor(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_part(hashes, parts).astype(np.int64) << 40) | (hashes & _LOW).astype(np.int64)


def _probe(parts: int):
    """Hashes of reference blocks and of all other windows, packed by partition of the hash space; and, with no ``block``,
    the live windows of documents in which, or in whose neighbours, they occur again."""

    def emit(held: list) -> pa.RecordBatch:
        sizes = [len(h[0]) for h in held]
        ids = np.concatenate([h[0] for h in held])
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.uint64)
        rank[by_id] = np.arange(len(ids), dtype=np.uint64)
        ids = ids[by_id]
        hashes = np.concatenate([h[1] for h in held])
        inner = np.concatenate([h[2] for h in held])
        owner = np.concatenate([rank[h[3] + at] for h, at in zip(held, np.cumsum([0, *sizes]))])
        held.clear()
        order = np.argsort(hashes)
        hashes, inner, owner = hashes[order], inner[order], owner[order]
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1))) if len(hashes) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(hashes)))
        rows = []
        if len(first):
            block = ~np.logical_and.reduceat(inner, first)
            known = (times > 1) & (block | (times > OFTEN))
            live = np.repeat(known, times)
            if live.any():
                doc = owner[live].astype(np.int64)
                sort = np.argsort(doc, kind="stable")
                rows.append((int(_part(mix64(ids[:1].view(np.uint64)), parts)[0]), None, _pack(ids[doc[sort]], _anchor(hashes[live], parts)[sort].view(np.uint64))))
            # of what is known here one record, a block if any of its places is one
            sent = ~live
            sent[first] = True
            inner[first] &= ~(block & known)
            hashes, inner, owner = hashes[sent], inner[sent], owner[sent]
        key = (_part(hashes, parts).astype(np.uint64) << np.uint64(33)) | (inner.astype(np.uint64) << np.uint64(32)) | owner
        order = np.argsort(key)
        key, hashes = key[order], hashes[order]
        group = (key >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            low = hashes[x:y] & _LOW
            rows.append((int(group[x]) >> 1, group[x] & 1 == 0, _pack(ids[(key[x:y] & np.uint64(0xFFFFFFFF)).astype(np.int64)], low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8))))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in _sorted_slices(batches):
            words, ids, at, hashes = _windows(part, ANCHOR)
            row = words.row[at]
            held.append((ids, hashes, (at - words.starts[row]) % ANCHOR != 0, row))
            size += part.column("text").nbytes
            if size >= PACK_BYTES:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    return run


def _by_document(ids: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    ids, anchor = ids[order], anchor[order]
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, np.int64)
    anchors = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(anchor))
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), anchors], ["doc_id", "anchors"])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence ``doc_id, anchors`` of a hash that is a reference block and occurs twice or more, and those that
    were found live where they were read."""
    found: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for part, block, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
            if block is None:
                ids, anchor = _unpack(payload, np.int64, np.uint64)
                yield _by_document(ids, anchor.view(np.int64))
            else:
                found.setdefault(part, ([], []))[0 if block else 1].append(payload)
    for part in sorted(found):
        blocks, others = found.pop(part)
        b_ids, *b_hash = _unpack_all(blocks, np.int64, np.uint32, np.uint8)
        o_ids, *o_hash = _unpack_all(others, np.int64, np.uint32, np.uint8)
        b_hash, o_hash = (x[0].astype(np.int64) | (x[1].astype(np.int64) << 32) for x in (b_hash, o_hash))
        index, count = np.unique(b_hash, return_counts=True)
        if not len(index):
            continue
        slot = np.minimum(np.searchsorted(index, o_hash), len(index) - 1)
        hit = index[slot] == o_hash
        o_ids, slot = o_ids[hit], slot[hit]
        count = count + np.bincount(slot, minlength=len(index))
        own = np.searchsorted(index, b_hash)
        ids = np.concatenate([b_ids, o_ids])
        slot = np.concatenate([own, slot])
        alive = count[slot] > 1
        yield _by_document(ids[alive], (np.int64(part) << np.int64(40)) | index[slot[alive]])


def _extend(parts: int):
    """Every window of ``MIN_WORDS`` words that holds a live anchor window, packed by hash with the number of the task that
    asks; of those that are often here only the first, while all stay in the task's own partition (``block``)."""

    def emit(held: list, task: int) -> pa.RecordBatch:
        ids, one, two, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, ids))
        ids, one, two, start = ids[order], one[order], two[order], start[order]
        order = np.argsort(one, kind="stable")
        if np.any((np.diff(one[order]) == 0) & (np.diff(two[order]) != 0)):
            order = np.lexsort((two, one))
        new = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
        first = np.flatnonzero(new)
        often = np.repeat(np.diff(np.append(first, len(order))) > OFTEN, np.diff(np.append(first, len(order))))
        many = np.zeros(len(ids), bool)
        many[order] = often
        sent = ~many
        sent[order[first]] = True
        rows = []
        if many.any():
            rows.append((task, True, _pack(ids[many], start[many], one[many], two[many])))
        ids, one, two, start, many = ids[sent], one[sent], two[sent], start[sent], many[sent].astype(np.uint8)
        rows += [(p, False, _pack(ids[w], start[w], one[w], two[w], np.full(len(w), task, np.int32), many[w])) for p, w in _by_part(_part(one, parts), parts)]
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        task = TaskContext.get().partitionId()
        for part in _sorted_slices(batches):
            words, ids, at, hashes = _windows(part, ANCHOR)
            anchors = part.column("anchors")
            owner = np.repeat(np.arange(len(anchors)), np.diff(np.asarray(anchors.offsets)))
            mine = np.asarray(anchors.flatten())
            # a window is live when its (row, anchor) is among the row's live anchors
            key = _anchor(hashes, parts)
            slot_of, coded = np.unique(mine, return_inverse=True)
            slot = np.minimum(np.searchsorted(slot_of, key), max(len(slot_of) - 1, 0))
            known = slot_of[slot] == key if len(slot_of) else np.zeros(len(key), bool)
            row = words.row[at]
            pair = row[known].astype(np.int64) * max(len(slot_of), 1) + slot[known]
            live = at[known][np.isin(pair, owner * max(len(slot_of), 1) + coded)]
            # mark the starts live - ANCHOR .. live, inside the row, of windows of MIN_WORDS words
            rows = words.row[live]
            first = np.maximum(live - ANCHOR, words.starts[rows])
            last = np.minimum(live, words.starts[rows + 1] - MIN_WORDS)
            ok = last >= first
            edge = np.bincount(first[ok], minlength=len(words.code) + 2)[: len(words.code) + 2] - np.bincount(last[ok] + 1, minlength=len(words.code) + 2)[: len(words.code) + 2]
            start = np.flatnonzero(np.cumsum(edge) > 0)
            if len(start):
                row, hashes = words.row[start], words.hashes()
                long, other = rolling(hashes, MIN_WORDS), rolling(mix64(hashes ^ np.uint64(0x6C62272E07BB0142)), MIN_WORDS)
                held.append((ids[row], long[start], other[start], (start - words.starts[row]).astype(np.int32)))
                size += len(start)
            if size >= 1 << 21:
                yield emit(held, task)
                held, size = [], 0
        if held:
            yield emit(held, task)

    return run


_FIRST = [np.uint64, np.uint64, np.int64, np.int32]


def _first(parts: int):
    """Sent to the task that asked: of each window that occurs again all places but the first, with the first (no
    ``block``), and the first place of those that are often there; and what stays in the task's own partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for part, own, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
                if own:
                    yield _batch([(part, True, payload)])
                else:
                    found.setdefault(part, []).append(payload)
        for part in sorted(found):
            ids, start, one, two, task, many = _unpack_all(found.pop(part), np.int64, np.int32, np.uint64, np.uint64, np.int32, np.uint8)
            order = np.lexsort((start, ids, two, one))
            ids, start, one, two, task, many = (x[order] for x in (ids, start, one, two, task, many))
            new = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
            first = np.repeat(new, np.diff(np.append(new, len(one))))
            later = np.flatnonzero((many == 0) & ((ids != ids[first]) | (start - start[first] >= MIN_WORDS)))
            later = later[np.lexsort((start[later], ids[later]))]
            asked = np.flatnonzero(many)
            rows = [(p, None, _pack(ids[later[w]], start[later[w]], ids[first[later[w]]], start[first[later[w]]])) for p, w in _by_part(task[later], parts)]
            rows += [(p, False, _pack(one[asked[w]], two[asked[w]], ids[first[asked[w]]], start[first[asked[w]]])) for p, w in _by_part(task[asked], parts)]
            if rows:
                yield _batch(rows)

    return run


def _resolved(own: list[bytes], firsts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that are often in this task all places but the first: document, start, and those of the first."""
    ids, start, one, two = _unpack_all(own, np.int64, np.int32, np.uint64, np.uint64)
    f_one, f_two, f_id, f_start = _unpack_all(firsts, *_FIRST)
    if not len(f_one):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    order = np.lexsort((f_two, f_one))
    f_one, f_two, f_id, f_start = (x[order] for x in (f_one, f_two, f_id, f_start))
    slot, last = np.searchsorted(f_one, one), np.searchsorted(f_one, one, side="right") - 1
    while len(behind := np.flatnonzero((slot < last) & (f_two[np.minimum(slot, len(f_two) - 1)] != two))):
        slot[behind] += 1
    known = np.flatnonzero(slot <= last)
    known = known[f_two[slot[known]] == two[known]]
    ids, start, first_id, first_start = ids[known], start[known], f_id[slot[known]], f_start[slot[known]]
    later = (ids != first_id) | (start - first_start >= MIN_WORDS)
    return ids[later], start[later], first_id[later], first_start[later]


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats: runs of windows whose distance to the first occurrence is the same."""
    found: dict[int, dict[bool | None, list]] = {}
    for batch in batches:
        for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
            found.setdefault(part, {True: [], False: [], None: []})[kind].append(payload)
    for part in sorted(found):
        kinds = found.pop(part)
        told = _unpack_all(kinds[None], np.int64, np.int32, np.int64, np.int32)
        ids, start, first_id, first_start = (np.concatenate(x) for x in zip(told, _resolved(kinds[True], kinds[False])))
        shift = first_start - start
        order = np.lexsort((start, shift, first_id, ids))
        ids, start, first_id, shift = ids[order], start[order], first_id[order], shift[order]
        repeated = np.concatenate(([False], (ids[1:] == ids[:-1]) & (first_id[1:] == first_id[:-1]) & (shift[1:] == shift[:-1]) & (start[1:] == start[:-1])))[: len(ids)]
        ids, start, first_id, shift = (x[~repeated] for x in (ids, start, first_id, shift))
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (first_id[1:] != first_id[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] != start[:-1] + 1))) if len(ids) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        words = np.diff(np.append(at, len(ids))) + MIN_WORDS - 1
        columns = [ids[at], start[at], words.astype(np.int32), first_id[at], (start[at] + shift[at]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start_word", "n_words", "first_doc_id", "first_start_word"])


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id, first_start_word``: maximal repeats of an earlier occurrence."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    packed = texts.mapInArrow(_probe(parts), _PACKED).repartitionById(parts, "part")
    live = materialise(packed.mapInArrow(_live, "doc_id long, anchors array<long>"))
    hits = live.repartition(parts, "doc_id").groupBy("doc_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors")).withColumnRenamed("doc_id", "__id")
    # the hits grow with the text, so both sides shuffle at every size, in a fixed number of partitions, by which the
    # tasks of the next step are known; hashing the hits spares sorting the texts
    near = texts.repartition(parts, "doc_id").join(hits.hint("shuffle_hash"), F.col("doc_id") == F.col("__id")).drop("__id")
    windows = near.mapInArrow(_extend(parts), _PACKED).repartitionById(parts, "part")
    later = windows.mapInArrow(_first(parts), _PACKED).repartitionById(parts, "part")
    return later.mapInArrow(_join_runs, "doc_id long, start_word int, n_words int, first_doc_id long, first_start_word int")


_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first word, number of words) and the white space after them."""
    gone: list[list[int]] = []
    for start, n in sorted(spans):
        if gone and start <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], start + n)
        else:
            gone.append([start, start + n])
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    kept, last = [], 0
    for start, end in gone:
        kept.append(text[last : at[start]])
        last = at[end]
    return "".join(kept) + text[last:]


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = [None if t is None or s is None else cut(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeat cut out of ``text`` and ``n_chars`` counted anew; what has no word left is dropped.

    Texts without repeats, null ones included, stay as they are.
    """
    key, found, left = (unused(docs, n) for n in ("__id", "__spans", "__cut"))
    spans = materialise(repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias(found)).withColumnRenamed("doc_id", key))
    size = spans.agg(F.sum(64 + 16 * F.size(found))).first()[0] or 0
    joined = docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, F.col("doc_id") == F.col(key), "left")
    touched = F.col(found).isNotNull() & F.col("text").isNotNull()
    joined = joined.withColumn(left, _cut(F.when(touched, F.col("text")), F.when(touched, F.col(found))))
    joined = joined.where(F.col(left).isNull() | F.col(left).rlike(r"[^ \t\n\r\f\x0B]")).withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType)))
    return joined.select(*docs.columns)


#: The same repeats without anchors: every window of every text, grouped by its words.
REPEATS_SQL = f"""
WITH texts AS (
  SELECT DISTINCT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT doc_id, unnest(range(greatest(len(words) - {MIN_WORDS - 1}, 0))) AS start,
    unnest(list_transform(range(greatest(len(words) - {MIN_WORDS - 1}, 0)), lambda i: md5(array_to_string(words[i + 1:i + {MIN_WORDS}], ' ')))) AS content
  FROM texts
), places AS (
  SELECT DISTINCT * FROM windows
), firsts AS (
  SELECT content, min((doc_id, start)) AS first FROM places GROUP BY content HAVING count(*) > 1
), later AS (
  SELECT doc_id, start, first[1] AS first_doc_id, first[2] AS first_start FROM places JOIN firsts USING (content)
  WHERE doc_id <> first[1] OR start - first[2] >= {MIN_WORDS}
), runs AS (
  SELECT *, start - row_number() OVER (PARTITION BY doc_id, first_doc_id, first_start - start ORDER BY start) AS run FROM later
)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start_word, CAST(count(*) + {MIN_WORDS - 1} AS INTEGER) AS n_words, first_doc_id, CAST(min(first_start) AS INTEGER) AS first_start_word
FROM runs GROUP BY doc_id, first_doc_id, first_start - start, run
"""
