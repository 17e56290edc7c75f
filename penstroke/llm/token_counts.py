"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a run without white space behind the word-start mark. Its tokens are the pieces of the vocabulary that
cover it with the highest sum of log probabilities; a character that no piece covers costs one token for each of its
UTF-8 bytes (byte fallback). The vocabulary file gives the pieces and their order; a piece's log probability is that
of Zipf's law at its rank, -ln(rank + ``ZIPF_SHIFT``), since the file's own scores are merge ranks.

The distinct pre-tokens of a slice are put in order, which is a depth-first walk of their trie: the forward score of a
node (best sum, its number of tokens) is computed once, when the walk first enters it, and shared by every pre-token
below; terminal nodes give the counts, which a bounded table keeps for the next slices of the worker. One pass, no
shuffle; texts are read once and only counts leave.

Defined cases: a null text has a null count, an empty or blank one 0; of covers with equal sums that of the shorter
last piece wins; rows are neither merged nor dropped; an empty table stays empty; further columns are ignored, whatever
their names; a missing vocabulary file is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, slices

MARK = "▁"
ZIPF_SHIFT = 2.7
#: A byte of the fallback scores this much.
BYTE_SCORE = -20.0
#: Pre-tokens whose counts a worker keeps.
KEPT_WORDS = 1 << 18


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file with their log probabilities; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + ZIPF_SHIFT) for rank, i in enumerate(normal)}


def with_suffixes(pieces: dict[str, float]) -> dict[str, float | None]:
    """The pieces, and every suffix of one (None where it is no piece itself): reading backwards, whatever isn't here
    ends no piece however far it is continued."""
    out: dict[str, float | None] = {}
    for piece in pieces:
        for at in range(1, len(piece)):
            out.setdefault(piece[at:], None)
    return out | pieces


def walk(words: list[str], suffixes: dict[str, float | None]) -> list[int]:
    """Token count of each of the sorted distinct pre-tokens ``words`` (without mark), in one walk of their trie."""
    counts = []
    path = MARK
    start = suffixes.get(MARK)
    mark_bytes = len(MARK.encode())
    # forward[i]: best sum of the first i characters of the path; tokens[i]: its number of tokens
    forward = [0.0, start if start is not None else BYTE_SCORE * mark_bytes]
    tokens = [0, 1 if start is not None else mark_bytes]
    missing = 1.0  # no score is positive
    get = suffixes.get
    last = ""
    for word in words:
        shared = 0
        for x, y in zip(word, last):
            if x != y:
                break
            shared += 1
        del forward[shared + 2 :], tokens[shared + 2 :]
        path = MARK + word
        for end in range(shared + 2, len(path) + 1):
            size = len(path[end - 1].encode("utf-8", "surrogatepass"))
            best, number = forward[end - 1] + BYTE_SCORE * size, tokens[end - 1] + size
            for begin in range(end - 1, -1, -1):
                score = get(path[begin:end], missing)
                if score is None:
                    continue
                if score is missing:
                    break
                if (total := forward[begin] + score) > best:
                    best, number = total, tokens[begin] + 1
            forward.append(best)
            tokens.append(number)
        counts.append(tokens[len(path)])
        last = word
    return counts


class Counter:
    """Counts of pre-tokens, with a bounded memory of earlier ones."""

    def __init__(self, pieces: dict[str, float]):
        self.suffixes = with_suffixes(pieces)
        self.known: dict[str, int] = {}

    def count(self, vocab: list[str]) -> np.ndarray:
        known = self.known
        fresh = sorted(w for w in vocab if w not in known)
        found = dict(zip(fresh, walk(fresh, self.suffixes)))
        out = np.fromiter((known[w] if w in known else found[w] for w in vocab), np.int64, len(vocab))
        if len(known) + len(found) > KEPT_WORDS:
            known.clear()
        if len(found) <= KEPT_WORDS:
            known.update(found)
        return out


def _rows(pieces: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                sums = np.concatenate(([0], np.cumsum(counter.count(words.vocab.to_pylist())[words.code])))
                total = sums[words.starts[1:]] - sums[words.starts[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, mask=np.asarray(part.column("text").is_null()))], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens`` of every row. The driver reads the vocabulary; executors get its pieces with the task."""
    return docs.select("doc_id", "text").mapInArrow(_rows(load_pieces(vocabulary)), "doc_id long, n_tokens long")
