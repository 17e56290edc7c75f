"""Document quality: random Fourier features, ridge scores, isotonic calibration.

``FEATURES`` statistics of the whole text are standardised and mapped by ``COMPONENTS`` random Fourier features, whose
inner products approximate a Gaussian kernel. Each partition sums its part of the ridge normal equations; the sums are
added and solved on the driver, where their size depends on ``COMPONENTS`` alone. Scores of held-out labelled rows are
calibrated by isotonic regression (pool adjacent violators). Training reads at most about ``MAX_LABELLED`` labelled
rows, chosen by hash of the id; scoring reads every document once and moves no text.

Defined cases: a null, empty or blank text scores 0 and is rejected; labels that are null are ignored and several
labels of one document averaged; labels without their document are ignored; with labels of one class only, or none,
every other document scores that class (1 without labels); repeated rows score alike; further columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .runtime import materialise, sized_hint
from .text import Words, bounds, mix64, slices, string_parts, sum_runs

#: Labelled rows used for fitting and calibration, about; the rest of a larger label table isn't needed.
MAX_LABELLED = 40_000
COMPONENTS = 256
RIDGE = 1e-3
SEED = 20_240_601
#: Documents whose calibrated probability of good quality is below this are rejected.
THRESHOLD = 0.5
_FIT_PARTITIONS = 8
_HELD_OUT = 4  # one labelled row in so many calibrates

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _WIDE = range(8)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in " \t\r\f\v"]] = _SPACE
_CLASS[ord("\n")] = _LINE
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _STOP
_CLASS[128:] = _WIDE

FEATURES = [
    "log_words", "word_bytes", "lower", "upper", "digit", "stops", "marks", "wide", "line_breaks", "distinct_words",
    "top_word", "distinct_pairs", "marked_words", "capital_words", "short_words", "long_words", "distinct_lines", "exclaimed",
]


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text; all zero without words."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words = Words(texts)
    count = np.diff(words.starts).astype(float)
    per_word = 1 / np.maximum(count, 1)
    data, offsets = string_parts(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64) * 8, np.diff(offsets))
    owner += _CLASS[data]
    kinds = np.bincount(owner, minlength=n * 8).reshape(n, 8).astype(float)
    size = np.maximum(kinds.sum(1), 1)
    exclaimed = np.zeros(n)
    at = np.flatnonzero(data == ord("!"))
    np.add.at(exclaimed, np.searchsorted(offsets, at, side="right") - 1, 1)
    # by distinct word: what its bytes are
    v_data, v_offsets = string_parts(words.vocab)
    v_owner = np.repeat(np.arange(len(words.vocab), dtype=np.int64) * 8, np.diff(v_offsets)) + _CLASS[v_data]
    v = np.bincount(v_owner, minlength=len(words.vocab) * 8).reshape(-1, 8)
    length = v.sum(1)
    flags = np.stack([v[:, _MARK] > 0, (v[:, _UPPER] > 1) & (v[:, _LOWER] == 0), length <= 3, length >= 14], axis=1)
    flag_sums = sum_runs(flags[words.code].astype(np.uint8), words.starts)
    row, term, tf, hashes = words.terms()
    starts = bounds(row, n)
    top = np.zeros(n)
    np.maximum.at(top, row, tf)
    # distinct neighbours
    code = mix64(words.code.astype(np.uint64))
    pair = mix64(code[:-1] * np.uint64(3) + code[1:]) if len(code) > 1 else np.zeros(0, np.uint64)
    inside = words.row[:-1] == words.row[1:] if len(code) > 1 else np.zeros(0, bool)
    key = (words.row[:-1][inside].astype(np.uint64) << np.uint64(44)) | (pair[inside] >> np.uint64(20))
    pairs = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64), minlength=n)
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    line_row = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.asarray(lines.offsets)))
    distinct = np.bincount(np.unique(line_row * max(len(coded.dictionary), 1) + np.asarray(coded.indices)) // max(len(coded.dictionary), 1), minlength=n)
    out = np.column_stack([
        np.log1p(count), size * per_word, *(kinds[:, [_LOWER, _UPPER, _DIGIT, _STOP, _MARK, _WIDE]] / size[:, None]).T, np.log1p(kinds[:, _LINE]) - np.log1p(count),
        np.log1p(np.diff(starts)) - np.log1p(count), np.sqrt(top * per_word), pairs / np.maximum(count - 1, 1),
        *(flag_sums * per_word[:, None]).T, distinct / np.maximum(np.bincount(line_row, minlength=n), 1), exclaimed * per_word,
    ])
    out[count == 0] = 0
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), values], ["doc_id", "y", "x"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("y"))


def fourier(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random features, for standardised inputs of ``d`` dimensions."""
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(d, COMPONENTS)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, COMPONENTS)


class Model:
    """Standardisation, Fourier map, ridge weights and calibration knots; small, and independent of the data's size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.frequency, self.phase = fourier(len(mean))
        self.weights = np.zeros(COMPONENTS + 1)
        self.knots = (np.array([0.0]), np.array([1.0]))

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / COMPONENTS) * np.cos(z @ self.frequency + self.phase), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), *self.knots)


class Constant:
    """Where labels show one class only."""

    def __init__(self, value: float):
        self.value = value

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of ``y`` to ``score`` (least squares, equal scores pooled)."""
    value, index = np.unique(score, return_inverse=True)
    weight = np.bincount(index).astype(float)
    mean = np.bincount(index, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(value)):
        blocks.append([mean[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            top = blocks[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, last
    x, p = [], []
    for m, _, first, last in blocks:
        for i in {int(first), int(last)}:
            x.append(value[i])
            p.append(m)
    order = np.lexsort((p, x))
    return np.array(x)[order], np.array(p)[order]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x, y = _matrix(batch)
        part = np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


def _normal(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = _matrix(batch)
            z = model.basis(x)
            part = np.concatenate([(z.T @ z).ravel(), z.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    return run


def _added(df: DataFrame) -> np.ndarray | None:
    parts = [np.frombuffer(r.sums) for r in df.collect()]
    return np.sum(parts, axis=0) if parts else None


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model | Constant:
    """Train on labelled documents (``labels``: doc_id and ``target`` 0/1)."""
    known = materialise(labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.avg(target).alias("y")))
    share = MAX_LABELLED / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    rows = texts.join(sized_hint(known, MAX_LABELLED, 32), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")
    table = materialise(rows.mapInArrow(_feature_rows, "doc_id long, y double, x array<double>"))
    held_out = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(_HELD_OUT)) == 0
    train = table.where(~held_out).repartition(_FIT_PARTITIONS, "doc_id")
    sums = _added(train.mapInArrow(_moments, "sums binary"))
    if sums is None or not 0 < sums[1] < sums[0]:
        return Constant(1.0 if sums is None or sums[1] else 0.0)
    n, d = sums[0], (len(sums) - 2) // 2
    mean = sums[2 : 2 + d] / n
    model = Model(mean, np.sqrt(np.maximum(sums[2 + d :] / n - mean**2, 1e-12)) + 1e-6)
    both = _added(train.mapInArrow(_normal(model), "sums binary"))
    size = COMPONENTS + 1
    gram, right = both[: size * size].reshape(size, size), both[size * size :]
    penalty = np.full(size, RIDGE * n / COMPONENTS)
    penalty[-1] = 0
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)
    scored = [(np.asarray(r.x), r.y) for r in table.where(held_out).orderBy("doc_id").collect()]
    if scored:
        model.knots = isotonic(model.score(np.stack([x for x, _ in scored])), np.array([y for _, y in scored]))
    return model


def scorer(model: Model | Constant):
    """A column function: text to calibrated probability of good quality."""

    @F.arrow_udf(DoubleType())
    def quality_probability(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
            x = features(part.column("text"))
            out.append(np.where(x[:, 0] > 0, model.probability(x), 0.0))
        return pa.array(np.concatenate(out))

    return quality_probability


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality_probability, accepted`` of every document."""
    probability = scorer(fit(docs, labels))
    scored = docs.select("doc_id", probability("text").alias("quality_probability"))
    return scored.withColumn("accepted", F.col("quality_probability") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without what the classifier rejects."""
    probability = scorer(fit(docs, labels))
    return docs.where(probability("text") >= THRESHOLD)
