"""Parsed tokens by an optional parser; without it only this source is missing."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "en_core_web_sm"
#: Characters that single-author reports parse; pass it as ``most_chars`` for the same sample, None parses all.
SAMPLE_CHARS = 50_000


def available() -> bool:
    return importlib.util.find_spec("spacy") is not None


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, most_chars: int | None = None) -> DataFrame:
    """``key, sentence, at, head, tag, dep, lemma`` of every token; the model is loaded once a partition."""
    if not available():
        raise ModuleNotFoundError("parsing needs the spacy package and its model")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        import spacy

        nlp = spacy.load(model)
        for frame in frames:
            rows = []
            for k, value in zip(frame[key], frame[text]):
                for number, sentence in enumerate(nlp(value).sents):
                    tokens = [t for t in sentence if not t.is_space]
                    at = {t.i: i for i, t in enumerate(tokens)}
                    rows += [(k, number, i, at.get(t.head.i, i), t.pos_, t.dep_, t.lemma_) for i, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=[key, "sentence", "at", "head", "tag", "dep", "lemma"])

    value = F.col(text) if most_chars is None else F.substring(text, 1, most_chars)
    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(text).isNotNull()).select(key, value.alias(text)).mapInPandas(run, f"{key} {kind}, sentence int, at int, head int, tag string, dep string, lemma string")
