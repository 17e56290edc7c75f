"""Extracted turns as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_turns(turns: DataFrame, path: str, text: str = "cleaned") -> None:
    """A folder of text files, one a partition, with a blank line after each turn; nothing passes the driver."""
    turns.select(F.concat(text, F.lit("\n")).alias("value")).write.text(path)


def joined(turns: DataFrame, *order: str, text: str = "cleaned") -> str:
    """All turns in order, with blank lines between them, on the driver: for one author's export."""
    return "\n\n".join(r[text] for r in turns.orderBy(*order).select(text).toLocalIterator())
