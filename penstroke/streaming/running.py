"""Running totals over a stream of documents.

Every count of a document is additive, so the state is one row of sums a scope; it doesn't grow with the stream. Rates
follow from the totals at any time. Ranked lists and length statistics need all words or sizes, and stay with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from penstroke.operators import profile


def document_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def running_totals(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    """Totals by scope: narrow measuring, then one partial aggregation into the state."""
    return profile.totals(profile.measure(docs, by, order, text), by)


def running_rates(docs: DataFrame, by: list[str], order: str = "doc_id", text: str = "text") -> DataFrame:
    return profile.rates(running_totals(docs, by, order, text), by)


def start(totals: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there, keeping the result as the in-memory table ``name``."""
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
