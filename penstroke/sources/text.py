"""Text files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions.clean import strip, unix_lines

_FILE = "_metadata.file_path"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """``path, stem, size, text`` of each file below ``path`` that fits the pattern; a single file is read whatever its
    name. Bytes that aren't UTF-8 become U+FFFD, line ends a line feed."""
    reader = spark.read.option("recursiveFileLookup", True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(path, wholetext=True).select(F.col(_FILE).alias("path"), F.col("_metadata.file_size").alias("size"), unix_lines(F.col("value")).alias("text"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"[.][^.]*$", "")
    return raw.select("path", stem.alias("stem"), "size", "text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Texts with a sort key ``ord``: Markdown files by path, then text files by path; blank files are left out."""
    texts = read_texts(spark, path)
    rank = F.when(F.endswith("path", F.lit(".md")), "0").otherwise("1")
    return texts.where(strip(F.col("text")) != "").withColumn("ord", F.concat(rank, F.col("path")))
