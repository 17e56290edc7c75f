"""Conversation exports: headed Markdown files and the two JSON formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.functions.clean import strip
from penstroke.operators import turns

from .text import read_texts


def markdown_files(spark: SparkSession, path: str, min_bytes: int = 500, numbered_copies: bool = False) -> DataFrame:
    """Markdown files of at least ``min_bytes``; a name that ends in _ and digits is taken for a numbered copy."""
    files = read_texts(spark, path, "*.md").where(F.col("size") >= min_bytes)
    return files if numbered_copies else files.where(~F.col("stem").rlike(r"_\d+$"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file; of a folder its conversations.json, or else every JSON file below it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    main = f"{path.rstrip('/')}/conversations.json"
    if fs.getFileStatus(fs_path(path)).isDirectory():
        return read_texts(spark, main) if fs.exists(fs_path(main)) else read_texts(spark, path, "*.json")
    if not path.endswith(".json"):
        raise ValueError(f"{path} is neither a JSON file nor a folder")
    return read_texts(spark, path)


def _part(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def messages_by_sender(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, turn, role, text, broken`` of exports holding chat_messages with sender and text; human becomes user.

    A root that is no list counts as a list of one. ``broken`` marks every row of a file that doesn't parse, or in
    which a human message has a text that is no string; such files are skipped whole.
    """
    root = files.select(key, F.try_parse_json(text).alias("root"))
    convs = F.coalesce(_part(F.col("root"), "$", "array<variant>"), F.array("root"))
    each = root.select(key, F.col("root").isNull().alias("lost"), F.posexplode_outer(F.flatten(F.transform(convs, lambda c: F.coalesce(_part(c, "$.chat_messages", "array<variant>"), F.array().cast("array<variant>"))))).alias("turn", "m"))
    value = _part(F.col("m"), "$.text", "variant")
    rows = each.select(key, "lost", "turn", _part(F.col("m"), "$.sender", "string").alias("sender"), value.alias("value"))
    bad = F.col("lost") | ((F.col("sender") == "human") & F.col("value").isNotNull() & ~_is_text(F.col("value")))
    rows = rows.select(key, "turn", F.when(F.col("sender") == "human", "user").otherwise(F.col("sender")).alias("role"), F.coalesce(_part(F.col("value"), "$", "string"), F.lit("")).alias("text"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return _with_broken(rows, key)


def messages_by_mapping(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, turn, role, text, broken`` of exports holding a mapping of nodes, in the order of their keys in the file,
    every branch included. Of a message's parts those that are strings are joined by a space."""
    kind = "array<struct<mapping:map<string,variant>>>"
    root = files.select(key, F.from_json(text, kind).alias("root"), F.try_parse_json(text).isNull().alias("lost"))
    each = root.select(key, "lost", F.posexplode_outer(F.flatten(F.transform("root", lambda c: F.coalesce(F.map_values(c["mapping"]), F.array().cast("array<variant>"))))).alias("turn", "node"))
    rows = each.select(key, "lost", "turn", _part(F.col("node"), "$.message.author.role", "string").alias("role"), _part(F.col("node"), "$.message.content.parts", "variant").alias("parts"))
    joined = F.array_join(F.transform(F.filter(_part(F.col("parts"), "$", "array<variant>"), _is_text), lambda p: p.cast("string")), " ")
    bad = F.col("lost") | ((F.col("role") == "user") & F.col("parts").isNotNull() & _part(F.col("parts"), "$", "array<variant>").isNull())
    rows = rows.select(key, "turn", "role", F.coalesce(joined, F.lit("")).alias("text"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return _with_broken(rows, key)


def _with_broken(rows: DataFrame, key: str) -> DataFrame:
    broken = rows.where("bad").select(F.col(key).alias("__broken")).distinct()
    return rows.join(broken, F.col(key) == F.col("__broken"), "left").select(key, "turn", "role", "text", F.col("__broken").isNotNull().alias("broken"))


def extracted(messages: DataFrame) -> DataFrame:
    """The author's cleaned turns of the files that aren't broken."""
    return turns.author_turns(messages.where(~F.col("broken")))


def warnings(messages: DataFrame, key: str = "path") -> DataFrame:
    """Files that were skipped."""
    return messages.where("broken").select(key).distinct().withColumn("warning", F.concat(F.lit("Error reading "), F.substring_index(key, "/", -1)))


__all__ = ["extracted", "json_files", "markdown_files", "messages_by_mapping", "messages_by_sender", "strip", "warnings"]
