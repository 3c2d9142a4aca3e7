"""Readers: each gives documents with path, title and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parsers of binary formats by extension, functions of bytes; there is none for PDF unless one is registered.
PARSERS: dict[str, Callable[[bytes], str]] = {}


def format_of(path: Column) -> Column:
    """text, markdown, json, csv or pdf by the extension; text for any other."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("json", "csv", "pdf"), ext).otherwise("text")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, whole."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", stem(F.col("path")).alias("title"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON files: an array, one object, or {"documents": [...]}; text is required, a title defaults to name#i."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    one = "struct<title:string,text:string>"
    parsed = F.coalesce(
        F.from_json("value", f"struct<documents:array<{one}>>")["documents"],
        F.from_json("value", f"array<{one}>"),
    )
    lone = F.array(F.from_json("value", one))
    docs = F.when(F.size(F.filter(F.coalesce(parsed, F.array().cast(f"array<{one}>")), lambda x: x["text"].isNotNull())) > 0, parsed).otherwise(lone)
    rows = raw.select("path", F.posexplode(docs).alias("i", "d")).where("d.text is not null")
    return rows.select("path", F.coalesce("d.title", F.concat(stem(F.col("path")), F.lit("#"), F.col("i").cast("string"))).alias("title"), F.col("d.text").alias("text"))


def read_binary(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Documents of a binary format by the parser registered for it, a batch of files at a time in Arrow."""
    if extension not in PARSERS:
        raise ValueError(f"no parser for {extension}")
    parse = F.pandas_udf(_each(PARSERS[extension]), "string")
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", stem(F.col("path")).alias("title"), parse("content").alias("text"))


def _each(parser):
    import pandas as pd

    def run(content: pd.Series) -> pd.Series:
        return content.map(parser)

    return run


def dialogs(messages: DataFrame) -> DataFrame:
    """One document a conversation: conv_id, title (the first user message, 64 characters), text of `role: content` lines."""
    trimmed = F.regexp_replace("content", r"^\s+|\s+$", "")
    line = F.concat("role", F.lit(": "), trimmed)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n")
    title = F.substring(F.min_by(trimmed, F.when(F.col("role") == "user", F.col("turn"))), 1, 64)
    return messages.groupBy("conv_id").agg(title.alias("title"), body.alias("text"))


def raw_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text isn't blank, trimmed."""
    t = F.regexp_replace(column, r"^\s+|\s+$", "")
    return texts.withColumn(column, t).where(F.col(column) != "")


def unseen(docs: DataFrame, seen: DataFrame, key: str = "title") -> DataFrame:
    """Documents whose key isn't in seen, one of each key: the first by id."""
    fresh = docs.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where("_r = 1").drop("_r")


def cursor(docs: DataFrame, mark: str) -> DataFrame:
    """(seen, watermark): how many different titles, and the largest mark."""
    return docs.agg(F.countDistinct("title").alias("seen"), F.max(mark).alias("watermark"))
