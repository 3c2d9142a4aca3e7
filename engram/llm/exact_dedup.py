"""Exact dedup: group by a 128-bit content hash, keep one row of each group, compare bytes inside groups.

Texts are equal when they are identical after deleting ASCII white space. Everything is a DataFrame
expression; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import SPACE


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _order(length: Column, doc_id: Column) -> Column:
    """Least for the row that stays: most code points, then smallest id, rows without an id last."""
    return F.struct((-length).alias("l"), doc_id.isNull().alias("o"), doc_id.alias("i"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The shuffle key is the MD5 of the normalised text. Within a hash the normalised bytes themselves are a
    grouping key, so two texts that only share the hash fall apart; copies combine before the shuffle, so a
    group of any size reaches its reducer as one row per map task. Documents find their group again by MD5
    and SHA-256 together; should two different texts ever share both, the query fails instead of merging them.

    Null texts count as empty, and all empty texts are one group. A row without an id comes after those of its length that
    have one; where it stays, keep_id is null. `kept` marks the row that stays and those that tie with it, in id and length:
    repeated rows, which are counted each, are so marked all. An empty table gives no rows. Other columns of docs are not
    read.
    """
    norm = normalised(docs[text])
    rows = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.coalesce(F.length(docs[text]), F.lit(0)).alias("chars"),
        norm.alias("norm"),
    )
    keyed = rows.withColumns({"h": F.unhex(F.md5("norm")), "sha": F.sha2("norm", 256)})
    variants = keyed.groupBy("h", "sha", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min(_order(F.col("chars"), F.col("doc_id"))).alias("best")
    )
    groups = (
        variants.groupBy("h", "sha")
        .agg(F.count(F.lit(1)).alias("variants"), F.first("n").alias("n"), F.first("best").alias("best"))
        .withColumn(
            "n",
            F.when(F.col("variants") == 1, F.col("n")).otherwise(
                F.raise_error(F.lit("different texts share MD5 and SHA-256")).cast("long")
            ),
        )
        # a key of its own type: both sides of the join below get an exchange that can be split where one key is hot
        .select(F.concat(F.hex("h"), "sha").alias("key"), F.col("n").alias("group_size"), F.col("best.i").alias("keep_id"), (-F.col("best.l")).alias("keep_chars"))
    )
    narrow = keyed.select("doc_id", "chars", F.col("sha").alias("text_sha256"), F.concat(F.hex("h"), "sha").alias("key"))
    return narrow.join(groups, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    The row is one that exact_groups() marks as kept; of several that tie there, the one of the least hash of all columns
    but maps. One shuffle: keys are the MD5 and the normalised bytes, and copies combine before it.
    """
    norm = normalised(docs[text])
    chars = F.coalesce(F.length(docs[text]), F.lit(0))
    whole = F.struct(*[docs[c] for c in docs.columns])
    tie = F.xxhash64(*[docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    best = docs.select(F.md5(norm).alias("h"), norm.alias("norm"), whole.alias("r"), F.struct(_order(chars, docs[doc_id]).alias("o"), tie.alias("t")).alias("o"))
    return best.groupBy("h", "norm").agg(F.min_by("r", "o").alias("r")).select("r.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
