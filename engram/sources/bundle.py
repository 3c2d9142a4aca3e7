"""The graph as name-keyed rows, without surrogate ids, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "engram-bundle-1"


def export_edges(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by the names and types of their ends; those with an end that is no object are left out."""
    a = objects.select(F.col("id").alias("source_id"), F.col("name").alias("source"), F.col("object_type").alias("source_type"))
    b = objects.select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("object_type").alias("target_type"))
    return edges.join(a, "source_id").join(b, "target_id").select("source", "source_type", "predicate", "target", "target_type", "valid_from", "valid_to")


def write(objects: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines in two folders, each row with the format's tag."""
    objects.select(F.lit(FORMAT).alias("format"), "object_type", "name").write.json(f"{path}/objects")
    export_edges(objects, edges).withColumn("format", F.lit(FORMAT)).write.json(f"{path}/edges")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, edges by name) of a bundle; rows of another format are an error."""
    tagged = lambda df: df.where(F.when(F.col("format") == FORMAT, True).otherwise(F.raise_error(F.lit("not a bundle of this format")).cast("boolean")))
    objects = spark.read.schema("format string, object_type string, name string").json(f"{path}/objects")
    edges = spark.read.schema("format string, source string, source_type string, predicate string, target string, target_type string, valid_from int, valid_to int").json(f"{path}/edges")
    return tagged(objects).drop("format"), tagged(edges).drop("format")


def merge(objects: DataFrame, edges: DataFrame, new_objects: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with a bundle's rows that it hasn't: objects by type and name, with ids from a hash of both, then edges by
    ends, predicate and times. Merging a bundle twice changes nothing (edges too, unlike a plain append)."""
    whole, ids = _named(objects, new_objects)
    e = new_edges.join(ids.toDF("source_type", "source", "source_id"), ["source_type", "source"]).join(ids.toDF("target_type", "target", "target_id"), ["target_type", "target"])
    return whole, _with_new(edges, e.select(edges.columns))


def merge_graph(objects: DataFrame, edges: DataFrame, other_objects: DataFrame, other_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merge() of export_edges() of another graph (objects and edges by ids of its own), without its names on every edge: the
    other's ids are put into this graph's first, by type and name, and its edges take those."""
    whole, ids = _named(objects, other_objects)
    own = other_objects.join(ids.withColumnRenamed("id", "own"), ["object_type", "name"]).select("id", "own")
    e = other_edges
    for end in ("source_id", "target_id"):
        e = e.join(own.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("own", end)
    return whole, _with_new(edges, e.select(edges.columns))


def _named(objects: DataFrame, new_objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects with the new ones that they haven't, and (object_type, name, id): the smallest id of a type and name."""
    fresh = new_objects.select("object_type", "name").distinct().join(objects, ["object_type", "name"], "left_anti")
    whole = objects.unionByName(fresh.withColumn("id", F.xxhash64("object_type", "name")))
    return whole, whole.groupBy("object_type", "name").agg(F.min("id").alias("id"))


def _with_new(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges, and each new one once that isn't there. One grouping of both, so the edges are made once."""
    both = edges.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    # few rows are equal, so none are added up before they are shuffled
    both = both.repartition("source_id", "target_id").groupBy(*edges.columns).agg(F.sum("_old").alias("_n"))
    times = F.array_repeat(F.lit(0), F.greatest(F.col("_n"), F.lit(1)).cast("int"))
    return both.withColumn("_copy", F.explode(times)).select(edges.columns)
