"""Vectors as arrays: cosines, and centroids by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null, empty or all zeros, or their lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n)


def clamped_cosine(a: Column, b: Column) -> Column:
    """In [0, 1], 0 where cosine has no value."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, n): the mean of each group's vectors by position; groups of unequal lengths or zero mean go."""
    n = df.groupBy(key).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).where("lo = hi and hi > 0")
    means = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return n.join(c, key).where(F.exists("centroid", lambda x: F.abs(x) > 1.1920929e-07)).select(key, "centroid", "n")
