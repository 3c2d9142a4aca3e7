"""External sources: a registry of DataFrames with id, text, score; search over them; links to canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Registry:
    """Sources by name. A source is any DataFrame with id, text and score: a table, spark.read.jdbc, spark.read.json."""

    def __init__(self):
        self.sources: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> Registry:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("score").cast("double"), F.lit(0.5)))) if "score" in df.columns else F.lit(0.5)
        self.sources[name] = df.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), score.alias("score"), F.lit(name).alias("source"))
        return self

    def all(self) -> DataFrame:
        if not self.sources:
            raise ValueError("no source is registered")
        first, *rest = self.sources.values()
        for df in rest:
            first = first.unionByName(df)
        return first

    def search(self, query: str, k: int = 10) -> DataFrame:
        """Rows that hold the query, ASCII case aside, best score first, then by id and source; each source gives its top k."""
        return search(self.all(), query, k)


def search(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    return docs.where(F.lower("text").contains(query.lower())).orderBy(F.desc("score"), "id", "source").limit(k)


def materialise(docs: DataFrame, stored: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents, new evidence): titles that stored hasn't, contents that evidence hasn't under the title."""
    new = docs.dropDuplicates(["title"]).join(stored.select("title").distinct(), "title", "left_anti")
    rows = docs.select("title", F.col("text").alias("content")).distinct()
    return new, rows.join(evidence.select("title", "content").distinct(), ["title", "content"], "left_anti")


def links_once(links: DataFrame) -> DataFrame:
    """Links (seq, source, external_name, canonical_name), the first of equals: where a name comes from. resolve() takes all links,
    as one that is registered again counts as the last of its name."""
    w = Window.partitionBy("source", "external_name", "canonical_name").orderBy("seq")
    return links.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def resolve(names: DataFrame, links: DataFrame) -> DataFrame:
    """names (source, surface) with canonical: the last link of the source and surface, else the first of the surface."""
    own = links.groupBy("source", F.col("external_name").alias("surface")).agg(F.max_by("canonical_name", "seq").alias("own"))
    any_ = links.groupBy(F.col("external_name").alias("surface")).agg(F.min_by("canonical_name", "seq").alias("other"))
    return names.join(own, ["source", "surface"], "left").join(any_, "surface", "left").select("source", "surface", F.coalesce("own", "other").alias("canonical"))
