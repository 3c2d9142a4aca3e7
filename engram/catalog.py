"""Tables by name, and the driver's tables as the model's: messages, memories, facts, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.scores import ttl_seconds

#: 2024-01-01 00:00:00 UTC, from which the driver's documents count their hours.
BASE = 1704067200
NOW = BASE + 40 * 86400
KINDS = ("knowledge", "skill", "profile", "experience", "preference", "interaction")


class Catalog:
    """Named DataFrames, read from a folder of Parquet files on first use; others can be put in their place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.own = spark, folder.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        return self.own[name] if name in self.own else self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def put(self, name: str, df: DataFrame) -> None:
        self.own[name] = df

    def write(self, name: str, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
        """Store a table as Parquet, in folders by the given columns."""
        self.table(name).write.mode(mode).partitionBy(*(by or [])).parquet(path)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return Catalog(spark, folder).table("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """documents as memories: tenant = source, six types by doc_id, created an hour apart, expiring by type."""
    return memories_of(Catalog(spark, folder).table("documents"))


def memories_of(d: DataFrame) -> DataFrame:
    """memories() of a table or stream of documents."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    d = d.select(F.col("doc_id").alias("id"), F.col("source").alias("tenant_id"), kind.alias("memory_type"), F.col("text").alias("content"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"), (F.lit(BASE) + F.col("doc_id") % 960 * 3600).alias("created_at"))
    return d.withColumn("expires_at", F.col("created_at") + ttl_seconds(F.col("memory_type")))


MEMORIES_SQL = f"""(
  SELECT doc_id AS id, source AS tenant_id, ['{"', '".join(KINDS)}'][CAST(doc_id % 6 + 1 AS INT)] AS memory_type, text AS content, (doc_id % 100) / 100.0::DOUBLE AS confidence,
    {BASE} + doc_id % 960 * 3600 AS created_at,
    {BASE} + doc_id % 960 * 3600 + CASE doc_id % 6 WHEN 0 THEN 2592000 WHEN 1 THEN 2592000 WHEN 2 THEN 2592000 WHEN 3 THEN 1209600 WHEN 4 THEN 604800 ELSE 86400 END AS expires_at
  FROM documents)"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """events as facts: entity = user, type by event type, payload from its k and value."""
    e = Catalog(spark, folder).table("events")
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = {"view": "interest", "click": "habit", "purchase": "preference", "signup": "identity", "error": "emotion"}
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in kinds.items()], F.lit("event"))
    time = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), kind.alias("fact_type"), time.alias("time"), k.alias("k"), "value")
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("topic "), (F.col("k") % 7).cast("string"), F.lit(" item "), (F.col("k") % 13).cast("string")).alias("content"),
            (F.col("k") % 2 == 1).alias("negated"),
            F.when(F.col("k") % 3 == 0, "agent_personality").otherwise("user").alias("attribution"),
            F.round(F.col("k") % 10 / 10.0, 1).alias("importance"),
            (F.col("k") % 8).alias("access_count"),
            F.when(F.col("k") % 5 < 2, F.concat(F.lit("t"), (F.col("k") % 5).cast("string"))).alias("topic"),
        )
    )
    return e.withColumn("payload", payload).withColumn("created_at", F.col("time"))


#: The same facts for DuckDB, with the payload's fields as columns.
FACTS_SQL = """(
  SELECT event_id AS id, user_id AS entity_id, CASE event_type WHEN 'view' THEN 'interest' WHEN 'click' THEN 'habit' WHEN 'purchase' THEN 'preference' WHEN 'signup' THEN 'identity' WHEN 'error' THEN 'emotion' ELSE 'event' END AS fact_type,
    CAST(floor(epoch(ts)) AS BIGINT) AS time, k, 'topic ' || (k % 7) || ' item ' || (k % 13) AS content, k % 2 = 1 AS negated, k % 3 = 0 AS persona,
    round(k % 10 / 10.0, 1) AS importance, k % 8 AS access_count, CASE WHEN k % 5 < 2 THEN 't' || (k % 5) END AS topic
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) from the star schema: places, companies, parts, and orders as events.

    Ids are offset by kind. Edges: located_in, part_of, supplies (with the months it held), participated_in.
    """
    t = Catalog(spark, folder).table
    off = {"region": 0, "nation": 100, "customer": 10_000_000, "supplier": 20_000_000, "part": 30_000_000, "order": 40_000_000_000}
    obj = lambda df, kind, key, name, of: df.select((F.col(key).cast("long") + off[of]).alias("id"), F.lit(kind).alias("object_type"), F.col(name).cast("string").alias("name"))
    objects = obj(t("region"), "location", "r_regionkey", "r_name", "region")
    for part in (
        obj(t("nation"), "location", "n_nationkey", "n_name", "nation"),
        obj(t("customer"), "person", "c_custkey", "c_name", "customer"),
        obj(t("supplier"), "organization", "s_suppkey", "s_name", "supplier"),
        obj(t("part"), "concept", "p_partkey", "p_name", "part"),
        obj(t("orders"), "event", "o_orderkey", "o_orderkey", "order"),
    ):
        objects = objects.unionByName(part)
    line = t("lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")

    def edge(df, a, b, predicate, lo=None, hi=None):
        return df.select(a.cast("long").alias("source_id"), b.cast("long").alias("target_id"), F.lit(predicate).alias("predicate"), (F.lit(None) if lo is None else lo).cast("int").alias("valid_from"), (F.lit(None) if hi is None else hi).cast("int").alias("valid_to"))

    c = F.col
    edges = edge(t("nation"), c("n_nationkey") + off["nation"], c("n_regionkey"), "located_in")
    edges = edges.unionByName(edge(t("customer"), c("c_custkey") + off["customer"], c("c_nationkey") + off["nation"], "located_in"))
    edges = edges.unionByName(edge(t("supplier"), c("s_suppkey") + off["supplier"], c("s_nationkey") + off["nation"], "located_in"))
    supplies = line.groupBy("l_suppkey", "l_partkey").agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    edges = edges.unionByName(edge(supplies, c("l_suppkey") + off["supplier"], c("l_partkey") + off["part"], "supplies", c("lo"), c("hi")))
    when = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    edges = edges.unionByName(edge(t("orders"), c("o_custkey") + off["customer"], c("o_orderkey") + off["order"], "participated_in", when))
    # by order before they are made distinct, which serves the join as well
    of_order = line.select("l_orderkey", "l_suppkey").repartition("l_orderkey").distinct().join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.unionByName(edge(of_order, c("l_suppkey") + off["supplier"], c("o_orderkey") + off["order"], "participated_in", when))
    return objects, edges


OBJECTS_SQL = """(
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'location' AS object_type, r_name AS name FROM region UNION ALL
  SELECT n_nationkey + 100, 'location', n_name FROM nation UNION ALL SELECT c_custkey + 10000000, 'person', c_name FROM customer UNION ALL
  SELECT s_suppkey + 20000000, 'organization', s_name FROM supplier UNION ALL SELECT p_partkey + 30000000, 'concept', p_name FROM part UNION ALL
  SELECT o_orderkey + 40000000000, 'event', CAST(o_orderkey AS VARCHAR) FROM orders)"""
EDGES_SQL = """(
  SELECT CAST(n_nationkey + 100 AS BIGINT) AS source_id, CAST(n_regionkey AS BIGINT) AS target_id, 'located_in' AS predicate, CAST(NULL AS INT) AS valid_from, CAST(NULL AS INT) AS valid_to FROM nation UNION ALL
  SELECT c_custkey + 10000000, c_nationkey + 100, 'located_in', NULL, NULL FROM customer UNION ALL
  SELECT s_suppkey + 20000000, s_nationkey + 100, 'located_in', NULL, NULL FROM supplier UNION ALL
  SELECT l_suppkey + 20000000, l_partkey + 30000000, 'supplies', min(year(l_shipdate) * 12 + month(l_shipdate)), max(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem GROUP BY l_suppkey, l_partkey UNION ALL
  SELECT o_custkey + 10000000, o_orderkey + 40000000000, 'participated_in', year(o_orderdate) * 12 + month(o_orderdate), NULL FROM orders UNION ALL
  SELECT DISTINCT l_suppkey + 20000000, o_orderkey + 40000000000, 'participated_in', year(o_orderdate) * 12 + month(o_orderdate), NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
