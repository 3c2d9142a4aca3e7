"""Networks of characters around one of them, by relations and by events that they share.

An event is a hyperedge: a level goes from names to their events and from those to the events' names, so an event costs as
many rows as it has members, and it is opened once. Levels are breadth-first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.graph import checkpointed


def neighbourhood(relations: DataFrame, members: DataFrame, start: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, events): names within depth steps of the start, with their level, and the events met, with theirs.

    relations has a and b, read both ways; members has event_id and name. A step goes along a relation or through an event.
    nodes: name, level; the start is of level 0, though it has no relation or event. events: event_id, level (that of the
    names that led to it); those of the last level's names aren't opened. Null names are nobody.
    """
    spark = relations.sparkSession
    kind = relations.schema["a"].dataType
    ways = relations.select(F.col("a").alias("name"), F.col("b").alias("other")).unionByName(relations.select(F.col("b").alias("name"), F.col("a").alias("other"))).where("name is not null and other is not null")
    took = members.select("event_id", "name").where("event_id is not null and name is not null").distinct()
    nodes = spark.createDataFrame([(start,)], "name string").select(F.col("name").cast(kind).alias("name"), F.lit(0).alias("level"))
    events = took.select("event_id", F.lit(0).alias("level")).where("false")
    for level in range(1, depth + 1):
        front = nodes.where(F.col("level") == level - 1).select("name")
        opened = took.join(front, "name").select("event_id").distinct().join(events, "event_id", "left_anti")
        opened = checkpointed(opened.withColumn("level", F.lit(level - 1)))
        met = took.join(opened, "event_id").select(F.col("name").alias("other")).unionByName(ways.join(front, "name").select("other")).distinct()
        new = met.select(F.col("other").alias("name")).join(nodes, "name", "left_anti").withColumn("level", F.lit(level))
        nodes = checkpointed(nodes.unionByName(new))
        events = checkpointed(events.unionByName(opened))
    return nodes, events


def network(relations: DataFrame, members: DataFrame, start: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a neighbourhood as JSON.

    nodes: name, level, json of name, level, relations and events (how many it has in all). edges: source, target, kind,
    json. An edge of kind relation joins two names of the network, once for each relation type (a, b, relation); one of
    kind event goes from an event of the network to each of its members, so a large event has as many edges as members.
    """
    nodes, events = neighbourhood(relations, members, start, depth)
    ends = relations.select(F.col("a").alias("name")).unionByName(relations.where("a <> b").select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("relations"))
    took = members.select("event_id", "name").distinct()
    n = took.groupBy("name").agg(F.count("event_id").alias("events"))
    full = nodes.join(ends, "name", "left").join(n, "name", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("relations", "events")})
    out = full.select("name", "level", "relations", "events", F.to_json(F.struct("name", "level", "relations", "events")).alias("json"))
    inside = nodes.select("name")
    kept = relations.select("a", "b", "relation").distinct().join(inside.withColumnRenamed("name", "a"), "a").join(inside.withColumnRenamed("name", "b"), "b")
    text = lambda c: F.col(c).cast("string")
    of_relations = kept.select(text("a").alias("source"), text("b").alias("target"), F.lit("relation").alias("kind"), F.to_json(F.struct("a", "b", "relation")).alias("json"))
    of_events = took.join(events, "event_id").select(text("event_id").alias("source"), text("name").alias("target"), F.lit("event").alias("kind"), F.to_json(F.struct("event_id", "name", "level")).alias("json"))
    return out, of_relations.unionByName(of_events)
