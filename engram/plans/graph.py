"""Queries of the graph family, over the star schema as objects and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.operators import graph as G
from engram.plans.registry import query

ORDER_ID = 40_000_000_000
WAY = f"(SELECT source_id AS node, target_id AS other, * FROM {C.EDGES_SQL} UNION ALL SELECT target_id, source_id, * FROM {C.EDGES_SQL})"
LINKS = f"(SELECT l_orderkey + {ORDER_ID} AS event_id FROM lineitem)"


def links(spark, d):
    return C.Catalog(spark, d).table("lineitem").select((F.col("l_orderkey") + ORDER_ID).alias("event_id"))


@query("graph_counts", f"SELECT object_type AS kind, count(*) AS n FROM {C.OBJECTS_SQL} GROUP BY 1 UNION ALL SELECT predicate, count(*) FROM {C.EDGES_SQL} GROUP BY 1")
def graph_counts(spark, d):
    o, e = C.graph(spark, d)
    return o.groupBy(F.col("object_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("predicate").alias("kind")).agg(F.count("*").alias("n")))


@query("find_object", f"SELECT id, object_type, name FROM {C.OBJECTS_SQL} WHERE name = (SELECT n_name FROM nation WHERE n_nationkey = 3) ORDER BY id LIMIT 1")
def find_object(spark, d):
    name = C.Catalog(spark, d).table("nation").where("n_nationkey = 3").first()["n_name"]
    return G.find(C.graph(spark, d)[0], name)


_O = f"(SELECT * FROM {C.OBJECTS_SQL} WHERE object_type = 'location')"
_S = "(SELECT substr(n_name, 1, 3) AS surface FROM nation UNION SELECT n_name || ' x' FROM nation UNION SELECT r_name FROM region)"


@query("find_by_alias", f"""WITH m AS (SELECT surface, id, object_type FROM {_S} s JOIN {_O} o ON contains(name, surface) OR contains(surface, name)), e AS (SELECT name, min(id) AS id FROM {_O} GROUP BY name),
  g AS (SELECT surface, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM m GROUP BY surface) SELECT s.surface, coalesce(e.id, g.id) AS id FROM {_S} s LEFT JOIN e ON e.name = s.surface LEFT JOIN g ON g.surface = s.surface""")  # fmt: skip
def find_by_alias(spark, d):
    t = C.Catalog(spark, d).table
    n = t("nation")
    names = n.select(F.substring("n_name", 1, 3).alias("surface")).union(n.select(F.concat("n_name", F.lit(" x")))).union(t("region").select("r_name")).distinct()
    return G.find_by_alias(C.graph(spark, d)[0].where("object_type = 'location'"), names)


@query("edges_touching", f"SELECT node, other, predicate FROM {WAY} WHERE node = 20000007 OR node = 103")
def edges_touching(spark, d):
    return G.both_ways(C.graph(spark, d)[1]).where(F.col("node").isin(20000007, 103)).select("node", "other", "predicate")


@query("entity_timeline", f"SELECT valid_from AS time, CASE WHEN object_type = 'event' THEN name ELSE predicate || ' → ' || coalesce(name, '#' || target_id) END AS title, source_id, target_id FROM {C.EDGES_SQL} LEFT JOIN {C.OBJECTS_SQL} o ON o.id = target_id WHERE source_id = 20000005 OR target_id = 20000005")
def entity_timeline(spark, d):
    return G.timeline(*C.graph(spark, d), 20000005)


_bfs = f"""RECURSIVE w AS MATERIALIZED (SELECT DISTINCT node, other FROM {WAY} WHERE predicate <> 'participated_in'),
  r AS (SELECT CAST(20000001 AS BIGINT) AS id, 0 AS hops UNION SELECT w.other, r.hops + 1 FROM r JOIN w ON w.node = r.id WHERE r.hops < 2), n AS (SELECT id, min(hops) AS hops FROM r GROUP BY id)"""


def _around(spark, d, depth=2):
    e = C.graph(spark, d)[1].where("predicate <> 'participated_in'")
    return G.neighbourhood(e, spark.createDataFrame([(20000001,)], "id long"), depth), e


@query("relation_graph_nodes", f"WITH {_bfs} SELECT * FROM n")
def relation_graph_nodes(spark, d):
    return _around(spark, d)[0]


@query("relation_graph_edges", f"WITH {_bfs} SELECT source_id, target_id, predicate FROM {C.EDGES_SQL} WHERE predicate <> 'participated_in' AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def relation_graph_edges(spark, d):
    nodes, e = _around(spark, d)
    return G.induced(e, nodes).select("source_id", "target_id", "predicate")


@query("trace_path_length", f"WITH {_bfs.replace('r.hops < 2', 'r.hops < 3')} SELECT id, hops AS length FROM n WHERE id < 20000000")
def trace_path_length(spark, d):
    e = C.graph(spark, d)[1].where("predicate <> 'participated_in'")
    return G.path_lengths(e, 20000001, 3).where("id < 20000000")


@query("trace_path", f"""WITH RECURSIVE w AS (SELECT node, other FROM {WAY} WHERE predicate = 'located_in'),
  r AS (SELECT 20000001::BIGINT AS id, 0 AS hops UNION SELECT w.other, hops + 1 FROM r JOIN w ON w.node = r.id WHERE hops < 4), n AS (SELECT id, min(hops) AS hops FROM r GROUP BY id),
  p AS (SELECT a.id, a.hops, min(w.other) AS parent FROM n a JOIN w ON w.node = a.id JOIN n b ON b.id = w.other AND b.hops = a.hops - 1 GROUP BY a.id, a.hops),
  t AS (SELECT id, hops, parent FROM p WHERE id = (SELECT max(id) FROM n WHERE id < 20000000) UNION ALL SELECT p.id, p.hops, p.parent FROM t JOIN p ON p.id = t.parent)
  SELECT CAST(hops AS INT) AS step, id, 'located_in' AS predicate FROM t UNION ALL SELECT 0, 20000001, NULL""")  # fmt: skip
def trace_path(spark, d):
    """From a supplier to the last customer of its region."""
    e = C.graph(spark, d)[1].where("predicate = 'located_in'")
    goal = G.path_lengths(e, 20000001, 4).where("id < 20000000").agg(F.max("id")).first()[0]
    return G.trace_path(e, 20000001, goal, 6)


@query("search_graph", f"SELECT o.id, o.name, (SELECT count(*) FROM {C.EDGES_SQL} e WHERE e.source_id = o.id OR e.target_id = o.id) AS edge_count FROM (SELECT * FROM {C.OBJECTS_SQL} WHERE object_type = 'organization' AND contains(lower(name), '1') ORDER BY id LIMIT 20) o")
def search_graph(spark, d):
    return G.search(*C.graph(spark, d), "1", "organization", 20).select("id", "name", "edge_count")


@query("evidence_search", "SELECT page_id AS id, html AS content, CAST(page_id % 7 AS BIGINT) AS chapter_no, 'doc' || (page_id % 3) AS title FROM pages WHERE contains(lower(html), 'tion the') ORDER BY id LIMIT 50")
def evidence_search(spark, d):
    p = C.Catalog(spark, d).table("pages")
    e = p.select(F.col("page_id").alias("id"), F.col("html").alias("content"), (F.col("page_id") % 21).alias("chapter_id"))
    chapters = spark.range(21).select(F.col("id").alias("chapter_id"), (F.col("id") % 7).alias("chapter_no"), (F.col("id") % 3).alias("doc_id"))
    documents = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc"), F.col("id").cast("string")).alias("title"))
    return G.search_evidence(e, chapters, documents, "tion the")


@query("inspect_entity", f"""SELECT o.id, o.name, coalesce(relations, 0) AS relations, coalesce(events, 0) AS events, coalesce(v.n, 0) AS evidence, first_time, last_time FROM {C.OBJECTS_SQL} o
  LEFT JOIN (SELECT node, count(*) FILTER (predicate <> 'participated_in') AS relations, count(DISTINCT other) FILTER (predicate = 'participated_in') AS events, min(valid_from) AS first_time, max(coalesce(valid_to, valid_from)) AS last_time FROM {WAY} GROUP BY node) w ON w.node = o.id
  LEFT JOIN (SELECT event_id, count(*) AS n FROM {LINKS} GROUP BY event_id) v ON v.event_id = o.id""")  # fmt: skip
def inspect_entity(spark, d):
    return G.inspect(*C.graph(spark, d), links(spark, d)).drop("object_type")


_turn = """(count(*) OVER g >= 3 AND b IS NOT NULL AND a IS NOT NULL AND (max(time) OVER g - min(time) OVER g) > 0
    AND greatest(b, a) > 1.5 * (max(time) OVER g - min(time) OVER g) / (count(*) OVER g - 1))"""
TURNING = f"""t AS (SELECT DISTINCT source_id AS id, target_id AS event_id, coalesce(valid_from, 0) AS time FROM {C.EDGES_SQL} WHERE predicate = 'participated_in'),
  u AS (SELECT *, time - lag(time) OVER w AS b, lead(time) OVER w - time AS a FROM t WINDOW w AS (PARTITION BY id ORDER BY time, event_id)),
  f AS (SELECT id, event_id, time, coalesce({_turn}, false) AS turning FROM u WINDOW g AS (PARTITION BY id))"""


@query("turning_points", f"WITH {TURNING} SELECT id, event_id, time FROM f WHERE turning")
def turning_points(spark, d):
    e = C.graph(spark, d)[1].where("predicate = 'participated_in'")
    t = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("event_id"), F.coalesce("valid_from", F.lit(0)).alias("time")).distinct()
    return G.turning(t, "id", "time", "event_id").where("turning").select("id", "event_id", "time")


@query("key_events", f"""WITH {TURNING}, p AS (SELECT node, count(DISTINCT other) AS n FROM {WAY} GROUP BY node), e AS (SELECT event_id, least(count(*), 5) AS n FROM {LINKS} GROUP BY event_id),
  s AS (SELECT f.id, f.event_id, f.time, coalesce(p.n - 1, 0) AS participants, coalesce(e.n, 0) AS evidence, turning FROM f LEFT JOIN p ON p.node = f.event_id LEFT JOIN e ON e.event_id = f.event_id)
  SELECT *, round(least(1, 0.5 * CASE WHEN evidence = 0 THEN 0 WHEN evidence = 1 THEN 0.3 WHEN evidence <= 4 THEN 0.5 WHEN evidence <= 9 THEN 0.8 ELSE 1 END
    + 0.3 * CASE WHEN participants = 0 THEN 0 WHEN participants <= 2 THEN 0.3 WHEN participants <= 4 THEN 0.6 WHEN participants <= 7 THEN 0.8 ELSE 1 END + CASE WHEN turning THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score FROM s WHERE score >= 0.7""")  # fmt: skip
def key_events(spark, d):
    return G.key_events(C.graph(spark, d)[1], links(spark, d), may_be_event=lambda id_: id_ >= ORDER_ID)


@query("correct_relation", f"SELECT source_id, CASE WHEN source_id % 10 = 3 THEN CAST(101 AS BIGINT) ELSE target_id END AS target_id, predicate FROM {C.EDGES_SQL} WHERE predicate = 'located_in' AND source_id >= 10000000")
def correct_relation(spark, d):
    e = C.graph(spark, d)[1].where("predicate = 'located_in' and source_id >= 10000000")
    fixes = e.where("source_id % 10 = 3").select("source_id", "predicate", "target_id", F.lit(101).cast("long").alias("new_target"))
    return G.correct(e, fixes).select("source_id", "target_id", "predicate")


@query("world_upsert", "SELECT c_name AS name, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS importance FROM customer QUALIFY row_number() OVER (PARTITION BY c_name ORDER BY c_custkey DESC) = 1")
def world_upsert(spark, d):
    c = C.Catalog(spark, d).table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("importance"), "c_custkey")
    new = c.where("c_custkey % 3 = 0").withColumn("importance", F.col("importance") + 1)
    return G.upsert(c, new, ["name"], "c_custkey").select("name", "importance")


@query("property_merge", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE p_type END AS type FROM part")
def property_merge(spark, d):
    p = C.Catalog(spark, d).table("part")
    old = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")))
    new = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.lit("even").alias("type"))))
    m = p.select("p_partkey", G.merge_properties(old, new).alias("m"))
    return m.select("p_partkey", F.get_json_object("m", "$.brand").alias("brand"), F.get_json_object("m", "$.type").alias("type"))


@query("matched_attributes", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(lower(p_brand), '1') THEN 'brand' END, CASE WHEN contains(lower(p_type), '1') THEN 'type' END) AS keys FROM part")
def matched_attributes(spark, d):
    p = C.Catalog(spark, d).table("part")
    return p.select("p_partkey", F.array_join(G.matched_keys(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))), "1"), ",").alias("keys"))
