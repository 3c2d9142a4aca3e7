"""Knowledge graph: objects (id, object_type, name) and edges (source_id, target_id, predicate, valid_from, valid_to)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions.lexicons import EVENT_DEATHS
from engram.functions.scores import event_importance
from engram.functions.text import any_of


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (as in tests) uses its warehouse; on a cluster
    that is an error, since the warehouse may be a folder of the driver's own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back, so iterations keep short plans and survive lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges as (node, other, ...) from both ends, so "touching" is an equality."""
    out = edges.withColumns({"node": F.col("source_id"), "other": F.col("target_id"), "forward": F.lit(True)})
    back = edges.where("source_id <> target_id").withColumns({"node": F.col("target_id"), "other": F.col("source_id"), "forward": F.lit(False)})
    return out.unionByName(back)


def find(objects: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The object of that name; the smallest id of several."""
    o = objects.where(F.col("name") == name)
    return (o if kind is None else o.where(F.col("object_type") == kind)).orderBy("id").limit(1)


def find_by_alias(objects: DataFrame, names: DataFrame, person: str = "person") -> DataFrame:
    """names (surface) to objects: exact names first; else the one object whose name holds the surface or is in it; else
    the one person among those; else none: (surface, id).

    Surfaces meet names by a shared pair of letters, which any two texts of two letters or more have if one holds the
    other; one-letter surfaces and names meet by their letter.
    """
    from engram.functions.text import bigram_set

    exact = names.join(objects.groupBy(F.col("name").alias("surface")).agg(F.min("id").alias("exact")), "surface", "left")
    rest = exact.where("exact is null and surface <> ''").select("surface")
    chars = lambda c: F.array_distinct(F.split(c, ""))
    parts = lambda c: F.when(F.length(c) >= 2, F.concat(bigram_set(c), chars(c))).otherwise(chars(c))
    # only one key of the shorter text is needed: its first pair, or its letter
    head = lambda c: F.substring(c, 1, 2)
    s_in_o = rest.withColumn("k", head(F.col("surface"))).join(objects.select("id", "object_type", "name", F.explode(parts(F.col("name"))).alias("k")), "k").where(F.contains("name", "surface"))
    o_in_s = rest.select("surface", F.explode(parts(F.col("surface"))).alias("k")).join(objects.select("id", "object_type", "name", head(F.col("name")).alias("k")), "k").where(F.contains("surface", "name"))
    met = s_in_o.select("surface", "id", "object_type").unionByName(o_in_s.select("surface", "id", "object_type")).distinct()
    one = met.groupBy("surface").agg(F.count("*").alias("n"), F.min("id").alias("any"), F.count_if(F.col("object_type") == person).alias("p"), F.min(F.when(F.col("object_type") == person, F.col("id"))).alias("who"))
    found = F.when(F.col("n") == 1, F.col("any")).when(F.col("p") == 1, F.col("who"))
    return exact.join(one, "surface", "left").select("surface", F.coalesce("exact", found).alias("id"))


def timeline(objects: DataFrame, edges: DataFrame, id_: int) -> DataFrame:
    """One row for each edge at a node: time, title (an event's name, else predicate and target), nulls first."""
    own = edges.where((F.col("source_id") == id_) | (F.col("target_id") == id_))
    names = objects.select(F.col("id").alias("target_id"), "name", "object_type")
    target = F.coalesce("name", F.concat(F.lit("#"), F.col("target_id").cast("string")))
    title = F.when(F.col("object_type") == "event", F.col("name")).otherwise(F.concat("predicate", F.lit(" → "), target))
    return own.join(names, "target_id", "left").select(F.col("valid_from").alias("time"), title.alias("title"), "source_id", "target_id").orderBy(F.asc_nulls_first("time"), "source_id", "target_id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of all nodes within depth hops of the seeds (id), edges taken both ways; each level is a join. Edges are
    written once; repeated ones stay, as each level's nodes are made distinct and not all edges."""
    way = both_ways(checkpointed(edges.select("source_id", "target_id"))).select("node", "other")
    seen = frontier = seeds.select("id", F.lit(0).alias("hops"))
    for level in range(1, depth + 1):
        step = frontier.join(way, frontier["id"] == way["node"]).select(F.col("other").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes (id); parallel ones stay."""
    n = nodes.select("id")
    return edges.join(n.toDF("source_id"), "source_id", "left_semi").join(n.toDF("target_id"), "target_id", "left_semi")


def path_lengths(edges: DataFrame, start: int, depth: int = 5) -> DataFrame:
    """(id, length): hops from the start to every node within depth."""
    spark = edges.sparkSession
    return neighbourhood(edges, spark.createDataFrame([(start,)], "id long"), depth).toDF("id", "length")


def trace_path(edges: DataFrame, start: int, goal: int, depth: int = 5) -> DataFrame:
    """One shortest path as rows (step, id, predicate): at each step back the parent of least (valid_from, id). Empty if
    there is none within depth."""
    spark = edges.sparkSession
    way = both_ways(edges)
    levels = neighbourhood(edges, spark.createDataFrame([(start,)], "id long"), depth)
    before = levels.select(F.col("id").alias("other"), (F.col("hops") + 1).alias("hops"))
    link = F.struct(F.col("valid_from").isNull().alias("open"), "valid_from", "other", "predicate")
    back = way.join(levels.withColumnRenamed("id", "node"), "node").join(before, ["other", "hops"]).groupBy("node").agg(F.min(link).alias("link"), F.first("hops").alias("hops"))
    parents = checkpointed(back.select("node", "hops", "link.other", "link.predicate"))  # one pass over the edges, whatever the depth
    rows, hit = [], parents.where(F.col("node") == goal).first() if goal != start else None
    while hit is not None:  # `depth` look-ups at most
        rows.append((hit["hops"], hit["node"], hit["predicate"]))
        hit = parents.where(F.col("node") == hit["other"]).first() if hit["other"] != start else None
    if rows or goal == start:
        rows.append((0, start, None))
    return spark.createDataFrame(sorted(rows), "step int, id long, predicate string")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("edge_count"))


def search(objects: DataFrame, edges: DataFrame, name: str | None = None, kind: str | None = None, k: int = 100) -> DataFrame:
    """Objects whose name holds the text and whose type is kind (None: any), with their number of edges; by id."""
    o = objects
    if name is not None:
        o = o.where(F.lower("name").contains(name.lower()))
    if kind is not None:
        o = o.where(F.col("object_type") == kind)
    o = o.orderBy("id").limit(k)
    touching = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    n = touching.join(F.broadcast(o.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("edge_count"))  # k rows
    return o.join(n, "id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def matched_keys(properties: Column, text: str) -> Column:
    """Keys of a JSON object of strings whose key or value holds the text, lower case, sorted."""
    m = F.from_json(properties, "map<string,string>")
    t = text.lower()
    return F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: F.lower(k).contains(t) | F.lower(v).contains(t))))


def search_evidence(evidence: DataFrame, chapters: DataFrame, documents: DataFrame, text: str, k: int = 50) -> DataFrame:
    """Evidence rows that hold the text, with chapter and document: id, content, chapter_no, title; by id."""
    e = evidence.where(F.lower("content").contains(text.lower()))
    return e.join(chapters, "chapter_id").join(documents, "doc_id").select("id", "content", "chapter_no", "title").orderBy("id").limit(k)


def turning(times: DataFrame, by: str, at: str, order: str, factor: float = 1.5) -> DataFrame:
    """times with a flag: not the first or last of its group, three of them at least, and a gap to the one before or after
    over factor times the mean gap."""
    w = Window.partitionBy(by).orderBy(at, order)
    g = Window.partitionBy(by)
    t = times.withColumns({"_b": F.col(at) - F.lag(at).over(w), "_a": F.lead(at).over(w) - F.col(at), "_n": F.count("*").over(g), "_m": F.max(at).over(g) - F.min(at).over(g)})
    mean = F.try_divide(F.col("_m"), F.col("_n") - 1)
    flag = (F.col("_n") >= 3) & F.col("_b").isNotNull() & F.col("_a").isNotNull() & (mean > 0) & ((F.col("_b") > factor * mean) | (F.col("_a") > factor * mean))
    return t.withColumn("turning", F.coalesce(flag, F.lit(False))).drop("_b", "_a", "_n", "_m")


def key_events(edges: DataFrame, evidence_links: DataFrame, threshold: float = 0.7, most_evidence: int = 5, may_be_event: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events of every participant with their score: id, event_id, time, participants, evidence, turning, score; those at
    the threshold. At most most_evidence rows of evidence count for an event; participants are the others in it.

    evidence_links has event_id, one row for each piece of evidence. may_be_event tells of an id whether it can be an event's:
    ends that can't, and are no target of participated_in, aren't looked at.
    """
    took = edges.where("predicate = 'participated_in'").select(F.col("source_id").alias("id"), F.col("target_id").alias("event_id"), F.coalesce("valid_from", F.lit(0)).alias("time"))
    took = turning(took.repartition("id").distinct(), "id", "time", "event_id")  # by what the windows need
    way = both_ways(edges)
    if may_be_event is not None:
        way = way.where(((F.col("predicate") == "participated_in") & (F.col("node") == F.col("target_id"))) | may_be_event(F.col("node")))
    n = way.select(F.col("node").alias("event_id"), "other").repartition("event_id").distinct().groupBy("event_id").agg(F.count("*").alias("all"))
    e = evidence_links.groupBy("event_id").agg(F.least(F.count("*"), F.lit(most_evidence)).alias("evidence"))
    j = took.join(n, "event_id", "left").join(e, "event_id", "left")
    j = j.withColumns({"participants": F.coalesce(F.col("all") - 1, F.lit(0)), "evidence": F.coalesce("evidence", F.lit(0))})
    score = F.round(event_importance(F.col("evidence"), F.col("participants"), F.col("turning")), 6)
    return j.withColumn("score", score).where(F.col("score") >= threshold).select("id", "event_id", "time", "participants", "evidence", "turning", "score")


def inspect(objects: DataFrame, edges: DataFrame, evidence_links: DataFrame) -> DataFrame:
    """One row an object: relations (other edges than participated_in), events, first and last time, evidence of its own."""
    way = both_ways(edges)
    event = F.col("predicate") == "participated_in"
    a = way.groupBy(F.col("node").alias("id")).agg(F.count_if(~event).alias("relations"), F.countDistinct(F.when(event, F.col("other"))).alias("events"), F.min("valid_from").alias("first_time"), F.max(F.coalesce("valid_to", "valid_from")).alias("last_time"))
    e = evidence_links.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("evidence"))
    j = objects.join(a, "id", "left").join(e, "id", "left")
    return j.select(*objects.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("relations", "events", "evidence")], "first_time", "last_time")


#: Properties that an entity's profile shows, in this order.
PROFILE_KEYS = ("description", "personality", "clothing", "aliases")


def inspect_all(objects: DataFrame, edges: DataFrame, object_links: DataFrame, edge_links: DataFrame, mentions: DataFrame, deaths: Sequence[str] = EVENT_DEATHS) -> DataFrame:
    """One row an object (id, object_type, name, properties as JSON): id, name, relations, events, evidence, mentions,
    first_seen, last_seen, death_chapter, profile.

    Relations are the other edges than participated_in that touch it, an edge with itself once; events the different other
    ends of the rest that are objects. Evidence is the different ids linked to it (id, evidence_id) or to edges that touch it
    (source_id, target_id, predicate, evidence_id). First and last seen are chapters of its mentions (id, chapter_no). It
    dies in the least chapter (property chapter) of an event whose name, or property description, has a death phrase.
    The profile has key and value of what PROFILE_KEYS find, without empty ones; lists are shown as JSON.
    """
    from engram.operators.people import evidence_of

    way = both_ways(edges)
    event = F.col("predicate") == "participated_in"
    text = F.concat_ws("\n", "name", F.get_json_object("properties", "$.description"))
    dead = objects.select(F.col("id").alias("other"), F.when(any_of(text, list(deaths)), F.get_json_object("properties", "$.chapter").cast("int")).alias("chapter"))
    took = way.where(event).select("node", "other").distinct().join(dead, "other").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("events"), F.min("chapter").alias("death_chapter"))
    related = way.where(~event).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("relations"))
    known = evidence_of(objects, edges, object_links, edge_links).groupBy("id").agg(F.count("*").alias("evidence"))
    seen = mentions.groupBy("id").agg(F.count("*").alias("mentions"), F.min("chapter_no").alias("first_seen"), F.max("chapter_no").alias("last_seen"))
    entry = lambda k: F.struct(F.lit(k).alias("key"), F.get_json_object("properties", f"$.{k}").alias("value"))
    profile = F.filter(F.array(*map(entry, PROFILE_KEYS)), lambda x: F.coalesce(x["value"] != "", F.lit(False)))
    j = objects.withColumn("profile", profile)
    for part in (related, took, known, seen):
        j = j.join(part, "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return j.select("id", "name", *map(count, ("relations", "events", "evidence", "mentions")), "first_seen", "last_seen", "death_chapter", "profile")


def correct(edges: DataFrame, fixes: DataFrame) -> DataFrame:
    """edges with the targets of fixes (source_id, predicate, target_id, new_target) replaced."""
    j = edges.join(fixes, ["source_id", "predicate", "target_id"], "left")
    return j.withColumn("target_id", F.coalesce("new_target", "target_id")).select(edges.columns)


def correct_by_name(objects: DataFrame, edges: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, report) of corrections by name: fixes has source, predicate, old_target, new_target, each correction once.

    A name is the object of the smallest id that has it. Only edges that go out from the source with that predicate to the old
    target get the new one, and keep what they were before as evidence: corrected_from, the old target's id (null for all
    others). The report has a row for each correction: its names, from_id, to_id, changed (edges) and problem, which says
    what was not found, or is null. A correction with a problem changes nothing; of two of one edge the least new id counts.
    """
    ids = objects.groupBy("name").agg(F.min("id").alias("id"))
    named = fixes.select("source", "predicate", "old_target", "new_target").distinct()
    for name, column in (("source", "source_id"), ("old_target", "from_id"), ("new_target", "to_id")):
        named = named.join(ids.select(F.col("name").alias(name), F.col("id").alias(column)), name, "left")
    n = edges.groupBy("source_id", "predicate", F.col("target_id").alias("from_id")).agg(F.count("*").alias("changed"))
    said = lambda c: F.when(F.col({"source": "source_id", "old_target": "from_id", "new_target": "to_id"}[c]).isNull(), F.concat(F.lit(f"{c} `"), c, F.lit("` not found")))
    report = named.join(n, ["source_id", "predicate", "from_id"], "left")
    report = report.withColumn("problem", F.coalesce(said("source"), said("old_target"), said("new_target"), F.when(F.col("changed").isNull(), F.concat(F.lit("no `"), "predicate", F.lit("` edge from `"), "source", F.lit("` to `"), "old_target", F.lit("` found")))))
    report = report.withColumn("changed", F.when(F.col("problem").isNull(), F.col("changed")).otherwise(0))
    good = report.where("problem is null").groupBy("source_id", "predicate", F.col("from_id").alias("target_id")).agg(F.min("to_id").alias("new_target"))
    j = edges.join(good, ["source_id", "predicate", "target_id"], "left").withColumn("corrected_from", F.when(F.col("new_target").isNotNull(), F.col("target_id")))
    out = j.withColumn("target_id", F.coalesce("new_target", "target_id")).select(*edges.columns, "corrected_from")
    return out, report.select("source", "predicate", "old_target", "new_target", "from_id", "to_id", "changed", "problem")


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """store with new rows put in: of rows with equal keys the one of the largest order stays, new ones before old."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def merge_properties(old: Column, new: Column) -> Column:
    """Two JSON objects of strings as one; the new one's values win."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for c in (old, new))
    keep = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(keep, b))


def purge(tables: dict[str, DataFrame], docs: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the documents (doc_id)."""
    return {k: t.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").select(t.columns) for k, t in tables.items()}


def vector_texts(objects: DataFrame, aliases: DataFrame, edges: DataFrame, repeat: int = 3, most_events: int = 5) -> DataFrame:
    """(id, text): what is embedded for an object: its name repeated, aliases (id, alias), relations, first events."""
    a = aliases.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("aliases"))
    names = objects.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    e = edges.join(names, "target_id").withColumn("event", F.col("predicate") == "participated_in")
    w = Window.partitionBy("source_id", "event").orderBy(F.asc_nulls_last("valid_from"), "target_id")
    e = e.withColumn("r", F.row_number().over(w)).where(~F.col("event") | (F.col("r") <= most_events))
    text = F.when(F.col("event"), F.col("target")).otherwise(F.concat_ws(" ", "predicate", "target"))
    r = e.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event", "r", text.alias("t")))), lambda s: s["t"]), " ").alias("relations"))
    j = objects.join(a, "id", "left").join(r, "id", "left")
    return j.select("id", F.concat_ws(" ", F.array_join(F.array_repeat("name", repeat), " "), "aliases", "relations").alias("text"))


def run_row(spark, run_id: int, version: str, status: str, started: int, finished: int | None, statistics: dict[str, int]) -> DataFrame:
    """One row of the compiler's run log, to append to it; statistics as JSON."""
    import json

    return spark.createDataFrame([(run_id, version, status, started, finished, json.dumps(statistics, sort_keys=True))], "run_id long, version string, status string, started long, finished long, statistics string")
