"""Queries of stores, inspection, corrections, registries, and readings that had no query before."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram import catalog as C
from engram.operators import cognition as K
from engram.operators import corpus as P
from engram.operators import graph as G
from engram.operators import lexicon as X
from engram.operators import narrative as N
from engram.operators import persona
from engram.operators.graph import shared_folder
from engram.plans.cognition import facts
from engram.plans.graph import WAY
from engram.plans.narrative import SENT, docs
from engram.plans.registry import query
from engram.functions import text as T
from engram.sources import adapters, loaders
from engram.sources.store import Store, append_facts, evidence_tables


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("store_crud", f"""SELECT id, memory_type, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN id % 5 = 0 THEN 'again' ELSE md5(content) END AS content FROM {C.MEMORIES_SQL} WHERE id % 5 <> 0 OR id % 10 = 0 OR id % 7 = 1""")
def store_crud(spark, d):
    """Memories put in, some changed, some taken out, some of those put in again; and a batch that is written twice."""
    m = C.memories(spark, d).select("id", "memory_type", "confidence", F.md5("content").alias("content"))
    store = Store(spark, folder(spark, "memories"), m.schema)
    for _ in range(2):
        store.put(m, 0)
    store.update(m.where("id % 3 = 0").select("id", F.lit(1.0).alias("confidence")), 1)
    store.delete(m.where("id % 5 = 0"), 2)
    store.update(m.where("id % 5 = 0").select("id", F.lit("lost").alias("content")), 3)
    store.insert(m.where("id % 10 = 0 or id % 7 = 1").withColumn("content", F.lit("again")), 4)
    return store.compact(folder(spark, "memories")).current()


@query("facts_sink", f"SELECT fact_type, count(*) AS n, (SELECT count(*) FROM {C.FACTS_SQL} WHERE id % 4 = 0) AS known FROM {C.FACTS_SQL} GROUP BY fact_type")
def facts_sink(spark, d):
    """Facts appended twice, a part of them at first; known: how many the second batch brought again."""
    f = C.facts(spark, d).select("id", "entity_id", "fact_type", "time")
    store = Store(spark, folder(spark, "facts"), f.schema)
    append_facts(store, f.where("id % 4 = 0"), 0)
    counts = append_facts(store, f, 1)
    return store.current().groupBy("fact_type").agg(F.count("*").alias("n")).join(F.broadcast(counts.select("known")))  # one row


@query("evidence_batches", f"""SELECT e.doc_id, count(*) AS evidence, sum(CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS links FROM {SENT} e WHERE contains(sentence, 'tion') GROUP BY e.doc_id""")
def evidence_batches(spark, d):
    """Sentences as evidence, each with a link to its document and one in three with another, written in two batches."""
    link = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("long").alias("source_id"))
    s = N.sentence_rows(docs(spark, d)).where("sentence like '%tion%'")
    links = F.when(F.col("pos") % 3 == 0, F.array(link("object", F.col("doc_id")), link("edge", F.col("pos")))).otherwise(F.array(link("object", F.col("doc_id"))))
    e = s.select(F.xxhash64("doc_id", "pos").alias("id"), "doc_id", F.col("sentence").alias("content"), links.alias("links"))
    store = Store(spark, folder(spark, "evidence"), e.schema)
    store.put(e.where("doc_id % 2 = 0"), 0)
    store.put(e.where("doc_id % 2 = 1"), 1)
    evidence, linked = evidence_tables(store)
    n = linked.groupBy("evidence_id").agg(F.count("*").alias("n"))
    return evidence.join(n, evidence["id"] == n["evidence_id"]).groupBy("doc_id").agg(F.count("*").alias("evidence"), F.sum("n").alias("links"))


_LOCATED = f"(SELECT *, source_id % 1000 AS evidence_id FROM {C.EDGES_SQL} WHERE predicate = 'located_in')"
_SEEN = "(SELECT l_suppkey + 20000000 AS id, year(l_shipdate) AS chapter_no FROM lineitem)"


@query("inspect_lifecycle", f"""WITH own AS (SELECT id, id % 1000 AS evidence_id FROM {C.OBJECTS_SQL} WHERE object_type = 'location' UNION SELECT source_id, evidence_id FROM {_LOCATED} UNION SELECT target_id, evidence_id FROM {_LOCATED}),
  dead AS (SELECT o_orderkey + 40000000000 AS id, month(o_orderdate) AS chapter FROM orders WHERE contains(o_orderpriority, 'URGENT')),
  took AS (SELECT DISTINCT node, other FROM {WAY} WHERE predicate = 'participated_in'),
  e AS (SELECT node AS id, count(*) AS events, min(dead.chapter) AS death_chapter FROM took LEFT JOIN dead ON dead.id = other WHERE other IN (SELECT id FROM {C.OBJECTS_SQL}) GROUP BY node),
  r AS (SELECT node AS id, count(*) AS relations FROM {WAY} WHERE predicate <> 'participated_in' GROUP BY node), v AS (SELECT id, count(*) AS evidence FROM own GROUP BY id),
  m AS (SELECT id, count(*) AS mentions, min(chapter_no) AS first_seen, max(chapter_no) AS last_seen FROM {_SEEN} GROUP BY id)
  SELECT o.id, o.name, coalesce(relations, 0) AS relations, coalesce(events, 0) AS events, coalesce(evidence, 0) AS evidence, coalesce(mentions, 0) AS mentions, first_seen, last_seen, death_chapter,
    CASE WHEN o.object_type = 'event' THEN 'description=' || o_orderpriority WHEN o.object_type = 'concept' THEN 'description=' || p_type || ';aliases=["' || p_brand || '"]' ELSE '' END AS profile
  FROM {C.OBJECTS_SQL} o LEFT JOIN r ON r.id = o.id LEFT JOIN e ON e.id = o.id LEFT JOIN v ON v.id = o.id LEFT JOIN m ON m.id = o.id
  LEFT JOIN orders ON object_type = 'event' AND o_orderkey + 40000000000 = o.id LEFT JOIN part ON object_type = 'concept' AND p_partkey + 30000000 = o.id""")  # fmt: skip
def inspect_lifecycle(spark, d):
    objects, edges = C.graph(spark, d)
    t = C.Catalog(spark, d).table
    c = F.col
    events = t("orders").select((c("o_orderkey") + 40_000_000_000).alias("id"), F.to_json(F.struct(F.month("o_orderdate").alias("chapter"), c("o_orderpriority").alias("description"))).alias("properties"))
    parts = t("part").select((c("p_partkey") + 30_000_000).alias("id"), F.to_json(F.struct(c("p_type").alias("description"), F.lit("").alias("clothing"), F.array("p_brand").alias("aliases"))).alias("properties"))
    objects = objects.join(events.unionByName(parts), "id", "left")
    links = edges.where("predicate = 'located_in'").select("source_id", "target_id", "predicate", (c("source_id") % 1000).alias("evidence_id"))
    own = objects.where("object_type = 'location'").select("id", (c("id") % 1000).alias("evidence_id"))
    seen = t("lineitem").select((c("l_suppkey") + 20_000_000).alias("id"), F.year("l_shipdate").alias("chapter_no"))
    out = G.inspect_all(objects, edges, own, links, seen, ["URGENT"])
    return out.withColumn("profile", F.array_join(F.transform("profile", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";"))


_named = f"(SELECT e.source_id, e.target_id, a.name AS source, b.name AS target FROM {C.EDGES_SQL} e JOIN {C.OBJECTS_SQL} a ON a.id = e.source_id JOIN {C.OBJECTS_SQL} b ON b.id = e.target_id WHERE predicate = 'located_in' AND a.object_type = 'person')"


@query("correct_by_name", f"""SELECT source_id, CASE WHEN source_id % 10 = 3 THEN (SELECT min(id) FROM {C.OBJECTS_SQL} WHERE name = 'NATION_1') ELSE target_id END AS target_id, CASE WHEN source_id % 10 = 3 THEN target_id END AS corrected_from FROM {_named}""")
def correct_by_name(spark, d):
    return _corrected(spark, d)[0].select("source_id", "target_id", "corrected_from")


@query("correction_report", f"""SELECT source, target AS old_target, 'NATION_1' AS new_target, 1 AS changed, NULL AS problem FROM {_named} WHERE source_id % 10 = 3 UNION ALL SELECT source, target, 'NOWHERE', 0, 'new_target `NOWHERE` not found' FROM {_named} WHERE source_id % 10 = 4
  UNION ALL SELECT source, 'REGION_X', 'NATION_1', 0, 'old_target `REGION_X` not found' FROM {_named} WHERE source_id % 10 = 5 UNION ALL SELECT source, source, 'NATION_1', 0, 'no `located_in` edge from `' || source || '` to `' || source || '` found' FROM {_named} WHERE source_id % 10 = 6""")  # fmt: skip
def correction_report(spark, d):
    return _corrected(spark, d)[1].select("source", "old_target", "new_target", F.col("changed").cast("int").alias("changed"), "problem")


def _corrected(spark, d):
    objects, edges = C.graph(spark, d)
    edges = edges.where("predicate = 'located_in'").join(objects.where("object_type = 'person'").select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    named = edges.join(objects.select(F.col("id").alias("target_id"), F.col("name").alias("old_target")), "target_id")
    k = F.col("source_id") % 10
    fixes = named.where(k.between(3, 6)).select("source", "predicate", F.when(k == 5, "REGION_X").when(k == 6, F.col("source")).otherwise(F.col("old_target")).alias("old_target"), F.when(k == 4, "NOWHERE").otherwise("NATION_1").alias("new_target"))
    return G.correct_by_name(objects, edges.drop("source"), fixes)


_LEXEMES = "(SELECT p_brand AS language, 'p' || p_partkey AS id, p_name || ' ' || p_partkey AS lemma, CASE p_size % 4 WHEN 0 THEN 'attack' WHEN 1 THEN 'speech' WHEN 2 THEN 'rescue' ELSE 'thing' END AS class, CASE WHEN p_partkey % 3 = 0 THEN 'core' WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN 'domain' WHEN p_partkey % 3 = 2 THEN 'user' END AS layer FROM part)"


@query("lexicon_registry", f"""SELECT id, lemma, language, class, layer, CAST(row_number() OVER (ORDER BY language, id) AS INT) AS no, class IN ('attack', 'rescue') AS strong, class = 'speech' AS action, class = 'attack' AS hostile, class = 'rescue' AS friendly FROM {_LEXEMES} WHERE layer IS NOT NULL AND id <> 'p3'""")
def lexicon_registry(spark, d):
    """Parts as lexemes: a core, one of two packs, the user's own, one disabled."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("attack", "speech", "rescue", "thing"))), (c("p_size") % 4 + 1).cast("int"))
    own = C.Catalog(spark, d).table("part").select("p_partkey", "p_size", F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit(" "), c("p_partkey").cast("string")).alias("lemma"), F.array(F.concat(F.lit("of "), c("p_partkey").cast("string"))).alias("forms"), c("p_brand").alias("language"), kind.alias("class"), F.lit(False).alias("word_boundary"))
    part = lambda where: own.where(where).drop("p_partkey", "p_size")
    packs = {"even": part("p_partkey % 3 = 1 and p_size % 2 = 0"), "odd": part("p_partkey % 3 = 1 and p_size % 2 = 1")}
    return X.registry(part("p_partkey % 3 = 0"), packs, ["even"], part("p_partkey % 3 = 2"), ["p3"]).drop("forms", "word_boundary")


@query("adapter_vectors", "SELECT vec_id AS id, label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id >= 100")
def adapter_vectors(spark, d):
    """The embeddings as an external index, read by the data source."""
    v = adapters.read(spark, "vectors", f"{d}/embeddings.parquet", id="vec_id", vector="embedding", columns="label")
    return v.where("id >= 100").select("id", "label", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("read_texts", "SELECT md5(text) AS line FROM documents")
def read_texts(spark, d):
    """Lines of text files that Spark has written of the documents."""
    path = folder(spark, "texts")
    docs(spark, d).select(F.md5("text").alias("value")).write.text(path)
    return loaders.read_texts(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("read_json", "SELECT url AS title, md5(html) AS text FROM pages")
def read_json(spark, d):
    """Pages by way of JSON files of a few pages each."""
    path = folder(spark, "json")
    p = C.Catalog(spark, d).table("pages").select(F.floor(F.col("page_id") / 50).alias("k"), F.col("url").alias("title"), F.md5("html").alias("text"))
    whole = p.groupBy("k").agg(F.to_json(F.struct(F.collect_list(F.struct("title", "text")).alias("documents"))).alias("value"))
    whole.repartition("k").write.partitionBy("k").text(path)
    return loaders.read_json(spark, path).select("title", "text")


_four = r"list_filter(list_transform(list_filter(regexp_extract_all(sentence, '[0-9]+'), lambda x: length(x) = 4), lambda x: CAST(x AS INT)), lambda y: y BETWEEN 1700 AND 2100)[1]"


@query("chapter_of_sentences", f"SELECT doc_id, CAST(pos AS INT) AS pos, last_value({_four} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM {SENT}")
def chapter_of_sentences(spark, d):
    return N.headed(N.sentence_rows(docs(spark, d))).select("doc_id", "pos", "chapter")


@query("chinese_numbers", "SELECT o_orderkey, CAST(o_orderkey % 9999 + 1 AS INT) AS value FROM orders")
def chinese_numbers(spark, d):
    """Keys written as Chinese numerals and read again."""
    n = F.col("o_orderkey") % 9999 + 1
    digit = lambda p: F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (F.floor(n / p) % 10 + 1).cast("int"))
    part = lambda p, unit: F.when(F.floor(n / p) % 10 > 0, F.concat(digit(p), F.lit(unit))).when((n >= p) & (n % p > 0), "零").otherwise("")
    text = F.regexp_replace(F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), F.when(n % 10 > 0, digit(1)).otherwise("")), "零+", "零")
    return C.Catalog(spark, d).table("orders").select("o_orderkey", T.chinese_number(text).alias("value"))


_story = "'before' || chr(10) || '第' || (1 + doc_id % 40) || '回 x' || chr(10) || substr(text, 1, 30) || chr(10) || '第' || (doc_id % 90) || '章' || chr(10) || 'end'"


@query("split_chapters", """SELECT doc_id, CAST(1 + doc_id % 40 AS INT) AS chapter, replace(substr(text, 1, 30), chr(10), ' ') || CASE WHEN doc_id % 90 > 1 + doc_id % 40 THEN '' ELSE ' 第' || (doc_id % 90) || '章 end' END AS body FROM documents
  UNION ALL SELECT doc_id, CAST(doc_id % 90 AS INT), 'end' FROM documents WHERE doc_id % 90 > 1 + doc_id % 40""")  # fmt: skip
def split_chapters(spark, d):
    """Texts with two headers; the second one counts if its number is over the first one's."""
    text = lambda c: c.cast("string")
    k = F.col("doc_id")
    story = F.concat(F.lit("before\n第"), text(1 + k % 40), F.lit("回 x\n"), F.substring("text", 1, 30), F.lit("\n第"), text(k % 90), F.lit("章\nend"))
    out = N.split_chapters(docs(spark, d).select("doc_id", story.alias("text")))
    return out.select("doc_id", "chapter", F.replace("body", F.lit("\n"), F.lit(" ")).alias("body"))


@query("search_characters", "SELECT p_name || ' ' || p_partkey AS name, p_size / 50.0::DOUBLE AS importance FROM part WHERE contains(lower(p_name || ' ' || p_partkey), 'ring 1') OR contains(lower('b' || p_partkey), 'ring 1') OR contains('ring 1' || (p_partkey % 9), 'ring 1') AND p_partkey % 4 = 0 ORDER BY lower(p_name || ' ' || p_partkey) = 'ring 1' DESC, importance DESC, name LIMIT 20")
def search_characters(spark, d):
    c = F.col
    s = lambda x: x.cast("string")
    other = F.when(c("p_partkey") % 4 == 0, F.concat(F.lit("Ring 1"), s(c("p_partkey") % 9)))
    p = C.Catalog(spark, d).table("part").select(F.concat("p_name", F.lit(" "), s(c("p_partkey"))).alias("name"), F.array_compact(F.array(F.concat(F.lit("b"), s(c("p_partkey"))), other)).alias("aliases"), (c("p_size") / 50.0).alias("importance"))
    return P.search_characters(p, "RING 1").select("name", "importance")


@query("alias_in_json", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 3 OR s_nationkey = 3")
def alias_in_json(spark, d):
    """Suppliers whose JSON list of aliases holds a name."""
    s = C.Catalog(spark, d).table("supplier")
    tag = lambda c: F.concat(F.lit("k"), c.cast("string"))
    listed = F.to_json(F.array(tag(F.col("s_suppkey") % 7), tag(F.col("s_nationkey"))))
    return s.withColumn("aliases", listed).where(F.array_contains(F.from_json("aliases", "array<string>"), "k3")).select("s_suppkey")


@query("resolve_or_create", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 WHEN c_custkey % 3 = 1 AND c_nationkey < 10 THEN 1000 + c_nationkey END AS known FROM customer""")
def resolve_or_create(spark, d):
    """Customers as mentions of entities: some by key, some by name and type, others new; the ids of new ones are hashes."""
    t = C.Catalog(spark, d).table
    c = F.col
    s = lambda x: x.cast("string")
    key = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("user:"), s(c("c_custkey") % 50)))
    new = t("customer").select("c_custkey", F.lit("t").alias("tenant_id"), F.when(c("c_custkey") % 3 == 1, F.concat(F.lit("nation "), s(c("c_nationkey")))).otherwise(c("c_name")).alias("name"), F.lit("place").alias("entity_type"), key.alias("external_key"))
    by_key = spark.range(50).select("id", F.lit("t").alias("tenant_id"), F.lit("x").alias("name"), F.lit("user").alias("entity_type"), F.concat(F.lit("user:"), s(c("id"))).alias("external_key"))
    places = t("nation").where("n_nationkey < 10").select((c("n_nationkey") + 1000).cast("long").alias("id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("nation "), s(c("n_nationkey"))).alias("name"), F.lit("place").alias("entity_type"), F.lit(None).cast("string").alias("external_key"))
    out = K.resolve_or_create(new, by_key.unionByName(places))
    return out.select("c_custkey", F.when(~c("created"), c("entity_id")).alias("known"))


@query("vector_texts", f"""WITH e AS (SELECT source_id AS id, b.name AS t, predicate, coalesce(valid_from, 1000000) AS v, target_id FROM {C.EDGES_SQL} e JOIN {C.OBJECTS_SQL} b ON b.id = target_id),
  r AS (SELECT id, string_agg(predicate || ' ' || t, ' ' ORDER BY v, target_id) AS s FROM e WHERE predicate <> 'participated_in' GROUP BY id), p AS (SELECT id, string_agg(t, ' ' ORDER BY v, target_id) AS s FROM (SELECT * FROM e WHERE predicate = 'participated_in' QUALIFY row_number() OVER (PARTITION BY id ORDER BY v, target_id) <= 5) GROUP BY id)
  SELECT o.id, concat_ws(' ', o.name || ' ' || o.name || ' ' || o.name, CASE WHEN o.id % 5 = 0 THEN 'a' || (o.id % 3) END, r.s, p.s) AS text FROM {C.OBJECTS_SQL} o LEFT JOIN r ON r.id = o.id LEFT JOIN p ON p.id = o.id WHERE object_type IN ('person', 'organization')""")  # fmt: skip
def vector_texts(spark, d):
    objects, edges = C.graph(spark, d)
    aliases = objects.where("id % 5 = 0").select("id", F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("alias"))
    return G.vector_texts(objects, aliases, edges).join(objects.where("object_type in ('person', 'organization')").select("id"), "id", "left_semi")


@query("story_bridge", """WITH f AS (SELECT c_custkey AS entity_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT entity_id, id, r * 2000000 AS time, m AS milestone FROM (SELECT *, unnest(CASE WHEN r = 1 THEN ['new_theme'] ELSE ['large_gap'] END) AS m FROM f)""")  # fmt: skip
def story_bridge(spark, d):
    """Orders as a customer's story: the milestones that a persona's timeline has of it."""
    o = C.Catalog(spark, d).table("orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("content"))
    known = C.Catalog(spark, d).table("customer").select(F.col("c_custkey").alias("entity_id"))
    return persona.milestones(persona.story_facts(o.join(known, "entity_id", "left_semi"))).select("entity_id", "id", "time", "milestone")


@query("greedy_spans", """WITH RECURSIVE s AS (SELECT l_orderkey AS g, (l_partkey % 40)::BIGINT AS start, -(1 + l_quantity::BIGINT % 9) AS o, 'n' || l_linenumber AS name FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY start, o, name) AS k FROM s), w AS (SELECT g, k, start, o, name, true AS kept, start - o AS last FROM r WHERE k = 1
    UNION ALL SELECT r.g, r.k, r.start, r.o, r.name, r.start >= w.last, CASE WHEN r.start >= w.last THEN r.start - r.o ELSE w.last END FROM w JOIN r ON r.g = w.g AND r.k = w.k + 1)
  SELECT g AS group_id, start, -o AS length, name FROM w WHERE kept""")  # fmt: skip
def greedy_spans(spark, d):
    line = C.Catalog(spark, d).table("lineitem")
    s = line.select(F.col("l_orderkey").alias("group_id"), (F.col("l_partkey") % 40).alias("start"), (1 + F.col("l_quantity").cast("long") % 9).alias("length"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"))
    return N.without_overlap(s)


_pieces = "(SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))"


@query("speech_names", f"""WITH t AS (SELECT doc_id, regexp_extract(p[i], '([A-Z][a-z]{{1,19}})$', 1) AS name, strlen(array_to_string(p[1:i], ' ')) AS stop FROM {_pieces} WHERE regexp_matches(p[i + 1], '^(the|and|la)([^A-Za-z]|$)')),
  f AS (SELECT *, stop - strlen(name) AS s, lag(stop - strlen(name)) OVER (PARTITION BY doc_id, name ORDER BY stop) AS last FROM t WHERE name <> '') SELECT name, count(*) AS n FROM f WHERE last IS NULL OR s - last >= 12 GROUP BY name HAVING count(*) >= 2""")  # fmt: skip
def speech_names(spark, d):
    return N.speakers(docs(spark, d), ["the", "and", "la"])


@query("purge_documents", "SELECT doc_id, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY doc_id")
def purge_documents(spark, d):
    t = docs(spark, d)
    return G.purge({"documents": t}, t.where("doc_id % 3 = 0"))["documents"].groupBy("doc_id").agg(F.count("*").alias("n"))


@query("faction_moves")
def faction_moves(spark, d):
    """Moves between the factions of documents' names, in order; the tests compare them with a plain loop."""
    from engram.plans.matching import NAMES, events

    start = docs(spark, d).select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit("wei" if i % 2 else "shu").alias("faction")) for i, c in enumerate(dict(NAMES).values()) if i % 3])).alias("m")).select("doc_id", "m.*").distinct()
    return N.factions(events(spark, d), start, ["ing"], ["ment"])
