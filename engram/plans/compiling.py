"""Queries of document compile, dialogue relations and networks, over documents and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.operators import dialogue as T
from engram.operators import migration as M
from engram.operators import network as W
from engram.operators.compile import Profile, compile_documents, recompile, statistics
from engram.plans.matching import names
from engram.plans.narrative import SENT, docs
from engram.plans.registry import ORACLE, contains_sql, query

PROFILE = Profile(hints={"size": ["tion", "ing"], "kind": ["with", "que"]}, predicates=["ment", "that"], verbs=["the ", "une"], story=["tion", "ing"], titles=["Mr."], stop_names=["And"])


def titled(spark, d):
    """documents with a title and a type: two in three are called by their first capitalised word, one in seven is a dialog."""
    word = F.regexp_extract("text", "([A-Z][a-z]+)", 1)
    return docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 > 0, word).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("doc_id") % 7 == 0, "dialog").otherwise("novel").alias("doc_type"), "text")


HEADS = r"(SELECT doc_id, title, doc_id % 7 = 0 AS dialog, regexp_matches(title, '^[A-Z][a-z]*$') AS named FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN regexp_extract(text, '[A-Z][a-z]+') ELSE 'doc-' || doc_id END AS title FROM documents))"
_attributes = "[{'key': 'kind', 'value': CASE WHEN contains(sentence, 'with') THEN 'with' WHEN contains(sentence, 'que') THEN 'que' END}, {'key': 'size', 'value': CASE WHEN contains(sentence, 'tion') THEN 'tion' WHEN contains(sentence, 'ing') THEN 'ing' END}]"
SAID = f"""(SELECT doc_id, pos, sentence, list_filter({_attributes}, lambda a: a.value IS NOT NULL) AS attributes, CASE WHEN contains(sentence, 'ment') THEN 'ment' WHEN contains(sentence, 'that') THEN 'that' END AS predicate, {contains_sql('sentence', ['the ', 'une'])} AS evidence,
  list_filter(regexp_extract_all(sentence, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{1,19}}') AND x <> 'And') AS names FROM {SENT})"""
#: Documents begin with a line that calls someone by a title, as their own words never do.
TITLED = rf"""(SELECT doc_id, array_to_string(ws[1:bad - 1], ' ') AS name FROM (SELECT doc_id, ws, coalesce(nullif(coalesce(list_position(list_transform(ws, lambda w: NOT regexp_matches(w, '^\p{{Lu}}') OR w = 'And'), true), 0), 0), 5) AS bad FROM
  (SELECT doc_id, list_transform(list_transform(string_split_regex('Mr. ' || regexp_extract(text, '[A-Z][a-z]+') || ' Und came. ' || text, '\s+')[1:4], lambda x: regexp_replace(x, '^\P{{L}}+|\P{{L}}+$', '', 'g')), lambda w: CASE WHEN w = 'Mr' THEN 'Mr.' ELSE regexp_extract(w, '^([\p{{L}}.]*)', 1) END) AS ws FROM documents)) WHERE len(ws[1:bad - 1]) >= 2)"""


@query("compile_documents", f"""WITH h AS {HEADS}, s AS {SAID}, subj AS (SELECT doc_id, title FROM h WHERE named AND NOT dialog),
  met AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(names) AS name FROM s) GROUP BY doc_id, name HAVING count(*) >= 2),
  found AS (SELECT m.doc_id, m.name FROM met m JOIN h ON h.doc_id = m.doc_id AND NOT dialog AND m.name <> title),
  cast_ AS (SELECT doc_id, title AS name FROM subj UNION SELECT doc_id, name FROM found),
  story AS (SELECT DISTINCT w.doc_id, w.title, w.name FROM (SELECT doc_id, substr(sentence, 1, 24) AS title, unnest(regexp_extract_all(sentence, '[A-Za-z]+')) AS name FROM {SENT} WHERE length(sentence) BETWEEN 6 AND 80 AND {contains_sql('sentence', ['tion', 'ing'])}) w JOIN cast_ c ON c.doc_id = w.doc_id AND c.name = w.name)
  SELECT 'document' AS kind, doc_id, title AS name, '' AS value FROM h UNION ALL SELECT 'person', doc_id, title, '0.8' FROM subj UNION ALL SELECT 'person', doc_id, name, '0.7' FROM found
  UNION ALL SELECT 'event', doc_id, title, '' FROM (SELECT DISTINCT doc_id, title FROM story) UNION ALL SELECT 'took part', doc_id, name, title FROM story
  UNION ALL SELECT 'evidence', doc_id, md5(sentence), CAST(pos AS VARCHAR) FROM s WHERE evidence UNION ALL SELECT 'link', s.doc_id, subj.title, CAST(count(*) AS VARCHAR) FROM s JOIN subj ON subj.doc_id = s.doc_id WHERE evidence GROUP BY ALL
  UNION ALL SELECT DISTINCT 'attribute', doc_id, title, a.key || '=' || a.value FROM (SELECT s.doc_id, title, unnest(attributes) AS a FROM s JOIN subj ON subj.doc_id = s.doc_id)
  UNION ALL SELECT 'relation', s.doc_id, predicate, substr(trim(substr(sentence, instr(sentence, predicate) + length(predicate)), ' '), 1, 20) FROM s JOIN subj ON subj.doc_id = s.doc_id WHERE predicate IS NOT NULL
  UNION ALL SELECT 'world', 0, name, CAST(max(x) AS VARCHAR) FROM (SELECT title AS name, 0.5 AS x FROM subj UNION ALL SELECT name, 0.6 FROM found) GROUP BY name""")  # fmt: skip
def compile_all(spark, d):
    """Every table's rows of compiled documents, as kind, doc_id, name and value. Titles aren't looked for here."""
    profile = Profile(PROFILE.hints, PROFILE.predicates, PROFILE.verbs, PROFILE.story, (), PROFILE.stop_names)
    return table_rows(compile_documents(titled(spark, d), profile))


def table_rows(t):
    text, none = lambda c: F.col(c).cast("string"), F.lit("")
    row = lambda df, kind, name, value, doc="doc_id": df.select(F.lit(kind).alias("kind"), F.col(doc).cast("long").alias("doc_id"), name.alias("name"), value.alias("value"))
    c = F.col
    persons, events = t["objects"].where("object_type = 'person'"), t["objects"].where("object_type = 'event'")
    took = t["edges"].join(persons.select(c("id").alias("source_id"), "name"), "source_id").join(events.select(c("id").alias("target_id"), c("name").alias("title")), "target_id")
    linked = t["links"].join(persons.select(c("id").alias("object_id"), "name"), "object_id").groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    says = F.from_json("properties", "relations array<struct<predicate:string,target_snippet:string,sentence:string>>")
    related = persons.where("confidence = 0.8").select("doc_id", F.explode(says["relations"]).alias("r"))
    out = row(t["documents"], "document", c("title"), none)
    for part in (
        row(persons, "person", c("name"), text("confidence")),
        row(events, "event", c("name"), none),
        row(took, "took part", c("name"), c("title")),
        row(t["evidence"], "evidence", F.md5("content"), text("pos")),
        row(linked, "link", c("name"), text("n")),
        row(t["profiles"], "attribute", c("name"), F.concat("key", F.lit("="), "value")),
        row(related, "relation", c("r.predicate"), c("r.target_snippet")),
        row(t["world_entities"].withColumn("doc_id", F.lit(0)), "world", c("name"), text("importance")),
    ):
        out = out.unionByName(part)
    return out


@query("compile_titles", f"SELECT doc_id, name, 1 AS n FROM {TITLED} WHERE doc_id % 7 > 0")
def compile_titles(spark, d):
    """Persons that a compile finds after titles, with how often."""
    called = F.concat(F.lit("Once Mr. "), F.regexp_extract("text", "([A-Z][a-z]+)", 1), F.lit(" Und came. "), F.col("text"))
    t = compile_documents(titled(spark, d).withColumn("text", called), Profile(titles=PROFILE.titles, stop_names=PROFILE.stop_names, least_names=1 << 30))
    p = F.from_json("properties", "source string, frequency long")
    return t["objects"].select("doc_id", "name", p.alias("p")).where("p.source = 'title'").select("doc_id", "name", F.col("p.frequency").alias("n"))


@query("recompile_document", f"SELECT doc_id, count(*) AS n, md5(string_agg(md5(sentence), '' ORDER BY pos)) AS contents FROM {SAID} WHERE evidence GROUP BY doc_id")
def recompile_document(spark, d):
    """The evidence of all documents after every second one was compiled from a broken text and then again from its own."""
    t = titled(spark, d)
    broken = t.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("the end. "), "text")).otherwise(F.col("text")))
    tables = recompile(compile_documents(broken, PROFILE), t.where("doc_id % 2 = 0"), PROFILE)
    listed = F.array_sort(F.collect_list(F.struct("pos", F.md5("content").alias("m"))))
    return tables["evidence"].groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(listed, lambda s: s["m"]), "")).alias("contents"))


_KINDS = {"document": "documents", "person": "persons", "event": "events", "took part": "edges", "evidence": "evidence"}


@query("compile_statistics", f"SELECT CASE kind {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in _KINDS.items())} END AS kind, count(*) AS n FROM ({ORACLE['compile_documents']}) WHERE kind IN ({', '.join(f'{chr(39)}{a}{chr(39)}' for a in _KINDS)}) GROUP BY 1")
def compile_statistics(spark, d):
    return statistics(compile_documents(titled(spark, d), PROFILE))


@query("dialogue_relations")
def dialogue_relations(spark, d):
    """Who addresses whom in documents; the tests compare it with a reading of the same rules in plain Python."""
    texts = docs(spark, d).select("doc_id", F.lit(0).alias("pos"), "text")
    return T.dialogue_relations(texts, names(spark), ["th ", "que "], ["an", "le"], ["wh", "ç"], RULES)


RULES = [(["ing", "ment"], "kin"), (["er", "ion"], "oath"), (["the"], "lord")]

_bonds = "(SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand AS relation FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND (a.p_size + b.p_size) % 3 = 0)"
_took = "(SELECT DISTINCT l_orderkey AS e, l_partkey AS name FROM lineitem WHERE l_linenumber <= 2)"
_level1 = f"SELECT name FROM {_took} WHERE e IN (SELECT e FROM {_took} WHERE name = 1) UNION SELECT b FROM {_bonds} WHERE a = 1 UNION SELECT a FROM {_bonds} WHERE b = 1"
_level2 = f"SELECT name FROM {_took} WHERE e IN (SELECT e FROM {_took} WHERE name IN (SELECT name FROM l1)) UNION SELECT b FROM {_bonds} WHERE a IN (SELECT name FROM l1) UNION SELECT a FROM {_bonds} WHERE b IN (SELECT name FROM l1)"
NODES = f"l1 AS ({_level1}), l2 AS ({_level2}), n AS (SELECT name, CAST(min(level) AS INT) AS level FROM (SELECT 1 AS name, 0 AS level UNION ALL SELECT name, 1 FROM l1 UNION ALL SELECT name, 2 FROM l2) GROUP BY name)"


def bonds(spark, d):
    """(a, b, relation), (event_id, name): parts next to each other that fit together, and parts of one order."""
    t = C.Catalog(spark, d).table
    p = t("part").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("relation"), "p_size")
    q = t("part").select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_size").alias("size"))
    r = p.join(q, "a").where("(p_size + size) % 3 = 0").select("a", "b", "relation")
    return r, t("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("name"))


@query("network_nodes", f"""WITH {NODES} SELECT n.name, level, (SELECT count(*) FROM {_bonds} x WHERE x.a = n.name OR x.b = n.name) AS relations, (SELECT count(*) FROM {_took} x WHERE x.name = n.name) AS events FROM n""")
def network_nodes(spark, d):
    return W.network(*bonds(spark, d), 1)[0].drop("json")


@query("network_edges", f"""WITH {NODES} SELECT 'relation' AS kind, CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target FROM {_bonds} WHERE a IN (SELECT name FROM n) AND b IN (SELECT name FROM n)
  UNION ALL SELECT 'event', CAST(e AS VARCHAR), CAST(name AS VARCHAR) FROM {_took} WHERE e IN (SELECT e FROM {_took} WHERE name IN (SELECT name FROM n WHERE level < 2))""")  # fmt: skip
def network_edges(spark, d):
    return W.network(*bonds(spark, d), 1)[1].drop("json")


CAST = [("The", ["Than", "tion"], 0.9), ("De", ["Des"], 0.5), ("Nobody", [], 0.1)]
_names = "(VALUES ('The', 'The'), ('The', 'Than'), ('The', 'tion'), ('De', 'De'), ('De', 'Des'), ('Nobody', 'Nobody')) v(name, alias)"
_chapters = "(SELECT doc_id, 1 AS chapter_no, substr(text, 1, 400) AS text FROM documents UNION ALL SELECT doc_id, 2, substr(text, 401) FROM documents WHERE length(text) > 400)"
_first = f"(SELECT doc_id, chapter_no, name, alias, text, length(split_part(text, alias, 1)) AS p FROM {_chapters} JOIN {_names} ON contains(text, alias) QUALIFY row_number() OVER (PARTITION BY doc_id, chapter_no, name ORDER BY p, length(alias) DESC) = 1)"
#: The window in whole characters: the fewest before that have 40 bytes, the most behind that have 80.
_window = "substr(text, p - back + 1, back + length(alias) + fore)"
_sized = f"(SELECT *, coalesce(list_min(list_filter(range(0, p + 1), lambda k: strlen(substr(text, p - k + 1, k)) >= 40)), p) AS back, list_max(list_filter(range(0, 81), lambda k: strlen(substr(text, p + length(alias) + 1, k)) <= 80)) AS fore FROM {_first})"


@query("migrate_characters", f"""WITH m AS {_sized}, d AS (SELECT doc_id FROM documents WHERE length(text) > 0),
  ev AS (SELECT doc_id, 'The' AS name, 'start' AS title, 1 AS chapter, 'they met' AS description FROM d UNION ALL SELECT doc_id, 'De', 'start', 1, 'he came' FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Nobody', 'end', 9, 'gone' FROM d UNION ALL SELECT doc_id, 'Stranger', 'x', 1, 'y' FROM d),
  told AS (SELECT * FROM ev WHERE name <> 'Stranger')
  SELECT 'mention' AS kind, doc_id, CAST(chapter_no AS INT) AS chapter, name AS a, alias || '@' || strlen(substr(text, 1, p)) AS b FROM m UNION ALL SELECT 'seen', doc_id, CAST(chapter_no AS INT), name, md5({_window}) FROM m
  UNION ALL SELECT 'event', doc_id, CAST(chapter AS INT), title, '' FROM (SELECT DISTINCT doc_id, chapter, title FROM told) UNION ALL SELECT 'took part', doc_id, CAST(chapter AS INT), name, title FROM told
  UNION ALL SELECT 'relation', doc_id, 2, 'The', 'De' FROM d UNION ALL SELECT 'told', t.doc_id, CAST(chapter AS INT), name, description FROM told t WHERE chapter = 1
  UNION ALL SELECT 'told', doc_id, 2, '', 'they fell out' FROM d JOIN documents USING (doc_id) WHERE length(text) > 400
  UNION ALL SELECT 'chapter', doc_id, CAST(chapter_no AS INT), CAST(coalesce(lag(strlen(text)) OVER (PARTITION BY doc_id ORDER BY chapter_no), 0) AS VARCHAR), CAST(strlen(text) AS VARCHAR) FROM {_chapters} WHERE text <> ''""")  # fmt: skip
def migrate_characters(spark, d):
    """Documents in two chapters, three characters in each, and what they do: the rows of the tables that come of it."""
    t = docs(spark, d).where("text <> ''")
    one = t.select("doc_id", F.lit(1).alias("chapter_no"), F.substring("text", 1, 400).alias("text"))
    two = t.where("length(text) > 400").select("doc_id", F.lit(2), F.expr("substring(text, 401)"))
    cast = t.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).cast("array<string>").alias("aliases"), F.lit(x).alias("importance")) for n, a, x in CAST])).alias("c")).select("doc_id", "c.*", F.lit("{}").alias("properties"))
    does = [("The", "start", 1, "they met"), ("De", "start", 1, "he came"), ("Nobody", "end", 9, "gone"), ("Stranger", "x", 1, "y")]
    happened = t.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("title"), F.lit(c).alias("chapter"), F.lit(s).alias("description")) for n, e, c, s in does])).alias("e")).select("doc_id", "e.*", F.array(F.lit("De")).alias("related")).where("name <> 'De' or doc_id % 2 = 0")
    related = t.select("doc_id", F.lit("The").alias("a"), F.lit("De").alias("b"), F.lit("foe").alias("relation"), F.lit(2).alias("chapter"), F.lit("they fell out").alias("description"), F.lit(0.6).alias("confidence"))
    m = M.migrate(t.select("doc_id", F.md5("text").alias("title")), one.union(two), cast, happened, related)
    c = F.col
    chapters = m["chapters"].select(c("id").alias("chapter_id"), c("chapter_no").alias("chapter"))
    named = m["objects"].select(c("id").alias("object_id"), c("name").alias("a"), "object_type")
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), "doc_id", c("chapter").cast("int").alias("chapter"), a.alias("a"), b.alias("b"))
    evidence = m["evidence"].join(chapters, "chapter_id")
    persons = m["links"].where("kind = 'object'").select(c("source_id").alias("object_id"), c("evidence_id").alias("id")).join(named.where("object_type = 'person'"), "object_id").select("id", "a")
    whose = evidence.join(persons, "id", "left")
    edges = m["edges"].withColumn("chapter", c("valid_from")).join(named.select(c("object_id").alias("source_id"), "a"), "source_id").join(named.select(c("object_id").alias("target_id"), c("a").alias("b")), "target_id")
    out = row(m["mentions"].join(chapters, "chapter_id").join(named, "object_id"), "mention", c("a"), F.concat("alias_used", F.lit("@"), c("start_offset").cast("string")))
    for part in (
        row(whose.where("start_offset is not null"), "seen", c("a"), F.md5("content")),
        row(m["objects"].where("object_type = 'event'").withColumn("chapter", F.get_json_object("properties", "$.chapter")), "event", c("name"), F.lit("")),
        row(edges.where("predicate = 'participated_in'"), "took part", c("a"), c("b")),
        row(edges.where("predicate = 'foe'"), "relation", c("a"), c("b")),
        row(whose.where("start_offset is null"), "told", F.coalesce("a", F.lit("")), c("content")),
        row(m["chapters"].withColumn("chapter", c("chapter_no")), "chapter", c("start_offset").cast("string"), F.octet_length("content").cast("string")),
    ):
        out = out.unionByName(part)
    return out
