"""Queries of the narrative and corpus families, over documents and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.functions.lexicons import IMPACT_WORDS
from engram.operators import corpus as K
from engram.operators import narrative as N
from engram.plans.registry import contains_sql, query

SENT = r"""(SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]+[。！？；.!?;\n]?'), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), lambda x: x <> '') AS s FROM documents))"""
VERBS = ["tion", "with", "ing"]


def docs(spark, d):
    return C.Catalog(spark, d).table("documents")


@query("sentences", f"SELECT doc_id, CAST(pos AS INT) AS pos, md5(sentence) AS sentence FROM {SENT}")
def sentence_rows(spark, d):
    return N.sentence_rows(docs(spark, d)).select("doc_id", "pos", F.md5("sentence").alias("sentence"))


@query("chunks", "SELECT doc_id, CAST(i AS INT) AS chunk_no, md5(substr(text, CAST(i * 1800 + 1 AS BIGINT), 2000)) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(floor((length(text) - 1) / 1800) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunk_rows(spark, d):
    return N.chunk_rows(docs(spark, d)).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


CAPS = "(SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{1,19}'))) AS name FROM documents)"


@query("capitalised_names", f"SELECT name, count(*) AS n FROM {CAPS} WHERE name NOT IN ('The', 'And') GROUP BY name HAVING count(*) >= 2")
def capitalised_names(spark, d):
    return N.capitalised(docs(spark, d), ["The", "And"])


@query("cast_discovery", f"SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {CAPS} GROUP BY name HAVING count(DISTINCT doc_id) >= 5")
def cast_discovery(spark, d):
    runs = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda t: t.rlike("^[A-Z][a-z]{1,19}$"))
    return docs(spark, d).select("doc_id", F.explode(runs).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 5")


CAST = f"(SELECT DISTINCT doc_id, name FROM {CAPS})"
STORY = f"""SELECT w.doc_id, w.title, w.name, min(pos) AS pos, count(*) AS n FROM (SELECT doc_id, pos, substr(sentence, 1, 24) AS title, unnest(list_distinct(regexp_extract_all(sentence, '[A-Za-z]+'))) AS name FROM {SENT}
  WHERE length(sentence) BETWEEN 6 AND 80 AND {contains_sql('sentence', VERBS)}) w JOIN {CAST} c ON c.doc_id = w.doc_id AND c.name = w.name GROUP BY ALL"""  # fmt: skip


def cast(spark, d):
    runs = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda t: t.rlike("^[A-Z][a-z]{1,19}$"))
    return docs(spark, d).select("doc_id", F.explode(F.array_distinct(runs)).alias("name"))


@query("story_events", STORY)
def story_events(spark, d):
    return N.story_events(N.sentence_rows(docs(spark, d)), cast(spark, d), VERBS)


@query("association_pairs", f"WITH e AS ({STORY}) SELECT a.doc_id, a.name AS a, b.name AS b, min(a.pos) AS first_pos, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.title = b.title AND a.name < b.name GROUP BY ALL")
def association_pairs(spark, d):
    e = story_events(spark, d).select("doc_id", "title", "name", "pos")
    j = e.toDF("doc_id", "title", "subject", "pos").join(e.select("doc_id", "title", F.col("name").alias("object")), ["doc_id", "title"]).where("subject < object")
    return N.associations(j)


@query("relation_timeline", """WITH o AS (SELECT l_suppkey AS doc_id, l_partkey AS a, year(l_shipdate) * 12 + month(l_shipdate) AS time, min(l_returnflag) AS relation FROM lineitem GROUP BY 1, 2, 3),
  s AS (SELECT * FROM o QUALIFY lag(relation) OVER (PARTITION BY doc_id, a ORDER BY time) IS DISTINCT FROM relation)
  SELECT doc_id, a, a AS b, relation, CAST(time AS INT) AS valid_from, CAST(lead(time) OVER (PARTITION BY doc_id, a ORDER BY time) AS INT) AS valid_to FROM s""")  # fmt: skip
def relation_timeline(spark, d):
    line = C.Catalog(spark, d).table("lineitem")
    o = line.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("a"), F.col("l_partkey").alias("b"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("time"), F.col("l_returnflag").alias("relation"))
    return N.relation_timeline(o)


MEMBERS = "(SELECT DISTINCT l_orderkey AS g, l_suppkey AS name FROM lineitem)"


def members(spark, d):
    return C.Catalog(spark, d).table("lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("name")).distinct()


CO = f"(SELECT a.name AS a, b.name AS b, count(*) AS n FROM {MEMBERS} a JOIN {MEMBERS} b ON a.g = b.g AND a.name < b.name GROUP BY ALL HAVING count(*) >= 5)"


@query("cooccurrence", f"SELECT * FROM {CO}")
def cooccurrence(spark, d):
    return K.cooccurrence(members(spark, d), 5)


EV = "(SELECT DISTINCT l_partkey % 200 AS e, l_suppkey AS name FROM lineitem)"


@query("relation_scores", f"""WITH co AS {CO}, own AS (SELECT name, count(*) AS n FROM {EV} GROUP BY name), sh AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM {EV} a JOIN {EV} b ON a.e = b.e AND a.name < b.name GROUP BY ALL)
  SELECT co.a, co.b, co.n, round(least(1, (0.5 * least(co.n / 15.0, 1) + 0.3 * coalesce(sh.n / own.n, 0) + 0.2 * CASE WHEN co.n < 10 THEN 0.3 ELSE 1 END) * CASE WHEN x.s_nationkey % 5 = y.s_nationkey % 5 THEN 1.2 ELSE 0.8 END)::DOUBLE, 6) AS score
  FROM co LEFT JOIN sh ON sh.a = co.a AND sh.b = co.b LEFT JOIN own ON own.name = co.a JOIN supplier x ON x.s_suppkey = co.a JOIN supplier y ON y.s_suppkey = co.b""")  # fmt: skip
def relation_scores(spark, d):
    t = C.Catalog(spark, d).table
    events = t("lineitem").select((F.col("l_partkey") % 200).alias("event_id"), F.col("l_suppkey").alias("name"))
    f = t("supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_nationkey") % 5).alias("faction"))
    return K.relation_scores(K.cooccurrence(members(spark, d), 5), events, F.col("n") < 10, f)


@query("character_aggregates", f"SELECT name, count(*) AS n_groups, min(g) AS first_group, least(count(*) / 300.0, 1)::DOUBLE AS importance FROM {MEMBERS} GROUP BY name")
def character_aggregates(spark, d):
    return K.characters(members(spark, d), full=300)


WORDS = r"(SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) GROUP BY w)"


@query("verb_frequency", f"SELECT word, n, round(100.0 * n / sum(n) OVER ()::DOUBLE, 6) AS share FROM {WORDS} QUALIFY n >= 3")
def verb_frequency(spark, d):
    return K.word_frequency(docs(spark, d), 3)


_impact = contains_sql("lower(word)", IMPACT_WORDS)


@query("elite_scores", f"""WITH t AS (SELECT word, n, sum(n) OVER () AS total, n / (max(n) OVER ())::DOUBLE AS f FROM {WORDS} ORDER BY n DESC, word LIMIT 40),
  s AS (SELECT *, CASE WHEN {_impact} THEN 0.9 WHEN length(word) >= 5 THEN 0.8 WHEN length(word) >= 3 THEN 0.6 ELSE 0.4 END::DOUBLE AS impact,
    CASE WHEN n > total * 0.01 THEN 0.9 WHEN n > total * 0.001 THEN 0.7 ELSE 0.4 END::DOUBLE AS domain, least(length(word) / 8.0::DOUBLE, 1) * 0.8 + 0.2 AS p FROM t)
  SELECT word, n, impact, domain, round(f, 6) AS frequency, round(p, 6) AS precision, round(0.25 * impact + 0.2 * domain + 0.2 * f + 0.15 * p + 0.08, 6) AS elite FROM s""")  # fmt: skip
def elite_scores(spark, d):
    return K.elite_scores(K.word_frequency(docs(spark, d)))


@query("unknown_words", f"SELECT word, n FROM {WORDS} WHERE word NOT IN (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) FROM benchmark)")
def unknown_words(spark, d):
    known = C.Catalog(spark, d).table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    return K.unknown_words(K.word_frequency(docs(spark, d)), known).select("word", "n")


@query("faction_membership", "SELECT coalesce(n_name, '未知') AS faction, count(*) AS n FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3 GROUP BY 1")
def faction_membership(spark, d):
    t = C.Catalog(spark, d).table
    s = t("supplier").select(F.col("s_name").alias("name"), "s_nationkey")
    f = s.join(t("nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey")).select("name", F.col("n_name").alias("faction"))
    return K.faction_members(s, f).select("faction", "n")


@query("prefix_forms", "SELECT p_partkey AS id, p_name AS form FROM part WHERE starts_with(lower(p_name), 'sm') ORDER BY form, id LIMIT 20")
def prefix_forms(spark, d):
    lex = C.Catalog(spark, d).table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("form"))
    return N.prefix_forms(lex, "SM")


@query("value_after", f"SELECT doc_id, CAST(pos AS INT) AS pos, nullif(trim(regexp_extract(sentence, 'with([^，,。；、\n：;]*)', 1), ' '), '') AS value FROM {SENT} WHERE contains(sentence, 'with')")
def value_after(spark, d):
    return N.sentence_rows(docs(spark, d)).where(F.contains("sentence", F.lit("with"))).select("doc_id", "pos", N.value_after(F.col("sentence"), "with").alias("value"))


@query("attribute_hints", f"""SELECT doc_id, attribute, arg_min(word, (pos, i)) AS word FROM {SENT} JOIN (VALUES ('a', 0, 'tion'), ('a', 1, 'ing'), ('b', 0, 'with'), ('b', 1, 'from')) w(attribute, i, word) ON contains(sentence, word) GROUP BY doc_id, attribute""")
def attribute_hints(spark, d):
    return N.attribute_hints(N.sentence_rows(docs(spark, d)), {"a": ["tion", "ing"], "b": ["with", "from"]}).select("doc_id", "attribute", "word")


@query("relation_snippets", f"""SELECT doc_id, CAST(pos AS INT) AS pos, p AS predicate, substr(sentence, CAST(instr(sentence, p) + length(p) AS BIGINT), 20) AS snippet FROM (SELECT *, CASE WHEN contains(sentence, 'tion') THEN 'tion' WHEN contains(sentence, 'with') THEN 'with' END AS p FROM {SENT}) WHERE p IS NOT NULL""")
def relation_snippets(spark, d):
    return N.relation_snippets(N.sentence_rows(docs(spark, d)), ["tion", "with"])
