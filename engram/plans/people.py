"""Queries of names, profiles, traits, signals, records and metrics, over the driver's tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.functions import lexicons as L
from engram.functions import scores as S
from engram.operators import distill as D
from engram.operators import people as P
from engram.operators import retrieval as R
from engram.operators.persona import recent_topics
from engram.plans import cognition  # noqa: F401  its SQL is read below
from engram.plans import distill as PD
from engram.plans.matching import values_sql
from engram.plans.registry import ORACLE, contains_sql, query
from engram.plans.retrieval import MEANS, VEC, COS, entity_resolution, vectors

MESSAGES = PD.MESSAGES


def fixture(spark, rows, schema: str):
    return spark.createDataFrame(rows, schema)


ODD_NAMES = [("林黛玉",), ("王",), ("东方不败教主们",), ("Mr. Smith",), ("elizabeth",), ("Ann Mary Lou Smith",), (" Jane ",), ("McCoy",), ("",), (None,)]
_names = f"SELECT c_name AS name FROM customer UNION SELECT n_name FROM nation UNION SELECT p_name FROM part UNION SELECT regexp_extract(html, '[A-Z][a-z]+') FROM pages UNION SELECT name FROM {values_sql(ODD_NAMES, 'name')}"


@query("person_like_names", f"""WITH n AS ({_names}), t AS (SELECT name, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS t FROM n)
  SELECT name, coalesce(regexp_matches(t, '^[一-鿿]{{2,6}}$') OR (len(string_split_regex(t, '\\s+')) <= 3 AND regexp_matches(t, '(^|\\s)[A-Z][a-z]*$')), false) AS person FROM t""")  # fmt: skip
def person_like_names(spark, d):
    t = C.Catalog(spark, d).table
    names = t("customer").select(F.col("c_name").alias("name")).union(t("nation").select("n_name")).union(t("part").select("p_name")).union(t("pages").select(F.regexp_extract("html", "([A-Z][a-z]+)", 1)))
    return names.union(fixture(spark, ODD_NAMES, "name string")).distinct().select("name", P.person_like(F.col("name")).alias("person"))


#: Digits as Han characters, so that keys of the tables give names, good and bad ones.
HAN_DIGITS = "刘诸葛司马张赵不军飞"
SURNAMES, FUNCTION_WORDS, TAILS = ["刘", "诸葛", "司马", "张", "赵"], ["不是", "之"], ["军"]
_han = f"translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{HAN_DIGITS}')"
_valid = lambda c: f"(regexp_matches({c}, '^[一-鿿]{{2,4}}$') AND (substr({c}, 1, 2) IN ('诸葛', '司马') OR substr({c}, 1, 1) IN ('刘', '张', '赵')) AND NOT regexp_matches({c}, '[不之]') AND NOT ends_with({c}, '军'))"


def han(key: str):
    return F.translate(F.col(key).cast("string"), "0123456789", HAN_DIGITS)


@query("valid_han_names", f"WITH n AS (SELECT o_orderkey, {_han} AS name FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders) SELECT o_orderkey, name, coalesce({_valid('name')}, false) AS valid FROM n")
def valid_han_names(spark, d):
    o = C.Catalog(spark, d).table("orders")
    rows = o.select("o_orderkey", han("o_orderkey").alias("name")).union(o.select("o_orderkey", "o_orderpriority"))
    return rows.select("o_orderkey", "name", P.valid_han_name(F.col("name"), SURNAMES, FUNCTION_WORDS, TAILS).alias("valid"))


TITLES, STOP_NAMES = ["Mr.", "Mr", "Mrs.", "Dr.", "Miss"], ["The", "Bolt"]
#: A line about each part: a title or none, its name with capitals or without, and what follows.
_pick = lambda xs, k: "[" + ", ".join(f"'{x}'" for x in xs) + f"][CAST({k} AS INT) + 1]"
LINE_TITLES, LINE_ENDS = ["Mr. ", "Mr ", "Mrs. ", "“Dr. ", "Miss ", "no ", "Missing "], [" replied.", ", well” said he", " The end", "—and Anne", " Anne Mary Sue", " (Project Gutenberg)"]
_line = f"'Then ' || {_pick(LINE_TITLES, 'p_partkey % 7')} || CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END || {_pick(LINE_ENDS, 'p_partkey % 6')}"
_clean = r"CASE WHEN w IN ('Mr', 'Mrs', 'Dr') THEN w || '.' ELSE regexp_extract(w, '^([\p{L}.]*)', 1) END"


def part_lines(spark, d):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % n + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.initcap("p_name"))
    return C.Catalog(spark, d).table("part").select("p_partkey", F.concat(F.lit("Then "), pick(LINE_TITLES, 7), name, pick(LINE_ENDS, 6)).alias("line"))


@query("title_names", rf"""WITH l AS (SELECT p_partkey, {_line} AS line FROM part), t AS (SELECT p_partkey, line, regexp_extract(line, '(?:^|[^\p{{L}}])((?:Mrs\.|Miss|Mr\.|Dr\.|Mr)(?:[^\p{{L}}].*)?)$', 1) AS tail FROM l),
  w AS (SELECT p_partkey, line, list_transform(list_transform(string_split_regex(tail, '\s+')[1:4], lambda x: regexp_replace(x, '^\P{{L}}+|\P{{L}}+$', '', 'g')), lambda w: {_clean}) AS ws FROM t WHERE tail <> ''),
  k AS (SELECT *, coalesce(list_position(list_transform(ws, lambda w: NOT regexp_matches(w, '^\p{{Lu}}') OR w IN ('The', 'Bolt')), true), 0) AS bad FROM w),
  n AS (SELECT p_partkey, line, CASE WHEN bad = 0 THEN ws ELSE ws[1:bad - 1] END AS ws FROM k)
  SELECT l.p_partkey, CASE WHEN len(ws) >= 2 AND NOT contains(l.line, 'Project Gutenberg') THEN array_to_string(ws, ' ') END AS name FROM l LEFT JOIN n ON n.p_partkey = l.p_partkey""")  # fmt: skip
def title_names(spark, d):
    return part_lines(spark, d).select("p_partkey", P.title_name(F.col("line"), TITLES, STOP_NAMES, ["Project Gutenberg"]).alias("name"))


HAN_LINES = ["姓{}字玄德", "有人，{}，字翼德", "{}", "说话。{}、飞号云长", "名{}号子龙"]
_han_line = "[" + ", ".join("replace('" + x + "', '{}', h)" for x in HAN_LINES) + "][CAST(o_orderkey % 5 AS INT) + 1]"
_before = lambda m: f"CASE WHEN contains(line, '{m}') THEN regexp_replace(regexp_extract(split_part(line, '{m}', 1), '((?:[一-同后-姒委-鿿][，,、 ]*){{0,4}})$', 1), '[，,、 ]', '', 'g') END"
_good = lambda c: f"CASE WHEN length({c}) >= 2 AND {_valid(c)} THEN {c} END"


@query("han_names", f"WITH h AS (SELECT o_orderkey, {_han} AS h FROM orders), l AS (SELECT o_orderkey, {_han_line} AS line FROM h), b AS (SELECT o_orderkey, {_before('字')} AS x, {_before('号')} AS y FROM l) SELECT o_orderkey, coalesce({_good('x')}, {_good('y')}) AS name FROM b")
def han_names(spark, d):
    valid = lambda c: P.valid_han_name(c, SURNAMES, FUNCTION_WORDS, TAILS)
    o = C.Catalog(spark, d).table("orders").select("o_orderkey", han("o_orderkey").alias("h"))
    line = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{}"), F.col("h")) for x in HAN_LINES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", P.han_name(line, ["字", "号"], valid).alias("name"))


@query("alias_dictionary", """WITH e AS (SELECT 0 AS provider, s_suppkey AS no, s_name AS canonical, ['N' || s_nationkey, 'S' || (s_suppkey % 50)] AS aliases, NULL AS single FROM supplier
    UNION ALL SELECT 1, n_nationkey, n_name, ['N' || n_nationkey, '', NULL], right(n_name, 1) FROM nation), f AS (SELECT provider, no, canonical, unnest(list_concat([canonical, single], aliases)) AS alias FROM e)
  SELECT alias, arg_max(canonical, (provider, no)) AS canonical FROM f WHERE alias <> '' GROUP BY alias""")  # fmt: skip
def alias_dictionary(spark, d):
    t = C.Catalog(spark, d).table
    tag = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    s = t("supplier").select(F.lit(0).alias("provider"), F.col("s_suppkey").alias("no"), F.col("s_name").alias("canonical"), F.array(tag("N", F.col("s_nationkey")), tag("S", F.col("s_suppkey") % 50)).alias("aliases"), F.lit(None).cast("string").alias("single"))
    n = t("nation").select(F.lit(1).alias("provider"), F.col("n_nationkey").alias("no"), F.col("n_name").alias("canonical"), F.array(tag("N", F.col("n_nationkey")), F.lit(""), F.lit(None).cast("string")).alias("aliases"), F.right("n_name", F.lit(1)).alias("single"))
    return P.dictionary(s.union(n))


TRAITS = [("tion", "formal", 0.5), ("with", "social", 0.7), ("the", "formal", 0.3), ("ing", "active", 0.6)]


@query("trait_profiles", f"""WITH e AS (SELECT conv_id AS entity_id, trait, turn, max(weight) AS weight, content FROM {MESSAGES} JOIN {values_sql(TRAITS, 'word, trait, weight')} ON contains(content, word) GROUP BY ALL),
  f AS (SELECT entity_id, trait, max(weight) AS confidence, list({{'n': strlen(content), 's': substr(content, 1, 80)}} ORDER BY turn) AS xs FROM e GROUP BY entity_id, trait)
  SELECT entity_id, trait, confidence::DOUBLE AS confidence, list_reduce(xs, lambda a, b: CASE WHEN b.n < strlen(a.s) THEN b ELSE a END).s AS snippet FROM f""")  # fmt: skip
def trait_profiles(spark, d):
    m = C.messages(spark, d).select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("pos"), F.col("content").alias("text"))
    return P.traits(m, TRAITS)


MARKS = [("tion", "identity", False), ("ation", "identity", True), ("with", "goal", False), ("the", "emotion", False)]


@query("agent_personality", f"""WITH m AS (SELECT conv_id, turn, arg_min(fact_type, (-strlen(marker), no)) AS fact_type, arg_min(negated, (-strlen(marker), no)) AS negated FROM {MESSAGES}
  JOIN {values_sql([(i, *m[:2], m[2]) for i, m in enumerate(MARKS)], 'no, marker, fact_type, negated')} ON role = 'assistant' AND contains(content, marker) GROUP BY conv_id, turn) SELECT CAST(2 AS BIGINT) AS entity_id, * FROM m""")  # fmt: skip
def agent_personality(spark, d):
    return P.agent_facts(C.messages(spark, d), F.lit(2).cast("long"), MARKS).drop("payload")


ZONES = {"warm": [("tion", "joy"), ("with", "trust")], "cold": [("the", "fear"), ("ing", "anger")]}


def _zone_sql(words) -> str:
    return "CASE " + " ".join(f"WHEN contains(content, '{w}') THEN '{x}'" for w, x in words) + " END"


_zones = " UNION ALL ".join(f"SELECT conv_id, turn, role, 'emotion' AS fact_type, '{z}' AS zone, {_zone_sql(w)} AS label FROM {MESSAGES}" for z, w in ZONES.items())


@query("companion_signals", f"SELECT * FROM ({_zones} UNION ALL SELECT conv_id, turn, role, 'identity', 'self', CASE WHEN {contains_sql('content', ['that', 'ness'])} THEN 'self' END FROM {MESSAGES}) WHERE label IS NOT NULL")
def companion_signals(spark, d):
    return P.companion_signals(C.messages(spark, d), ZONES, ["that", "ness"])


@query("prototype_signals", f"""WITH {MEANS}, a AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
  b AS (SELECT b.id, a.label, round({COS}, 9) AS s FROM a JOIN {VEC} b ON true QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round({COS}, 9) DESC, a.label) = 1)
  SELECT id, 't' || (label % 3) AS fact_type, label % 2 = 1 AS negated, round(greatest(0, least(1, s)), 6) AS confidence FROM b WHERE greatest(0, least(1, s)) >= 0.25""")  # fmt: skip
def prototype_signals(spark, d):
    v = vectors(spark, d)
    protos = R.anchors_of(v).select("label", "centroid", F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("fact_type"), (F.col("label") % 2 == 1).alias("negated"))
    return P.prototype_signals(v, protos, 0.25).withColumn("confidence", F.round("confidence", 6))


def _oracle(name: str) -> str:
    return ORACLE[name]


@query("resolver_rates", f"""WITH r AS ({_oracle("entity_resolution")}) SELECT count(*) AS mentions, round(100.0 * count(*) FILTER (stage = 'alias') / count(*)::DOUBLE, 6) AS alias,
  round(100.0 * count(*) FILTER (stage = 'embedding') / count(*)::DOUBLE, 6) AS embedding, round(100.0 * count(*) FILTER (stage = 'unknown') / count(*)::DOUBLE, 6) AS unknown FROM r""")  # fmt: skip
def resolver_rates(spark, d):
    return P.resolver_rates(entity_resolution(spark, d))


@query("embed_hook", "SELECT doc_id, strlen(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM documents")
def embed_hook(spark, d):
    e = P.embed(C.Catalog(spark, d).table("documents").select("doc_id", "text"), "text", P.text_lengths)
    return e.select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("evidence_union", f"""WITH l AS (SELECT source_id, target_id, source_id % 1000 AS evidence_id FROM {C.EDGES_SQL} WHERE predicate = 'located_in')
  SELECT id, evidence_id FROM (SELECT id, id % 1000 AS evidence_id FROM {C.OBJECTS_SQL} WHERE object_type = 'location' UNION SELECT source_id, evidence_id FROM l UNION SELECT target_id, evidence_id FROM l) WHERE id IN (SELECT id FROM {C.OBJECTS_SQL})""")  # fmt: skip
def evidence_union(spark, d):
    objects, edges = C.graph(spark, d)
    links = edges.where("predicate = 'located_in'").select("source_id", "target_id", "predicate", (F.col("source_id") % 1000).alias("evidence_id"))
    own = objects.where("object_type = 'location'").select("id", (F.col("id") % 1000).alias("evidence_id"))
    return P.evidence_of(objects, edges, own, links)


_pairs = PD.CANDIDATES_SQL


@query("conversation_records", f"""WITH RECURSIVE {_pairs}, goal AS ({_oracle("conversation_goal")}), prob AS ({_oracle("open_problems").replace('WITH m AS', 'WITH om AS').replace('FROM m WHERE', 'FROM om WHERE').replace('FROM m x', 'FROM om x').replace('m.conv_id', 'om.conv_id').replace('m.content', 'om.content')}),
  dec AS (SELECT conv_id, turn, problem FROM pairs WHERE contains(lower(solution), 'done') OR contains(lower(problem), 'tion'))
  SELECT c.conv_id, c.n AS n_messages, goal, coalesce(p.n, 0) AS n_problems, coalesce(d.n, 0) AS n_decisions, coalesce(k.n, 0) AS n_knowledge, coalesce(d.t, '') AS decisions FROM (SELECT conv_id, count(*) AS n FROM {MESSAGES} GROUP BY conv_id) c
  LEFT JOIN goal ON goal.conv_id = c.conv_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM prob GROUP BY conv_id) p ON p.conv_id = c.conv_id
  LEFT JOIN (SELECT conv_id, count(*) AS n, md5(string_agg(problem, ' ' ORDER BY turn)) AS t FROM dec GROUP BY conv_id) d ON d.conv_id = c.conv_id
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM s WHERE memory_type = 'knowledge' AND importance >= 0.3 GROUP BY conv_id) k ON k.conv_id = c.conv_id""")  # fmt: skip
def conversation_records(spark, d):
    m, pairs = C.messages(spark, d), PD.driver_pairs(spark, d)
    r = P.conversation_records(m, D.goals(m), D.files(m), D.open_problems(m), D.decisions(pairs, ["done"], ["tion"]), PD.driver_candidates(spark, d))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return r.select("conv_id", "n_messages", "goal", size("problems"), size("decisions"), size("knowledge"), F.when(F.size("decisions") > 0, F.md5(F.array_join("decisions", " "))).otherwise("").alias("decisions"))


_problems = _oracle("open_problems").replace("WITH m AS", "WITH om AS").replace("FROM m WHERE", "FROM om WHERE").replace("FROM m x", "FROM om x").replace("m.con", "om.con")


@query("conversation_prompts", f"""WITH RECURSIVE {_pairs}, goal AS ({_oracle("conversation_goal")}), prob AS ({_problems}),
  k AS (SELECT conv_id, turn, '- [' || CAST(floor(importance * 100) AS INT) || '%] ' || problem AS line, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, turn) AS r FROM s WHERE memory_type = 'knowledge' QUALIFY r <= 5),
  dec AS (SELECT conv_id, '- ' || problem || ' (' || CASE WHEN turn % 2 = 0 THEN 'core' ELSE '' END || ')' AS line, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN contains(lower(solution), 'done') THEN 0 ELSE 1 END, turn) AS r
    FROM pairs WHERE contains(lower(solution), 'done') OR contains(lower(problem), 'tion') QUALIFY r <= 3),
  last AS (SELECT conv_id, turn, role || ': ' || substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '…' ELSE '' END AS line FROM {MESSAGES} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3),
  kk AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY r) AS t FROM k GROUP BY conv_id), dd AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY r) AS t FROM dec GROUP BY conv_id),
  ll AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS t FROM last GROUP BY conv_id), pp AS (SELECT conv_id, string_agg(content, '; ' ORDER BY turn) AS t FROM prob GROUP BY conv_id)
  SELECT c.conv_id, md5(concat_ws(chr(10), '## Knowledge' || chr(10) || kk.t || chr(10), '## Decisions' || chr(10) || dd.t || chr(10), '## Session State', '- Goal: ' || goal, CASE WHEN c.conv_id % 2 = 0 THEN '- Module: api' END,
    '- Problems: ' || pp.t, '## Recent' || chr(10) || ll.t)) AS prompt FROM (SELECT DISTINCT conv_id FROM {MESSAGES}) c LEFT JOIN kk ON kk.conv_id = c.conv_id LEFT JOIN dd ON dd.conv_id = c.conv_id
    LEFT JOIN ll ON ll.conv_id = c.conv_id LEFT JOIN pp ON pp.conv_id = c.conv_id LEFT JOIN goal ON goal.conv_id = c.conv_id""")  # fmt: skip
def conversation_prompts(spark, d):
    m, pairs, scored = C.messages(spark, d), PD.driver_pairs(spark, d), PD.driver_candidates(spark, d)
    decided = D.decisions(pairs, ["done"], ["tion"])
    records = P.conversation_records(m, D.goals(m), D.files(m), D.open_problems(m), decided, scored)
    records = records.withColumn("module", F.when(F.col("conv_id") % 2 == 0, "api"))
    known = scored.where("memory_type = 'knowledge'").select("conv_id", "turn", "importance", F.col("problem").alias("summary"))
    p = P.prompts(m, records, known, decided.withColumn("module", F.when(F.col("turn") % 2 == 0, "core")))
    return p.select("conv_id", F.md5("prompt").alias("prompt"))


_topics = _oracle("repeated_themes").replace("<= 20", "<= 10")


@query("relationship_topics", f"""SELECT c.conv_id, coalesce(t, '') AS topics FROM (SELECT DISTINCT conv_id FROM {MESSAGES}) c LEFT JOIN (SELECT conv_id, string_agg(keyword, ',' ORDER BY occurrences DESC, keyword) AS t FROM ({_topics}) GROUP BY conv_id) x ON x.conv_id = c.conv_id""")
def relationship_topics(spark, d):
    return recent_topics(C.messages(spark, d)).select("conv_id", F.array_join("topics", ",").alias("topics"))


_decided = f"SELECT 'Decision: ' || problem || ' — Rationale: ' || solution AS content, max(CASE WHEN contains(lower(solution), 'done') THEN 0.9 ELSE 0.7 END)::DOUBLE AS confidence FROM pairs WHERE contains(lower(solution), 'done') OR contains(lower(problem), 'tion') GROUP BY content"


@query("persist_decisions", f"WITH RECURSIVE {PD.PAIRS_SQL}, n AS ({_decided}) SELECT 't' AS tenant_id, 'knowledge' AS memory_type, content, confidence FROM n WHERE NOT {contains_sql('lower(content)', L.SECRETS)} AND strlen(trim(content)) <= 8000 AND confidence <= 0.8")
def persist_decisions(spark, d):
    """What is decided, against a store that has the completed ones already."""
    found = D.decisions(PD.driver_pairs(spark, d), ["done"], ["tion"])
    first = P.new_decisions(found, fixture(spark, [], "tenant_id string, memory_type string, content string"), "t", S.is_noise, S.is_sensitive)
    return P.new_decisions(found, first.where("confidence > 0.8"), "t", S.is_noise, S.is_sensitive)


@query("context_check", f"WITH RECURSIVE {PD.CANDIDATES_SQL} SELECT 55.0::DOUBLE AS usage, 40.0::DOUBLE AS threshold, true AS distill_mode, (SELECT count(*) FROM top) AS n UNION ALL SELECT 12.0, 40.0, false, (SELECT count(*) FROM events)")
def context_check(spark, d):
    run = lambda: D.keep_important(PD.driver_candidates(spark, d))
    facts = C.facts(spark, d)
    return P.context_check(55, run, facts).unionByName(P.context_check(12, run, facts))


@query("faction_constraint", """WITH s AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey + l_partkey) % 97 AS b, (l_partkey % 10) / 10.0::DOUBLE AS score, ['same', 'different', 'any'][CAST(l_partkey % 3 AS INT) + 1] AS rule FROM lineitem),
  f AS (SELECT s_suppkey AS name, n_regionkey AS faction FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 > 0), j AS (SELECT s.*, coalesce(x.faction = y.faction, true) AS same FROM s LEFT JOIN f x ON x.name = s.a LEFT JOIN f y ON y.name = s.b)
  SELECT a, b, rule, round(CASE WHEN rule = 'same' AND NOT same OR rule = 'different' AND same THEN 0.2 * score ELSE score END::DOUBLE, 6) AS score FROM j""")  # fmt: skip
def faction_constraint(spark, d):
    t = C.Catalog(spark, d).table
    part = F.col("l_partkey")
    rule = F.element_at(F.array(F.lit("same"), F.lit("different"), F.lit("any")), (part % 3 + 1).cast("int"))
    s = t("lineitem").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") + part) % 97).alias("b"), ((part % 10) / 10.0).alias("score"), rule.alias("rule")).distinct()
    f = t("supplier").where("s_suppkey % 4 > 0").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("name"), F.col("n_regionkey").alias("faction"))
    return P.constrained(s, f, F.col("rule")).select("a", "b", "rule", "score")


@query("temporal_exponential", f"SELECT id, round(CASE WHEN expires_at <= {C.NOW} THEN 0 ELSE exp(-1.157e-7 * greatest(0, {C.NOW} - created_at)) END::DOUBLE, 9) AS fresh FROM {C.MEMORIES_SQL}")
def temporal_exponential(spark, d):
    m = C.memories(spark, d)
    return m.select("id", F.round(S.temporal_score_exponential(F.lit("current"), F.col("created_at"), F.col("expires_at"), F.lit(C.NOW)), 9).alias("fresh"))


@query("snapshot_text", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY entity_id, fact_type ORDER BY time DESC, id DESC) AS r FROM {C.FACTS_SQL} QUALIFY r <= 5),
  k AS (SELECT entity_id, fact_type, string_agg(content, chr(10) || '- ' ORDER BY r) AS m, string_agg(content, ', ' ORDER BY r) AS t FROM l GROUP BY entity_id, fact_type)
  SELECT entity_id, string_agg('## ' || fact_type || chr(10) || '- ' || m, chr(10) ORDER BY fact_type) AS markdown, string_agg(fact_type || ': ' || t, '; ' ORDER BY fact_type) AS embedding_text FROM k GROUP BY entity_id""")  # fmt: skip
def snapshot_text(spark, d):
    from engram.operators.persona import with_payload

    return P.snapshots(with_payload(C.facts(spark, d)))
