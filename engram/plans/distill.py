"""Queries of the distillation family, over conversations with the driver's word lists and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import catalog as C
from engram.functions import lexicons as L
from engram.functions import scores as S
from engram.functions.text import any_of, file_names
from engram.operators import distill as D
from engram.plans.registry import contains_sql, count_sql, query, starts_sql

TRIM = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_chatter = "|".join(sorted(L.CHATTER, key=len, reverse=True))
MESSAGES = "(SELECT conv_id, turn, role, text AS content FROM conversations)"


def driver_problem():
    return any_of(F.lower("content"), L.DRIVER_PROBLEMS) & (F.octet_length("content") >= 12)


def driver_question():
    return F.col("content").contains("that")


def driver_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.extract_pairs(C.messages(spark, d), driver_problem(), driver_question())


def driver_candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(driver_pairs(spark, d), L.DRIVER_TYPES, L.DRIVER_VALUE)


#: Greedy reading as a recursion over positions; DuckDB only.
PAIRS_SQL = f"""
  m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, contains(content, 'that') AS q,
          role = 'user' AND {contains_sql('lower(content)', L.DRIVER_PROBLEMS)} AND strlen(content) >= 12 AS p FROM {MESSAGES}),
  c AS (SELECT a.conv_id, a.turn, a.pos, a.content AS problem, b.content AS next_content, b.q AS next_q, b.pos AS next_pos,
          (SELECT min(x.pos) FROM m x WHERE x.conv_id = a.conv_id AND x.pos > a.pos + 1 AND x.role = 'assistant') AS later_pos
        FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1 AND b.role = 'assistant' WHERE a.p),
  f AS (SELECT c.*, l.content AS later_content, l.q AS later_q FROM c LEFT JOIN m l ON l.conv_id = c.conv_id AND l.pos = c.later_pos),
  g AS (SELECT conv_id, turn, pos, problem, CASE WHEN NOT next_q THEN next_content ELSE later_content END AS solution, CASE WHEN NOT next_q THEN 'direct' ELSE 'cross-turn' END AS method,
          CASE WHEN NOT next_q THEN next_pos ELSE later_pos END AS until FROM f WHERE NOT next_q OR NOT later_q),
  r AS (SELECT * FROM g WHERE (conv_id, pos) IN (SELECT conv_id, min(pos) FROM g GROUP BY conv_id)
        UNION ALL SELECT g.* FROM r JOIN g ON g.conv_id = r.conv_id AND g.pos = (SELECT min(h.pos) FROM g h WHERE h.conv_id = r.conv_id AND h.pos > r.until)),
  pairs AS (SELECT conv_id, turn, problem, solution, method FROM r)"""
_text = "(problem || ' ' || solution)"
_hits = {k: count_sql(f"lower({_text})", w) for k, w in L.DRIVER_TYPES.items()}
_best = "greatest(" + ", ".join(_hits.values()) + ")"
TYPE_SQL = f"CASE WHEN {_best} = 0 THEN 'knowledge' " + " ".join(f"WHEN {h} = {_best} THEN '{k}'" for k, h in _hits.items()) + " END"
_n = f"strlen({_text})"
LENGTH_SQL = f"CASE WHEN {_n} < 16 THEN {_n} / 16.0 * 0.30 WHEN {_n} <= 400 THEN 0.30 WHEN {_n} >= 800 THEN 0 ELSE (1 - ({_n} - 400) / 400.0) * 0.30 END"
_bias = " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.TYPE_BIAS.items())
CANDIDATES_SQL = f"""{PAIRS_SQL},
  t AS (SELECT *, {contains_sql('lower(problem)', L.SECRETS)} OR {contains_sql('lower(solution)', L.SECRETS)} AS sensitive,
          strlen(trim(problem)) < 8 OR strlen(trim(problem)) > 8000 OR regexp_matches(lower(trim(problem)), '^({_chatter})([^\\p{{L}}\\p{{N}}]|$)') AS noise, {TYPE_SQL} AS memory_type FROM pairs),
  s AS (SELECT *, round(greatest(0, least(1, 0.10 + least({count_sql(f'lower({_text})', L.DRIVER_VALUE)}, 6) * 0.08 + {LENGTH_SQL} + 0.40 * CASE memory_type {_bias} END))::DOUBLE, 9) AS importance FROM t),
  top AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, turn) AS rank FROM s WHERE NOT sensitive AND NOT noise AND importance >= 0.6 QUALIFY rank <= 3)"""


@query("noise_filter", f"SELECT conv_id, turn, strlen({TRIM}) < 8 OR strlen({TRIM}) > 8000 OR regexp_matches(lower({TRIM}), '^({_chatter})([^\\p{{L}}\\p{{N}}]|$)') AS noise FROM {MESSAGES}")
def noise_filter(spark, d):
    return C.messages(spark, d).select("conv_id", "turn", S.is_noise(F.col("content")).alias("noise"))


@query("security_filter", f"SELECT doc_id, {contains_sql('lower(text)', L.SECRETS)} AS listed, {contains_sql('lower(text)', ['token = '])} AS custom FROM documents")
def security_filter(spark, d):
    t = F.col("text")
    return C.Catalog(spark, d).table("documents").select("doc_id", S.is_sensitive(t).alias("listed"), S.is_sensitive(t, ["token = "]).alias("custom"))


_low = f"lower({TRIM})"
_problem = f"strlen({TRIM}) >= 12 AND NOT {starts_sql(_low, L.NOT_PROBLEMS)} AND ({{}} OR regexp_matches({_low}, '[?？]$'))"


@query("problem_detect", f"SELECT conv_id, turn, {_problem.format(contains_sql(_low, L.PROBLEM_WORDS))} AS listed, {_problem.format(contains_sql(_low, L.DRIVER_PROBLEMS))} AS driver FROM {MESSAGES}")
def problem_detect(spark, d):
    c = F.col("content")
    return C.messages(spark, d).select("conv_id", "turn", S.is_problem(c).alias("listed"), S.is_problem(c, L.DRIVER_PROBLEMS).alias("driver"))


@query("question_detect", f"SELECT conv_id, turn, {TRIM} <> '' AND (regexp_matches({TRIM}, '[?？]$') OR {starts_sql(_low, L.INTERROGATIVES)}) AS question FROM {MESSAGES}")
def question_detect(spark, d):
    return C.messages(spark, d).select("conv_id", "turn", S.is_question(F.col("content")).alias("question"))


@query("extract_pairs", f"WITH RECURSIVE {PAIRS_SQL} SELECT * FROM pairs")
def extract_pairs(spark, d):
    return driver_pairs(spark, d)


@query("pair_direct", f"WITH RECURSIVE {PAIRS_SQL} SELECT conv_id, turn, problem, solution FROM pairs WHERE method = 'direct'")
def pair_direct(spark, d):
    return driver_pairs(spark, d).where("method = 'direct'").drop("method")


@query("pair_cross_turn", f"WITH RECURSIVE {PAIRS_SQL} SELECT conv_id, turn, problem, solution FROM pairs WHERE method = 'cross-turn'")
def pair_cross_turn(spark, d):
    return driver_pairs(spark, d).where("method = 'cross-turn'").drop("method")


@query("classify_memories", f"WITH RECURSIVE {CANDIDATES_SQL} SELECT conv_id, turn, memory_type FROM s")
def classify_memories(spark, d):
    return driver_candidates(spark, d).select("conv_id", "turn", "memory_type")


@query("importance_score", f"WITH RECURSIVE {CANDIDATES_SQL} SELECT conv_id, turn, memory_type, importance FROM s")
def importance_score(spark, d):
    return driver_candidates(spark, d).select("conv_id", "turn", "memory_type", "importance")


@query("distill_topn", f"WITH RECURSIVE {CANDIDATES_SQL} SELECT conv_id, turn, memory_type, importance, rank FROM top")
def distill_topn(spark, d):
    return D.keep_important(driver_candidates(spark, d)).select("conv_id", "turn", "memory_type", "importance", F.col("rank").cast("long").alias("rank"))


@query("distill_metrics", f"""WITH RECURSIVE {CANDIDATES_SQL} SELECT count(*) AS pairs, count(*) FILTER (method = 'direct') AS direct, count(*) FILTER (sensitive) AS sensitive,
  count(*) FILTER (noise) AS noise, count(*) FILTER (importance < 0.6) AS unimportant, (SELECT count(*) FROM top) AS kept FROM s""")  # fmt: skip
def distill_metrics(spark, d):
    c = driver_candidates(spark, d)
    kept = D.keep_important(c).agg(F.count("*").alias("kept"))
    flags = c.agg(F.count("*").alias("pairs"), F.count_if(F.col("method") == "direct").alias("direct"), F.count_if("sensitive").alias("sensitive"), F.count_if("noise").alias("noise"), F.count_if(F.col("importance") < 0.6).alias("unimportant"))
    return flags.crossJoin(F.broadcast(kept))  # one row each


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE substr({x}, 1, list_max(list_filter(range(0, {n + 1}), lambda i: strlen(substr({x}, 1, i)) <= {n}))) || '…' END"


_trimmed = {c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')" for c in ("problem", "solution")}
_subject = f"regexp_replace({_trimmed['problem']}, '[?？]$', '')"
COMPRESSED = f"{_cut(_subject, 60)} || chr(10) || 'Problem: ' || {_cut(_trimmed['problem'], 160)} || chr(10) || '→ Solution: ' || {_cut(_trimmed['solution'], 200)}"


@query("compress_pairs", f"WITH RECURSIVE {PAIRS_SQL} SELECT conv_id, turn, {COMPRESSED} AS content FROM pairs")
def compress_pairs(spark, d):
    return driver_pairs(spark, d).select("conv_id", "turn", D.compress(F.col("problem"), F.col("solution")).alias("content"))


@query("conflict_keyword", f"""WITH s AS (SELECT * FROM {C.MEMORIES_SQL} WHERE id % 2 = 0), o AS (SELECT tenant_id, memory_type, trim(content) AS key, min(id) AS old_id, arg_min(confidence, id) AS c FROM s GROUP BY ALL)
  SELECT n.id, CASE WHEN o.old_id IS NULL THEN 'insert' WHEN n.confidence > o.c THEN 'replace' ELSE 'drop' END AS action, CASE WHEN n.confidence > o.c THEN o.old_id END AS old_id
  FROM (SELECT * REPLACE ('all' AS tenant_id, 'knowledge' AS memory_type) FROM {C.MEMORIES_SQL} WHERE id % 2 = 1) n
  LEFT JOIN (SELECT trim(content) AS key, min(id) AS old_id, arg_min(confidence, id) AS c FROM s GROUP BY ALL) o ON trim(n.content) = o.key""")  # fmt: skip
def conflict_keyword(spark, d):
    m = C.memories(spark, d).withColumns({"tenant_id": F.lit("all"), "memory_type": F.lit("knowledge")})
    new = m.where("id % 2 = 1").withColumnRenamed("confidence", "importance")
    return D.resolve_by_content(new, m.where("id % 2 = 0")).select("id", "action", "old_id")


@query("capacity_evict", f"""SELECT id, tenant_id, confidence FROM {C.MEMORIES_SQL} WHERE memory_type = 'knowledge'
  QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY confidence, created_at DESC, id) <= count(*) OVER (PARTITION BY tenant_id) - 5""")  # fmt: skip
def capacity_evict(spark, d):
    return D.over_capacity(C.memories(spark, d), 5).select("id", "tenant_id", "confidence")


@query("forget_expired", f"SELECT id, memory_type, expires_at FROM {C.MEMORIES_SQL} WHERE expires_at < {C.NOW}")
def forget_expired(spark, d):
    return D.expired(C.memories(spark, d), C.NOW).select("id", "memory_type", "expires_at")


@query("memory_stats", f"SELECT tenant_id, memory_type, count(*) AS n FROM {C.MEMORIES_SQL} GROUP BY ROLLUP (tenant_id, memory_type)")
def memory_stats(spark, d):
    return C.memories(spark, d).rollup("tenant_id", "memory_type").agg(F.count("*").alias("n"))


@query("feedback_apply", f"""SELECT m.id, round(greatest(0, least(1, confidence + 0.1 * coalesce(v.up, 0)))::DOUBLE, 9) AS confidence, coalesce(v.n, 0) AS n_votes
  FROM {C.MEMORIES_SQL} m LEFT JOIN (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS up, count(*) AS n FROM labels GROUP BY doc_id) v ON v.doc_id = m.id""")  # fmt: skip
def feedback_apply(spark, d):
    votes = C.Catalog(spark, d).table("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("vote"))
    return D.feedback(C.memories(spark, d), votes).select("id", "confidence", "n_votes")


@query("conversation_goal", f"SELECT conv_id, arg_min(substr(content, 1, 100), turn) AS goal FROM {MESSAGES} WHERE role = 'user' AND strlen(content) > 15 AND NOT starts_with(lower(content), 'thanks') AND NOT starts_with(content, '好的') GROUP BY conv_id")
def conversation_goal(spark, d):
    return D.goals(C.messages(spark, d))


@query("open_problems", f"""WITH m AS (SELECT *, role = 'user' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' AS a FROM {MESSAGES})
  SELECT conv_id, turn, content FROM m WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.conv_id = m.conv_id AND x.content = m.content AND x.a)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5""")  # fmt: skip
def open_problems(spark, d):
    return D.open_problems(C.messages(spark, d))


@query("knowledge_keep_first", f"""WITH k AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN substr(content, 1, 1) || '：' || content WHEN 1 THEN substr(content, 1, 1) ELSE content END AS summary FROM {MESSAGES})
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, CASE WHEN contains(summary, '：') THEN split_part(summary, '：', 1) ELSE substr(summary, 1, 40) END ORDER BY turn) = 1""")  # fmt: skip
def knowledge_keep_first(spark, d):
    first, c = F.substring("content", 1, 1), F.col("content")
    summary = F.when(F.col("turn") % 3 == 0, F.concat(first, F.lit("："), c)).when(F.col("turn") % 3 == 1, first).otherwise(c)
    return D.keep_first(C.messages(spark, d).select("conv_id", "turn", summary.alias("summary")))


@query("decisions", f"WITH RECURSIVE {PAIRS_SQL} SELECT conv_id, turn, problem AS decision, solution AS rationale, CASE WHEN contains(lower(solution), 'done') THEN 0.9 ELSE 0.7 END::DOUBLE AS importance FROM pairs WHERE contains(lower(solution), 'done') OR contains(lower(problem), 'tion')")
def decisions(spark, d):
    return D.decisions(driver_pairs(spark, d), ["done"], ["tion"])


@query("memory_ttl", f"SELECT id, expires_at - created_at AS ttl, expires_at <= {C.NOW} AS is_expired FROM {C.MEMORIES_SQL}")
def memory_ttl(spark, d):
    return C.memories(spark, d).select("id", (F.col("expires_at") - F.col("created_at")).alias("ttl"), (F.col("expires_at") <= C.NOW).alias("is_expired"))


@query("distill_run", f"""WITH RECURSIVE {CANDIDATES_SQL}, n AS (SELECT memory_type, importance, {COMPRESSED} AS content FROM top)
  SELECT memory_type, round(importance::DOUBLE, 6) AS importance, content, CASE WHEN starts_with(content, 'a') THEN 'replace' ELSE 'insert' END AS action FROM n""")  # fmt: skip
def distill_run(spark, d):
    """The whole pipeline over all conversations, twice: the first run's memories that begin with an a are a store of little
    confidence for the second one, whose actions are returned."""
    run = lambda store: D.distil(C.messages(spark, d), store, "t", C.NOW, problem=driver_problem(), question=driver_question(), types=L.DRIVER_TYPES, value_words=L.DRIVER_VALUE)
    empty = spark.createDataFrame([], "id long, tenant_id string, memory_type string, content string, confidence double, created_at long, expires_at long")
    old = run(empty)[0].where(F.col("content").startswith("a")).withColumn("confidence", F.lit(0.0)).select(empty.columns)
    return run(old)[1].select("memory_type", F.round("importance", 6).alias("importance"), "content", "action")


_two = lambda x: f"list_distinct(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2)))"


@query("containment_duplicates", f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part WHERE p_name IS NOT NULL), g AS (SELECT t, {_two('t')} AS g FROM n),
  j AS (SELECT a.t AS a, b.t AS b, least(len(a.g), len(b.g)) AS small, greatest(len(a.g), len(b.g)) AS large, len(list_intersect(a.g, b.g)) AS common FROM g a JOIN g b ON a.t < b.t)
  SELECT a, b, round(common / small::DOUBLE, 6) AS similarity FROM j WHERE small > 0 AND small / large::DOUBLE >= 0.5 AND common / small::DOUBLE >= 0.8""")  # fmt: skip
def containment_duplicates(spark, d):
    return D.contained_pairs(C.Catalog(spark, d).table("part"), "p_name", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


_ends = " OR ".join(f"ends_with(w, '{e}')" for e in L.FILE_ENDINGS)


@query("file_names", f"""SELECT conv_id, turn, CAST(len(list_distinct(list_filter(list_transform(string_split_regex(content, '[\\s，。、？?）(),;]+'), lambda w: regexp_replace(w, '[^A-Za-z0-9._/\\-]', '', 'g')), lambda w: length(w) >= 4 AND ({_ends})))) AS INT) AS n_files
  FROM (SELECT conv_id, turn, text || ' see src/a' || (turn % 3) || '.rs, b' || conv_id % 5 || '.py and src/a1.rs' AS content FROM conversations)""")  # fmt: skip
def file_mentions(spark, d):
    """The driver's messages name no files, so each gets three names, of which some are equal."""
    named = F.concat("content", F.lit(" see src/a"), (F.col("turn") % 3).cast("string"), F.lit(".rs, b"), (F.col("conv_id") % 5).cast("string"), F.lit(".py and src/a1.rs"))
    return C.messages(spark, d).withColumn("content", named).select("conv_id", "turn", F.size(file_names(F.col("content"))).alias("n_files"))
