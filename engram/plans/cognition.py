"""Queries of cognition, persona, relationship and decay, over conversations and over events as facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.functions import lexicons as L
from engram.functions.vectors import clamped_cosine
from engram.operators import cognition as K
from engram.operators import persona as P
from engram.plans.distill import MESSAGES
from engram.plans.registry import contains_sql, query
from engram.plans.retrieval import COS, VEC, vectors


def facts(spark, d):
    return P.with_payload(C.facts(spark, d))


_marks = ", ".join(f"({i}, '{m}', '{a}')" for i, (m, a) in enumerate(L.DRIVER_MARKERS))
OBS = f"""(SELECT conv_id, turn, content, action, arg_min(marker, no) AS marker FROM {MESSAGES} JOIN (VALUES {_marks}) k(no, marker, action) ON role = 'user' AND contains(content, marker) GROUP BY conv_id, turn, content, action)"""
TYPE = "CASE WHEN action = 'feel' THEN 'emotion' WHEN action IN ('plan', 'want') THEN 'goal' WHEN action IN ('love', 'like', '喜欢') THEN 'preference' ELSE 'event' END"


@query("observations", f"SELECT conv_id, turn, action, marker, CAST(strlen(split_part(content, marker, 1)) AS INT) AS \"offset\", contains(content, 'onti') AS negated FROM {OBS}")
def observations(spark, d):
    return K.observations(C.messages(spark, d), L.DRIVER_MARKERS, ["onti"]).select("conv_id", "turn", "action", "marker", "offset", "negated")


@query("facts_from_observations", f"SELECT CAST(1 AS BIGINT) AS entity_id, conv_id, turn, {TYPE} AS fact_type, content FROM {OBS} WHERE NOT contains(content, 'onti')")
def facts_from_observations(spark, d):
    f = K.facts_of(K.observations(C.messages(spark, d), L.DRIVER_MARKERS, ["onti"]), F.lit(1))
    return f.select("entity_id", "conv_id", "turn", "fact_type", F.get_json_object("payload", "$.content").alias("content"))


RESTATE = [("tion", "preference"), ("with", "goal")]
_derived = "SELECT conv_id, turn, marker, fact_type, content FROM {} JOIN (VALUES ('tion', 'preference'), ('with', 'goal')) k(marker, fact_type) ON role = 'assistant' AND contains(lower(content), marker)".format(MESSAGES)


@query("derived_restatements", f"SELECT conv_id, turn, marker, fact_type, 0.5::DOUBLE AS confidence, u AS user_message FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM {MESSAGES}) JOIN (VALUES ('tion', 'preference'), ('with', 'goal')) k(marker, fact_type) ON role = 'assistant' AND contains(lower(content), marker)")
def derived_restatements(spark, d):
    return K.restatements(C.messages(spark, d), RESTATE).drop("content")


@query("facts_three_channel", f"""SELECT 'user' AS channel, conv_id, turn, {TYPE} AS fact_type, content FROM {OBS} UNION ALL
  SELECT 'agent', conv_id, turn, 'event', content FROM {MESSAGES} WHERE role = 'assistant' AND contains(lower(content), 'done') UNION ALL SELECT 'derived', conv_id, turn, fact_type, content FROM ({_derived})""")  # fmt: skip
def facts_three_channel(spark, d):
    return three_channels(C.messages(spark, d))


def three_channels(messages):
    return K.channels(messages, L.DRIVER_MARKERS, RESTATE, ["done"])


#: Every third turn counts as valuable, in one of two categories.
_VALUABLE = f"(SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM {MESSAGES} WHERE (conv_id + turn) % 3 = 0)"


@query("value_fusion", f"""WITH f AS (SELECT conv_id, turn, content FROM {OBS} WHERE NOT contains(content, 'onti')), h AS (SELECT m.conv_id, m.turn, category, content FROM {MESSAGES} m JOIN {_VALUABLE} v ON v.conv_id = m.conv_id AND v.turn = m.turn),
  i AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = h.conv_id AND f.content = h.content))
  SELECT c.conv_id, c.n AS messages, (SELECT count(*) FROM h WHERE h.conv_id = c.conv_id) AS high_value, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id) AS facts, (SELECT count(*) FROM i WHERE i.conv_id = c.conv_id) AS raw_items,
    (SELECT count(*) FROM h WHERE h.conv_id = c.conv_id AND category = 'even') AS even, coalesce((SELECT md5(string_agg(content, '|' ORDER BY turn)) FROM i WHERE i.conv_id = c.conv_id), '') AS items FROM (SELECT conv_id, count(*) AS n FROM {MESSAGES} GROUP BY conv_id) c""")  # fmt: skip
def value_fusion(spark, d):
    m = C.messages(spark, d)
    valuable = m.where("(conv_id + turn) % 3 = 0").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("category"))
    _, items, summary = K.fuse(m, valuable, L.DRIVER_MARKERS, ["onti"])
    texts = items.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("t"))
    texts = texts.select("conv_id", F.md5(F.array_join(F.transform("t", lambda s: s["content"]), "|")).alias("items"))
    out = summary.join(texts, "conv_id", "left").withColumn("even", F.coalesce(F.try_element_at("by_category", F.lit("even")), F.lit(0).cast("long")))
    return out.select("conv_id", "messages", "high_value", "facts", "raw_items", "even", F.coalesce("items", F.lit("")).alias("items"))


LATEST = "time DESC, id DESC"


@query("state_latest_per_key", f"SELECT id, entity_id, fact_type, CASE WHEN fact_type = 'preference' THEN coalesce(topic, content) ELSE content END AS key FROM {C.FACTS_SQL} WHERE fact_type IN ('preference', 'identity') QUALIFY row_number() OVER (PARTITION BY entity_id, fact_type, key ORDER BY {LATEST}) = 1")
def state_latest_per_key(spark, d):
    return K.latest_by_key(C.facts(spark, d)).select("id", "entity_id", "fact_type", "key")


@query("recent_events", f"SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY {LATEST}) AS rank FROM {C.FACTS_SQL} WHERE fact_type = 'habit' QUALIFY rank <= 20")
def recent_events(spark, d):
    return K.recent(C.facts(spark, d), "habit").select("id", "entity_id", F.col("rank").cast("long").alias("rank"))


@query("emotion_trend", f"SELECT entity_id, coalesce(topic, 'general') AS dimension, arg_max(content, struct_pack(time, id)) AS trend FROM {C.FACTS_SQL} WHERE fact_type = 'emotion' GROUP BY 1, 2")
def emotion_trend(spark, d):
    return K.emotion_trends(C.facts(spark, d), "topic", "content")


@query("user_profile", f"SELECT entity_id, array_to_string(list_sort(list_distinct(list(content) FILTER (fact_type = 'preference'))), ';') AS preference, count(*) FILTER (fact_type NOT IN ('preference', 'goal', 'identity', 'emotion')) AS others FROM {C.FACTS_SQL} GROUP BY entity_id HAVING count(*) FILTER (fact_type = 'preference') > 0")
def user_profile(spark, d):
    return K.profile(C.facts(spark, d)).where(F.size("preference") > 0).select("entity_id", F.array_join("preference", ";").alias("preference"), "others")


@query("entity_snapshot", f"SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY {LATEST}) AS rank, fact_type, time FROM {C.FACTS_SQL} QUALIFY rank <= 20")
def entity_snapshot(spark, d):
    return K.snapshot(C.facts(spark, d)).select("entity_id", F.col("rank").cast("long").alias("rank"), "fact_type", "time")


@query("repeated_themes", rf"""WITH g AS (SELECT conv_id, turn, unnest(list_distinct(list_transform(range(1, length(content)), lambda i: substr(content, i, 2)))) AS k FROM {MESSAGES} WHERE length(content) >= 2),
  n AS (SELECT conv_id, k AS keyword, count(DISTINCT turn) AS occurrences FROM g WHERE regexp_full_match(k, '[\p{{L}}\p{{N}}]{{2}}') AND NOT regexp_matches(k, '[A-Za-z]') GROUP BY conv_id, k HAVING occurrences >= 2)
  SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY occurrences DESC, keyword) <= 20""")  # fmt: skip
def repeated_themes(spark, d):
    return K.themes(C.messages(spark, d))


@query("fact_timeline", f"SELECT id, entity_id, fact_type, time FROM {C.FACTS_SQL} WHERE entity_id = 7 AND fact_type = 'preference'")
def fact_timeline(spark, d):
    return C.facts(spark, d).where("entity_id = 7 and fact_type = 'preference'").select("id", "entity_id", "fact_type", "time").orderBy("time", "id")


NOW = C.BASE + 200 * 86400
_late = f"greatest({NOW} - time - 7776000, 0) / 3888000.0::DOUBLE"
_time = f"(CASE WHEN {NOW} - time <= 7776000 THEN 1 ELSE 1 - (1 - pow(0.5, {_late})) * 0.5 END)"
_imp = "(CASE WHEN importance >= 0.3 THEN 1 ELSE 1 - (1 - importance / 0.3) * 0.5 END)"
_acc = "(CASE WHEN access_count >= 5 THEN 1 ELSE 1 - (1 - access_count / 5.0) * 0.5 END)"
for _name, _w in {"time": _time, "importance": _imp, "access": _acc, "hybrid": f"{_time} * {_imp} * {_acc}"}.items():

    def _decay(spark, d, strategy=_name):
        return P.decayed(facts(spark, d), NOW, strategy).select("id", F.round("weight", 6).alias("weight"), "archived")

    _sql = f"SELECT id, round(round((CASE WHEN persona THEN 1 ELSE {_w} END)::DOUBLE, 9), 6) AS weight, round((CASE WHEN persona THEN 1 ELSE {_w} END)::DOUBLE, 9) < 1 AS archived FROM {C.FACTS_SQL}"
    query(f"decay_{_name}", _sql)(_decay)


@query("decay_pass_stats", f"SELECT count(*) AS scanned, count(*) FILTER (w < 1) AS archived, count(*) FILTER (w >= 1) AS kept, count(*) FILTER (persona) AS protected FROM (SELECT persona, round((CASE WHEN persona THEN 1 ELSE {_time} * {_imp} * {_acc} END)::DOUBLE, 9) AS w FROM {C.FACTS_SQL})")
def decay_pass_stats(spark, d):
    return P.decay_stats(P.decayed(facts(spark, d), NOW))


_step = "CASE WHEN role = 'user' THEN 0.02 ELSE 0.01 END::DOUBLE"
_move = f"sum(CASE WHEN {contains_sql('content', ['tion', 'that'])} THEN {_step} ELSE 0 END - CASE WHEN {contains_sql('content', ['with'])} THEN {_step} ELSE 0 END)"


@query("relationship_update", f"SELECT conv_id, intimacy, CASE WHEN intimacy < 0.2 THEN 'stranger' WHEN intimacy < 0.5 THEN 'acquaintance' WHEN intimacy < 0.8 THEN 'companion' ELSE 'partner' END AS stage, CASE WHEN intimacy > old THEN 'rising' WHEN intimacy < old THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT conv_id, old, round(greatest(0, least(1, old + m))::DOUBLE, 9) AS intimacy FROM (SELECT conv_id, conv_id % 10 / 10.0::DOUBLE AS old, {_move} AS m FROM {MESSAGES} GROUP BY conv_id))")
def relationship_update(spark, d):
    m = C.messages(spark, d)
    state = m.select("conv_id", (F.col("conv_id") % 10 / 10.0).alias("intimacy")).distinct()
    return P.relationship(m, state, ["tion", "that"], ["with"])


@query("relationship_query", f"SELECT c.id AS conv_id, CASE WHEN m.conv_id IS NULL THEN 'stranger' ELSE 'known' END AS state FROM (SELECT unnest(range(0, 400)) AS id) c LEFT JOIN (SELECT DISTINCT conv_id FROM {MESSAGES}) m ON m.conv_id = c.id")
def relationship_query(spark, d):
    known = C.messages(spark, d).select("conv_id", F.lit("known").alias("state")).distinct()
    return spark.range(400).withColumnRenamed("id", "conv_id").join(known, "conv_id", "left").select("conv_id", F.coalesce("state", F.lit("stranger")).alias("state"))


@query("speaker_attribution", f"SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'user' END AS speaker FROM {MESSAGES}")
def speaker_attribution(spark, d):
    return C.messages(spark, d).select("conv_id", "turn", P.speaker(F.col("role")).alias("speaker"))


@query("persona_card", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY entity_id, fact_type ORDER BY time, id) AS r FROM {C.FACTS_SQL} WHERE persona)
  SELECT entity_id, arg_min(content, struct_pack(negated, time, id)) FILTER (fact_type = 'identity') AS identity,
    coalesce(string_agg(content, ';' ORDER BY r) FILTER (fact_type = 'preference' AND r <= 5), '') AS preference, coalesce(string_agg(content, ';' ORDER BY r) FILTER (fact_type = 'emotion' AND r <= 5), '') AS emotion FROM p GROUP BY entity_id""")  # fmt: skip
def persona_card(spark, d):
    return P.cards(facts(spark, d)).select("entity_id", "identity", F.array_join("preference", ";").alias("preference"), F.array_join("emotion", ";").alias("emotion"))


_pairs = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
_shared = f"len(list_filter({_pairs.format('f.content')}, lambda g: list_contains({_pairs.format('s.content')}, g)))"


@query("persona_check_keyword", f"""WITH f AS (SELECT * FROM {C.FACTS_SQL} WHERE persona AND id % 10 <> 0), s AS (SELECT * REPLACE (substr(content, 7) AS content) FROM {C.FACTS_SQL} WHERE id % 10 = 0),
  j AS (SELECT s.id AS signal_id, f.id, f.negated <> s.negated AS other, {_shared} AS n FROM s LEFT JOIN f ON s.entity_id = f.entity_id AND s.fact_type = f.fact_type),
  g AS (SELECT signal_id, max(n) FILTER (NOT other) AS same, arg_max(id, (n, -id)) FILTER (other AND n >= 1) AS fact_id FROM j GROUP BY signal_id)
  SELECT signal_id, CASE WHEN same >= 1 THEN 'consistent' WHEN fact_id IS NOT NULL THEN 'conflict' ELSE 'drift' END AS verdict, CASE WHEN same >= 1 THEN NULL ELSE fact_id END AS fact_id FROM g""")  # fmt: skip
def persona_check_keyword(spark, d):
    f = facts(spark, d)
    signals = f.where("id % 10 = 0").select(F.col("id").alias("signal_id"), "entity_id", "fact_type", F.substring("content", 7, 100).alias("text"), "negated")
    return P.check(signals, f.where("id % 10 <> 0"))


@query("persona_check_semantic", f"""WITH j AS (SELECT a.id AS signal_id, b.id, (a.id % 4 >= 2) <> (b.id % 4 >= 2) AS other, round(greatest(0, least(1, {COS}))::DOUBLE, 9) AS s FROM {VEC} a LEFT JOIN {VEC} b ON a.label = b.label AND b.id % 20 <> 0 WHERE a.id % 20 = 0),
  g AS (SELECT signal_id, max(s) FILTER (NOT other) AS same, arg_max(id, (s, -id)) FILTER (other AND s >= 0.2) AS fact_id FROM j GROUP BY signal_id)
  SELECT signal_id, CASE WHEN same >= 0.3 THEN 'consistent' WHEN fact_id IS NOT NULL THEN 'conflict' ELSE 'drift' END AS verdict, CASE WHEN same >= 0.3 THEN NULL ELSE fact_id END AS fact_id FROM g""")  # fmt: skip
def persona_check_semantic(spark, d):
    signals, stored = _signals(spark, d)
    return P.check_semantic(signals, stored, 0.3, 0.2)


def _signals(spark, d):
    """Every twentieth vector as a signal against the others as facts of their label."""
    v = vectors(spark, d).select("id", F.lit(0).alias("entity_id"), F.col("label").cast("string").alias("fact_type"), "vector", (F.col("id") % 4 >= 2).alias("negated"))
    return v.where("id % 20 = 0").withColumnRenamed("id", "signal_id"), v.where("id % 20 <> 0")


@query("reconcile", f"""WITH j AS (SELECT a.id AS candidate_id, b.id, (a.id % 4 >= 2) <> (b.id % 4 >= 2) AS other, round(greatest(0, least(1, {COS}))::DOUBLE, 9) AS s FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND b.id % 20 <> 0 WHERE a.id % 20 = 0),
  g AS (SELECT candidate_id, max(s) FILTER (other AND s >= 0.3) AS t, arg_max(id, (s, -id)) FILTER (other AND s >= 0.3) AS f, max(s) FILTER (NOT other AND s >= 0.2) AS dup FROM j GROUP BY candidate_id)
  SELECT candidate_id, CASE WHEN t IS NOT NULL THEN 'add_with_transition' WHEN dup IS NOT NULL THEN 'noop' ELSE 'add' END AS decision, f AS transition_from, round(coalesce(t, dup, 0)::DOUBLE, 6) AS similarity FROM g""")  # fmt: skip
def reconcile(spark, d):
    candidates, stored = _signals(spark, d)
    return P.reconcile_semantic(candidates, stored, 0.3, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("evolution_milestones", f"""WITH f AS (SELECT *, lag(negated) OVER t AS old, lag(content) OVER t AS before, row_number() OVER t = 1 AS first, time - lag(time) OVER e > 50000 AS late FROM {C.FACTS_SQL}
    WINDOW t AS (PARTITION BY entity_id, fact_type ORDER BY time, id), e AS (PARTITION BY entity_id ORDER BY time, id))
  SELECT entity_id, id, time, 'stance_flip' AS milestone FROM f WHERE old <> negated AND {_shared.replace('s.content', 'before').replace('f.content', 'content')} >= 2
  UNION ALL SELECT entity_id, id, time, 'new_theme' FROM f WHERE first UNION ALL SELECT entity_id, id, time, 'large_gap' FROM f WHERE late""")  # fmt: skip
def evolution_milestones(spark, d):
    return P.milestones(facts(spark, d), 50_000)


@query("timeline_start_current", f"SELECT entity_id, arg_min(id, struct_pack(p := CASE WHEN fact_type = 'identity' THEN 0 WHEN persona THEN 1 ELSE 2 END, time, id)) AS start_id, arg_max(id, struct_pack(p := CAST(persona AS INT), time, id)) AS current_id FROM {C.FACTS_SQL} GROUP BY entity_id")
def timeline_start_current(spark, d):
    return P.start_and_current(facts(spark, d))
