"""Cognition: observations, facts, and the state folded from facts.

Facts have id, entity_id, fact_type, time, created_at and payload (JSON). The order of facts is time, created_at, id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.lexicons import DONE, KEYS, RESTATEMENTS

ORDER = ("time", "created_at", "id")

THEME_LIMIT = 20


def observations(messages: DataFrame, markers: Sequence[tuple[str, str]], negations: Sequence[str] = (), doubts: Sequence[str] = ()) -> DataFrame:
    """User messages by marker, as written: conv_id, turn, action, marker, offset (bytes), negated, uncertain, content.

    One row for each action of a message, by its first marker in list order.
    """
    from engram.functions.text import any_of

    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("marker"), F.lit(a).alias("action")) for i, (m, a) in enumerate(markers)]), lambda s: F.contains("content", s["marker"]))
    found = messages.where("role = 'user'").select("conv_id", "turn", "content", F.explode(hits).alias("h"))
    first = found.groupBy("conv_id", "turn", "content", F.col("h.action").alias("action")).agg(F.min_by("h.marker", "h.no").alias("marker"))
    offset = F.octet_length(F.expr("substring(content, 1, instr(content, marker) - 1)"))
    return first.select("conv_id", "turn", "action", "marker", offset.alias("offset"), any_of(F.col("content"), negations).alias("negated"), any_of(F.col("content"), doubts).alias("uncertain"), "content")


def fact_type_of(action: Column) -> Column:
    return F.when(action == "feel", "emotion").when(action.isin("plan", "want"), "goal").when(action.isin("love", "like", "喜欢"), "preference").otherwise("event")


def facts_of(obs: DataFrame, subject: Column) -> DataFrame:
    """Observations that aren't negated as facts about a subject (an id other than 0): payload with content and evidence."""
    payload = F.to_json(F.struct(F.col("action"), F.col("content"), F.col("uncertain"), F.struct(F.col("offset"), F.octet_length("marker").alias("length"), F.col("marker").alias("text")).alias("evidence")))
    out = obs.where(~F.col("negated")).select(subject.cast("long").alias("entity_id"), fact_type_of(F.col("action")).alias("fact_type"), F.col("turn").alias("time"), payload.alias("payload"), "conv_id", "turn", "action")
    return out.where("entity_id <> 0")


def with_user_message(messages: DataFrame) -> DataFrame:
    """messages with user_message, the nearest earlier user message of the conversation, by turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("user_message", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))


def restatements(messages: DataFrame, markers: Sequence[tuple[str, str]] = RESTATEMENTS) -> DataFrame:
    """Assistant messages that restate the user: conv_id, turn, marker, fact_type, confidence, content, user_message.

    One row for each marker in the lower-case text; user_message is the nearest earlier user message, looked up here
    unless the messages have it already.
    """
    m = messages if "user_message" in messages.columns else with_user_message(messages)
    m = m.where("role = 'assistant'")
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("marker"), F.lit(t).alias("fact_type")) for k, t in markers]), lambda s: F.contains(F.lower("content"), s["marker"]))
    return m.select("conv_id", "turn", F.explode(hits).alias("h"), F.lit(0.5).alias("confidence"), "content", "user_message").select("conv_id", "turn", "h.marker", "h.fact_type", "confidence", "content", "user_message")


def completions(messages: DataFrame, words: Sequence[str] = DONE) -> DataFrame:
    """Assistant messages that say something is completed: the agent's events."""
    from engram.functions.text import any_of

    return messages.where((F.col("role") == "assistant") & any_of(F.lower("content"), words)).select("conv_id", "turn", F.lit("completed").alias("action"), "content")


def tool_events(messages: DataFrame) -> DataFrame:
    """Tool calls with the status of the first result before the next assistant message: conv_id, turn, tool, status."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    result = F.first(F.when(F.col("tool_call_id").isNotNull(), F.struct("turn", "content")), ignorenulls=True).over(w)
    stop = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)
    m = messages.withColumns({"result": result, "stop": stop}).where("tool_name is not null")
    answered = F.col("result").isNotNull() & (F.col("stop").isNull() | (F.col("result.turn") < F.col("stop")))
    return m.select("conv_id", "turn", F.col("tool_name").alias("tool"), F.when(~answered, "timeout").when(F.lower("result.content").rlike("error|failed"), "error").otherwise("ok").alias("status"))


def channels(messages: DataFrame, markers: Sequence[tuple[str, str]], restate: Sequence[tuple[str, str]] = RESTATEMENTS, done: Sequence[str] = DONE) -> DataFrame:
    """User, agent and derived facts in one table: channel, conv_id, turn, fact_type, content."""
    user = facts_of(observations(messages, markers), F.lit(1)).select(F.lit("user").alias("channel"), "conv_id", "turn", "fact_type", F.get_json_object("payload", "$.content").alias("content"))
    agent = completions(messages, done).select(F.lit("agent").alias("channel"), "conv_id", "turn", F.lit("event").alias("fact_type"), "content")
    derived = restatements(messages, restate).select(F.lit("derived").alias("channel"), "conv_id", "turn", "fact_type", "content")
    return user.unionByName(agent).unionByName(derived)


def _is_string(payload: Column, key: str) -> Column:
    """The payload's value under a key where it is a JSON string, else null."""
    v = F.parse_json(payload)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.get_json_object(payload, f"$.{key}"))


def latest_by_key(facts: DataFrame, keys: dict[str, list[str]] = KEYS) -> DataFrame:
    """The newest fact of each entity, type and semantic key; a fact without a string under any key counts by its payload."""
    per = F.lit(None).cast("string")
    for kind, names in keys.items():
        per = F.when(F.col("fact_type") == kind, F.coalesce(*[_is_string(F.col("payload"), n) for n in names], F.col("payload"))).otherwise(per)
    f = facts.where(F.col("fact_type").isin(list(keys))).withColumn("key", per)
    w = Window.partitionBy("entity_id", "fact_type", "key").orderBy(*[F.desc(c) for c in ORDER])
    return f.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def recent(facts: DataFrame, kind: str = "event", n: int = 20) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(*[F.desc(c) for c in ORDER])
    return facts.where(F.col("fact_type") == kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def emotion_trends(facts: DataFrame, dimension: str = "dimension", trend: str = "trend") -> DataFrame:
    """The last trend of each emotion dimension of an entity; general where a fact has none, stable where it has no trend."""
    e = facts.where("fact_type = 'emotion'")
    d, t = F.coalesce(F.get_json_object("payload", f"$.{dimension}"), F.lit("general")), F.coalesce(F.get_json_object("payload", f"$.{trend}"), F.lit("stable"))
    return e.groupBy("entity_id", d.alias("dimension")).agg(F.max_by(t, F.struct(*ORDER)).alias("trend"))


def profile(facts: DataFrame, kinds: Sequence[str] = ("preference", "goal", "identity", "emotion")) -> DataFrame:
    """Per entity: sorted different contents of each kind, and the number of facts of other kinds."""
    c = F.get_json_object("payload", "$.content")
    aggs = [F.array_sort(F.collect_set(F.when(F.col("fact_type") == k, c))).alias(k) for k in kinds]
    return facts.groupBy("entity_id").agg(*aggs, F.count_if(~F.col("fact_type").isin(list(kinds))).alias("others"))


def themes(messages: DataFrame, n: int = THEME_LIMIT, stop: str = "") -> DataFrame:
    """Pairs of letters that recur in a conversation: conv_id, keyword, occurrences (different turns, 2 at least); top n.

    Pairs with an ASCII letter, a character that is no letter or digit, or one of stop don't count.
    """
    from engram.functions.text import bigrams

    own = F.filter(F.array_distinct(bigrams(F.col("content"))), lambda g: g.rlike(r"^[\p{L}\p{N}&&[^A-Za-z]]{2}$") & (~g.rlike(f"[{stop}]") if stop else F.lit(True)))
    g = messages.select("conv_id", "turn", F.explode(own).alias("keyword")).groupBy("conv_id", "keyword").agg(F.countDistinct("turn").alias("occurrences")).where("occurrences >= 2")
    w = Window.partitionBy("conv_id").orderBy(F.desc("occurrences"), "keyword")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def snapshot(facts: DataFrame, n: int = 20) -> DataFrame:
    """An entity's newest facts, newest first: entity_id, rank, fact_type, time, payload."""
    w = Window.partitionBy("entity_id").orderBy(*[F.desc(c) for c in ORDER])
    return facts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("entity_id", "rank", "fact_type", "time", "payload")


def resolve_or_create(new: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids for (tenant_id, name, entity_type, external_key): those of entities by external key, else by name and type,
    else a hash of tenant and key or name and type, the same in every run."""
    by_key = entities.where("external_key is not null").groupBy("tenant_id", "external_key").agg(F.min("id").alias("k_id"))
    by_name = entities.groupBy("tenant_id", "name", "entity_type").agg(F.min("id").alias("n_id"))
    j = new.join(by_key, ["tenant_id", "external_key"], "left").join(by_name, ["tenant_id", "name", "entity_type"], "left")
    fresh = F.xxhash64("tenant_id", F.coalesce("external_key", F.concat_ws("/", "name", "entity_type")))
    found = F.when(F.col("external_key").isNotNull(), F.col("k_id")).otherwise(F.col("n_id"))
    return j.select(*new.columns, F.coalesce(found, fresh).alias("entity_id"), found.isNull().alias("created"))


def uncovered(messages: DataFrame, facts: DataFrame, evidence: str = "$.content") -> DataFrame:
    """Messages whose text is of no fact the evidence, which is found in its payload under that path."""
    seen = facts.select(F.get_json_object("payload", evidence).alias("content")).distinct()
    return messages.join(seen, "content", "left_anti")


def fuse(messages: DataFrame, valuable: DataFrame, markers: Sequence[tuple[str, str]], negations: Sequence[str] = (), subject: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of all messages, the high-value messages that no fact covers, and what each conversation gives.

    valuable has conv_id, turn, category of the messages worth keeping (retrieval.classify_by_anchor finds them). Facts are
    conv_id, turn, fact_type, payload. Items are conv_id, turn, category, content: kept as they are, unless their whole
    text is the content a fact of the same conversation stands on. The summary has a row for each conversation: conv_id,
    messages, high_value, facts, raw_items, by_category (category to count, of all high-value ones). Null texts are no
    evidence and aren't covered; messages that repeat a conversation and turn count each.
    """
    facts = facts_of(observations(messages, markers, negations), F.lit(1) if subject is None else subject).select("conv_id", "turn", "fact_type", "payload")
    high = messages.join(valuable.select("conv_id", "turn", "category"), ["conv_id", "turn"]).select("conv_id", "turn", "category", "content")
    seen = facts.select("conv_id", F.get_json_object("payload", "$.content").alias("content")).distinct()
    items = high.join(seen, ["conv_id", "content"], "left_anti").select("conv_id", "turn", "category", "content")
    n = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    kinds = high.groupBy("conv_id", "category").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    out = n(messages, "messages")
    for part in (n(high, "high_value"), n(facts, "facts"), n(items, "raw_items")):
        out = out.join(part, "conv_id", "left")
    out = out.join(kinds, "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("high_value", "facts", "raw_items")})
    return facts, items, out
