"""Persona: signals against stored facts, reconciliation, evolution, cards; relationship state; decay of facts.

Facts carry content, negated, persona (are they the agent's own) beside id, entity_id, fact_type, time, created_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicons as L
from engram.functions.scores import decay_access, decay_importance, decay_time, stage, trend
from engram.functions.text import any_of, shared_bigrams
from engram.operators.cognition import ORDER


def with_payload(facts: DataFrame) -> DataFrame:
    """facts with the payload's fields as columns."""
    g = lambda k: F.get_json_object("payload", f"$.{k}")
    return facts.withColumns({"content": g("content"), "negated": g("negated").cast("boolean"), "persona": F.coalesce(g("attribution") == "agent_personality", F.lit(False)), "importance": F.coalesce(g("importance").cast("double"), F.lit(0.5)), "access_count": F.coalesce(g("access_count").cast("int"), F.lit(0))})


def keyword_signals(text: Column, markers: Sequence[tuple[str, str, bool]] = L.PERSONA_MARKERS) -> Column:
    """(marker, fact_type, negated) of the longest marker in the text by bytes, the first of equals; null if there is none."""
    rows = F.array(*[F.struct(F.lit(-len(m.encode())).alias("o"), F.lit(i).alias("i"), F.lit(m).alias("marker"), F.lit(t).alias("fact_type"), F.lit(n).alias("negated")) for i, (m, t, n) in enumerate(markers)])
    best = F.array_min(F.filter(rows, lambda r: F.contains(text, r["marker"])))
    return F.when(best.isNotNull(), F.struct(best["marker"].alias("marker"), best["fact_type"].alias("fact_type"), best["negated"].alias("negated")))


def check(signals: DataFrame, facts: DataFrame, similar: Column | None = None, match: float = 1.0, conflict: float = 1.0) -> DataFrame:
    """Signals (signal_id, entity_id, fact_type, text, negated) against an entity's persona facts of the same type.

    consistent: one of the same polarity is similar; else conflict: one of the other is, the most similar; else drift.
    similar is over columns text and content (default: shared letter pairs, with repeats).
    """
    similar = shared_bigrams(F.col("text"), F.col("content")).cast("double") if similar is None else similar
    f = facts.where("persona and coalesce(content, '') <> ''").select("entity_id", "fact_type", F.col("id").alias("fact_id"), "content", F.coalesce("negated", F.lit(False)).alias("stored_negated"))
    j = signals.join(f, ["entity_id", "fact_type"], "left").withColumn("s", similar)
    other = F.col("stored_negated") != F.col("negated")
    out = j.groupBy("signal_id").agg(
        F.max(F.when(~other, F.col("s"))).alias("same"),
        F.max(F.when(other & (F.col("s") >= conflict), F.col("s"))).alias("against"),
        F.max_by("fact_id", F.when(other & (F.col("s") >= conflict), F.struct("s", (-F.col("fact_id")).alias("x")))).alias("fact_id"),
    )
    verdict = F.when(F.col("same") >= match, "consistent").when(F.col("against").isNotNull(), "conflict").otherwise("drift")
    return out.select("signal_id", verdict.alias("verdict"), F.when(verdict == "conflict", F.col("fact_id")).alias("fact_id"))


def reconcile(pairs: DataFrame, conflict: float = 0.75, dedup: float = 0.95) -> DataFrame:
    """pairs has candidate_id, candidate_negated and each existing fact's fact_id, fact_negated, similarity. One row a
    candidate: transition (from the most similar fact of known, other polarity), else noop, else add."""
    differs = F.coalesce(F.col("candidate_negated") != F.col("fact_negated"), F.lit(False))
    flip = F.when(differs & (F.col("similarity") >= conflict), F.struct("similarity", (-F.col("fact_id")).alias("x")))
    g = pairs.groupBy("candidate_id").agg(F.max(flip).alias("flip"), F.max(F.when(~differs & (F.col("similarity") >= dedup), F.col("similarity"))).alias("dup"))
    decision = F.when(F.col("flip").isNotNull(), "add_with_transition").when(F.col("dup").isNotNull(), "noop").otherwise("add")
    return g.select("candidate_id", decision.alias("decision"), (-F.col("flip.x")).alias("transition_from"), F.coalesce("flip.similarity", "dup", F.lit(0.0)).alias("similarity"))


def nearest_facts(signals: DataFrame, facts: DataFrame) -> DataFrame:
    """(signal_id, same, same_id, other, other_id): the similarity and id of the nearest fact of a signal's polarity and of the
    nearest of the other, among those of its entity and type; null where there is none, the smallest id of equals.

    signals has signal_id, entity_id, fact_type, vector, negated (null counts as false), facts the same with id. Signals meet
    the facts of their entity, type and polarity in blocks, of which a task compares one pair as matrices: no pair is a row.
    """
    from engram.operators.retrieval import nearest_in_cells

    cell = lambda negated: F.concat_ws("\x01", F.col("entity_id").cast("string"), "fact_type", negated.cast("string"))
    own = F.coalesce("negated", F.lit(False))
    ways = signals.select("signal_id", "entity_id", "fact_type", "vector", own.alias("negated"), F.explode(F.array(F.lit(False), F.lit(True))).alias("flipped"))
    q = ways.select((F.col("signal_id") * 2 + F.col("flipped").cast("long")).alias("query_id"), F.col("vector").alias("q"), cell(F.col("negated") != F.col("flipped")).alias("cell"))
    near = nearest_in_cells(q, facts.select("id", "vector", cell(own).alias("cell")), 1)
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("distance"))), 9)
    flipped = F.pmod("query_id", F.lit(2)) == 1
    pick = lambda c, where: F.max(F.when(where, c))
    met = near.groupBy(F.floor(F.col("query_id") / 2).alias("signal_id")).agg(pick(clamped, ~flipped).alias("same"), pick(F.col("id"), ~flipped).alias("same_id"), pick(clamped, flipped).alias("other"), pick(F.col("id"), flipped).alias("other_id"))
    return signals.select("signal_id").join(met, "signal_id", "left")


def check_semantic(signals: DataFrame, facts: DataFrame, match: float = 0.75, conflict: float = 0.75) -> DataFrame:
    """check() by vectors: signal_id, verdict, fact_id (of a conflict). See nearest_facts."""
    near = nearest_facts(signals, facts)
    verdict = F.when(F.col("same") >= match, "consistent").when(F.col("other") >= conflict, "conflict").otherwise("drift")
    return near.select("signal_id", verdict.alias("verdict"), F.when(verdict == "conflict", F.col("other_id")).alias("fact_id"))


def reconcile_semantic(candidates: DataFrame, facts: DataFrame, conflict: float = 0.75, dedup: float = 0.95) -> DataFrame:
    """reconcile() of candidates by their nearest facts only: candidate_id, decision, transition_from, similarity. Both tables
    are as in nearest_facts."""
    near = nearest_facts(candidates, facts)
    flips, known = F.coalesce(F.col("other") >= conflict, F.lit(False)), F.coalesce(F.col("same") >= dedup, F.lit(False))
    decision = F.when(flips, "add_with_transition").when(known, "noop").otherwise("add")
    return near.select(F.col("signal_id").alias("candidate_id"), decision.alias("decision"), F.when(flips, F.col("other_id")).alias("transition_from"), F.when(flips, F.col("other")).when(known, F.col("same")).otherwise(0.0).alias("similarity"))


def milestones(facts: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """Stance flips, new themes and large gaps of an entity's facts in order: entity_id, id, time, milestone."""
    w = Window.partitionBy("entity_id").orderBy(*ORDER)
    per_type = Window.partitionBy("entity_id", "fact_type", F.col("negated").isNull()).orderBy(*ORDER)
    first = F.row_number().over(Window.partitionBy("entity_id", "fact_type").orderBy(*ORDER)) == 1
    f = facts.withColumns({"old": F.lag("negated").over(per_type), "before": F.lag("content").over(per_type), "first": first, "late": F.col("time") - F.lag("time").over(w) > gap})
    flip = F.coalesce((F.col("old") != F.col("negated")) & (shared_bigrams(F.col("before"), F.col("content")) >= 2), F.lit(False))
    kinds = F.array_compact(F.array(F.when(flip, "stance_flip"), F.when(F.col("first"), "new_theme"), F.when(F.coalesce("late", F.lit(False)), "large_gap")))
    return f.select("entity_id", "id", "time", F.explode(kinds).alias("milestone"))


def start_and_current(facts: DataFrame) -> DataFrame:
    """(entity_id, start_id, current_id): the first identity, else first persona, else first fact; the last persona, else last."""
    o = F.struct(*ORDER)
    start = F.struct(F.when(F.col("fact_type") == "identity", 0).when(F.col("persona"), 1).otherwise(2).alias("p"), o)
    return facts.groupBy("entity_id").agg(F.min_by("id", start).alias("start_id"), F.max_by("id", F.struct(F.col("persona").cast("int").alias("p"), o)).alias("current_id"))


def cards(facts: DataFrame, n: int = 5) -> DataFrame:
    """Persona cards: entity_id, identity (the first affirmative one, else the first), and first n preferences, emotions, goals."""
    p = facts.where("persona")
    w = Window.partitionBy("entity_id", "fact_type").orderBy(*ORDER)
    p = p.withColumn("r", F.row_number().over(w))
    who = F.min_by("content", F.when(F.col("fact_type") == "identity", F.struct(F.coalesce("negated", F.lit(False)).alias("n"), *ORDER)))
    lists = [F.transform(F.array_sort(F.collect_list(F.when((F.col("fact_type") == k) & (F.col("r") <= n), F.struct("r", "content")))), lambda s: s["content"]).alias(k) for k in ("preference", "emotion", "goal")]
    return p.groupBy("entity_id").agg(who.alias("identity"), *lists)


def speaker(role: Column) -> Column:
    return F.when(role == "assistant", "agent").when(role == "user", "user")


def relationship(messages: DataFrame, state: DataFrame | None = None, positive: Sequence[str] = L.POSITIVE_WORDS, negative: Sequence[str] = L.NEGATIVE_WORDS) -> DataFrame:
    """New state of each key (conv_id) after its messages: intimacy, stage, trend. A user's word moves it by .02, another's
    by .01, once a message and polarity; the clamp to [0, 1] comes after all. state has conv_id and intimacy (default 0)."""
    c, step = F.col("content"), F.when(F.col("role") == "user", 0.02).otherwise(0.01)
    move = F.when(any_of(c, positive), step).otherwise(0.0) - F.when(any_of(c, negative), step).otherwise(0.0)
    moved = messages.groupBy("conv_id").agg(F.sum(move).alias("move"))
    old = F.lit(0.0)
    if state is not None:
        moved = moved.join(state.select("conv_id", F.col("intimacy").alias("old")), "conv_id", "left")
        old = F.coalesce("old", F.lit(0.0))
    new = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), old + F.col("move"))), 9)
    return moved.select("conv_id", new.alias("intimacy"), stage(new).alias("stage"), trend(new - F.round(old, 9)).alias("trend"))


def recent_topics(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, topics): the n most repeated themes of each conversation's messages, most frequent first; a conversation
    without any has an empty list. They replace the topics of a relationship's state."""
    from engram.operators.cognition import themes

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), "keyword")))
    t = themes(messages, n).groupBy("conv_id").agg(F.transform(ordered, lambda s: s["keyword"]).alias("topics"))
    every = messages.select("conv_id").distinct()
    return every.join(t, "conv_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def decayed(facts: DataFrame, now: int, strategy: str = "hybrid", force: bool = False, ttl: float = 90 * 86400.0) -> DataFrame:
    """facts with weight and archived: below 1 is archived. Persona and relationship facts keep 1, unless forced."""
    protected = F.col("persona") | (F.col("fact_type") == "relationship")
    parts = {"time": decay_time((F.lit(now) - F.col("time")).cast("double"), ttl), "importance": decay_importance(F.col("importance")), "access": decay_access(F.col("access_count"))}
    w = parts["time"] * parts["importance"] * parts["access"] if strategy == "hybrid" else parts[strategy]
    w = F.round(w if force else F.when(protected, 1.0).otherwise(w), 9)
    return facts.withColumns({"protected": protected, "weight": w, "archived": w < 1.0})


def decay_stats(assessed: DataFrame) -> DataFrame:
    return assessed.agg(F.count("*").alias("scanned"), F.count_if("archived").alias("archived"), F.count_if(~F.col("archived")).alias("kept"), F.count_if("protected").alias("protected"))


def check_thresholds(match: float, conflict: float, dedup: float) -> None:
    """Thresholds are in [0, 1] and don't fall from match to conflict to dedup; else ValueError."""
    if not 0 <= match <= conflict <= dedup <= 1:
        raise ValueError(f"thresholds must be 0 <= match <= conflict <= dedup <= 1, not {match}, {conflict}, {dedup}")


def card_text(cards_: DataFrame) -> DataFrame:
    """(entity_id, text): a card as lines, without those that are empty."""
    line = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: "), F.array_join(name, "; ")))
    return cards_.select("entity_id", F.concat_ws("\n", F.when(F.col("identity").isNotNull(), F.concat(F.lit("identity: "), "identity")), line("preference"), line("emotion"), line("goal")).alias("text"))


def story_facts(events: DataFrame, stride: int = 2_000_000) -> DataFrame:
    """Events of a character (entity_id, event_id, content) as facts: id order, times a stride apart, so that gaps between
    them count as large."""
    r = F.row_number().over(Window.partitionBy("entity_id").orderBy("event_id"))
    return events.select(F.col("event_id").alias("id"), "entity_id", F.lit("event").alias("fact_type"), (r.cast("long") * stride).alias("time"), (r.cast("long") * stride).alias("created_at"), "content", F.lit(None).cast("boolean").alias("negated"), F.lit(True).alias("persona"))
