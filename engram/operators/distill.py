"""Distillation: conversations to memories. Messages have conv_id, turn, role, content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicons as L
from engram.functions.scores import importance, is_noise, is_problem, is_question, is_sensitive, memory_type, trimmed
from engram.functions.text import bigram_set, file_names, truncate_bytes


def extract_pairs(messages: DataFrame, problem: Column | None = None, question: Column | None = None) -> DataFrame:
    """Problem and solution pairs: conv_id, turn, problem, solution, method.

    direct: a user's problem and the assistant message right after it, if that isn't a question. cross-turn: if it is,
    the next assistant message after it, unless that is a question too. Reading goes on after the solution of a pair, so
    a problem inside a cross-turn pair is not one of its own; problems are non-overlapping from the first on.
    """
    problem = is_problem(F.col("content")) if problem is None else problem
    question = is_question(F.col("content")) if question is None else question
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumns({"q": question, "p": problem & (F.col("role") == "user"), "pos": F.row_number().over(w)})
    after = w.rowsBetween(1, Window.unboundedFollowing)
    reply = F.struct("pos", "content", "q")
    m = m.withColumn("next", F.when(F.lead("role").over(w) == "assistant", F.lead(reply).over(w)))
    m = m.withColumn("later", F.first(F.when(F.col("role") == "assistant", reply), ignorenulls=True).over(w.rowsBetween(2, Window.unboundedFollowing)))
    direct = F.col("p") & F.col("next").isNotNull() & ~F.col("next.q")
    cross = F.col("p") & F.col("next.q") & F.col("later").isNotNull() & ~F.col("later.q")
    found = m.where(direct | cross).select(
        "conv_id", "turn", "pos", F.col("content").alias("problem"), F.when(direct, F.col("next.content")).otherwise(F.col("later.content")).alias("solution"),
        F.when(direct, "direct").otherwise("cross-turn").alias("method"), F.when(direct, F.col("next.pos")).otherwise(F.col("later.pos")).alias("until"),
    )
    # a pair is read unless one that is read reaches over it; only runs of overlapping cross-turn pairs need the fold
    v = Window.partitionBy("conv_id").orderBy("pos")
    reach = F.max("until").over(v.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("run", F.sum(F.when(F.coalesce(reach, F.lit(0)) < F.col("pos"), 1).otherwise(0)).over(v))
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct("pos", "until", "turn", "problem", "solution", "method"))),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<turn:bigint,problem:string,solution:string,method:string>>").alias("out")),
        lambda a, x: F.when(x["pos"] > a["end"], F.struct(x["until"].alias("end"), F.concat(a["out"], F.array(F.struct(x["turn"].cast("long").alias("turn"), x["problem"].alias("problem"), x["solution"].alias("solution"), x["method"].alias("method")))).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return found.groupBy("conv_id", "run").agg(taken.alias("t")).select("conv_id", F.inline("t"))


def candidates(pairs: DataFrame, types: dict[str, Sequence[str]] = L.TYPE_WORDS, value_words: Sequence[str] = L.VALUE_WORDS, secrets: Sequence[str] = L.SECRETS, chatter: Sequence[str] = L.CHATTER) -> DataFrame:
    """Pairs with their stage flags, type and importance; nothing is dropped yet."""
    text = F.concat("problem", F.lit(" "), "solution")
    out = pairs.withColumns({"low": F.lower(text), "n_bytes": F.octet_length(text)})
    out = out.withColumns({"sensitive": is_sensitive(F.col("problem"), secrets) | is_sensitive(F.col("solution"), secrets), "noise": is_noise(F.col("problem"), chatter), "memory_type": memory_type(F.col("low"), types)})
    return out.withColumn("importance", F.round(importance(F.col("low"), F.col("n_bytes"), F.col("memory_type"), value_words), 9)).drop("low", "n_bytes")


def keep_important(rows: DataFrame, least: float = 0.6, n: int = 3) -> DataFrame:
    """At most n of each conversation, most important first, that are neither sensitive, noise nor below the least importance."""
    good = rows.where(~F.col("sensitive") & ~F.col("noise") & (F.col("importance") >= least))
    w = Window.partitionBy("conv_id").orderBy(F.desc("importance"), "turn")
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def compress(problem: Column, solution: Column) -> Column:
    """Subject, problem and solution, cut to 60, 160 and 200 bytes."""
    p, s = trimmed(problem), trimmed(solution)
    subject = truncate_bytes(F.regexp_replace(p, "[?？]$", ""), 60)
    return F.concat(subject, F.lit("\nProblem: "), truncate_bytes(p, 160), F.lit("\n→ Solution: "), truncate_bytes(s, 200))


def resolve_by_content(new: DataFrame, store: DataFrame) -> DataFrame:
    """new with an action each: replace where the store has the same trimmed content and type with less confidence, drop
    where it has it with as much, insert otherwise. Also the id it replaces. Compared with the store only."""
    s = store.select("tenant_id", "memory_type", trimmed(F.col("content")).alias("key"), F.col("id").alias("old_id"), F.col("confidence").alias("old_confidence"))
    first = s.groupBy("tenant_id", "memory_type", "key").agg(F.min_by("old_confidence", "old_id").alias("old_confidence"), F.min("old_id").alias("old_id"))
    j = new.withColumn("key", trimmed(F.col("content"))).join(first, ["tenant_id", "memory_type", "key"], "left").drop("key")
    action = F.when(F.col("old_id").isNull(), "insert").when(F.col("importance") > F.col("old_confidence"), "replace").otherwise("drop")
    return j.withColumn("action", action).withColumn("old_id", F.when(action == "replace", F.col("old_id"))).drop("old_confidence")


def resolve_by_vector(near: DataFrame, threshold: float = 0.85) -> DataFrame:
    """near has a candidate's id, type and importance with each of its nearest stored memories (old_id, old_type,
    old_confidence, similarity). One row per candidate: the nearest of its type at the threshold decides."""
    hit = near.where((F.col("memory_type") == F.col("old_type")) & (F.col("similarity") >= threshold))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "old_id")
    best = hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "old_id", "old_confidence")
    one = near.select("id", "memory_type", "importance").distinct().join(best, "id", "left")
    action = F.when(F.col("old_id").isNull(), "insert").when(F.col("importance") > F.col("old_confidence"), "replace").otherwise("keep_both")
    return one.select("id", action.alias("action"), F.when(action == "replace", F.col("old_id")).alias("old_id"))


def over_capacity(memories: DataFrame, cap: int, kind: str = "knowledge") -> DataFrame:
    """The rows of a type beyond cap of each tenant: those of least confidence, the newest first among equals."""
    w = Window.partitionBy("tenant_id")
    own = memories.where(F.col("memory_type") == kind)
    ranked = own.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("confidence", F.desc("created_at"), "id"))})
    return ranked.where(F.col("r") <= F.col("n") - cap).drop("n", "r")


def keep_first(knowledge: DataFrame, shown: int = 40) -> DataFrame:
    """knowledge (conv_id, turn, summary) without what repeats within a conversation: of equal keys the first turn stays. The
    key is what comes before the first `：`, else the first 40 characters; a null summary counts as empty."""
    s = F.coalesce("summary", F.lit(""))
    key = F.when(s.contains("："), F.substring_index(s, "：", 1)).otherwise(F.substring(s, 1, shown))
    w = Window.partitionBy("conv_id", "_key").orderBy("turn")
    return knowledge.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_key", "_r")


def expired(memories: DataFrame, now: int) -> DataFrame:
    return memories.where(F.col("expires_at") < F.lit(now))


def goals(messages: DataFrame) -> DataFrame:
    """(conv_id, goal): the first user message of over 15 bytes that opens with no thanks, 100 characters."""
    c = F.col("content")
    good = messages.where((F.col("role") == "user") & (F.octet_length(c) > 15) & ~F.lower(c).startswith("thanks") & ~c.startswith("好的"))
    return good.groupBy("conv_id").agg(F.min_by(F.substring("content", 1, 100), "turn").alias("goal"))


def open_problems(messages: DataFrame, n: int = 5) -> DataFrame:
    """User messages that no assistant message follows, nor any equal one of the conversation: the first n of each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("answered", (F.col("role") == "user") & F.coalesce(F.lead("role").over(w) == "assistant", F.lit(False)))
    done = m.where("answered").select("conv_id", "content").distinct()
    left = m.where("role = 'user'").join(done, ["conv_id", "content"], "left_anti")
    return left.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("r") <= n).select("conv_id", "turn", "content")


def decisions(pairs: DataFrame, done: Sequence[str] = ("done", "implemented", "replaced", "完成"), change: Sequence[str] = ("replace", "换成", "改用")) -> DataFrame:
    """Pairs whose solution says it is done (.9) or whose problem asks for a replacement (.7)."""
    from engram.functions.text import any_of

    is_done, asks = any_of(F.lower("solution"), done), any_of(F.lower("problem"), change)
    return pairs.where(is_done | asks).select("conv_id", "turn", F.col("problem").alias("decision"), F.col("solution").alias("rationale"), F.when(is_done, 0.9).otherwise(0.7).alias("importance"))


def files(messages: DataFrame) -> DataFrame:
    """(conv_id, files): file names in user messages, in order of first mention."""
    m = messages.where("role = 'user'").select("conv_id", "turn", F.posexplode(file_names(F.col("content"))).alias("i", "f"))
    first = m.groupBy("conv_id", "f").agg(F.min(F.struct("turn", "i")).alias("at"))
    return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f"))), lambda s: s["f"]).alias("files"))


def reasoning_steps(messages: DataFrame, n: int = 5) -> DataFrame:
    """A user message whose next one calls a tool: trigger, tool_name, status of the first result after the call, and the
    assistant message after that; the last n of each conversation. messages also has tool_name and tool_call_id."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = w.rowsBetween(2, Window.unboundedFollowing)
    m = messages.withColumn("result", F.first(F.when(F.col("tool_call_id").isNotNull(), F.struct("turn", "content")), ignorenulls=True).over(ahead))
    m = m.withColumn("tool", F.lead("tool_name").over(w)).withColumn("replies", F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "content"))).over(ahead))
    status = F.when(F.col("result").isNull(), "timeout").when(F.col("result.content").rlike("error|failed"), "error").otherwise("ok")
    reply = F.try_element_at(F.filter("replies", lambda r: r["turn"] > F.col("result.turn")), F.lit(1))
    s = m.where("role = 'user' and tool is not null").select("conv_id", "turn", F.col("content").alias("trigger"), F.col("tool").alias("tool_name"), status.alias("status"), F.coalesce(reply["content"], F.lit("")).alias("reasoning"))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return s.withColumn("r", F.row_number().over(back)).where(F.col("r") <= n).drop("r")


def distil(messages: DataFrame, store: DataFrame, tenant: str, now: int, least: float = 0.6, n: int = 3, cap: int = 5000, problem: Column | None = None, question: Column | None = None, **lists) -> tuple[DataFrame, DataFrame]:
    """(new state of the store, actions): pairs, scores, top n, conflicts with the store, expiry and capacity, in this order.

    Ids of new memories are hashes of tenant, conversation and turn, so running twice over one input gives one state.
    """
    top = keep_important(candidates(extract_pairs(messages, problem, question), **lists), least, n)
    new = top.select(
        F.concat_ws("-", F.lit(tenant), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.lit(tenant).alias("tenant_id"), "memory_type",
        compress(F.col("problem"), F.col("solution")).alias("content"), "importance",
    ).select(F.xxhash64("key").alias("id"), "tenant_id", "memory_type", "content", "importance")
    actions = resolve_by_content(new, store)
    from engram.functions.scores import ttl_seconds

    added = actions.where("action <> 'drop'").select("id", "tenant_id", "memory_type", "content", F.col("importance").alias("confidence"), F.lit(now).cast("long").alias("created_at")).withColumn("expires_at", F.col("created_at") + ttl_seconds(F.col("memory_type")))
    gone = actions.where("action = 'replace'").select(F.col("old_id").alias("id"))
    state = store.join(gone, "id", "left_anti").select(added.columns).unionByName(added).where(F.col("expires_at") >= F.lit(now))
    return state.join(over_capacity(state, cap).select("id"), "id", "left_anti"), actions


def contained_pairs(rows: DataFrame, text: str, threshold: float = 0.8) -> DataFrame:
    """Pairs of different texts (a < b) whose bigram sets are contained in each other to the threshold: a, b, similarity.

    Equal texts are one text. Of two sets at the threshold t the smaller one, of n bigrams, shares ceil(tn) with the other,
    so one of its n - ceil(tn) + 1 rarest is in the other set: only texts that meet so are compared, and no pair is lost.
    A set of less than half the other's size counts as not contained. Null texts and those of one character have no pairs.
    """
    sets = rows.select(F.col(text).alias("t")).distinct().withColumn("g", bigram_set(F.col("t"))).where(F.size("g") > 0)
    each = sets.select("t", F.size("g").alias("n"), F.explode("g").alias("k"))
    often = each.groupBy("k").agg(F.count("*").alias("often"))
    w = Window.partitionBy("t").orderBy("often", "k")
    lead = each.join(often, "k").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
    x, y = lead.select("k", F.col("t").alias("x"), F.col("n").alias("n_x")), each.select("k", F.col("t").alias("y"), F.col("n").alias("n_y"))
    met = x.join(y, "k").where((F.col("x") != F.col("y")) & (F.col("n_x") <= F.col("n_y")) & (2 * F.col("n_x") >= F.col("n_y")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    both = both.withColumn("similarity", F.size(F.array_intersect("ga", "gb")) / F.least(F.size("ga"), F.size("gb")))
    return both.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def feedback(memories: DataFrame, votes: DataFrame, step: float = 0.1) -> DataFrame:
    """memories with confidence moved by the votes (id, vote of 1 or -1) and clamped to [0, 1], and their number."""
    v = votes.groupBy("id").agg(F.sum("vote").alias("up"), F.count("*").alias("n_votes"))
    j = memories.join(v, "id", "left")
    return j.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + step * F.coalesce("up", F.lit(0)))), 9)).withColumn("n_votes", F.coalesce("n_votes", F.lit(0))).drop("up")
