"""People in texts: names that could be a person's, names found by titles and markers, the dictionary of aliases, profiles,
first mentions, traits, what an agent says of itself, and figures of matching and resolving."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import any_of
from engram.operators.lexicon import with_places
from engram.operators.narrative import value_after, value_before, value_between
from engram.operators.persona import keyword_signals
from engram.operators.retrieval import classify_by_anchor

HAN = r"[\x{4e00}-\x{9fff}]"


def person_like(name: Column) -> Column:
    """Two to six Han characters, or at most three words of which the last is a capital and small letters; null is not."""
    t = F.regexp_replace(name, r"^\s+|\s+$", "")
    latin = (F.size(F.split(t, r"\s+")) <= 3) & t.rlike(r"(^|\s)[A-Z][a-z]*$")
    return F.coalesce(t.rlike(f"^{HAN}{{2,6}}$") | latin, F.lit(False))


def valid_han_name(name: Column, surnames: Sequence[str], function_words: Sequence[str] = (), noun_tails: Sequence[str] = ()) -> Column:
    """Two to four Han characters, none of them the first of a function word, without a noun's tail, after a surname of one or
    two characters. The lists are the caller's."""
    odd = "".join(sorted({w[0] for w in function_words if w}))
    ok = name.rlike(f"^{HAN}{{2,4}}$") & (F.substring(name, 1, 2).isin(list(surnames)) | F.substring(name, 1, 1).isin(list(surnames)))
    if odd:
        ok = ok & ~name.rlike(f"[{odd}]")
    for tail in noun_tails:
        ok = ok & ~name.endswith(tail)
    return F.coalesce(ok, F.lit(False))


def is_stop_name(word: Column, stop: Sequence[str]) -> Column:
    return F.coalesce(word.isin(list(stop)), F.lit(False))


def title_name(line: Column, titles: Sequence[str], stop: Sequence[str] = (), boilerplate: Sequence[str] = ()) -> Column:
    """The first name after a title of the line, title included: up to four words while they begin with a capital and are no
    stop name, two at least; null if there is none. Titles have no letter on either side; words lose the marks around them and
    what follows an inner one; Mr, Mrs and Dr get their point."""
    marks = "|".join(sorted(titles, key=len, reverse=True))
    tails = F.regexp_extract_all(line, F.lit(rf"(?<!\p{{L}})(?=((?:{marks})(?!\p{{L}})\s*\S*(?:\s+\S+){{0,3}}))"), F.lit(1))

    def clean(word: Column) -> Column:
        w = F.regexp_replace(word, r"^\P{L}+|\P{L}+$", "")
        return F.when(w.isin("Mr", "Mrs", "Dr"), F.concat(w, F.lit("."))).otherwise(F.regexp_extract(w, r"^([\p{L}.]*)", 1))

    def name(tail: Column) -> Column:
        words = F.slice(F.transform(F.split(tail, r"\s+"), clean), 1, 4)
        bad = F.transform(words, lambda w: ~w.rlike(r"^\p{Lu}") | is_stop_name(w, stop))
        n = F.array_position(bad, F.lit(True))
        kept = F.when(n == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(n.cast("int") - 1, F.lit(0))))
        return F.when(F.size(kept) >= 2, F.array_join(kept, " "))

    first = F.when(line.rlike(marks), F.try_element_at(F.filter(F.transform(tails, name), lambda x: x.isNotNull()), F.lit(1)))
    return F.when(~any_of(line, list(boilerplate)), first) if boilerplate else first


def han_name(line: Column, markers: Sequence[str], valid: Callable[[Column], Column], noise: Sequence[str] = ()) -> Column:
    """The name before the first marker, in list order, that has a valid one: up to four Han characters to its left over light
    punctuation, up to a 名 or 姓 or any other character; null if there is none."""
    out = []
    for m in markers:
        run = F.regexp_extract(F.substring_index(line, m, 1), r"((?:[\x{4e00}-\x{9fff}&&[^名姓]][，,、 ]*){0,4})$", 1)
        found = F.regexp_replace(run, "[，,、 ]", "")
        out.append(F.when(line.contains(m) & (F.length(found) >= 2) & ~found.isin(list(noise)) & valid(found), found))
    return F.coalesce(*out)


def dictionary(entries: DataFrame) -> DataFrame:
    """(alias, canonical): names, aliases and single characters of entries (provider, no, canonical, aliases, single). Where
    two entries have an alias, the later provider's later entry has it."""
    forms = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")), F.array("single")))
    each = entries.select("provider", "no", "canonical", F.explode(forms).alias("alias")).where("coalesce(alias, '') <> ''")
    return each.groupBy("alias").agg(F.max_by("canonical", F.struct("provider", "no")).alias("canonical"))


def profiles(lines: DataFrame, names: DataFrame, patterns: Sequence[tuple[str, str, str, str | None]], titles: Sequence[str] = (), stop: Sequence[str] = (), least_bytes: int = 6) -> DataFrame:
    """(name, key, value, confidence) from lines (doc_id, pos, line): the first value of each name and key, in text order.

    A line of least_bytes or more is about its longest alias of the dictionary `names` (alias, canonical; the least of equal
    length), else the name after a title. patterns: (key, mark, mode, other), mode after, before, between (other: the end)
    or before-or (other: a mark instead). A value loses the name it begins with. The dictionary may have any size: see
    operators.lexicon.
    """
    rows = lines.where(F.octet_length(F.trim("line")) >= least_bytes).select("doc_id", "pos", "line")
    rows = with_places(rows, names.select(F.col("alias").alias("form"), "canonical"), "line", "all")
    best = F.array_max(F.transform("found", lambda m: F.struct((m["end"] - m["start"]).alias("n"), m["matched"].alias("alias"), m["canonical"].alias("canonical"))))
    rows = rows.withColumn("known", best["canonical"]).drop("found")
    found = title_name(F.col("line"), titles, stop) if titles else F.lit(None).cast("string")
    rows = rows.withColumn("name", F.coalesce("known", found)).where("name is not null")
    line, each = F.col("line"), []
    for i, (key, mark, mode, other) in enumerate(patterns):
        if mode == "between":
            value = value_between(line, mark, other)
        elif mode == "before-or":
            value = F.coalesce(value_before(line, mark), value_before(line, other))
        else:
            value = {"after": value_after, "before": value_before}[mode](line, mark)
        each.append(F.struct(F.lit(i).alias("i"), F.lit(key).alias("key"), value.alias("value")))
    got = rows.select("doc_id", "pos", "name", F.explode(F.array(*each)).alias("v")).where("v.value is not null")
    got = got.select("doc_id", "pos", "name", "v.i", "v.key", F.when(F.startswith("v.value", "name"), F.expr("substring(v.value, length(name) + 1)")).otherwise(F.col("v.value")).alias("value")).where("value <> ''")
    return got.groupBy("name", "key").agg(F.min_by("value", F.struct("doc_id", "pos", "i")).alias("value")).withColumn("confidence", F.lit(0.9))


def first_mentions(chapters: DataFrame, aliases: DataFrame) -> DataFrame:
    """(chapter_id, name, alias, start, end, snippet): a name's first alias in each chapter (chapter_id, text), the longer one
    at the same place; start and end in bytes, the snippet 40 characters before to 80 after. aliases: (name, alias), an
    alias of several names counts for each; chapters' ids are their own."""
    owners = aliases.groupBy(F.col("alias").alias("form")).agg(F.collect_set("name").alias("names"))
    rows = with_places(chapters.select("chapter_id", "text"), owners, "text", "all", by=["chapter_id"])
    owned = F.flatten(F.transform("found", lambda m: F.transform(m["names"], lambda n: F.struct(n.alias("name"), m["start"].alias("start"), (-m["end"]).alias("o"), m["at"].alias("at"), m["matched"].alias("alias")))))
    firsts = F.transform(F.array_distinct(F.transform(owned, lambda m: m["name"])), lambda n: F.array_min(F.filter(owned, lambda m: m["name"] == n)))
    each = rows.select("chapter_id", "text", F.inline(firsts))
    low = F.greatest(F.col("at") - 40, F.lit(0))
    snippet = F.col("text").substr(low + 1, F.col("at") - low + F.length("alias") + 80)
    return each.select("chapter_id", "name", "alias", "start", (-F.col("o")).alias("end"), snippet.alias("snippet"))


def traits(evidence: DataFrame, patterns: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(entity_id, trait, confidence, snippet) of evidence (entity_id, pos, text): a trait's largest weight among its words that
    occur, and 80 characters of a text that has one: the first, then whichever is shorter in bytes than the snippet so far."""
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("trait"), F.lit(float(x)).alias("weight")) for w, t, x in patterns])
    each = evidence.select("entity_id", "pos", "text", F.explode(F.filter(rows, lambda r: F.contains("text", r["word"]))).alias("r"))
    each = each.groupBy("entity_id", "r.trait", "pos").agg(F.max("r.weight").alias("weight"), F.first("text").alias("text"))
    kept = F.struct("pos", F.octet_length("text").alias("n"), F.substring("text", 1, 80).alias("s"))
    fold = F.aggregate(F.array_sort(F.collect_list(kept)), F.lit("").cast("string"), lambda a, x: F.when((a == "") | (x["n"] < F.octet_length(a)), x["s"]).otherwise(a))
    return each.groupBy("entity_id", "trait").agg(F.max("weight").alias("confidence"), fold.alias("snippet"))


def agent_facts(messages: DataFrame, agent: Column, markers: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """What an agent says of itself: a fact for each assistant message with a marker, the longest one deciding."""
    m = messages.where("role = 'assistant'").withColumn("s", keyword_signals(F.col("content"), markers)).where("s is not null")
    payload = F.to_json(F.struct(F.lit("agent_personality").alias("attribution"), "content", F.col("s.negated").alias("negated")))
    return m.select(agent.alias("entity_id"), "conv_id", "turn", F.col("s.fact_type").alias("fact_type"), F.col("s.negated").alias("negated"), payload.alias("payload"))


def companion_signals(messages: DataFrame, zones: dict[str, Sequence[tuple[str, str]]], self_words: Sequence[str]) -> DataFrame:
    """(conv_id, turn, role, fact_type, zone, label): an emotion for each zone a message has a word of, the first in list order
    naming it, and an identity where it speaks of itself. zones: name to (word, label)."""
    def of(zone: str, words: Sequence[tuple[str, str]]) -> Column:
        label = F.coalesce(*[F.when(F.contains("content", F.lit(w)), F.lit(x)) for w, x in words])
        return F.struct(F.lit("emotion").alias("fact_type"), F.lit(zone).alias("zone"), label.alias("label"))

    own = F.struct(F.lit("identity").alias("fact_type"), F.lit("self").alias("zone"), F.when(any_of(F.col("content"), list(self_words)), F.lit("self")).alias("label"))
    each = messages.select("conv_id", "turn", "role", F.explode(F.array(*[of(z, w) for z, w in zones.items()], own)).alias("x"))
    return each.select("conv_id", "turn", "role", "x.*").where("label is not null")


def prototype_signals(vectors: DataFrame, prototypes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(id, fact_type, negated, confidence): the nearest prototype (label, fact_type, negated, centroid) by clamped cosine, if
    it reaches the threshold. Prototypes are few: see classify_by_anchor."""
    near = classify_by_anchor(vectors, prototypes).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))))
    return near.where(F.col("confidence") >= threshold).join(F.broadcast(prototypes.drop("centroid")), "label").select("id", "fact_type", "negated", "confidence")  # 10 000 rows at most


def resolver_rates(resolved: DataFrame) -> DataFrame:
    """One row: mentions, and the percentages found by alias, found by embedding and unknown; 0 without mentions."""
    n = F.count("*")
    rate = lambda s: F.coalesce(F.try_divide(100.0 * F.count_if(F.col("stage") == s), n), F.lit(0.0))
    return resolved.agg(n.alias("mentions"), *[F.round(rate(s), 6).alias(s) for s in ("alias", "embedding", "unknown")])


def embed(rows: DataFrame, text: str, service: Callable[[list[str]], list[list[float]]], name: str = "vector") -> DataFrame:
    """rows with a vector of each text from any service, called once a batch in the tasks. A batch that fails, and texts that
    are null, get null: embedding is optional."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[text].to_pylist()
            try:
                got = service([t or "" for t in texts])
            except Exception:  # noqa: BLE001  whatever a remote service raises
                got = [None] * len(texts)
            yield b.append_column(name, pa.array([None if t is None else v for t, v in zip(texts, got)], pa.list_(pa.float64())))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` array<double>")


def text_lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: bytes and spaces of a text."""
    return [[float(len(t.encode())), float(t.count(" "))] for t in texts]


def evidence_of(objects: DataFrame, edges: DataFrame, object_links: DataFrame, edge_links: DataFrame) -> DataFrame:
    """(id, evidence_id): the different evidence of each object and of the edges that touch it. object_links: id, evidence_id;
    edge_links: source_id, target_id, predicate, evidence_id."""
    ends = edges.join(edge_links, ["source_id", "target_id", "predicate"])
    own = object_links.select("id", "evidence_id")
    both = own.unionByName(ends.select(F.col("source_id").alias("id"), "evidence_id")).unionByName(ends.select(F.col("target_id").alias("id"), "evidence_id"))
    return both.distinct().join(objects.select("id"), "id", "left_semi")


def conversation_records(messages: DataFrame, goals: DataFrame, files: DataFrame, problems: DataFrame, decisions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_messages, goal, files, problems, decisions, knowledge; lists in turn order. The parts
    are those of operators.distill; knowledge has conv_id, turn, memory_type, importance, solution: .3 or more is kept."""
    listed = lambda d, c, name: d.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col(c).alias("x")))), lambda s: s["x"]).alias(name))
    known = knowledge.where("memory_type = 'knowledge' and importance >= 0.3")
    out = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    for part in (goals, files, listed(problems, "content", "problems"), listed(decisions, "decision", "decisions"), listed(known, "solution", "knowledge")):
        out = out.join(part, "conv_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("files", "problems", "decisions", "knowledge")})


def prompts(messages: DataFrame, records: DataFrame, knowledge: DataFrame, decisions: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(conv_id, prompt): what a model is told of a conversation, in sections: the 5 most important pieces of knowledge
    (conv_id, turn, importance, summary), the 3 most important decisions (conv_id, turn, importance, decision, module), the
    session state of records (conv_id, goal, module, files, problems), reasoning steps (conv_id, turn, trigger, tool_name,
    tool_args, status, reasoning), and the last 3 messages, 200 characters of each. Sections without lines are left out, but
    for the session's title; among equals of importance the earlier turn comes first."""

    def lines(rows: DataFrame, line: Column, name: str, n: int, *order: Column) -> DataFrame:
        w = Window.partitionBy("conv_id").orderBy(*order)
        top = rows.select("conv_id", line.alias("line"), F.row_number().over(w).alias("r")).where(F.col("r") <= n)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"])
        return top.groupBy("conv_id").agg(F.array_join(listed, "\n").alias(name))

    best = F.desc("importance"), F.asc("turn")
    known = lines(knowledge, F.format_string("- [%d%%] %s", F.floor(F.col("importance") * 100), F.col("summary")), "known", 5, *best)
    decided = lines(decisions, F.concat(F.lit("- "), "decision", F.lit(" ("), F.coalesce("module", F.lit("")), F.lit(")")), "decided", 3, *best)
    short = F.concat("role", F.lit(": "), F.substring("content", 1, 200), F.when(F.length("content") > 200, "…").otherwise(""))
    last = messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 3")
    recent = lines(last, short, "recent", 3, F.asc("turn"))
    out = records.select("conv_id", "goal", "module", "files", "problems")
    parts = [known, decided, recent]
    if steps is not None:
        reason = F.when(F.coalesce(F.col("reasoning"), F.lit("")) != "", F.concat(F.lit("\n  → "), "reasoning")).otherwise("")
        call = F.concat(F.lit("- Trigger: "), "trigger", F.lit("\n  Tool: "), "tool_name", F.lit("("), F.coalesce("tool_args", F.lit("")), F.lit(")\n  Status: "), "status", reason)
        parts.append(lines(steps, call, "steps", 1 << 30, F.asc("turn")))
    for part in parts:
        out = out.join(part, "conv_id", "left")
    out = out if steps is not None else out.withColumn("steps", F.lit(None).cast("string"))
    section = lambda title, c, gap: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n"), c, F.lit("\n" * gap)))
    told = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {title}: "), c))
    state = F.concat_ws("\n", F.lit("## Session State"), told("Goal", F.col("goal")), told("Module", F.col("module")), told("Files", F.array_join("files", ", ")), told("Problems", F.array_join("problems", "; ")))
    prompt = F.concat_ws("\n", section("Knowledge", "known", 1), section("Decisions", "decided", 1), state, section("Reasoning Chain", "steps", 1), section("Recent", "recent", 0))
    return out.select("conv_id", prompt.alias("prompt"))


def new_decisions(decisions: DataFrame, store: DataFrame, tenant: str, noise: Callable[[Column], Column], sensitive: Callable[[Column], Column]) -> DataFrame:
    """Memories of decisions that a tenant's knowledge doesn't have yet: tenant_id, memory_type, content, confidence; noise and
    secrets are left out, and equal decisions are one, of the largest importance."""
    text = F.concat(F.lit("Decision: "), "decision", F.lit(" — Rationale: "), "rationale")
    d = decisions.withColumn("content", text).where(~noise(F.col("content")) & ~sensitive(F.col("content")))
    d = d.groupBy("content").agg(F.max("importance").alias("confidence"))
    old = store.where((F.col("tenant_id") == tenant) & (F.col("memory_type") == "knowledge")).select("content")
    return d.join(old, "content", "left_anti").select(F.lit(tenant).alias("tenant_id"), F.lit("knowledge").alias("memory_type"), "content", "confidence")


def context_check(usage: float, run: Callable[[], DataFrame], facts: DataFrame, threshold: float = 40.0) -> DataFrame:
    """One row: usage, threshold, distill_mode, n. Where usage reaches the threshold (drawn in to 1 to 100) `run` is called and
    n counts its rows; below it nothing is run, and n counts the facts there are."""
    threshold = min(100.0, max(1.0, threshold))
    on = usage >= threshold
    return (run() if on else facts).agg(F.lit(float(usage)).alias("usage"), F.lit(threshold).alias("threshold"), F.lit(on).alias("distill_mode"), F.count("*").alias("n"))


def constrained(scores: DataFrame, factions: DataFrame, rule: Column) -> DataFrame:
    """scores (a, b, score) with those that break their type's rule times 0.2: same (a known other faction breaks it),
    different (one faction, or an unknown one), or any."""
    j = scores.join(factions.toDF("a", "fa"), "a", "left").join(factions.toDF("b", "fb"), "b", "left")
    same = F.coalesce(F.col("fa") == F.col("fb"), F.lit(True))
    broken = ((rule == "same") & ~same) | ((rule == "different") & same)
    return j.withColumn("score", F.round(F.when(broken, 0.2 * F.col("score")).otherwise(F.col("score")), 6)).drop("fa", "fb")


def snapshots(facts: DataFrame, most: int = 5) -> DataFrame:
    """(entity_id, markdown, embedding_text): the last `most` contents of each type, as a list under headings and as one line."""
    w = Window.partitionBy("entity_id", "fact_type").orderBy(F.desc("time"), F.desc("id"))
    last = facts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    items = F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), lambda s: s["content"])
    kinds = last.groupBy("entity_id", "fact_type").agg(items.alias("items"))
    rows = F.array_sort(F.collect_list(F.struct("fact_type", "items")))
    heading = lambda s: F.concat(F.lit("## "), s["fact_type"], F.lit("\n- "), F.array_join(s["items"], "\n- "))
    line = lambda s: F.concat(s["fact_type"], F.lit(": "), F.array_join(s["items"], ", "))
    return kinds.groupBy("entity_id").agg(rows.alias("k")).select("entity_id", F.array_join(F.transform("k", heading), "\n").alias("markdown"), F.array_join(F.transform("k", line), "; ").alias("embedding_text"))
