"""Corpus model: co-occurrence, relation scores, character aggregates, word frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.lexicons import IMPACT_WORDS
from engram.functions.text import any_of
from engram.operators.graph import checkpointed
from engram.operators.lexicon import lexicon_places
from engram.operators.narrative import gathered


def cooccurrence(members: DataFrame, least: int = 3, rows: int = 500_000) -> DataFrame:
    """(a, b, n): pairs of names and the groups (group_id, name) that both are in, at least `least`.

    Groups are chapters or the like, with a bounded cast; a pair is counted once for each group. Groups and pairs are dealt to
    as many tasks as the members ask for, so no task's share grows with them.
    """
    m = checkpointed(members.select("group_id", "name"))
    parts = max(m.sparkSession.sparkContext.defaultParallelism, -(-m.count() // rows))
    m = m.repartition(parts, "group_id").distinct()
    pairs = m.toDF("group_id", "a").join(m.toDF("group_id", "b"), "group_id").where("a < b")
    return pairs.repartition(2 * parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def relation_scores(pairs: DataFrame, events: DataFrame, generic: Column, factions: DataFrame | None = None) -> DataFrame:
    """pairs (a, b, n) with score: .5 co-occurrence (up to 15), .3 shared events over a's, .2 type (.3 if generic), times
    1.2 in one faction and 0.8 in two, at most 1. events has event_id, name; factions name, faction."""
    e = events.select("event_id", "name").distinct()
    own = e.groupBy(F.col("name").alias("a")).agg(F.count("*").alias("own"))
    shared = pairs.select("a", "b").join(e.toDF("event_id", "a"), "a").join(e.toDF("event_id", "b"), ["event_id", "b"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = pairs.join(shared, ["a", "b"], "left").join(own, "a", "left")
    coupling = F.coalesce(F.try_divide(F.col("shared"), F.col("own")), F.lit(0.0))
    score = 0.5 * F.least(F.col("n") / 15.0, F.lit(1.0)) + 0.3 * coupling + 0.2 * F.when(generic, 0.3).otherwise(1.0)
    bonus = F.lit(1.0)
    if factions is not None:
        j = j.join(factions.toDF("a", "fa"), "a", "left").join(factions.toDF("b", "fb"), "b", "left")
        bonus = F.when(F.col("fa") == F.col("fb"), 1.2).when(F.col("fa") != F.col("fb"), 0.8).otherwise(1.0)
    return j.select("a", "b", "n", F.round(F.least(F.lit(1.0), score * bonus), 6).alias("score"))


def characters(members: DataFrame, texts: DataFrame | None = None, full: int = 30) -> DataFrame:
    """(name, n_groups, importance): importance grows with the groups a name is in, 1 from `full` on."""
    g = members.groupBy("name").agg(F.countDistinct("group_id").alias("n_groups"), F.min("group_id").alias("first_group"))
    return g.withColumn("importance", F.least(F.col("n_groups") / float(full), F.lit(1.0)))


def word_frequency(docs: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, share): lower-case runs of letters and their share of all, in percent."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = w.agg(F.sum("n").alias("total"))
    return w.where(F.col("n") >= least).crossJoin(F.broadcast(total)).select("word", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))  # total is one row


def elite_scores(words: DataFrame, n: int = 40, han: bool = False, impact: Sequence[str] = IMPACT_WORDS) -> DataFrame:
    """The n most frequent of words (word, n; ties by word) with impact, domain, frequency, precision and elite score.

    The score is .25 impact + .2 domain + .2 frequency + .15 precision + .08, as upkeep counts .8 and coverage nothing. Domain
    goes by the share of all words, frequency is over the largest; Han words have one impact and one precision.
    """
    size, total = F.length("word"), words.agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    top = words.orderBy(F.desc("n"), "word").limit(n).crossJoin(F.broadcast(total))  # total is one row
    by_size = F.when(any_of(F.lower("word"), impact), 0.9).when(size >= 5, 0.8).when(size >= 3, 0.6).otherwise(0.4)
    scored = top.withColumns(
        {
            "impact": F.lit(0.7) if han else by_size,
            "domain": F.when(F.col("n") > F.col("total") * 0.01, 0.9).when(F.col("n") > F.col("total") * 0.001, 0.7).otherwise(0.4),
            "frequency": F.col("n") / F.col("largest"),
            "precision": F.lit(0.5) if han else F.least(size / 8.0, F.lit(1.0)) * 0.8 + 0.2,
        }
    )
    elite = 0.25 * F.col("impact") + 0.2 * F.col("domain") + 0.2 * F.col("frequency") + 0.15 * F.col("precision") + 0.08
    return scored.select("word", "n", "impact", "domain", F.round("frequency", 6).alias("frequency"), F.round("precision", 6).alias("precision"), F.round(elite, 6).alias("elite"))


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    return words.join(known.select("word").distinct(), "word", "left_anti")


def faction_members(names: DataFrame, factions: DataFrame, unknown: str = "未知") -> DataFrame:
    """(faction, n, members): sorted names of each faction, those of none under `unknown`."""
    j = names.select("name").distinct().join(factions, "name", "left").withColumn("faction", F.coalesce("faction", F.lit(unknown)))
    return j.groupBy("faction").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("members"))


def deaths(rows: DataFrame, found: DataFrame, phrases: list[str], reach: int = 40) -> DataFrame:
    """deaths_of() with names that were found elsewhere: found is mentions() of rows (doc_id, pos, chapter, sentence)."""
    return deaths_of(gathered(rows, found), phrases, reach)


def deaths_of(rows: DataFrame, phrases: list[str], reach: int = 40) -> DataFrame:
    """(doc_id, name, chapter): the first chapter in which a death phrase follows one of a name's places within `reach`
    characters. rows are those of narrative.with_mentions(), with chapter."""
    behind = lambda m: F.col("sentence").substr(m["at"] + F.length(m["matched"]) + 1, F.lit(reach))
    dead = F.array_distinct(F.transform(F.filter("named", lambda m: any_of(behind(m), phrases)), lambda m: m["canonical"]))
    return rows.where(any_of(F.col("sentence"), phrases)).select("doc_id", "chapter", F.explode(dead).alias("name")).groupBy("doc_id", "name").agg(F.min("chapter").alias("chapter"))


def action_sentences(rows: DataFrame, found: DataFrame, verbs: list[str], most_bytes: int = 300) -> DataFrame:
    """(doc_id, name, sentence): the first sentence with a mention and a strong verb, cut at most_bytes whole characters."""
    good = rows.where(any_of(F.col("sentence"), verbs) & (F.octet_length("sentence") <= most_bytes))
    j = found.join(good, ["doc_id", "pos"])
    return j.groupBy("doc_id", F.col("canonical").alias("name")).agg(F.min_by("sentence", F.struct("pos", "start")).alias("sentence"))


def relation_types(rows: DataFrame, found: DataFrame, rules: list[tuple[str, str]], reach: int = 40) -> DataFrame:
    """(doc_id, a, b, relation): of rules (keyword, relation) the first with a place of its keyword that begins less than
    reach bytes from where mentions of both names begin, in one row (doc_id, pos, sentence: a sentence or a chapter).

    All places of keywords and names count. Names near one place of a keyword are few, as reach bounds them.
    """
    forms = rows.sparkSession.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rules)], "rule int, form string, relation string")
    owners = forms.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("rule", "relation"))).alias("says"))
    k = lexicon_places(rows, owners, "all").select("doc_id", "pos", F.col("start").alias("at"), F.inline("says"))
    near = k.join(found.select("doc_id", "pos", "canonical", "start"), ["doc_id", "pos"]).where(F.abs(F.col("start") - F.col("at")) < reach)
    near = near.groupBy("doc_id", "pos", "at", "rule", "relation").agg(F.collect_set("canonical").alias("names"))
    pairs = near.select("doc_id", "rule", "relation", "names", F.explode("names").alias("a"))
    pairs = pairs.select("doc_id", "rule", "relation", "a", F.explode("names").alias("b")).where("a < b")
    return pairs.groupBy("doc_id", "a", "b").agg(F.min_by("relation", "rule").alias("relation"))


def search_characters(characters_: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Characters (name, aliases, importance) whose name or an alias holds the text: equal names first, then the most important."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q))
    exact = F.lower("name") == q
    return characters_.where(hit).orderBy(F.desc(exact), F.desc("importance"), "name").limit(k)


def to_graph(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, edges, evidence) of events (doc_id, chapter, title, name, sentence), one row a participant.

    Persons by document and name, events by document, chapter and title; ids are hashes of those keys, so a second run
    gives the same rows. Evidence is each different sentence of an event.
    """
    person = F.xxhash64(F.lit("person"), "doc_id", "name")
    event = F.xxhash64(F.lit("event"), "doc_id", "chapter", "title")
    objects = events.select(person.alias("id"), F.lit("person").alias("object_type"), "name", "doc_id").unionByName(events.select(event.alias("id"), F.lit("event").alias("object_type"), F.col("title").alias("name"), "doc_id")).distinct()
    edges = events.select(person.alias("source_id"), event.alias("target_id"), F.lit("participated_in").alias("predicate"), F.col("chapter").cast("int").alias("valid_from"), F.lit(None).cast("int").alias("valid_to")).distinct()
    evidence = events.select(event.alias("event_id"), "doc_id", "chapter", F.col("sentence").alias("content")).distinct()
    return objects, edges, evidence
