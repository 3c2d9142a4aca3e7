"""Document compile: text in, tables out.

One pass over the sentences of the documents tags each with what it says: attributes by hint words, the first relation
predicate and what follows it, whether it is evidence, the capitalised names in it. The tagged sentences are written once;
every table is read off them. Ids are hashes of content and document, so compiling a document again gives the same ids, and
recompile() replaces the rows of the documents it is given and of no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.text import any_of, sentences
from engram.operators.graph import checkpointed, purge, upsert
from engram.operators.narrative import story_events
from engram.operators.people import person_like, title_name

#: Tables whose rows belong to one document; world_entities and world_profiles go by name.
OF_DOCUMENTS = ("documents", "chapters", "objects", "edges", "evidence", "links", "profiles")


@dataclass
class Profile:
    """What to look for. hints: attribute to words; predicates: of relations, in order; verbs: of evidence; story: of events."""

    hints: dict[str, Sequence[str]] = field(default_factory=dict)
    predicates: Sequence[str] = ()
    verbs: Sequence[str] = ()
    story: Sequence[str] = ()
    titles: Sequence[str] = ()
    stop_names: Sequence[str] = ()
    dialog_types: Sequence[str] = ("dialog", "conversation")
    least_names: int = 2
    snippet: int = 20


def _id(kind: str, *parts) -> Column:
    return F.xxhash64(F.lit(kind), *[F.col(p) if isinstance(p, str) else p for p in parts])


def _capitalised(rest: str) -> str:
    """Pattern of a whole run of A-Z and a-z that is a capital and so many small letters."""
    return f"(?<![A-Za-z])[A-Z][a-z]{rest}(?![A-Za-z])"


def tag(docs: DataFrame, profile: Profile) -> DataFrame:
    """One row a sentence of docs (doc_id, title, doc_type, text), and one with pos null for a document without any: doc_id,
    title, doc_type, pos, sentence, attributes (array of attribute and word), predicate, snippet, evidence, names. If names
    after titles are looked for, there is also a row a line, as a title's point would end a sentence: pos null, titled."""
    first = lambda words: F.coalesce(*[F.when(F.contains("sentence", F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))
    part = lambda pos, sentence, line: F.struct(pos.cast("int").alias("pos"), sentence.cast("string").alias("sentence"), line.cast("string").alias("line"))
    parts = F.transform(sentences(F.col("text")), lambda s, i: part(i, s, F.lit(None)))
    if profile.titles:
        parts = F.concat(parts, F.transform(F.split("text", "\n"), lambda s: part(F.lit(None), F.lit(None), s)))
    rows = docs.select("doc_id", "title", F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.explode_outer(parts).alias("p")).select("doc_id", "title", "doc_type", "p.*")
    hits = [F.struct(F.lit(a).alias("key"), first(words).alias("value")) for a, words in sorted(profile.hints.items())]
    empty = F.array().cast("array<struct<key:string,value:string>>")
    attributes = F.filter(F.array(*hits), lambda s: s["value"].isNotNull()) if hits else empty
    predicate = first(profile.predicates)
    rows = rows.withColumns({"attributes": attributes, "predicate": predicate, "evidence": F.coalesce(any_of(F.col("sentence"), list(profile.verbs)), F.lit(False)) if profile.verbs else F.lit(False)})
    after = F.expr("substring(sentence, instr(sentence, predicate) + length(predicate))")
    names = F.filter(F.regexp_extract_all("sentence", F.lit(f"({_capitalised('{1,19}')})"), F.lit(1)), lambda t: ~t.isin(list(profile.stop_names)))
    titled = title_name(F.col("line"), profile.titles, profile.stop_names) if profile.titles else F.lit(None).cast("string")
    return rows.withColumns({"snippet": F.substring(F.trim(after), 1, profile.snippet), "names": names, "titled": titled}).drop("line")


def compile_documents(docs: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """Tables of docs (doc_id, title, doc_type, text): documents, chapters (one a document), objects, edges, evidence, links
    (of objects and evidence), profiles, world_entities and world_profiles.

    A document whose title could be a person's, and which is no dialog, is an object of that name, with properties (JSON)
    of its different attributes, its relations in text order (predicate, target_snippet, sentence) and doc_type. Names met
    at least least_names times, and names after a title, are persons as well, found in the text; sentences that name one of
    them and tell a story are events with a participated_in edge. Dialogs have evidence only. Null texts and empty ones have a
    document and a chapter; of rows that repeat a doc_id one stays, the least by title and text.
    """
    whole = F.struct(F.col("title"), F.col("text"), F.col("doc_type"))
    docs = docs.where("doc_id is not null")
    # ids that repeat are looked for by themselves, so that only the texts of those are shuffled
    again = checkpointed(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(whole).alias("d")).select("doc_id", "d.*")
    docs = docs.join(again, "doc_id", "left_anti").select(least.columns).unionByName(least)
    tagged = checkpointed(tag(docs, profile))
    is_dialog = any_of(F.col("doc_type"), list(profile.dialog_types))
    heads = checkpointed(tagged.select("doc_id", "title", "doc_type").distinct())
    heads = heads.withColumns({"dialog": F.coalesce(is_dialog, F.lit(False)), "named": person_like(F.col("title"))})
    documents = heads.select("doc_id", "title", "doc_type")
    chapters = heads.select(_id("chapter", "doc_id", F.lit(1)).alias("id"), "doc_id", F.lit(1).alias("chapter_no"), "title")
    said = tagged.where("pos is not null")
    evidence = said.where("evidence").select(_id("evidence", "doc_id", "pos").alias("id"), "doc_id", _id("chapter", "doc_id", F.lit(1)).alias("chapter_id"), "pos", F.col("sentence").alias("content"))

    subjects = heads.where("named and not dialog")
    attributes = said.select("doc_id", F.explode("attributes").alias("a")).groupBy("doc_id").agg(F.array_sort(F.collect_set("a")).alias("attributes"))
    told = F.struct("pos", "predicate", F.col("snippet").alias("target_snippet"), "sentence")
    relations = said.where("predicate is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(told)), lambda s: F.struct(s["predicate"].alias("predicate"), s["target_snippet"].alias("target_snippet"), s["sentence"].alias("sentence"))).alias("relations"))
    kinds = {"attributes": "array<struct<key:string,value:string>>", "relations": "array<struct<predicate:string,target_snippet:string,sentence:string>>"}
    own = subjects.join(attributes, "doc_id", "left").join(relations, "doc_id", "left").withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in kinds.items()})
    own = own.select("doc_id", F.col("title").alias("name"), F.to_json(F.struct("attributes", "relations", "doc_type")).alias("properties"), F.lit(0.8).alias("confidence"), F.lit(0.5).alias("importance"))

    met = said.select("doc_id", F.explode("names").alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= profile.least_names).select("doc_id", "name", "n", F.lit("corpus").alias("source"))
    after_title = tagged.where("titled is not null").groupBy("doc_id", F.col("titled").alias("name")).agg(F.count("*").alias("n")).select("doc_id", "name", "n", F.lit("title").alias("source"))
    found = met.unionByName(after_title).join(heads.where("not dialog").select("doc_id", "title"), "doc_id").where("title is null or name <> title")
    found = found.select("doc_id", "name", F.to_json(F.struct(F.lit(True).alias("discovered"), "source", F.col("n").alias("frequency"))).alias("properties"), F.lit(0.7).alias("confidence"), F.lit(0.6).alias("importance"))
    people = own.unionByName(found)
    persons = people.select(_id("person", "doc_id", "name").alias("id"), "doc_id", F.lit("person").alias("object_type"), "name", "properties", "confidence")

    stories = story_events(said.select("doc_id", "pos", "sentence"), people.select("doc_id", "name"), list(profile.story), word=_capitalised("*")) if profile.story else None  # no other single word is person_like
    if stories is None:
        objects = persons
        edges = persons.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("").alias("predicate"), "doc_id", F.lit(0).alias("pos")).where("false")
    else:
        event = _id("event", "doc_id", "title").alias("id")
        events = stories.select(event, "doc_id", F.lit("event").alias("object_type"), F.col("title").alias("name"), F.lit("{}").alias("properties"), F.lit(0.7).alias("confidence")).distinct()
        objects = persons.unionByName(events)
        edges = stories.select(_id("person", "doc_id", "name").alias("source_id"), _id("event", "doc_id", "title").alias("target_id"), F.lit("participated_in").alias("predicate"), "doc_id", "pos")
    links = evidence.select("doc_id", F.col("id").alias("evidence_id")).join(subjects.select("doc_id", _id("person", "doc_id", "title").alias("object_id")), "doc_id")
    profiles = subjects.join(said.select("doc_id", F.explode("attributes").alias("a")), "doc_id").select("doc_id", F.col("title").alias("name"), "a.key", "a.value").distinct()
    world = people.groupBy("name").agg(F.max("importance").alias("importance")).select("name", F.lit("person").alias("kind"), "importance")
    world_profiles = profiles.groupBy("name", "key").agg(F.max("value").alias("value")).withColumn("confidence", F.lit(0.8))
    return {"documents": documents, "chapters": chapters, "objects": objects, "edges": edges, "evidence": evidence, "links": links, "profiles": profiles, "world_entities": world, "world_profiles": world_profiles}


def recompile(tables: dict[str, DataFrame], docs: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """The tables with the documents of docs compiled anew: what they had before goes, all other rows stay as they are.

    Entities of the world stay once they are known; a name's importance is the largest there was, its profile the last.
    """
    new = compile_documents(docs, profile)
    old = purge({k: tables[k] for k in OF_DOCUMENTS}, docs.select("doc_id"))
    out = {k: old[k].unionByName(new[k]) for k in OF_DOCUMENTS}
    out["world_entities"] = tables["world_entities"].unionByName(new["world_entities"]).groupBy("name", "kind").agg(F.max("importance").alias("importance"))
    out["world_profiles"] = upsert(tables["world_profiles"], new["world_profiles"], ["name", "key"], "value")
    return out


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n): documents, persons, events, edges and evidence that were written."""
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    out = n(tables["documents"], "documents")
    for kind, df in (("persons", tables["objects"].where("object_type = 'person'")), ("events", tables["objects"].where("object_type = 'event'")), ("edges", tables["edges"]), ("evidence", tables["evidence"])):
        out = out.unionByName(n(df, kind))
    return out
