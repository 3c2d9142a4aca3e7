"""The character model (characters, events, relations of novels with chapters) as a knowledge graph.

Ids are hashes of what a row is, so migrating a novel again gives the same rows, and migrated() replaces a document's rows
whole. Evidence has three kinds of links: from events, from relations, and from persons to the places they are first
named at in each chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.graph import checkpointed, purge
from engram.operators.lexicon import with_places

TABLES = ("documents", "chapters", "objects", "edges", "evidence", "links", "mentions", "runs")


def _id(kind: str, *parts) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _whole(text: Column, at: Column) -> Column:
    """The start of the character that holds the byte at this place of a UTF-8 text."""
    inner = lambda k: F.hex(F.substring(text, at - k + 1, F.lit(1))).rlike("^[89AB]")  # noqa: E731  a byte that begins no character
    return F.when(inner(0) & inner(1) & inner(2), at - 3).when(inner(0) & inner(1), at - 2).when(inner(0), at - 1).otherwise(at)


def migrate(documents: DataFrame, chapters: DataFrame, characters: DataFrame, events: DataFrame, relations: DataFrame, version: str = "1", before: int = 40, after: int = 80) -> dict[str, DataFrame]:
    """Tables of documents (doc_id, title), chapters (doc_id, chapter_no, text), characters (doc_id, name, aliases, importance,
    properties as JSON), events (doc_id, name, title, chapter, description, related) and relations (doc_id, a, b,
    relation, chapter, description, confidence).

    Chapters get their places in bytes of all chapters of their document, by number. Persons are objects; an event is one
    object for each title and chapter of a document, whoever tells of it, with an edge participated_in from each character
    that has it. A relation between persons is an edge. Descriptions are evidence if their chapter is there: a relation's of
    its edge, an event's of the event, of the edge and of the person. A person's first place in each chapter, by name or
    alias, the longer at one place, is a mention, and the text from `before` bytes ahead of it to `after` behind is evidence.

    Documents without chapters, and what belongs to none, are left out; repeated rows count once; null descriptions are no
    evidence; names are looked for by an automaton of all names of all documents (see operators.lexicon).
    """
    chapters = chapters.where("text is not null").groupBy("doc_id", "chapter_no").agg(F.min("text").alias("text"))
    documents = documents.groupBy("doc_id").agg(F.min("title").alias("title")).join(chapters.select("doc_id").distinct(), "doc_id", "left_semi")
    end = F.sum(F.octet_length("text")).over(Window.partitionBy("doc_id").orderBy("chapter_no"))
    places = chapters.withColumns({"id": _id("chapter", "doc_id", "chapter_no"), "end_offset": end})
    places = places.withColumn("start_offset", F.col("end_offset") - F.octet_length("text"))
    known = places.select("doc_id", F.col("chapter_no").alias("chapter"), F.col("id").alias("chapter_id"))

    people = characters.where("name is not null").groupBy("doc_id", "name").agg(F.max(F.struct("importance", "properties", "aliases")).alias("c")).join(documents.select("doc_id"), "doc_id", "left_semi")
    people = people.select("doc_id", "name", "c.*").withColumn("id", _id("person", "doc_id", "name"))
    person = people.select("doc_id", "name", F.col("id").alias("person_id"))
    told = events.join(person, ["doc_id", "name"]).withColumn("event_id", _id("event", "doc_id", "title", "chapter"))
    told = told.withColumn("edge_id", _id("edge", "person_id", "event_id"))
    happened = told.groupBy("event_id", "doc_id", "title", "chapter").agg(F.min(F.struct("description", "related")).alias("e"))
    took = told.select("edge_id", "event_id", "doc_id", "chapter", "person_id").distinct()

    objects = people.select("id", "doc_id", F.lit("person").alias("object_type"), "name", "properties", F.col("importance").alias("confidence"))
    objects = objects.unionByName(happened.select(F.col("event_id").alias("id"), "doc_id", F.lit("event").alias("object_type"), F.col("title").alias("name"), F.to_json(F.struct("chapter", "e.description", F.col("e.related").alias("related_characters"))).alias("properties"), F.lit(0.8).alias("confidence")))
    a, b = (person.select("doc_id", F.col("name").alias(c), F.col("person_id").alias(f"{c}_id")) for c in "ab")
    related = relations.distinct().join(a, ["doc_id", "a"]).join(b, ["doc_id", "b"])
    edge = _id("edge", "doc_id", "a_id", "b_id", "relation", "chapter", F.coalesce("description", F.lit("")))
    related = related.withColumn("edge_id", edge)
    edges = took.select(F.col("edge_id").alias("id"), "doc_id", F.col("person_id").alias("source_id"), F.col("event_id").alias("target_id"), F.lit("participated_in").alias("predicate"), F.col("chapter").alias("valid_from"), F.lit(1.0).alias("confidence"))
    edges = edges.unionByName(related.select(F.col("edge_id").alias("id"), "doc_id", F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.col("relation").alias("predicate"), F.col("chapter").alias("valid_from"), "confidence"))

    forms = people.select("doc_id", F.col("id").alias("person_id"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias")).where("alias <> ''")
    # all documents' names are looked for at once, and a document's own are kept by a join: their number is not that of pairs
    met = with_places(places.select("doc_id", F.col("id").alias("chapter_id"), "text"), forms.select(F.col("alias").alias("form")).distinct(), "text", "all", by=["chapter_id"])
    met = met.select("doc_id", "chapter_id", F.explode("found").alias("m")).groupBy("doc_id", "chapter_id", F.col("m.matched").alias("alias")).agg(F.min("m.start").alias("start"))
    first = F.min_by(F.struct("alias", "start"), F.struct("start", -F.octet_length("alias")))
    named = met.join(forms, ["doc_id", "alias"]).groupBy("doc_id", "chapter_id", "person_id").agg(first.alias("m")).select("doc_id", "chapter_id", "person_id", "m.*")
    named = named.withColumn("end", F.col("start") + F.octet_length("alias")).join(places.select("doc_id", F.col("id").alias("chapter_id"), "text"), ["doc_id", "chapter_id"])
    raw = F.encode("text", "utf-8")
    named = named.withColumns({"low": _whole(raw, F.greatest(F.col("start") - before, F.lit(0))), "high": F.when(F.col("end") + after >= F.octet_length("text"), F.octet_length("text")).otherwise(_whole(raw, F.col("end") + after))})
    named = named.withColumn("content", F.decode(F.substring(raw, F.col("low") + 1, F.col("high") - F.col("low")), "utf-8")).drop("text")
    named = checkpointed(named)
    mentions = named.select(_id("mention", "person_id", "chapter_id").alias("id"), "doc_id", F.col("person_id").alias("object_id"), "chapter_id", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.col("alias").alias("alias_used"), F.lit(1.0).alias("confidence"))

    none = F.lit(None).cast("int")
    link = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("source_id"))
    described = lambda df, *links: df.where("description is not null").join(known, ["doc_id", "chapter"]).select("doc_id", "chapter_id", none.alias("start_offset"), none.alias("end_offset"), F.col("description").alias("content"), F.array(*links).alias("links"))
    said = described(told, link("object", "event_id"), link("edge", "edge_id"), link("object", "person_id")).unionByName(described(related, link("edge", "edge_id")))
    said = said.unionByName(named.select("doc_id", "chapter_id", F.col("low").alias("start_offset"), F.col("high").alias("end_offset"), "content", F.array(link("object", "person_id")).alias("links")))
    said = said.withColumn("id", _id("evidence", "chapter_id", F.coalesce("start_offset", F.lit(-1)), "content", "links"))
    evidence = said.select("id", "doc_id", "chapter_id", "start_offset", "end_offset", "content").distinct()
    links = said.select("doc_id", F.col("id").alias("evidence_id"), F.inline("links")).distinct()

    out = {"documents": documents, "chapters": places.select("id", "doc_id", "chapter_no", F.col("text").alias("content"), "start_offset", "end_offset"), "objects": objects, "edges": edges, "evidence": evidence, "links": links, "mentions": mentions}
    counts = documents.select("doc_id")
    for k in ("objects", "edges", "evidence", "mentions", "chapters"):
        counts = counts.join(out[k].groupBy("doc_id").agg(F.count("*").alias(k)), "doc_id", "left").withColumn(k, F.coalesce(k, F.lit(0).cast("long")))
    out["runs"] = counts.select("doc_id", F.lit(version).alias("version"), F.lit("completed").alias("status"), F.to_json(F.struct("objects", "edges", "evidence", "mentions", "chapters")).alias("statistics"))
    return out


def migrated(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the documents of new put in, in place of all rows that they had before."""
    old = purge({k: tables[k] for k in TABLES}, new["documents"])
    return {k: old[k].unionByName(new[k]) for k in TABLES}
