"""Narrative compiler: sentences, chapters, mentions, events, relations and arcs from prose.

Documents have doc_id and text. Places are counted in UTF-8 bytes where a distance is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.lexicons import ARC_NEGATIVE, ARC_POSITIVE
from engram.functions.text import any_of, chapter_number, chunks, sentences, year
from engram.operators.lexicon import lexicon_places, with_places


def sentence_rows(docs: DataFrame) -> DataFrame:
    """One row a sentence: doc_id, pos, sentence."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def chunk_rows(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """One row a chunk: doc_id, chunk_no, chunk."""
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))


def headed(rows: DataFrame) -> DataFrame:
    """Sentences with the chapter (or year, which comes first) of the last header up to them."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.coalesce(year(F.col("sentence")), chapter_number(F.col("sentence")))
    return rows.withColumn("chapter", F.last(mark, ignorenulls=True).over(w))


def split_chapters(docs: DataFrame) -> DataFrame:
    """One row a chapter: doc_id, chapter, body. A header line counts if its number is over all before it."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", chapter_number(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    best = F.max("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("head", F.when(F.col("n") > F.coalesce(best, F.lit(0)), F.col("n")))
    lines = lines.withColumn("chapter", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    return lines.where("chapter is not null").groupBy("doc_id", "chapter").agg(body.alias("body"))


def capitalised(docs: DataFrame, stop: Sequence[str] = (), least: int = 2) -> DataFrame:
    """(name, n): whole runs of ASCII letters that are one capital and 1 to 19 small letters, met at least `least` times."""
    runs = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda t: t.rlike("^[A-Z][a-z]{1,19}$") & ~t.isin(list(stop)))
    return docs.select(F.explode(runs).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def speakers(docs: DataFrame, verbs: Sequence[str], least: int = 2, gap: int = 12) -> DataFrame:
    """(name, n): capitalised words right before a speech verb; one within `gap` bytes of the same name's last counts once."""
    pattern = r"([A-Z][a-z]{1,19}) (?:" + "|".join(map(re.escape, verbs)) + r")(?![A-Za-z])"
    parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?={pattern})")).alias("i", "part"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("at", F.coalesce(F.sum(F.octet_length("part")).over(w), F.lit(0))).withColumn("name", F.regexp_extract("part", "^" + pattern, 1)).where("name <> ''")
    last = F.lag("at").over(Window.partitionBy("doc_id", "name").orderBy("at"))
    return at.withColumn("fresh", F.coalesce(F.col("at") - last >= gap, F.lit(True))).where("fresh").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mentions(rows: DataFrame, aliases: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Names in sentences, leftmost and longest first, without overlap: doc_id, pos, canonical, alias, start (bytes).

    aliases is a table (alias, canonical), or a list of such pairs, of any length: see operators.lexicon. An alias that
    occurs twice stands for its last canonical name in a list, for its least in a table.
    """
    if not isinstance(aliases, DataFrame):
        aliases = rows.sparkSession.createDataFrame(list(dict(aliases).items()), "alias string, canonical string")
    forms = aliases.select(F.col("alias").alias("form"), "canonical")
    return lexicon_places(rows, forms, "longest").select("doc_id", "pos", "canonical", F.col("matched").alias("alias"), "start")


def short_mentions(rows: DataFrame, shorts: Sequence[tuple[str, str]], verbs: Sequence[str]) -> DataFrame:
    """Names of one character: doc_id, pos, canonical, alias, start (bytes). A character (form, canonical) is a name where no
    Han character is before it and one of the verbs follows at once."""
    forms = rows.sparkSession.createDataFrame(list(dict(shorts).items()), "form string, canonical string")
    found = with_places(rows.select("doc_id", "pos", "sentence"), forms, rule="all").select("doc_id", "pos", "sentence", F.inline("found"))
    alone = (F.col("at") == 0) | ~F.col("sentence").substr(F.col("at"), F.lit(1)).rlike(r"[\x{4e00}-\x{9fff}]")
    behind = F.col("sentence").substr(F.col("at") + F.length("matched") + 1, F.lit(max(map(len, verbs))))
    return found.where(alone & behind.rlike("^(?:" + "|".join(map(re.escape, verbs)) + ")")).select("doc_id", "pos", "canonical", F.col("matched").alias("alias"), "start")


def with_mentions(rows: DataFrame, aliases: DataFrame, found: str = "named") -> DataFrame:
    """rows (doc_id, pos, sentence and what else they have) with an array of their names as mentions() reads them: canonical,
    matched, start, end (bytes) and at (characters). Nothing is shuffled, so what is read off the array costs each task what
    its own sentences cost. Rows without a doc_id or pos go, and those without a name; doc_id and pos are a row's own."""
    forms = aliases.select(F.col("alias").alias("form"), "canonical")
    return with_places(rows.where("doc_id is not null and pos is not null"), forms, rule="longest", name=found).where(F.size(found) > 0)


def gathered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """with_mentions() of rows from mentions that were found elsewhere (doc_id, pos, canonical, alias, start)."""
    one = F.struct("canonical", F.col("alias").alias("matched"), "start", (F.col("start") + F.octet_length("alias")).alias("end"))
    j = rows.join(found.groupBy("doc_id", "pos").agg(F.collect_set(one).alias("named")), ["doc_id", "pos"])
    at = lambda m: F.length(F.decode(F.substring(F.encode("sentence", "utf-8"), F.lit(1), m["start"]), "utf-8"))
    return j.withColumn("named", F.transform("named", lambda m: F.struct(m["canonical"].alias("canonical"), m["matched"].alias("matched"), m["start"].alias("start"), m["end"].alias("end"), at(m).alias("at"))))


def _all_places(rows: DataFrame, forms: Sequence[str], name: str) -> DataFrame:
    """(doc_id, pos, named, name, at): every place, in bytes, of every form in a sentence; places of one form don't overlap."""
    hit = F.filter(F.array(*map(F.lit, forms)), lambda v: F.contains("sentence", v))
    v = rows.select("doc_id", "pos", "named", "sentence", F.explode(hit).alias(name))
    parts = F.split("sentence", F.concat(F.lit(r"\Q"), F.col(name), F.lit(r"\E")))
    before = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.octet_length(F.array_join(F.slice("parts", F.lit(1), i), "")) + (i - 1) * F.octet_length(name))
    return v.withColumn("parts", parts).select("doc_id", "pos", "named", name, F.explode(before).alias("at"))


def _last_before(at: Column, reach: int | None = None) -> Column:
    """The canonical name of the last of the array `named` that ends at `at` at most, and less than reach bytes before."""
    good = F.filter("named", lambda m: (m["end"] <= at) & (F.lit(True) if reach is None else at - m["end"] < reach))
    return F.array_max(F.transform(good, lambda m: F.struct(m["end"].alias("end"), m["canonical"].alias("canonical"))))["canonical"]


def _first_behind(at: Column, reach: int | None = None) -> Column:
    """The canonical name of the first of the array `named` that starts at `at` at least, and less than reach bytes after."""
    good = F.filter("named", lambda m: (m["start"] >= at) & (F.lit(True) if reach is None else m["start"] - at < reach))
    return F.array_min(F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["canonical"].alias("canonical"))))["canonical"]


def verb_events(found: DataFrame, rows: DataFrame, verbs: Sequence[str], reach: int = 50) -> DataFrame:
    """verb_events_of() with names that were found elsewhere: found is mentions() of rows."""
    return verb_events_of(gathered(rows, found), verbs, reach)


def verb_events_of(rows: DataFrame, verbs: Sequence[str], reach: int = 50) -> DataFrame:
    """Events `subject verb object`, one for each place of a verb: doc_id, pos, verb, subject, object. The subject is the last
    name that ends less than reach bytes before the verb, the object the first that starts less than reach bytes after it,
    or null; both are in its sentence. Without a subject there is no event. rows are those of with_mentions()."""
    j = _all_places(rows, verbs, "verb")
    who, whom = _last_before(F.col("at"), reach), _first_behind(F.col("at") + F.octet_length("verb"), reach)
    # rows that repeat give their events once
    return j.select("doc_id", "pos", "verb", "at", who.alias("subject"), whom.alias("object")).where("subject is not null").distinct().drop("at")


def dialogue_events(found: DataFrame, rows: DataFrame, markers: Sequence[str]) -> DataFrame:
    """dialogue_events_of() with names that were found elsewhere: found is mentions() of rows."""
    return dialogue_events_of(gathered(rows, found), markers)


def dialogue_events_of(rows: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Who speaks to whom: doc_id, pos, marker, speaker, addressee, title, description, importance. For the first place of a
    marker in a sentence the speaker is the last name that ends before it, the addressee the first that starts after it,
    or null; the description is what stands before the marker. Without a speaker there is no event. rows are those of
    with_mentions()."""
    hit = F.filter(F.array(*map(F.lit, markers)), lambda v: F.contains("sentence", v))
    m = rows.select("doc_id", "pos", "named", "sentence", F.explode(hit).alias("marker"))
    m = m.withColumn("description", F.expr("substring(sentence, 1, instr(sentence, marker) - 1)")).withColumn("at", F.octet_length("description"))
    g = m.select("doc_id", "pos", "marker", "description", _last_before(F.col("at")).alias("speaker"), _first_behind(F.col("at") + F.octet_length("marker")).alias("addressee"))
    return g.where("speaker is not null").distinct().select("doc_id", "pos", "marker", "speaker", "addressee", F.concat("speaker", F.lit("曰")).alias("title"), "description", F.lit(0.5).alias("importance"))


def associations(events: DataFrame) -> DataFrame:
    """(doc_id, a, b, first_pos, n): pairs of names in one event, each unordered pair once."""
    p = events.where("subject is not null and object is not null and subject <> object")
    return p.groupBy("doc_id", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def story_events(rows: DataFrame, cast: DataFrame, verbs: Sequence[str], shortest: int = 6, longest: int = 80, title: int = 24, word: str = "[A-Za-z]+") -> DataFrame:
    """Events of sentences that name someone of the cast (doc_id, name) and hold a verb: doc_id, title, name, pos, n.

    Sentences have 6 to 80 characters; the title is the first 24, one event for each title of a document; one row a
    member of the cast in it, at its first sentence, with the number of sentences. word is the pattern of what is looked for
    in the cast: a narrower one spares rows where no other words can be in it.
    """
    good = rows.where(F.length("sentence").between(shortest, longest) & any_of(F.col("sentence"), verbs))
    words = good.select("doc_id", "pos", F.substring("sentence", 1, title).alias("title"), F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(f"({word})"), F.lit(1)))).alias("name"))
    return words.join(cast.select("doc_id", "name").distinct(), ["doc_id", "name"]).groupBy("doc_id", "title", "name").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


def relation_type(verb: Column, hostile: Sequence[str], friendly: Sequence[str], has_subject: Column) -> Column:
    return F.when(has_subject & verb.isin(list(hostile)), "enemy").when(has_subject & verb.isin(list(friendly)), "ally").otherwise("associated")


def relation_timeline(observed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Intervals of one relation type for each ordered pair: doc_id, a, b, relation, valid_from, valid_to (null: open).

    observed has doc_id, a, b, time, relation; runs of one type are one interval, ending where the next type begins. known
    has doc_id, a, b, relation, valid_from: relations from before, which hold until the first other type is observed. They
    come before every observation of their pair, whatever their time, and of several the first by time and type counts.
    """
    o = observed.groupBy("doc_id", "a", "b", "time").agg(F.min("relation").alias("relation")).withColumn("seen", F.lit(1))
    if known is not None:
        old = known.groupBy("doc_id", "a", "b").agg(F.min(F.struct(F.col("valid_from").alias("time"), "relation")).alias("k"))
        o = o.unionByName(old.select("doc_id", "a", "b", "k.time", "k.relation", F.lit(0).alias("seen")))
    w = Window.partitionBy("doc_id", "a", "b").orderBy("seen", "time")
    starts = o.withColumn("old", F.lag("relation").over(w)).where("old is null or old <> relation")
    return starts.withColumn("valid_to", F.lead("time").over(w)).select("doc_id", "a", "b", "relation", F.col("time").alias("valid_from"), "valid_to")


def both_ways(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) and the same with a and b exchanged: relations observed or known of one direction hold for both."""
    return pairs.unionByName(pairs.withColumns({"a": F.col("b"), "b": F.col("a")})).where("a <> b")


def timeline_of_pairs(observed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """relation_timeline() of both directions of every pair, its open intervals once only, from the smaller name: closed ones
    are of one direction each. confidence is 0.8."""
    t = relation_timeline(both_ways(observed), None if known is None else both_ways(known))
    return t.where("valid_to is not null or a <= b").withColumn("confidence", F.lit(0.8))


def personality_markers(lines: DataFrame, names: Sequence[str] | DataFrame, keywords: Sequence[str], stops: str = "，。；", reach: int = 25, least_bytes: int = 10, context: int = 120) -> DataFrame:
    """Traits that a text tells of a name: doc_id, pos, name, keyword, trait, context, confidence.

    In a line (doc_id, pos, line) of least_bytes or more, trimmed, each keyword that it holds speaks of the first of names
    (a list, or a table of rank and name) that it holds too, if the first places of both are less than reach bytes apart.
    The trait is what follows the keyword up to a stop; an empty one is none.

    One pass of an automaton for the names and one for the keywords; a line's places are compared inside its row.
    """
    spark = lines.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "rank int, name string")
    marks = spark.createDataFrame(list(enumerate(dict.fromkeys(keywords))), "rank int, form string")
    rows = lines.select("doc_id", "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("sentence")).where(F.octet_length("sentence") >= least_bytes)
    rows = with_places(rows, names.select("rank", F.col("name").alias("form")), rule="all", name="who")
    rows = with_places(rows.where("size(who) > 0"), marks, rule="all", name="what")
    rows = rows.withColumn("who", F.array_min(F.transform("who", lambda m: F.struct(m["rank"], m["start"], m["matched"]))))
    ranks = F.transform("what", lambda m: m["rank"])
    first = F.filter("what", lambda m, i: F.array_position(ranks, m["rank"]) == i + 1)
    each = rows.select("doc_id", "pos", "sentence", "who", F.explode(first).alias("m")).where(F.abs(F.col("m.start") - F.col("who.start")) < reach)
    after = F.col("sentence").substr(F.col("m.at") + F.length("m.matched") + 1, F.length("sentence"))
    trait = F.regexp_extract(after, f"^([^{re.escape(stops)}]*)", 1)
    return each.select("doc_id", "pos", F.col("who.matched").alias("name"), F.col("m.matched").alias("keyword"), trait.alias("trait"), F.substring("sentence", 1, context).alias("context"), F.lit(0.7).alias("confidence")).where("trait <> ''")


def polarity(trait: Column, positive: Sequence[str] = ARC_POSITIVE, negative: Sequence[str] = ARC_NEGATIVE) -> Column:
    """1 if the trait holds a positive word, else -1 if it holds a negative one, else 0."""
    return F.when(any_of(trait, positive), 1).when(any_of(trait, negative), -1).otherwise(0)


def arcs(traits: DataFrame, positive: Sequence[str] = ARC_POSITIVE, negative: Sequence[str] = ARC_NEGATIVE) -> DataFrame:
    """(doc_id, name, arc, n) from traits (doc_id, name, pos, trait): stable if the first and the last are the same text, else
    decline from a positive to a negative one, growth the other way, transformation otherwise. At one pos the least trait
    is first and the largest last."""
    at = F.struct("pos", "trait")
    g = traits.groupBy("doc_id", "name").agg(F.min(at)["trait"].alias("x"), F.max(at)["trait"].alias("y"), F.count("*").alias("n"))
    x, y = polarity(F.col("x"), positive, negative), polarity(F.col("y"), positive, negative)
    arc = F.when(F.col("x") == F.col("y"), "stable").when((x > 0) & (y < 0), "decline").when((x < 0) & (y > 0), "growth").otherwise("transformation")
    return g.select("doc_id", "name", arc.alias("arc"), "n")


def factions(events: DataFrame, start: DataFrame, surrender: Sequence[str], betray: Sequence[str], unknown: str = "未知") -> DataFrame:
    """Moves between factions in event order: doc_id, pos, name, old, new, kind.

    start has doc_id, name, faction. Who surrenders to one of another faction moves there; a betrayal is recorded. Each
    move depends on all before it, so a document's events are read in order in one task, as a stream that keeps the
    current faction of each name.
    """
    acts = events.where(F.col("verb").isin([*surrender, *betray]) & F.col("subject").isNotNull() & F.col("object").isNotNull())
    # members come before the acts of their document, a row each, so that no act carries all of them
    rows = acts.select("doc_id", F.lit(1).alias("act"), "pos", "verb", "subject", "object")
    rows = rows.unionByName(start.where("doc_id is not null").select("doc_id", F.lit(0).alias("act"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("verb"), F.col("name").alias("subject"), F.col("faction").alias("object")))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "act", "pos", "verb", "subject", "object")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, now = None, {}
        for b in batches:
            out = []
            for i, act, pos, verb, subject, object_ in zip(*(b[c].tolist() for c in ("doc_id", "act", "pos", "verb", "subject", "object"))):
                if i != doc:
                    doc, now = i, {}
                if not act:
                    now[subject] = object_
                    continue
                old, other = now.get(subject, unknown), now.get(object_, unknown)
                if verb in surrender and old != other and other != unknown:
                    now[subject] = other
                    out.append((doc, int(pos), subject, old, other, "surrender"))
                elif verb in betray:
                    out.append((doc, int(pos), subject, old, old, "betrayal"))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "name", "old", "new", "kind"])

    return rows.mapInPandas(run, "doc_id long, pos int, name string, old string, new string, kind string")


def check_lexicon(lexicon: DataFrame) -> DataFrame:
    """Faults of a lexicon (id, language, form): ids or forms of a language that occur twice: kind, value, n."""
    ids = lexicon.select("id", "language").distinct().groupBy(F.col("id").alias("value")).agg(F.count("*").alias("n")).select(F.lit("id").alias("kind"), "value", "n")
    forms = lexicon.groupBy(F.concat_ws("/", "language", "form").alias("value")).agg(F.count("*").alias("n")).select(F.lit("form").alias("kind"), "value", "n")
    return ids.unionByName(forms).where("n > 1")


def prefix_forms(lexicon: DataFrame, prefix: str, k: int = 20) -> DataFrame:
    """The first k forms of a lexicon (id, form) that begin with the text, lower case, by form and id."""
    return lexicon.where(F.lower("form").startswith(prefix.lower())).orderBy("form", "id").limit(k)


#: Where a value taken from a sentence ends.
STOPS = "，,。；、\n：;"


def value_after(text: Column, mark: str) -> Column:
    """What follows the first mark, up to the next stop, trimmed; null if the mark isn't there or nothing follows."""
    return _value(text, re.escape(mark) + f"([^{STOPS}]*)")


def value_before(text: Column, mark: str) -> Column:
    """What stands before the first mark, from the stop before it; in time that is linear in the text."""
    head = F.regexp_replace(F.substring_index(text, mark, 1), f"(?s)^.*[{STOPS}]", "")
    return F.when(F.contains(text, F.lit(mark)), F.nullif(F.trim(head), F.lit("")))


def value_between(text: Column, start: str, end: str) -> Column:
    return _value(text, re.escape(start) + f"([^{STOPS}]*?)" + re.escape(end))


def _value(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def without_overlap(spans: DataFrame) -> DataFrame:
    """Of a group's spans (group_id, start, length, name) those that a greedy reader keeps: by start, the longest first, each
    that begins where the last kept one has ended or later. A group is one chapter, folded as an array."""
    one = "array<struct<start:bigint,length:bigint,name:string>>"
    rows = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), (-F.col("length")).cast("long").alias("o"), "name")))
    kept = F.aggregate(
        rows,
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(one).alias("out")),
        lambda a, x: F.when(x["start"] >= a["end"], F.struct((x["start"] - x["o"]).alias("end"), F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), (-x["o"]).alias("length"), x["name"].alias("name")))).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return spans.groupBy("group_id").agg(kept.alias("k")).select("group_id", F.inline("k"))


def attribute_hints(rows: DataFrame, attributes: dict[str, Sequence[str]]) -> DataFrame:
    """Per document and attribute, the first sentence with one of its words and that word: doc_id, attribute, word, sentence."""
    words = [(a, i, w) for a, ws in attributes.items() for i, w in enumerate(ws)]
    hit = F.filter(F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(i).alias("i"), F.lit(w).alias("word")) for a, i, w in words]), lambda s: F.contains("sentence", s["word"]))
    each = rows.select("doc_id", "pos", "sentence", F.explode(hit).alias("h"))
    first = F.min_by(F.struct("h.word", "sentence"), F.struct("pos", "h.i"))
    return each.groupBy("doc_id", F.col("h.attribute").alias("attribute")).agg(first.alias("f")).select("doc_id", "attribute", "f.word", "f.sentence")


def relation_snippets(rows: DataFrame, predicates: Sequence[str], size: int = 20) -> DataFrame:
    """Sentences with a predicate, the first in list order, and the text after it: doc_id, pos, predicate, snippet."""
    first = F.try_element_at(F.filter(F.array(*map(F.lit, predicates)), lambda p: F.contains("sentence", p)), F.lit(1))
    r = rows.withColumn("predicate", first).where("predicate is not null")
    return r.select("doc_id", "pos", "predicate", F.expr(f"substring(sentence, instr(sentence, predicate) + length(predicate), {int(size)})").alias("snippet"))
