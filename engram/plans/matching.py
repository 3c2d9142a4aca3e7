"""Queries of lexicon matching and what is read off it: mentions, profiles, deaths, relation types, markers, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.operators import corpus as K
from engram.operators import lexicon as X
from engram.operators import narrative as N
from engram.operators import people as P
from engram.plans.narrative import SENT, docs
from engram.plans.registry import query, quoted


def values_sql(rows, names: str) -> str:
    """Rows of strings and numbers as a VALUES table for DuckDB."""
    say = lambda x: "NULL" if x is None else "true" if x is True else "false" if x is False else f"'{quoted(x)}'" if isinstance(x, str) else "[" + ", ".join(map(say, x)) + "]::VARCHAR[]" if isinstance(x, list) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows) + f") v({names})"


def places_sql(rows: str, keys: str, text: str, forms: str, rule: str = "standard") -> str:
    """Places of forms (a relation of no and form) in the texts of rows, by one of the readings, found by comparing every
    place with every form: keys, t (the text), no, s (from 1, in characters), n (characters), start and "end" (bytes)."""
    order = {"standard": "s + n, s, no", "longest": "s, -n, no", "all": "s, n, no"}[rule]
    every = f"""SELECT {keys}, {text} AS t, no, length(form) AS n, unnest(list_filter(range(1, length({text}) - length(form) + 2), lambda i: substr({text}, i, length(form)) = form)) AS s FROM {rows} JOIN {forms} ON contains({text}, form)"""
    if rule == "all":
        chosen = every
    else:
        chosen = f"""SELECT {keys}, t, x.no AS no, x.n AS n, x.s AS s FROM (SELECT {keys}, t, unnest(list_reduce(list_transform(xs, lambda x: {{'e': x.s + x.n, 'out': [x]}}),
          lambda a, b: CASE WHEN b.out[1].s >= a.e THEN {{'e': b.e, 'out': list_concat(a.out, b.out)}} ELSE a END).out) AS x
          FROM (SELECT {keys}, any_value(t) AS t, list({{'s': s, 'n': n, 'no': no}} ORDER BY {order}) AS xs FROM ({every}) GROUP BY {keys}))"""
    return f"""(SELECT *, strlen(substr(t, 1, s - 1)) AS start, strlen(substr(t, 1, s - 1 + n)) AS "end" FROM ({chosen}))"""


#: (no, id, form, class, word_boundary): forms that hold and overlap each other, and one that occurs nowhere.
LEX = [(0, "l1", "tion", "end", False), (1, "l2", "the", "word", True), (2, "l3", "with", "word", True), (3, "l4", "ing", "end", False), (4, "l5", "ations", "end", False), (5, "l6", "th", "part", False), (6, "l7", "hei", "part", False), (7, "l8", "é", "part", True), (8, "l9", "zzzzz", "part", False)]
LEX_SQL = f"(SELECT * FROM {values_sql(LEX, 'no, id, form, class, word_boundary')})"
WHOLE = r"(NOT word_boundary OR NOT (regexp_matches(CASE WHEN s > 1 THEN substr(t, s - 1, 1) ELSE '' END, '[\p{L}\p{N}]') OR regexp_matches(substr(t, s + n, 1), '[\p{L}\p{N}]')))"
FOUND = f"(SELECT p.*, id, form, class, {WHOLE} AS whole FROM {places_sql(SENT, 'doc_id, pos', 'sentence', LEX_SQL)} p JOIN {LEX_SQL} l ON l.no = p.no)"


def lexicon(spark):
    return spark.createDataFrame(LEX, "no int, id string, form string, class string, word_boundary boolean")


def sentence_rows(spark, d):
    return N.sentence_rows(docs(spark, d))


@query("lexicon_matches", f'SELECT doc_id, CAST(pos AS INT) AS pos, id, class, form AS matched, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM {FOUND} WHERE whole')
def lexicon_matches(spark, d):
    return X.lexicon_matches(sentence_rows(spark, d), lexicon(spark))


@query("lexicon_metrics", f"""WITH h AS {FOUND} SELECT 'id' AS kind, id AS key, count(*) AS n FROM h WHERE whole GROUP BY id UNION ALL SELECT 'class', class, count(*) FROM h WHERE whole GROUP BY class
  UNION ALL SELECT 'hits', '', count(*) FROM h WHERE whole HAVING count(*) > 0 UNION ALL SELECT 'rejections', '', count(*) FROM h WHERE NOT whole HAVING count(*) > 0""")  # fmt: skip
def lexicon_metrics(spark, d):
    return X.lexicon_metrics(X.lexicon_places(sentence_rows(spark, d), lexicon(spark)))


#: (alias, canonical): the invented prose has no names, so frequent words stand for them.
NAMES = [("The", "A"), ("Theblen", "A"), ("Than", "B"), ("Thanthe", "C"), ("De", "D"), ("Des", "E"), ("Und", "F"), ("tion", "G"), ("en", "H")]
NAMES_SQL = f"(SELECT * FROM {values_sql([(i, *x) for i, x in enumerate(NAMES)], 'no, form, canonical')})"
SAID = f"(SELECT p.doc_id, p.pos, canonical, form AS alias, t AS sentence, s, n, start, \"end\" FROM {places_sql(SENT, 'doc_id, pos', 'sentence', NAMES_SQL, 'longest')} p JOIN {NAMES_SQL} l ON l.no = p.no)"


def names(spark):
    return spark.createDataFrame(NAMES, "alias string, canonical string")


@query("mention_scan", f"SELECT doc_id, CAST(pos AS INT) AS pos, canonical, alias, CAST(start AS INT) AS start FROM {SAID}")
def mention_scan(spark, d):
    return N.mentions(sentence_rows(spark, d), names(spark))


SHORTS, AFTER = [("l", "L"), ("é", "E"), ("s", "S")], ["e ", "a", "t "]


@query("short_mentions", f"""SELECT doc_id, CAST(pos AS INT) AS pos, canonical, form AS alias, CAST(start AS INT) AS start FROM {places_sql(SENT, 'doc_id, pos', 'sentence', f"(SELECT * FROM {values_sql([(i, *x) for i, x in enumerate(SHORTS)], 'no, form, canonical')})", 'all')} p
  JOIN {values_sql([(i, *x) for i, x in enumerate(SHORTS)], 'no, form, canonical')} ON v.no = p.no WHERE NOT regexp_matches(CASE WHEN s > 1 THEN substr(t, s - 1, 1) ELSE '' END, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(substr(t, s + n), '^(e |a|t )')""")  # fmt: skip
def short_mentions(spark, d):
    return N.short_mentions(sentence_rows(spark, d), SHORTS, AFTER)


ALIASES = [("A", "tion"), ("A", "tions"), ("B", "with"), ("B", "th"), ("C", "zzzz"), ("D", "th")]


@query("first_mentions", f"""WITH h AS (SELECT doc_id AS chapter_id, name, alias, text, length(split_part(text, alias, 1)) AS p FROM documents JOIN {values_sql(ALIASES, 'name, alias')} ON contains(text, alias))
  SELECT chapter_id, name, alias, CAST(strlen(substr(text, 1, p)) AS INT) AS start, CAST(strlen(substr(text, 1, p + length(alias))) AS INT) AS "end", md5(substr(text, greatest(p - 40, 0) + 1, p - greatest(p - 40, 0) + length(alias) + 80)) AS snippet
  FROM h QUALIFY row_number() OVER (PARTITION BY chapter_id, name ORDER BY p, length(alias) DESC) = 1""")  # fmt: skip
def first_mentions(spark, d):
    chapters = C.Catalog(spark, d).table("documents").select(F.col("doc_id").alias("chapter_id"), "text")
    return P.first_mentions(chapters, spark.createDataFrame(ALIASES, "name string, alias string")).withColumn("snippet", F.md5("snippet"))


PATTERNS = [("courtesy", "with", "after", None), ("home", "tion", "before", None), ("weapon", "the ", "between", "an"), ("home", "ing", "after", None), ("rank", "que", "before-or", "ment")]
_STOPS = "，,。；、\n：;"
_value = {
    "after": lambda mark, _: f"regexp_extract(sentence, '{mark}([^{_STOPS}]*)', 1)",
    "before": lambda mark, _: f"regexp_extract(sentence, '([^{_STOPS}]*?){mark}', 1)",
    "between": lambda mark, end: f"regexp_extract(sentence, '{mark}([^{_STOPS}]*?){end}', 1)",
}
_said = lambda mode, mark, other: f"coalesce(nullif(trim({_value['before'](mark, None)}, ' '), ''), nullif(trim({_value['before'](other, None)}, ' '), ''))" if mode == "before-or" else f"nullif(trim({_value[mode](mark, other)}, ' '), '')"
_each = ", ".join(f"{{'i': {i}, 'key': '{k}', 'value': {_said(mode, mark, other)}}}" for i, (k, mark, mode, other) in enumerate(PATTERNS))


@query("profiles", f"""WITH n AS (SELECT doc_id, pos, sentence, arg_max(canonical, (strlen(form), form)) AS name FROM {SENT} JOIN {NAMES_SQL} ON contains(sentence, form) WHERE strlen(trim(sentence, ' ')) >= 6 GROUP BY doc_id, pos, sentence),
  v AS (SELECT doc_id, pos, name, unnest([{_each}]) AS x FROM n), w AS (SELECT doc_id, pos, name, x.i AS i, x.key AS key, CASE WHEN starts_with(x.value, name) THEN substr(x.value, length(name) + 1) ELSE x.value END AS value FROM v WHERE x.value IS NOT NULL)
  SELECT name, key, arg_min(value, (doc_id, pos, i)) AS value, 0.9::DOUBLE AS confidence FROM w WHERE value <> '' GROUP BY name, key""")  # fmt: skip
def profiles(spark, d):
    return P.profiles(sentence_rows(spark, d).withColumnRenamed("sentence", "line"), names(spark), PATTERNS)


DEATHS = ["ight", "ness"]


@query("deaths", f"SELECT doc_id, canonical AS name, CAST(min(pos // 10) AS INT) AS chapter FROM {SAID} WHERE contains(substr(sentence, s + n, 40), 'ight') OR contains(substr(sentence, s + n, 40), 'ness') GROUP BY doc_id, canonical")
def deaths(spark, d):
    rows = sentence_rows(spark, d).withColumn("chapter", F.floor(F.col("pos") / 10).cast("int"))
    return K.deaths_of(N.with_mentions(rows, names(spark)), DEATHS)


@query("action_sentences", f"SELECT doc_id, canonical AS name, md5(arg_min(sentence, (pos, start))) AS sentence FROM {SAID} WHERE (contains(sentence, 'ing') OR contains(sentence, 'ment')) AND strlen(sentence) <= 300 GROUP BY doc_id, canonical")
def action_sentences(spark, d):
    rows = sentence_rows(spark, d)
    return K.action_sentences(rows, N.mentions(rows, names(spark)), ["ing", "ment"]).withColumn("sentence", F.md5("sentence"))


RULES = [("ment", "oath"), ("ing", "kin"), ("aire", "foe"), ("ing", "foe")]
RULES_SQL = f"(SELECT * FROM {values_sql([(i, *x) for i, x in enumerate(RULES)], 'no, form, relation')})"
TYPES = f"""SELECT a.doc_id, a.canonical AS a, b.canonical AS b, arg_min(relation, k.no) AS relation FROM {places_sql(SENT, 'doc_id, pos', 'sentence', RULES_SQL, 'all')} k JOIN {RULES_SQL} r ON r.no = k.no
  JOIN {SAID} a ON a.doc_id = k.doc_id AND a.pos = k.pos AND abs(a.start - k.start) < 20 JOIN {SAID} b ON b.doc_id = k.doc_id AND b.pos = k.pos AND abs(b.start - k.start) < 20 AND a.canonical < b.canonical GROUP BY ALL"""  # fmt: skip


@query("relation_types", TYPES)
def relation_types(spark, d):
    rows = sentence_rows(spark, d)
    return K.relation_types(rows, N.mentions(rows, names(spark)), RULES, 20)


CHARACTERS, KEYWORDS = ["The", "De", "Un", "tion"], ["with", "ing", "que"]
LINES = r"(SELECT doc_id, unnest(range(len(s))) AS pos, regexp_replace(unnest(s), '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
MARKERS = f"""(WITH n AS (SELECT doc_id, pos, line, arg_min(name, rank) AS name FROM {LINES} JOIN {values_sql(list(enumerate(CHARACTERS)), 'rank, name')} ON contains(line, name) WHERE strlen(line) >= 10 GROUP BY doc_id, pos, line),
  k AS (SELECT *, split_part(line, keyword, 1) AS head FROM n JOIN {values_sql([(k,) for k in KEYWORDS], 'keyword')} ON contains(line, keyword))
  SELECT doc_id, CAST(pos AS INT) AS pos, name, keyword, regexp_extract(substr(line, length(head) + length(keyword) + 1), '^([^,.;]*)', 1) AS trait, substr(line, 1, 120) AS context, 0.7::DOUBLE AS confidence FROM k
  WHERE abs(strlen(head) - strlen(split_part(line, name, 1))) < 25 AND trait <> '')"""  # fmt: skip


def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def markers(spark, d):
    return N.personality_markers(lines(spark, d), CHARACTERS, KEYWORDS, ",.;")


@query("personality_markers", f"SELECT doc_id, pos, name, keyword, trait, md5(context) AS context, confidence FROM {MARKERS}")
def personality_markers(spark, d):
    return markers(spark, d).withColumn("context", F.md5("context"))


_polarity = lambda c: f"CASE WHEN contains({c}, 'th') THEN 1 WHEN contains({c}, 'an') OR contains({c}, 'en') THEN -1 ELSE 0 END"


@query("character_arcs", f"""WITH g AS (SELECT doc_id, name, arg_min(trait, (pos, trait)) AS x, arg_max(trait, (pos, trait)) AS y, count(*) AS n FROM {MARKERS} GROUP BY doc_id, name), p AS (SELECT *, {_polarity('x')} AS px, {_polarity('y')} AS py FROM g)
  SELECT doc_id, name, CASE WHEN x = y THEN 'stable' WHEN px > 0 AND py < 0 THEN 'decline' WHEN px < 0 AND py > 0 THEN 'growth' ELSE 'transformation' END AS arc, n FROM p""")  # fmt: skip
def character_arcs(spark, d):
    return N.arcs(markers(spark, d), ["th"], ["an", "en"])


SPOKEN = ["ing", "with"]


@query("dialogue_events", f"""WITH m AS (SELECT doc_id, pos, marker, split_part(sentence, marker, 1) AS description FROM {SENT} JOIN {values_sql([(m,) for m in SPOKEN], 'marker')} ON contains(sentence, marker)),
  j AS (SELECT m.doc_id, m.pos, marker, description, arg_max(canonical, "end") FILTER ("end" <= strlen(description)) AS speaker, arg_min(canonical, start) FILTER (start >= strlen(description) + strlen(marker)) AS addressee
    FROM m JOIN {SAID} a ON a.doc_id = m.doc_id AND a.pos = m.pos GROUP BY ALL)
  SELECT doc_id, CAST(pos AS INT) AS pos, marker, speaker, addressee, speaker || '曰' AS title, md5(description) AS description, 0.5::DOUBLE AS importance FROM j WHERE speaker IS NOT NULL""")  # fmt: skip
def dialogue_events(spark, d):
    return N.dialogue_events_of(N.with_mentions(sentence_rows(spark, d), names(spark)), SPOKEN).withColumn("description", F.md5("description"))


ACTS = ["ing", "ment"]
ACTS_SQL = f"(SELECT * FROM {values_sql(list(enumerate(ACTS)), 'no, form')})"
EVENTS = f"""(SELECT k.doc_id, CAST(k.pos AS INT) AS pos, form AS verb, arg_max(canonical, a."end") FILTER (a."end" <= k.start AND k.start - a."end" < 50) AS subject, arg_min(canonical, a.start) FILTER (a.start >= k."end" AND a.start - k."end" < 50) AS object
  FROM {places_sql(SENT, 'doc_id, pos', 'sentence', ACTS_SQL, 'all')} k JOIN {ACTS_SQL} f ON f.no = k.no JOIN {SAID} a ON a.doc_id = k.doc_id AND a.pos = k.pos GROUP BY k.doc_id, k.pos, form, k.start HAVING subject IS NOT NULL)"""  # fmt: skip


def events(spark, d):
    return N.verb_events_of(N.with_mentions(sentence_rows(spark, d), names(spark)), ACTS)


@query("action_events", f"SELECT * FROM {EVENTS}")
def action_events(spark, d):
    return events(spark, d)


@query("observed_relations", f"SELECT doc_id, pos, subject AS a, object AS b, CASE verb WHEN 'ing' THEN 'enemy' WHEN 'ment' THEN 'ally' ELSE 'associated' END AS relation FROM {EVENTS} WHERE object IS NOT NULL AND subject <> object")
def observed_relations(spark, d):
    e = events(spark, d).where("object is not null and subject <> object")
    return e.select("doc_id", "pos", F.col("subject").alias("a"), F.col("object").alias("b"), N.relation_type(F.col("verb"), ["ing"], ["ment"], F.col("subject").isNotNull()).alias("relation"))


_seen = f"(SELECT doc_id, pos AS time, subject AS a, object AS b, CASE verb WHEN 'ing' THEN 'enemy' ELSE 'ally' END AS relation FROM {EVENTS} WHERE object IS NOT NULL AND subject <> object)"


@query("seeded_timeline", f"""WITH s AS {_seen}, k AS (SELECT DISTINCT doc_id, 'A' AS a, 'G' AS b, 'ally' AS relation, 1 AS valid_from FROM s),
  o AS (SELECT doc_id, a, b, time, min(relation) AS relation, 1 AS seen FROM (SELECT doc_id, a, b, time, relation FROM s UNION ALL SELECT doc_id, b, a, time, relation FROM s) GROUP BY doc_id, a, b, time
    UNION ALL SELECT doc_id, a, b, valid_from, relation, 0 FROM k UNION ALL SELECT doc_id, b, a, valid_from, relation, 0 FROM k),
  t AS (SELECT * FROM o QUALIFY lag(relation) OVER (PARTITION BY doc_id, a, b ORDER BY seen, time) IS DISTINCT FROM relation),
  r AS (SELECT doc_id, a, b, relation, CAST(time AS INT) AS valid_from, CAST(lead(time) OVER (PARTITION BY doc_id, a, b ORDER BY seen, time) AS INT) AS valid_to, 0.8::DOUBLE AS confidence FROM t)
  SELECT * FROM r WHERE valid_to IS NOT NULL OR a <= b""")  # fmt: skip
def seeded_timeline(spark, d):
    o = observed_relations(spark, d).withColumnRenamed("pos", "time")
    known = o.select("doc_id", F.lit("A").alias("a"), F.lit("G").alias("b"), F.lit("ally").alias("relation"), F.lit(1).alias("valid_from")).distinct()
    return N.timeline_of_pairs(o, known)
