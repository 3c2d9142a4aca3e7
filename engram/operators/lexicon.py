"""Lexicon matching: one Aho-Corasick automaton of all forms, built once in a worker, run over Arrow batches.

An automaton reads a text once, whatever the number of forms. Three readings of what it finds:

    all        every place of every form
    standard   places that don't overlap, each ending as early as it can; at one end the longest form
    longest    places that don't overlap, each beginning as early as it can; at one beginning the longest form

A form with word_boundary needs no letter or digit on either side. That is looked at after the choice, so a place that
fails still takes its letters from others; it is returned with whole = false.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from engram.functions.lexicons import VERB_SETS

#: What is known of a place besides the lexicon's columns: places in UTF-8 bytes, and `at` in characters.
PLACE = [StructField("matched", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("at", IntegerType()), StructField("whole", BooleanType())]
RULES = {"all": None, "standard": lambda m: (m[1], m[0]), "longest": lambda m: (m[0], -m[1])}

_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def build(forms: Sequence[str | None]) -> ahocorasick.Automaton | None:
    """An automaton whose values are (place in forms, length); of equal forms the first counts, empty ones never."""
    a = ahocorasick.Automaton()
    for no, form in enumerate(forms):
        if form and form not in a:
            a.add_word(form, (no, len(form)))
    if not len(a):
        return None
    a.make_automaton()
    return a


def places(a: ahocorasick.Automaton | None, text: str, rule: str) -> list[tuple[int, int, int]]:
    """(start, end, form) of a text, in characters, by one of the readings, in the order of the reading."""
    found = [(end + 1 - n, end + 1, no) for end, (no, n) in a.iter(text)] if a is not None and text else []
    return without_overlap(found, rule)


def without_overlap(found: list[tuple], rule: str) -> list[tuple]:
    if not RULES[rule]:
        return sorted(found)
    out, last = [], 0
    for m in sorted(found, key=RULES[rule]):
        if m[0] >= last:
            out.append(m)
            last = m[1]
    return out


def small(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of about `size` bytes and `rows` rows at most, so that what is made of one stays small."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _offsets(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Starts and ends in UTF-8 bytes; the text is encoded once, up to the furthest place."""
    if text.isascii():
        return [m[:2] for m in found]
    marks = sorted({x for m in found for x in m[:2]})
    at, before, last = {}, 0, 0
    for x in marks:
        before, last = before + len(text[last:x].encode()), x
        at[x] = before
    return [(at[m[0]], at[m[1]]) for m in found]


def _alone(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def _schema(lexicon: DataFrame) -> StructType:
    return StructType([f for f in lexicon.schema if f.name not in ("form", "word_boundary", "no")] + PLACE)


def _tagged(rows: DataFrame, lexicon: DataFrame, text: str, rule: str, name: str) -> DataFrame:
    """rows with an array of places, for a lexicon that is small enough to be held by every worker."""
    table = lexicon.orderBy(*sorted(lexicon.columns, key=lambda c: (c != "no", c))).toArrow()
    forms = table["form"].to_pylist()
    bound = table["word_boundary"].to_pylist() if "word_boundary" in lexicon.columns else [False] * len(forms)
    found = _schema(lexicon)
    own = [f.name for f in found.fields[: -len(PLACE)]]
    shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, forms, bound, table.select(own).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, forms, bound, table = shared.value
        if key not in _BUILT:
            _BUILT.clear()  # one lexicon at a time
            _BUILT[key] = build(forms)
        a = _BUILT[key]
        for b in small(batches):
            sizes, nos, matched, bytes_, at, whole = [0], [], [], [], [], []
            for t in b[text].to_pylist():
                got = places(a, t or "", rule)
                for (s, e, no), se in zip(got, _offsets(t or "", got)):
                    nos.append(no)
                    matched.append(t[s:e])
                    bytes_.append(se)
                    at.append(s)
                    whole.append(not bound[no] or _alone(t, s, e))
                sizes.append(len(nos))
            taken = table.take(pa.array(nos, pa.int64())).combine_chunks()
            columns = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
            columns += [pa.array(matched, pa.string()), pa.array([x for x, _ in bytes_], pa.int32()), pa.array([x for _, x in bytes_], pa.int32()), pa.array(at, pa.int32()), pa.array(whole, pa.bool_())]
            structs = pa.StructArray.from_arrays(columns, names=[*own, *(f.name for f in PLACE)])
            yield b.append_column(name, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(found))]))


def with_places(rows: DataFrame, lexicon: DataFrame, text: str = "sentence", rule: str = "standard", name: str = "found", by: Sequence[str] = ("doc_id", "pos"), most_bytes: int = 4 << 20) -> DataFrame:
    """rows with an array `name` of the lexicon's places in a text: the lexicon's columns but form and word_boundary, then
    matched, start and end (bytes), at (characters) and whole.

    lexicon has form, and may have word_boundary and any other columns; of equal forms the least `no` counts, or the least
    row where there is no such column. Null texts and forms have no places; repeated rows keep theirs.

    One narrow pass while all forms together have most_bytes at most. A larger lexicon is cut into parts by a hash of the
    form; each part gives all its places, which meet at the row they are of (`by`, not null) and are chosen from there.
    """
    total = lexicon.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    if total <= most_bytes:
        return _tagged(rows, lexicon, text, rule, name)
    n = -(-total // most_bytes)
    keys = rows.groupBy(*by).agg(F.any_value(text).alias(text))
    found = None
    for k in range(n):
        part = _tagged(keys, lexicon.where(F.pmod(F.xxhash64("form"), F.lit(n)) == k), text, "all", name).select(*by, F.inline(name))
        found = part if found is None else found.unionByName(part)
    inner = [f.name for f in _schema(lexicon)]
    order = {"standard": ("end", "start"), "longest": ("start", "o"), "all": ("start", "end")}[rule]
    full = F.struct(*order, *[c for c in inner if c not in order])
    listed = F.array_sort(F.collect_list(full))
    if rule != "all":
        step = lambda s: F.struct(s["end"].alias("last"), F.array(s).alias("kept"))
        fold = F.reduce(F.slice(listed, F.lit(2), F.size(listed)), step(listed[0]), lambda a, s: F.when(s["start"] >= a["last"], F.struct(s["end"].alias("last"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    else:
        fold = listed
    found = found.withColumn("o", -F.col("end")).groupBy(*by).agg(fold.alias(name))
    found = found.withColumn(name, F.transform(name, lambda s: F.struct(*[s[c].alias(c) for c in inner])))
    kind = ArrayType(_schema(lexicon)).simpleString()
    return rows.join(found, list(by), "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).select(*rows.columns, name)


def lexicon_places(rows: DataFrame, lexicon: DataFrame, rule: str = "standard", by: Sequence[str] = ("doc_id", "pos"), text: str = "sentence", most_bytes: int = 4 << 20) -> DataFrame:
    """One row a place: `by`, the lexicon's columns, matched, start, end, at, whole. See with_places."""
    return with_places(rows.select(*by, text), lexicon, text, rule, "found", by, most_bytes).select(*by, F.inline("found"))


def lexicon_matches(rows: DataFrame, lexicon: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """Matches of a lexicon (id, form, word_boundary and what else it has) in sentences (doc_id, pos, sentence), by the
    standard reading: doc_id, pos, id, ..., matched, start, end in bytes."""
    return lexicon_places(rows, lexicon, most_bytes=most_bytes).where("whole").drop("whole", "at")


def lexicon_metrics(places_: DataFrame) -> DataFrame:
    """(kind, key, n) of lexicon_places() with id and class: matches by id, by class and in all, and rejections, the places
    that fail their word boundary. One pass: the four are grouping sets of one aggregation."""
    each = places_.select(F.explode(F.when(F.col("whole"), F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key")), F.struct(F.lit("class").alias("kind"), F.col("class").alias("key")), F.struct(F.lit("hits").alias("kind"), F.lit("").alias("key")))).otherwise(F.array(F.struct(F.lit("rejections").alias("kind"), F.lit("").alias("key"))))).alias("m"))
    return each.groupBy("m.kind", "m.key").agg(F.count("*").alias("n"))


LEXEME = "id string, lemma string, forms array<string>, language string, class string, constraints struct<word_boundary:boolean>"


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """Lexemes of a JSON file, an array or {"lexemes": [...]}: id, lemma, forms, language, class, word_boundary."""
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", f"struct<lexemes:array<struct<{_of(LEXEME)}>>>")["lexemes"], F.from_json("value", f"array<struct<{_of(LEXEME)}>>"))
    rows = raw.select(F.inline(both))
    return rows.select("id", "lemma", "forms", "language", "class", F.coalesce("constraints.word_boundary", F.lit(False)).alias("word_boundary"))


def _of(schema: str) -> str:
    return ",".join(f"{name}:{kind}" for name, _, kind in (part.strip().partition(" ") for part in re.split(r",(?![^<]*>)", schema)))


def forms_of(lexemes: DataFrame) -> DataFrame:
    """One row a form of each lexeme, the lemma first: id, form, language, class, word_boundary. Null and empty ones are none."""
    all_ = F.concat(F.array("lemma"), F.coalesce("forms", F.array().cast("array<string>")))
    return lexemes.select("id", F.explode(all_).alias("form"), "language", "class", F.coalesce("word_boundary", F.lit(False)).alias("word_boundary")).where("form <> ''")


def faults(lexemes: DataFrame) -> DataFrame:
    """(kind, value, n): ids that occur more than once, and forms that lexemes of one language have more than once."""
    ids = lexemes.groupBy(F.col("id").alias("value")).agg(F.count("*").alias("n")).select(F.lit("id").alias("kind"), "value", "n")
    forms = forms_of(lexemes).groupBy(F.concat_ws("/", "language", "form").alias("value")).agg(F.count("*").alias("n")).select(F.lit("form").alias("kind"), "value", "n")
    return ids.unionByName(forms).where("n > 1")


def registry(core: DataFrame, packs: dict[str, DataFrame] | None = None, select: Sequence[str] | None = None, user: DataFrame | None = None, disabled: Sequence[str] = (), sets: dict[str, Sequence[str]] = VERB_SETS) -> DataFrame:
    """One lexicon of layers: the core, the domain packs that are selected (all of them if select is None), the user's own.

    Rows are id, lemma, forms, language, class, word_boundary, layer, no (their place by language and id, the layers of one id in
    order), and for each of sets whether the class is in it. Within the core, within all selected packs together and within
    the user's lexemes an id or a form of a language may occur once; layers add up, and the same id in two of them is two
    rows. Disabled ids are left out. ValueError: a fault (see faults), a pack or a disabled id that there isn't.
    """
    packs = packs or {}
    if unknown := sorted(set(select or ()) - set(packs)):
        raise ValueError(f"no such pack: {', '.join(unknown)}")
    chosen = [df for name, df in packs.items() if select is None or name in select]
    domain = chosen[0] if chosen else None
    for df in chosen[1:]:
        domain = domain.unionByName(df)
    out = None
    for i, (layer, df) in enumerate((("core", core), ("domain", domain), ("user", user))):
        if df is None:
            continue
        if bad := faults(df).orderBy("kind", "value").limit(10).collect():
            raise ValueError(f"{layer}: " + ", ".join(f"{r['kind']} {r['value']} {r['n']} times" for r in bad))
        rows = df.withColumns({"layer": F.lit(layer), "_layer": F.lit(i)})
        out = rows if out is None else out.unionByName(rows)
    if disabled:
        there = {r["id"] for r in out.where(F.col("id").isin(list(disabled))).select("id").distinct().collect()}
        if missing := sorted(set(disabled) - there):
            raise ValueError(f"cannot disable: {', '.join(missing)}")
        out = out.where(~F.col("id").isin(list(disabled)))
    out = out.withColumn("no", F.row_number().over(Window.orderBy("language", "id", "_layer"))).drop("_layer")  # a lexicon, not a corpus
    return out.withColumns({name: F.col("class").isin(list(classes)) for name, classes in sets.items()})


def lookup(lexicon: DataFrame, lemma: str) -> DataFrame:
    """Lexemes of a lemma, in any case."""
    return lexicon.where(F.lower("lemma") == lemma.lower())
