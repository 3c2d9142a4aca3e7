"""Stores changed by key, lexicon layers, corrections, inspection, and faction moves by a plain loop."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from engram.functions import languages
from engram.operators import graph, lexicon, narrative, proximity, retrieval
from engram.plans import matching, stores
from engram.sources.store import Store, append_facts, evidence_tables

ROW = "id long, name string, tags array<string>, vector array<double>, extra map<string,int>"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_store_by_a_plain_dictionary(spark, folder):
    rng = random.Random(1)
    store, plain = Store(spark, folder + "/s", "id long, a string, b int"), {}
    assert store.current().count() == 0
    for batch in range(9):
        op = rng.choice(["put", "insert", "update", "delete"]) if batch else "put"
        ids = rng.sample(range(30), 12)
        rows = [(i, rng.choice(["x", None, "é"]), rng.choice([1, 2, None])) for i in ids]
        df = spark.createDataFrame(rows, "id long, a string, b int")
        if op == "update":
            store.update(df.select("id", "b"), batch)
            plain |= {i: (plain[i][0], b) for i, _, b in rows if i in plain}
        elif op == "delete":
            store.delete(df, batch)
            plain = {k: v for k, v in plain.items() if k not in ids}
        else:
            getattr(store, op)(df, batch)
            getattr(store, op)(df, batch)  # a batch that is written again replaces itself
            plain |= {i: (a, b) for i, a, b in rows if op == "put" or i not in plain}
    read = lambda s: {r["id"]: (r["a"], r["b"]) for r in s.current().collect()}
    assert read(store) == plain and read(store.compact(folder + "/c")) == plain
    assert {r["id"] for r in store.get(spark.createDataFrame([(1,), (2,), (1,)], "id long")).collect()} == {1, 2} & set(plain)
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([(1, 2)], "id long, nothing int"), 99)


def test_store_keeps_every_kind_of_column(spark, folder):
    rows = [(1, "a", ["x"], [0.5], {"k": 1}), (2, None, None, None, None)]
    store = Store(spark, folder, ROW)
    store.put(spark.createDataFrame(rows, ROW), 0)
    store.update(spark.createDataFrame([(1, None)], "id long, tags array<string>"), 1)
    got = {r["id"]: tuple(r)[1:] for r in store.current().collect()}
    assert got == {1: ("a", None, [0.5], {"k": 1}), 2: (None, None, None, None)}
    repeated = Store(spark, folder + "/r", "id long, name string")
    repeated.put(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "id long, name string"), 0)
    assert [tuple(r) for r in repeated.current().collect()] == [(1, "a")]


def test_facts_and_evidence(spark, folder):
    facts = Store(spark, folder + "/f", "id long, content string")
    f = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    assert tuple(append_facts(facts, f.where("id = 1"), 0).first()) == (1, 0)
    assert tuple(append_facts(facts, f.withColumn("content", F.lit("new")), 1).first()) == (1, 1)
    assert {tuple(r) for r in facts.current().collect()} == {(1, "a"), (2, "new")}  # a fact is never changed
    evidence = Store(spark, folder + "/e", "id long, doc_id long, content string, links array<struct<kind:string,source_id:long>>")
    evidence.put(spark.createDataFrame([(1, 7, "x", [("object", 3), ("edge", 4)]), (2, 7, "y", [])], evidence.schema), 0)
    rows, links = evidence_tables(evidence)
    assert rows.count() == 2 and {tuple(r) for r in links.collect()} == {(1, "object", 3), (1, "edge", 4)}


LEX = "id string, lemma string, forms array<string>, language string, class string, word_boundary boolean"


def test_lexicon_layers(spark):
    layer = lambda *rows: spark.createDataFrame([(i, w, fs, k, c, False) for i, w, fs, k, c in rows], LEX)
    core = layer(("k1", "Kill", ["kills"], "en", "attack"), ("k2", "救", None, "zh", "rescue"))
    packs = {"a": layer(("a1", "walk", [], "en", "movement")), "b": layer(("b1", "walk", [], "en", "movement"))}
    user = layer(("k1", "slay", ["slew"], "en", "attack"))
    got = lexicon.registry(core, packs, ["a"], user, ["k2"]).orderBy("no").collect()
    assert [(r["id"], r["lemma"], r["layer"], r["no"], r["strong"], r["action"], r["hostile"], r["friendly"]) for r in got] == [("a1", "walk", "domain", 1, False, True, False, False), ("k1", "Kill", "core", 2, True, False, True, False), ("k1", "slay", "user", 3, True, False, True, False)]
    assert [r["id"] for r in lexicon.lookup(core, "KILL").collect()] == ["k1"]
    assert sorted(r["form"] for r in lexicon.forms_of(core).collect()) == ["Kill", "kills", "救"]
    for bad in (
        lambda: lexicon.registry(core, packs),  # both packs have walk
        lambda: lexicon.registry(core.unionByName(core)),
        lambda: lexicon.registry(core, packs, ["c"]),
        lambda: lexicon.registry(core, disabled=["nobody"]),
        lambda: lexicon.registry(layer(("x", "war", ["war"], "en", "state"))),
    ):
        with pytest.raises(ValueError):
            bad()


def test_packs_of_json(spark, folder):
    one = {"id": "k", "lemma": "kill", "forms": ["kills"], "language": "en", "class": "attack", "constraints": {"word_boundary": True}}
    for i, said in enumerate(([one], {"lexemes": [one, {"id": "x", "lemma": "y"}]})):
        with open(f"{folder}/{i}.json", "w") as f:
            json.dump(said, f)
    got = lambda i: [tuple(r) for r in lexicon.read_pack(spark, f"{folder}/{i}.json").collect()]
    assert got(0) == [("k", "kill", ["kills"], "en", "attack", True)] and got(1) == [*got(0), ("x", "y", None, None, None, False)]


def test_inspection(spark):
    objects = spark.createDataFrame([(1, "person", "刘备", '{"description":"d","clothing":"","aliases":["玄德"]}'), (2, "event", "战死沙场", '{"chapter":9}'), (3, "event", "e", '{"chapter":5,"description":"病逝"}'), (4, "event", "士卒", '{"chapter":1}'), (5, "person", "x", None)], "id long, object_type string, name string, properties string")
    edges = spark.createDataFrame([(1, 2, "participated_in"), (1, 2, "participated_in"), (1, 3, "participated_in"), (4, 1, "participated_in"), (1, 5, "knows"), (1, 1, "is"), (1, 99, "participated_in")], "source_id long, target_id long, predicate string")
    own = spark.createDataFrame([(1, 100), (1, 100), (5, 101)], "id long, evidence_id long")
    linked = spark.createDataFrame([(1, 5, "knows", 100), (1, 5, "knows", 102)], "source_id long, target_id long, predicate string, evidence_id long")
    seen = spark.createDataFrame([(1, 3), (1, 8), (1, 5)], "id long, chapter_no int")
    got = {r["id"]: r for r in graph.inspect_all(objects, edges, own, linked, seen).collect()}
    assert tuple(got[1])[2:9] == (2, 3, 2, 3, 3, 8, 5)
    assert [tuple(x) for x in got[1]["profile"]] == [("description", "d"), ("aliases", '["玄德"]')]
    assert tuple(got[5])[2:] == (1, 0, 3, 0, None, None, None, []) and len(got) == 5


def test_corrections_say_what_they_did(spark):
    objects = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b")], "id long, name string")
    edges = spark.createDataFrame([(1, 2, "knows", 1), (1, 2, "knows", 2), (2, 1, "knows", 1), (1, 3, "knows", 1)], "source_id long, target_id long, predicate string, valid_from int")
    fixes = spark.createDataFrame([("a", "knows", "b", "c"), ("a", "knows", "b", "c"), ("b", "knows", "c", "a"), ("z", "knows", "b", "c"), ("a", "knows", "b", "q")], "source string, predicate string, old_target string, new_target string")
    out, report = graph.correct_by_name(objects, edges, fixes)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, 3, "knows", 1, 2), (1, 3, "knows", 2, 2), (2, 1, "knows", 1, None), (1, 3, "knows", 1, None)]))
    said = {(r["source"], r["new_target"]): (r["changed"], r["problem"]) for r in report.collect()}
    assert said == {("a", "c"): (2, None), ("b", "a"): (0, "no `knows` edge from `b` to `c` found"), ("z", "c"): (0, "source `z` not found"), ("a", "q"): (0, "new_target `q` not found")}


def test_faction_moves_by_a_plain_loop(spark, sf):
    first = {c: "wei" if i % 2 else "shu" for i, c in enumerate(dict(matching.NAMES).values()) if i % 3}
    now, want = {}, []
    for doc, pos, verb, a, b in sorted(tuple(r) for r in matching.events(spark, sf).where("object is not null").collect()):
        own = now.setdefault(doc, dict(first))
        old, new = own.get(a, "未知"), own.get(b, "未知")
        if verb == "ing" and new not in (old, "未知"):
            own[a] = new
            want.append((doc, pos, a, old, new, "surrender"))
        elif verb == "ment":
            want.append((doc, pos, a, old, old, "betrayal"))
    got = [tuple(r) for r in stores.faction_moves(spark, sf).collect()]
    by = lambda rows: sorted((r for r in rows), key=lambda r: (r[0], r[1]))
    assert len(got) == len(want) and [r[:2] for r in by(got)] == [r[:2] for r in by(want)]
    assert narrative.factions(matching.events(spark, sf).where("false"), spark.createDataFrame([(1, "a", "wei")], "doc_id long, name string, faction string"), ["ing"], []).count() == 0


def test_languages_take_their_verbs_from_a_lexicon(spark):
    rows = [("k", "Kill", ["kills"], "en", "attack", False), ("t", "Mr.", [""], "en", "title", True), ("z", "救", None, "zh", "rescue", False), ("s", "say", None, "en", "speech", False)]
    lex = lexicon.registry(spark.createDataFrame(rows, LEX))
    en = languages.with_lexicon(languages.Language("en", titles=["Dr."], verbs={"hostile": ["hit"]}), lex)
    assert (en.of("hostile"), en.of("action"), en.of("friendly"), en.titles) == (["hit", "kill", "kills"], ["say"], [], ["Dr.", "Mr."])
    assert languages.register(en) is languages.LANGUAGES["en"]
    with pytest.raises(ValueError):
        languages.with_lexicon(en, lex, most=2)


def test_stages_of_resolving(spark):
    m = spark.createDataFrame([(1, "Ann", None), (2, "she", [1.0, 0.0]), (3, "Bob", [0.0, 1.0]), (4, "Cy", [1.0, 1.0]), (5, None, None)], "id long, surface string, vector array<double>")
    aliases = spark.createDataFrame([("ＡＮＮ", 7), ("ann", 9)], "alias string, entity_id long")
    v = spark.createDataFrame([(20, [0.0, 2.0])], "id long, vector array<double>")
    stages = [("stop", retrieval.stop_stage(["she"])), ("alias", retrieval.alias_stage(aliases)), ("vector", retrieval.vector_stage(v, 0.9))]
    got = {r["id"]: tuple(r)[1:] for r in retrieval.resolve_by_stages(m, stages).collect()}
    assert got == {1: (7, 1.0, "alias"), 2: (None, 0.0, "stop"), 3: (20, 1.0, "vector"), 4: (None, 0.0, "unknown"), 5: (None, 0.0, "unknown")}
    assert {r["stage"] for r in retrieval.resolve_by_stages(m, []).collect()} == {"unknown"}
    for kind in proximity.INDEXES:
        assert [r["id"] for r in proximity.nearest_by(kind, m.where("id = 3"), v, 1).collect()] == [20]
    with pytest.raises(ValueError):
        proximity.nearest_by("tree", m, v, 1)


def test_anchors_of_any_number(spark):
    """Beyond the limit of the literal array anchors are compared in blocks, with the same result."""
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [0.0] * 4)], "id long, vector array<double>")
    a = spark.createDataFrame([(i % 30, [float((i * k) % 5 - 2) for k in range(1, 5)]) for i in range(30)], "label int, centroid array<double>")
    read = lambda **k: sorted((r["id"], r["label"], round(r["similarity"], 6)) for r in retrieval.classify_by_anchor(v, a, **k).collect())
    assert read() == read(most=5) and len(read()) == 62
