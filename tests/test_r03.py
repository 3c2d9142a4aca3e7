"""Findings of round 3: tables in folders, links that are registered again, and the work that grew too fast."""

import inspect
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions.vectors import clamped_cosine
from engram.operators import compile as compile_
from engram.operators import corpus, graph, narrative, retrieval
from engram.operators.lexicon import small
from engram.plans import all_queries
from engram.sources import bundle, external


@pytest.fixture(scope="module")
def parted(spark, sf):
    """A folder of tables, each a folder of two files."""
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for t in ("conversations", "documents"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(2).write.parquet(f"{d}/{t}.parquet")
    return d


def same(spark, name, a, b):
    got, want = (sorted(map(str, all_queries()[name](spark, d).collect())) for d in (a, b))
    assert got == want and got


def test_stream_compile_of_a_table_in_a_folder(spark, parted, sf):
    same(spark, "stream_compile", parted, sf)


def test_stream_relationship_of_a_table_in_a_folder(spark, parted, sf):
    same(spark, "stream_relationship", parted, sf)


def test_stream_forget_of_a_table_in_a_folder(spark, parted, sf):
    same(spark, "stream_forget", parted, sf)


def test_a_link_that_is_registered_again_is_the_last(spark):
    links = spark.createDataFrame([(1, "s", "x", "a"), (2, "s", "x", "b"), (3, "s", "x", "a")], "seq long, source string, external_name string, canonical_name string")
    names = spark.createDataFrame([("s", "x"), ("t", "x"), ("s", "y")], "source string, surface string")
    assert {tuple(r) for r in external.resolve(names, links).collect()} == {("s", "x", "a"), ("t", "x", "a"), ("s", "y", None)}


def test_entity_linker_takes_the_last_link(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(60, "s", 1), (120, "s", 51), (180, "s", 1), (1, "s", 7)]  # n1 is c1, then c2, then c1 again
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    got = {(r["surface"], r["canonical"]) for r in all_queries()["entity_linker"](spark, d).collect()}
    assert got == {("n0", None), ("n1", "c1")}


@pytest.mark.parametrize("name", ["action_events", "observed_relations", "dialogue_events"])
def test_events_are_read_off_a_sentence_without_a_join(spark, sf, name):
    plan = all_queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_events_of_names_in_the_row_and_found_elsewhere(spark):
    rows = spark.createDataFrame([(1, 0, "Éva met Anna, Anna met Éva met Bo", 3), (1, 1, "met Bo", 4), (None, 0, "Bo met Bo", 5)], "doc_id long, pos int, sentence string, chapter int")
    aliases = spark.createDataFrame([(n, n) for n in ("Éva", "Anna", "Bo")], "alias string, canonical string")
    got = sorted(map(tuple, narrative.verb_events_of(narrative.with_mentions(rows, aliases), ["met"], 6).collect()))
    assert sorted(map(tuple, narrative.verb_events_of(narrative.with_mentions(rows.union(rows), aliases), ["met"], 6).collect())) == got
    assert got == [(1, 0, "met", "Anna", "Éva"), (1, 0, "met", "Éva", "Anna"), (1, 0, "met", "Éva", "Bo")]
    assert sorted(map(tuple, narrative.verb_events(narrative.mentions(rows, aliases), rows, ["met"], 6).collect())) == got
    dead = corpus.deaths_of(narrative.with_mentions(rows, aliases), ["met B"], 5).collect()
    assert {tuple(r) for r in dead} == set() and {tuple(r) for r in corpus.deaths_of(narrative.with_mentions(rows, aliases), ["met B"], 6).collect()} == {(1, "Éva", 3)}


def test_batches_are_cut_by_rows_and_bytes():
    batch = pa.record_batch([pa.array(["x" * 1000] * 2000)], ["text"])
    cut = list(small([batch], rows=512, size=100_000))
    assert sum(b.num_rows for b in cut) == 2000 and max(b.num_rows for b in cut) <= 100
    assert [b.num_rows for b in small([pa.record_batch([pa.array(["x"] * 1200)], ["text"])])] == [512, 512, 176]


def greedy(ids, vectors, eps, samples=3):
    """Clusters by the plain rule, one vector and one cluster at a time."""
    out = []
    for i, v in zip(ids, vectors):
        for c in out:
            size = np.linalg.norm(c[0]) * np.linalg.norm(v)
            if size and 1 - c[0] @ v / size <= eps:
                c[0], c[1] = c[0] + v, c[1] + 1
                c[2] += [i] if len(c[2]) < samples else []
                break
        else:
            out.append([v, 1, [i]])
    return [(n, m) for _, n, m in out]


@pytest.mark.parametrize("eps", [0.05, 0.3, 0.8])
def test_clusters_by_blocks_are_those_of_the_plain_rule(eps):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 6))
    v[::50] = 0
    v[1::7] = v[3]
    c = retrieval.Clusters(eps, 3)
    for at in range(0, len(v), 256):
        c.add(list(range(at, min(len(v), at + 256))), v[at : at + 256])
    assert list(zip(c.n, c.members)) == greedy(range(len(v)), v, eps)


def test_cosines_of_pairs_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3)] if i % 9 else [None, [], [0.0, 0.0, 0.0], [1.0, 2.0]][i // 9 % 4], i % 2 if i % 11 else None) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, cell int")
    got = {(r["query_id"], r["id"]): r["similarity"] for r in retrieval.cosines_below(v.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), "cell"), v, 8, 16).collect()}
    a, b = v.toDF("a", "x", "cell"), v.toDF("b", "y", "cell")
    want = {(r["b"], r["a"]): r["s"] for r in a.join(b, "cell").where("a < b").select("a", "b", clamped_cosine(F.col("x"), F.col("y")).alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_block_of_neighbours_is_bounded():
    most = {k: p.default for k, p in inspect.signature(retrieval.nearest_in_cells).parameters.items() if k.endswith("block")}
    assert most["query_block"] * (1024 + 64) * 8 * 3 <= 64 << 20 and most["vector_block"] <= 16384


def test_edges_are_made_once_whatever_the_depth(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "source_id long, target_id long")
    got = graph.neighbourhood(edges.mapInArrow(count, edges.schema), spark.createDataFrame([(1,)], "id long"), 3)
    assert {(r["id"], r["hops"]) for r in got.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert seen.value == 7


def test_cooccurrence_takes_more_tasks_for_more_members(spark):
    m = spark.createDataFrame([(g, n) for g in range(40) for n in (g % 3, 7, 8, 7)], "group_id long, name long")
    few, many = (corpus.cooccurrence(m, 13, rows) for rows in (1 << 20, 10))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == {(0, 7, 14), (0, 8, 14), (1, 7, 13), (1, 8, 13), (2, 7, 13), (2, 8, 13), (7, 8, 40)}
    assert many.rdd.getNumPartitions() >= 16


def test_compile_shuffles_texts_of_repeated_ids_only(spark, monkeypatch):
    """What is tagged is joined with the ids that repeat and read off the documents: only theirs are grouped."""
    written = []
    write = compile_.checkpointed
    monkeypatch.setattr(compile_, "checkpointed", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    rows = [(1, "Anna", "novel", "Anna met Boris."), (2, "Bo", "novel", "Bo met B."), (2, "Bo", "novel", "A b."), (None, "C", "novel", "C met C.")]
    t = compile_.compile_documents(spark.createDataFrame(rows, "doc_id long, title string, doc_type string, text string"), compile_.Profile(verbs=["met"]))
    tagged = next(p for p in written if "sentence" in p)
    assert "LeftAnti" in tagged and tagged.count("Aggregate") == 1
    assert {(r["doc_id"], r["content"]) for r in t["evidence"].collect()} == {(1, "Anna met Boris.")}
    assert sorted(r["doc_id"] for r in t["documents"].collect()) == [1, 2]


def test_story_words_of_a_pattern_are_those_of_the_cast(spark):
    rows = spark.createDataFrame([(1, 0, "Anna met XAnna, annaAnna and Bo, A and B9.")], "doc_id long, pos int, sentence string")
    cast = spark.createDataFrame([(1, n) for n in ("Anna", "Bo", "A", "B", "met")], "doc_id long, name string")
    names = lambda **k: {r["name"] for r in narrative.story_events(rows, cast, ["met"], **k).collect()}
    assert names() == {"Anna", "Bo", "A", "B", "met"} and names(word=compile_._capitalised("*")) == {"Anna", "Bo", "A", "B"}


def test_a_graph_is_merged_as_its_bundle_is(spark):
    """Names that repeat, ends that are no objects, new objects, null times, and old edges that repeat."""
    o = spark.createDataFrame([(1, "p", "a"), (2, "p", "b"), (3, "p", "a"), (4, "q", "a")], "id long, object_type string, name string")
    edge = "source_id long, target_id long, predicate string, valid_from int, valid_to int"
    old = spark.createDataFrame([(1, 2, "x", None, None), (1, 2, "x", None, None), (3, 2, "x", None, None), (9, 2, "x", 1, None)], edge)
    other = spark.createDataFrame([(11, "p", "a"), (12, "p", "b"), (13, "p", "new"), (14, "q", "a")], o.schema)
    edges = spark.createDataFrame([(11, 12, "x", None, None), (11, 12, "x", 5, None), (11, 12, "x", 5, None), (13, 14, "y", 1, 2), (11, 99, "x", None, None)], edge)
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    got, want = bundle.merge_graph(o, old, other, edges), bundle.merge(o, old, other.select("object_type", "name"), bundle.export_edges(other, edges))
    assert rows(got[0], *o.columns) == rows(want[0], *o.columns) and rows(got[1], *old.columns) == rows(want[1], *old.columns)
    new = got[0].where("name = 'new'").first()["id"]
    assert sorted(map(str, got[1].collect())) == sorted(map(str, [*old.collect(), *spark.createDataFrame([(1, 2, "x", 5, None), (new, 4, "y", 1, 2)], edge).collect()]))


def test_import_merge_shuffles_no_names_with_edges(spark, sf):
    """Edges are shuffled by their ends and once to be grouped, and made twice, not three times."""
    plan = all_queries()["import_merge"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_shipdate" in x for x in plan.splitlines()) == 4  # two tables of edges are made of its rows


def test_key_events_look_at_events_only(spark, sf):
    """Ends that are no events are left out before anything is shuffled, and results are those of all edges, also if an event's id doesn't look like one."""
    plan = all_queries()["key_events"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 40000000000" in plan
    e = spark.createDataFrame([(i, 50, "participated_in", 1) for i in range(9)] + [(i, 15, "participated_in", 2) for i in range(3)] + [(20, 50, "knows", None), (50, 21, "knows", None), (30, 31, "knows", None)], "source_id long, target_id long, predicate string, valid_from int")
    links = spark.createDataFrame([(50,)] * 6 + [(15,)] * 9, "event_id long")
    read = lambda **k: sorted(map(str, graph.key_events(e, links, 0.0, **k).collect()))
    assert read() == read(may_be_event=lambda i: i >= 40) and len(read()) == 12
