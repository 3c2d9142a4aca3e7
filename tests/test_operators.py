"""Cases with known results, on rows written out here."""

import pytest
from pyspark.sql import functions as F

from engram.functions import scores as S
from engram.functions import text as T
from engram.functions.vectors import cosine
from engram.operators import cognition, corpus, distill, graph, narrative, persona, retrieval
from engram.sources import bundle, external, loaders
from engram.streaming import jobs


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def chat(spark, *lines):
    return spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(lines)], "conv_id long, turn long, role string, content string")


def test_direct_pair(spark):
    m = chat(spark, ("user", "How do I parse JSON in Rust?"), ("assistant", "Use serde_json::from_str."))
    assert [tuple(r) for r in distill.extract_pairs(m).collect()] == [(1, 0, "How do I parse JSON in Rust?", "Use serde_json::from_str.", "direct")]


def test_chatter_is_no_pair(spark):
    assert distill.extract_pairs(chat(spark, ("user", "ok"), ("assistant", "Great."))).count() == 0


def test_cross_turn_consumes_what_is_between(spark):
    m = chat(spark, ("user", "How do I fix the error: x?"), ("assistant", "Which version?"), ("user", "How do I see the version?"), ("assistant", "Upgrade it."), ("user", "How to go on from here?"), ("assistant", "Run it."))
    got = distill.extract_pairs(m).orderBy("turn").collect()
    assert [(r["turn"], r["solution"], r["method"]) for r in got] == [(0, "Upgrade it.", "cross-turn"), (4, "Run it.", "direct")]


def test_cross_turn_without_answer(spark):
    assert distill.extract_pairs(chat(spark, ("user", "How do I read a file?"), ("assistant", "Which file?"))).count() == 0


@pytest.mark.parametrize("text,noise", [("How do I read a file?", False), ("thanks", True), ("Use std::fs::read_to_string.", False), ("", True), ("hi, how do I parse JSON?", True), ("history of the borrow checker", False), ("x" * 8001, True), (None, True)])
def test_noise(spark, text, noise):
    assert one(spark, S.is_noise(F.col("t").cast("string")), t=text) is noise


@pytest.mark.parametrize("text,want", [("How do I parse a JSON string in Rust?", True), ("Why?", False), ("thank you, this is very helpful to me", False), (None, False)])
def test_problem(spark, text, want):
    assert one(spark, S.is_problem(F.col("t").cast("string")), t=text) is want


@pytest.mark.parametrize("text,want", [("really?", True), ("how do I solve this", True), ("the value is 42", False), ("真的？", True)])
def test_question(spark, text, want):
    assert one(spark, S.is_question(F.col("t")), t=text) is want


@pytest.mark.parametrize("n,want", [(0, 0.0), (8, 0.15), (16, 0.30), (400, 0.30), (600, 0.15), (800, 0.0)])
def test_length_score(spark, n, want):
    assert one(spark, S.length_score(F.col("n")), n=n) == pytest.approx(want)


def test_importance(spark):
    pairs = spark.createDataFrame([(1, 0, "How do I fix the memory leak?", "Use RAII to manage the resource.", "direct")], "conv_id long, turn long, problem string, solution string, method string")
    r = distill.candidates(pairs).first()
    assert (r["memory_type"], r["importance"]) == ("knowledge", pytest.approx(0.94))


def test_compress(spark):
    got = one(spark, distill.compress(F.col("p"), F.col("s")), p="é" * 100 + "?", s="short")
    assert got == "é" * 30 + "…\nProblem: " + "é" * 80 + "…\n→ Solution: short"


def test_tokens_and_bm25(spark):
    assert one(spark, T.tokenize(F.col("t")), t="The Rust Borrow Checker") == ["rust", "borrow", "checker"]
    assert one(spark, T.tokenize(F.col("t")), t="a b c") == []
    assert one(spark, T.bm25(T.raw_tokens(F.col("t")), ["rust"]), t="rust rust") == pytest.approx(0.625)
    assert one(spark, T.bm25(T.raw_tokens(F.col("t")), []), t="rust") == 0.0


def test_keyword_search_and_tenants(spark):
    rows = [(1, "t1", "rust async runtime uses tokio", 0.8), (2, "t1", "python gil concurrency model", 0.7), (3, "t1", "rust borrow checker prevents data races", 0.9), (4, "t2", "rust async elsewhere", 1.0)]
    m = spark.createDataFrame(rows, "id long, tenant_id string, content string, confidence double")
    assert [r["id"] for r in retrieval.keyword_search(m, "rust async", tenant="t1").collect()] == [1]
    assert retrieval.keyword_search(m, "rust async", tenant="t3").count() == 0
    assert [r["id"] for r in retrieval.keyword_search(m, "rust", tenant="t1").collect()] == [3, 1]


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    got = spark.range(1).select(cosine(v(1, 0), v(1, 0)).alias("a"), cosine(v(1, 0), v(0, 1)).alias("b"), cosine(v(1, 0), v(1)).alias("c"), cosine(v(0, 0), v(1, 0)).alias("d")).first()
    assert tuple(got) == (1.0, 0.0, None, None)


def test_nearest_buckets_recall(spark, sf):
    from engram.plans import all_queries

    q = all_queries()
    exact = {tuple(r) for r in q["knn_exact"](spark, sf).select("query_id", "id").collect()}
    near = {tuple(r) for r in q["knn_buckets"](spark, sf).select("query_id", "id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 5)).round(1)
    v[10:40] = v[0]  # copies: ties go to the smallest id
    rows = spark.createDataFrame([(i, x.tolist(), 0 if i < 60 else 1) for i, x in enumerate(v)], "id long, vector array<float>, cell int")
    q = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"), "cell")
    u = np.array(v, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for query_block, vector_block in ((8192, 32768), (4, 7)):
        got = retrieval.nearest_in_cells(q, rows, 4, query_block, vector_block).collect()
        want = set()
        for a in range(0, 90, 3):
            near = sorted((round(1 - float(u[a] @ u[b]), 9), b) for b in range(90) if (a < 60) == (b < 60))[:4]
            want |= {(a, b, r + 1) for r, (_, b) in enumerate(near)}
        assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, vector array<float>")
    for find in (retrieval.nearest_each, retrieval.nearest_by_cells):
        assert find(none, none, 3).count() == 0
        assert {(r["query_id"], r["id"]) for r in find(odd, odd, 1).collect()} == {(1, 1), (2, 1)}


def test_greedy_centroids(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "a", [0.0, 1.0])], "id long, g string, vector array<float>")
    got = retrieval.compress_centroids(v, "g", 0.1).orderBy("cluster").collect()
    assert [(r["n"], r["members"]) for r in got] == [(2, [1, 2]), (1, [3])]


@pytest.mark.parametrize("text,want", [("第十二回 甲", 12), ("第3章", 3), ("第一百零五回", 105), ("第二十章", 20), ("text", None)])
def test_chapters(spark, text, want):
    assert one(spark, T.chapter_number(F.col("t")), t=text) == want


def test_year(spark):
    assert one(spark, T.year(F.col("t")), t="in 12345 or 1815 and 1900") == 1815


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="小心！有埋伏。撤!") == ["小心！", "有埋伏。", "撤!"]
    assert one(spark, T.sentences(F.col("t")), t="") == []


def test_chunks(spark):
    assert [len(c) for c in one(spark, T.chunks(F.col("t")), t="x" * 3700)] == [2000, 1900, 100]
    assert one(spark, T.chunks(F.col("t")), t="") == []


def test_half_width(spark):
    assert one(spark, T.half_width(F.col("t")), t="ＡＢ　ｃ 1") == "ABc1"


def test_split_chapters(spark):
    d = spark.createDataFrame([(1, "preface\n第一回 甲\na\n第二回 乙\nb\n第一回 again\nc")], "doc_id long, text string")
    assert [tuple(r) for r in narrative.split_chapters(d).orderBy("chapter").collect()] == [(1, 1, "a"), (1, 2, "b\n第一回 again\nc")]


def test_mentions_are_leftmost_longest(spark):
    rows = spark.createDataFrame([(1, 0, "刘备用剑，刘备之子遇关羽")], "doc_id long, pos int, sentence string")
    got = narrative.mentions(rows, [("刘备", "刘备"), ("刘备之子", "刘禅"), ("关羽", "关羽")]).orderBy("start").collect()
    assert [(r["canonical"], r["start"]) for r in got] == [("刘备", 0), ("刘禅", 15), ("关羽", 30)]


def test_events_and_factions(spark):
    rows = spark.createDataFrame([(1, 0, "关羽归降曹操"), (1, 1, "曹操赞关羽")], "doc_id long, pos int, sentence string")
    found = narrative.mentions(rows, [("曹操", "曹操"), ("关羽", "关羽")])
    ev = narrative.verb_events(found, rows, ["归降", "赞"])
    assert {tuple(r) for r in ev.collect()} == {(1, 0, "归降", "关羽", "曹操"), (1, 1, "赞", "曹操", "关羽")}
    start = spark.createDataFrame([(1, "曹操", "魏"), (1, "关羽", "蜀")], "doc_id long, name string, faction string")
    assert [tuple(r) for r in narrative.factions(ev, start, ["归降"], []).collect()] == [(1, 0, "关羽", "蜀", "魏", "surrender")]


def test_relation_timeline_and_arcs(spark):
    o = spark.createDataFrame([(1, "a", "b", 1, "ally"), (1, "a", "b", 2, "ally"), (1, "a", "b", 5, "enemy")], "doc_id long, a string, b string, time int, relation string")
    assert [tuple(r)[3:] for r in narrative.relation_timeline(o).orderBy("valid_from").collect()] == [("ally", 1, 5), ("enemy", 5, None)]
    t = spark.createDataFrame([(1, "a", 0, "狡诈"), (1, "a", 5, "仁义"), (1, "b", 0, "x")], "doc_id long, name string, pos int, trait string")
    assert dict(narrative.arcs(t).select("name", "arc").collect()) == {"a": "growth", "b": "stable"}  # from a negative to a positive trait


def facts(spark, *rows):
    return spark.createDataFrame([(i, 1, k, t, t, c, n, p) for i, (k, t, c, n, p) in enumerate(rows)], "id long, entity_id long, fact_type string, time long, created_at long, content string, negated boolean, persona boolean")


def test_stance_flip(spark):
    f = facts(spark, ("preference", 2024, "我喜欢应酬", False, True), ("preference", 2026, "我不喜欢应酬", True, True))
    assert [r["milestone"] for r in persona.milestones(f).where("milestone = 'stance_flip'").collect()] == ["stance_flip"]
    f = facts(spark, ("preference", 1, "我喜欢", False, True), ("preference", 2, "我讨厌", True, True))
    assert persona.milestones(f).where("milestone = 'stance_flip'").count() == 0


def test_start_and_current(spark):
    f = facts(spark, ("identity", 2020, "a", None, True), ("preference", 2024, "b", None, True), ("preference", 2026, "c", None, True))
    assert tuple(persona.start_and_current(f).first()) == (1, 0, 2)


def test_decay(spark):
    f = facts(spark, ("event", 0, "a", None, False), ("event", 0, "b", None, True)).withColumns({"importance": F.lit(0.1), "access_count": F.lit(10)})
    got = {r["id"]: (round(r["weight"], 6), r["archived"]) for r in persona.decayed(f, 10).collect()}
    assert got == {0: (0.666667, True), 1: (1.0, False)}
    assert persona.decayed(f, 10, force=True).where("archived").count() == 2
    assert tuple(persona.decay_stats(persona.decayed(f, 10)).first()) == (2, 1, 1, 1)


def test_relationship(spark):
    r = persona.relationship(chat(spark, ("user", "我很开心"))).first()
    assert (r["intimacy"], r["stage"], r["trend"]) == (0.02, "stranger", "rising")
    r = persona.relationship(chat(spark, ("user", "我很难过"))).first()
    assert (r["intimacy"], r["trend"]) == (0.0, "stable")


def test_persona_signal(spark):
    got = one(spark, persona.keyword_signals(F.col("t")), t="其实我不喜欢应酬")
    assert (got["marker"], got["fact_type"], got["negated"]) == ("我不喜欢", "preference", True)
    assert one(spark, persona.keyword_signals(F.col("t")), t="nothing") is None


def test_latest_needs_string_keys(spark):
    rows = [(1, 1, "preference", 1, 1, '{"topic":"a","content":"x"}'), (2, 1, "preference", 2, 2, '{"topic":"a","content":"y"}'), (3, 1, "preference", 3, 3, '{"topic":5,"content":"x"}')]
    f = spark.createDataFrame(rows, "id long, entity_id long, fact_type string, time long, created_at long, payload string")
    assert {(r["id"], r["key"]) for r in cognition.latest_by_key(f).collect()} == {(2, "a"), (3, "x")}


def test_tool_status(spark):
    rows = [(1, 0, "user", "go", None, None), (1, 1, "assistant", "call", "t", None), (1, 2, "tool", "all failed", None, "c1"), (1, 3, "assistant", "sorry", "t2", None), (1, 4, "assistant", "end", None, None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, tool_name string, tool_call_id string")
    assert [(r["tool"], r["status"]) for r in cognition.tool_events(m).orderBy("turn").collect()] == [("t", "error"), ("t2", "timeout")]
    assert [(r["tool_name"], r["status"], r["reasoning"]) for r in distill.reasoning_steps(m).collect()] == [("t", "error", "sorry")]


def test_turning_points(spark):
    t = spark.createDataFrame([(1, x, i) for i, x in enumerate([1, 2, 3, 23, 24, 25])], "id long, time int, n long")
    assert [r["n"] for r in graph.turning(t, "id", "time", "n").where("turning").orderBy("n").collect()] == [2, 3]
    assert graph.turning(t.where("n < 2"), "id", "time", "n").where("turning").count() == 0


def test_alias_lookup(spark):
    o = spark.createDataFrame([(1, "person", "流苏"), (2, "person", "赵云"), (3, "person", "赵飞"), (4, "person", "刘备"), (5, "concept", "刘备用剑")], "id long, object_type string, name string")
    names = spark.createDataFrame([("白流苏",), ("赵",), ("刘备",), ("刘备用",)], "surface string")
    assert dict(graph.find_by_alias(o, names).collect()) == {"白流苏": 1, "赵": None, "刘备": 4, "刘备用": 4}


def test_path(spark):
    e = spark.createDataFrame([(1, 2, "a", 1, None), (2, 3, "b", 2, None), (1, 4, "c", 1, None)], "source_id long, target_id long, predicate string, valid_from int, valid_to int")
    assert [tuple(r) for r in graph.trace_path(e, 3, 4).orderBy("step").collect()] == [(0, 3, None), (1, 2, "b"), (2, 1, "a"), (3, 4, "c")]
    assert graph.trace_path(e, 3, 9).count() == 0


def test_property_merge(spark):
    got = one(spark, graph.merge_properties(F.col("a"), F.col("b")), a='{"x":"1","y":"2"}', b='{"y":"3"}')
    assert got == '{"x":"1","y":"3"}'


def test_bundle_round_trip(spark, tmp_path):
    o = spark.createDataFrame([(1, "person", "a"), (2, "person", "b")], "id long, object_type string, name string")
    e = spark.createDataFrame([(1, 2, "knows", 1, None), (1, 9, "lost", 1, None)], "source_id long, target_id long, predicate string, valid_from int, valid_to int")
    bundle.write(o, e, str(tmp_path / "b"))
    objects, edges = bundle.merge(o, e.where("false"), *bundle.read(spark, str(tmp_path / "b")))
    assert objects.count() == 2 and [tuple(r) for r in edges.collect()] == [(1, 2, "knows", 1, None)]
    objects, edges = bundle.merge(objects, edges, *bundle.read(spark, str(tmp_path / "b")))
    assert (objects.count(), edges.count()) == (2, 1)


def test_json_loader(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "one"}, {"title": "T", "text": "two"}, {"title": "no text"}]')
    (tmp_path / "b.json").write_text('{"documents": [{"text": "three"}]}')
    (tmp_path / "c.json").write_text('{"title": "C", "text": "four"}')
    got = {(r["title"], r["text"]) for r in loaders.read_json(spark, str(tmp_path)).collect()}
    assert got == {("a#0", "one"), ("T", "two"), ("b#0", "three"), ("C", "four")}


def test_external(spark):
    df = spark.createDataFrame([("a", "Rust one", 2.0), ("b", "rust two", None)], "id string, text string, score double")
    assert [r["id"] for r in external.Registry().add("x", df).search("RUST").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        external.Registry().all()


def test_distil_twice_is_stable(spark):
    m = chat(spark, ("user", "How do I fix the error in the config of production?"), ("assistant", "The solution is to fix the cause."))
    store = spark.createDataFrame([], "id long, tenant_id string, memory_type string, content string, confidence double, created_at long, expires_at long")
    s1, _ = distill.distil(m, store, "t", 1000)
    assert s1.count() == 1
    s2, actions = distill.distil(m, s1, "t", 2000)
    assert s2.count() == 1 and [r["action"] for r in actions.collect()] == ["drop"]
    assert distill.distil(m.where("false"), s1, "t", 10**10)[0].count() == 0


def test_stream_relationship_keeps_state(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    schema = "conv_id long, turn long, role string, content string"
    for i in range(2):
        chat(spark, ("user", "开心")).write.mode("append").parquet(str(src))
        q = jobs.relationship(spark.readStream.schema(schema).parquet(str(src)))
        q.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["intimacy"] for r in spark.read.parquet(str(out)).collect()) == [0.02, 0.04]


def test_cooccurrence(spark):
    m = spark.createDataFrame([(g, n) for g in range(3) for n in "ab"] + [(0, "c")], "group_id long, name string")
    assert [tuple(r) for r in corpus.cooccurrence(m).collect()] == [("a", "b", 3)]


def test_without_overlap(spark):
    rows = [(1, 0, 2, "ab"), (1, 0, 3, "abc"), (1, 2, 2, "cd"), (1, 3, 1, "d"), (2, 5, 1, "x")]
    s = spark.createDataFrame(rows, "group_id long, start long, length long, name string")
    assert sorted(r["name"] for r in narrative.without_overlap(s).collect()) == ["abc", "d", "x"]


def test_global_rank(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7919 % 1000)
    assert retrieval.global_rank(df, "r", F.desc("x")).where("r <> 999 - x").count() == 0


def test_character_model(spark):
    rows = spark.createDataFrame([(1, 0, "刘备与关羽结义"), (1, 1, "关羽斩颜良")], "doc_id long, pos int, sentence string")
    found = narrative.mentions(rows, [("刘备", "刘备"), ("关羽", "关羽"), ("颜良", "颜良")])
    assert {tuple(r) for r in corpus.relation_types(rows, found, [("结义", "oath"), ("斩", "enemy")]).collect()} == {(1, "关羽", "刘备", "oath"), (1, "关羽", "颜良", "enemy")}
    assert dict(corpus.action_sentences(rows, found, ["斩"]).select("name", "sentence").collect()) == {"关羽": "关羽斩颜良", "颜良": "关羽斩颜良"}
    c = spark.createDataFrame([("关羽", ["云长"], 0.5), ("关羽之子", None, 0.9), ("张飞", ["关三"], 0.7)], "name string, aliases array<string>, importance double")
    assert [r["name"] for r in corpus.search_characters(c, "关羽").collect()] == ["关羽", "关羽之子"]
    ev = spark.createDataFrame([(1, 3, "结义", "刘备", "s"), (1, 3, "结义", "关羽", "s"), (1, 3, "结义", "关羽", "s2")], "doc_id long, chapter int, title string, name string, sentence string")
    objects, edges, evidence = corpus.to_graph(ev)
    assert (objects.count(), edges.count(), evidence.count()) == (3, 2, 2)


def test_cards_stories_and_texts(spark):
    with pytest.raises(ValueError):
        persona.check_thresholds(0.9, 0.75, 0.95)
    persona.check_thresholds(0.75, 0.75, 0.95)
    f = facts(spark, ("identity", 1, "我是我", None, True), ("preference", 2, "茶", None, True))
    assert persona.card_text(persona.cards(f)).first()["text"] == "identity: 我是我\npreference: 茶"
    ev = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "entity_id long, event_id long, content string")
    assert persona.milestones(persona.story_facts(ev)).where("milestone = 'large_gap'").count() == 1
    o = spark.createDataFrame([(1, "person", "a"), (2, "event", "e"), (3, "person", "b")], "id long, object_type string, name string")
    e = spark.createDataFrame([(1, 2, "participated_in", 1, None), (1, 3, "knows", 1, None)], "source_id long, target_id long, predicate string, valid_from int, valid_to int")
    al = spark.createDataFrame([(1, "x")], "id long, alias string")
    assert graph.vector_texts(o, al, e).where("id = 1").first()["text"] == "a a a x knows b e"
    assert graph.run_row(spark, 1, "v", "done", 1, 2, {"n": 1}).first()["statistics"] == '{"n": 1}'


def test_embed_survives_a_failing_service(spark):
    from engram.operators import people

    def service(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    rows = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id int, t string").coalesce(1)
    assert [r["vector"] for r in people.embed(rows(["ab", None, ""]), "t", service).orderBy("id").collect()] == [[2.0], None, [0.0]]
    assert [r["vector"] for r in people.embed(rows(["ab", "bad"]), "t", service).collect()] == [None, None]


def test_first_mention_snippets(spark):
    from engram.operators import people

    chapters = spark.createDataFrame([(1, "é" * 50 + "Anna Lee went" + "x" * 100), (2, "nobody"), (3, None)], "chapter_id int, text string")
    aliases = spark.createDataFrame([("Anna", "Anna"), ("Anna", "Anna Lee"), ("Lee", "Lee")], "name string, alias string")
    got = {r["name"]: r for r in people.first_mentions(chapters, aliases).collect()}
    assert (got["Anna"]["alias"], got["Anna"]["start"], got["Anna"]["end"]) == ("Anna Lee", 100, 108) and got["Lee"]["start"] == 105
    assert got["Anna"]["snippet"] == "é" * 40 + "Anna Lee went" + "x" * 75


def test_hybrid_search_ranks_hits_among_candidates(spark):
    """A nearer memory that is no candidate takes no rank, and one of another tenant takes no place."""
    from engram.operators import retrieval

    rows = [(1, "a", "red fox", [0.0, 1.0]), (2, "a", "red fox runs", [1.0, 0.2]), (3, "a", "blue", [1.0, 0.0]), (4, "b", "red fox", [1.0, 0.1])]
    m = spark.createDataFrame(rows, "id long, tenant_id string, content string, vector array<double>").selectExpr("*", "'knowledge' AS memory_type", "0.0D AS confidence", "0L AS created_at", "CAST(NULL AS BIGINT) AS expires_at")
    got = {r["id"]: r["score"] for r in retrieval.hybrid_search(m, "red fox", [1.0, 0.0], 10**9, tenant="a").collect()}
    assert set(got) == {"1", "2"}
    # both have all terms once, so keyword ranks go by id; vector ranks are 0 for memory 2 and 1 for memory 1
    assert got["1"] == pytest.approx(1 / 60 + 1 / 61, abs=1e-8) and got["2"] == pytest.approx(1 / 61 + 1 / 60, abs=1e-8)


def test_contained_pairs_by_brute_force(spark):
    import random

    from engram.operators import distill

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None, "日本語の文", "日本語の文章"]
    grams = {t: {t[i : i + 2] for i in range(len(t) - 1)} for t in set(texts) if t}
    want = set()
    for a in grams:
        for b in grams:
            x, y = grams[a], grams[b]
            if a < b and x and y and 2 * min(len(x), len(y)) >= max(len(x), len(y)) and len(x & y) / min(len(x), len(y)) >= 0.8:
                want.add((a, b))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(r["a"], r["b"]) for r in distill.contained_pairs(rows, "t", 0.8).collect()} == want
