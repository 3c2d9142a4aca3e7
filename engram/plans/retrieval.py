"""Queries of the retrieval family, over documents as memories and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram import catalog as C
from engram.functions import lexicons as L
from engram.functions import scores as S
from engram.functions.text import bm25, raw_tokens, tokenize
from engram.operators import proximity as X
from engram.operators import retrieval as R
from engram.plans.registry import ORACLE, contains_sql, query

Q = "thing that"
TERMS = ["thing", "that"]
_runs = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
_tf = {t: f"len(list_filter(tokens, lambda x: x = '{t}'))" for t in TERMS}
_bm = "(" + " + ".join(f"({x} / ({x} + 1.2))" for x in _tf.values()) + f") / {len(TERMS)}"
_all = " AND ".join(f"list_contains(tokens, '{t}')" for t in TERMS)
CAND = f"SELECT *, {_bm} AS bm FROM (SELECT *, {_runs} AS tokens FROM {C.MEMORIES_SQL} WHERE {{where}}) WHERE ({_all}) OR contains(lower(content), '{Q}')"


def _cand(where: str) -> str:
    return CAND.replace("{where}", where)


def vectors(spark, d):
    return C.Catalog(spark, d).table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def probe(spark, d, at: int = 0) -> list[float]:
    """The embedding with this id: the query vector of the searches here."""
    return [float(x) for x in vectors(spark, d).where(F.col("id") == at).first()["vector"]]


def memory_vectors(spark, d):
    v = vectors(spark, d).drop("label")
    return C.memories(spark, d).join(v, "id")


VEC = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
COS = "list_cosine_similarity(a.v, b.v)"


@query("keyword_search", f"SELECT id, tenant_id, round((0.7 * bm + 0.3 * confidence)::DOUBLE, 9) AS score FROM ({_cand('true')}) ORDER BY score DESC, id LIMIT 10")
def keyword_search(spark, d):
    return R.keyword_search(C.memories(spark, d), Q).select("id", "tenant_id", "score")


@query("keyword_search_typed", f"""SELECT id, tenant_id, round((0.7 * bm + 0.3 * confidence)::DOUBLE, 9) AS score FROM ({_cand("tenant_id = 'src3' AND memory_type = 'experience'")}) ORDER BY score DESC, id LIMIT 5""")
def keyword_search_typed(spark, d):
    return R.keyword_search(C.memories(spark, d), Q, 5, "src3", "experience").select("id", "tenant_id", "score")


@query("fts_and_match", f"SELECT id FROM (SELECT id, {_runs} AS tokens FROM {C.MEMORIES_SQL}) WHERE {_all}")
def fts_and_match(spark, d):
    return C.memories(spark, d).where(R.matches_all(raw_tokens(F.col("content")), TERMS)).select("id")


@query("bm25_scores", f"SELECT id, round(({_bm})::DOUBLE, 6) AS score FROM (SELECT id, {_runs} AS tokens FROM {C.MEMORIES_SQL})")
def bm25_scores(spark, d):
    return C.memories(spark, d).select("id", F.round(bm25(raw_tokens(F.col("content")), TERMS), 6).alias("score"))


_stop = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


@query("tokenize", f"SELECT id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT id, list_filter({_runs}, lambda x: strlen(x) > 1 AND x NOT IN ({_stop})) AS t FROM {C.MEMORIES_SQL})")
def tokens(spark, d):
    t = C.memories(spark, d).select("id", tokenize(F.col("content")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("vector_topk", f"""WITH near AS (SELECT b.id, round(1 - {COS}, 9) AS distance FROM {VEC} a JOIN (SELECT v.* FROM {VEC} v JOIN documents ON doc_id = v.id) b ON a.id = 0 ORDER BY distance, b.id LIMIT 20)
  SELECT n.id, n.distance, round((0.6 * greatest(0, least(1, 1 - n.distance)) + 0.2 * m.confidence)::DOUBLE, 9) AS score FROM near n JOIN {C.MEMORIES_SQL} m ON m.id = n.id WHERE memory_type = 'knowledge'""")  # fmt: skip
def vector_topk(spark, d):
    return R.vector_search(memory_vectors(spark, d), probe(spark, d), 20, "knowledge").select("id", "distance", "score")


@query("knn_exact", f"SELECT a.id AS query_id, b.id, round(1 - {COS}, 6) AS distance FROM {VEC} a JOIN {VEC} b ON a.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(1 - {COS}, 9), b.id) <= 5")
def knn_exact(spark, d):
    v = vectors(spark, d)
    return R.nearest_each(v.where("id % 20 = 0"), v, 5).select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("knn_buckets")
def knn_buckets(spark, d):
    """Approximate neighbours of every twentieth vector; tests measure its recall against knn_exact."""
    v = vectors(spark, d)
    return R.nearest_by_cells(v.where("id % 20 = 0"), v, 5).select("query_id", "id", "distance", "rank")


@query("knn_graph")
def knn_graph(spark, d):
    """Approximate neighbours of every twentieth vector by proximity graphs, with the number of vectors compared."""
    v = vectors(spark, d)
    return X.nearest_by_graph(v.where("id % 20 = 0"), X.graph_index(v, 5), 5)


#: A hit is a candidate among the nearest of all memories; hits are ranked among themselves.
FUSED = f"""WITH c AS (SELECT *, row_number() OVER (ORDER BY bm DESC, id) - 1 AS r FROM ({_cand('id IN (SELECT vec_id FROM embeddings)')})),
  near AS (SELECT b.id, round(1 - {COS}, 9) AS distance FROM {VEC} a JOIN (SELECT v.* FROM {VEC} v JOIN documents ON doc_id = v.id) b ON a.id = 0
    QUALIFY row_number() OVER (ORDER BY round(1 - {COS}, 9), b.id) <= greatest((SELECT count(*) FROM c), 10)),
  hits AS (SELECT id, row_number() OVER (ORDER BY greatest(0, least(1, 1 - distance)) DESC, id) - 1 AS r FROM near JOIN c USING (id)),
  fused AS (SELECT CAST(c.id AS VARCHAR) AS id, round((1.0::DOUBLE / (60 + c.r) + coalesce(1.0::DOUBLE / (60 + hits.r), 0) + 0.2 * confidence + 0.15 * CASE WHEN expires_at <= {C.NOW} THEN 0 ELSE 1 - greatest(0, least(7776000, {C.NOW} - created_at)) / 7776000.0::DOUBLE END)::DOUBLE, 9) AS score
    FROM c LEFT JOIN hits ON hits.id = c.id)"""


@query("hybrid_rrf", f"{FUSED} SELECT * FROM fused ORDER BY score DESC, id LIMIT 10")
def hybrid_rrf(spark, d):
    return R.hybrid_search(memory_vectors(spark, d), Q, probe(spark, d), C.NOW)


@query("hybrid_typed", f"""{FUSED.replace("id IN (SELECT vec_id FROM embeddings)", "id IN (SELECT vec_id FROM embeddings) AND tenant_id = 'src3' AND memory_type = 'experience'").replace("JOIN documents ON doc_id = v.id)", "JOIN documents ON doc_id = v.id AND source = 'src3')")} SELECT * FROM fused ORDER BY score DESC, id LIMIT 10""")
def hybrid_typed(spark, d):
    return R.hybrid_search(memory_vectors(spark, d), Q, probe(spark, d), C.NOW, tenant="src3", kind="experience")


@query("external_fusion", f"""{FUSED}, pages_ AS (SELECT page_id, round(page_id % 10 / 10.0::DOUBLE, 1) AS s, row_number() OVER (ORDER BY round(page_id % 10 / 10.0::DOUBLE, 1) DESC, page_id) - 1 AS r FROM pages)
  SELECT * FROM (SELECT * FROM fused UNION ALL SELECT 'ext:pages:' || page_id, round((1.0::DOUBLE / (60 + r) + 0.2 * s)::DOUBLE, 9) FROM pages_ WHERE r < 5) ORDER BY score DESC, id LIMIT 10""")  # fmt: skip
def external_fusion(spark, d):
    pages = C.Catalog(spark, d).table("pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("source"), F.round(F.col("page_id") % 10 / 10.0, 1).alias("score")).orderBy(F.desc("score"), "id").limit(5)
    return R.hybrid_search(memory_vectors(spark, d), Q, probe(spark, d), C.NOW, external=pages)


MEANS = """means AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i)"""


@query("anchor_centroids", f"WITH {MEANS} SELECT label, CAST(i - 1 AS INT) AS i, round(x, 6) AS x, n FROM means JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def anchor_centroids(spark, d):
    c = R.anchors_of(vectors(spark, d))
    return c.select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"), "n")


@query("anchor_classify", f"""WITH {MEANS}, a AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label)
  SELECT b.id, a.label, round({COS}, 6) AS similarity FROM a JOIN {VEC} b ON true QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round({COS}, 9) DESC, a.label) = 1""")  # fmt: skip
def anchor_classify(spark, d):
    v = vectors(spark, d)
    return R.classify_by_anchor(v, R.anchors_of(v)).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query("high_value_messages", f"""WITH {MEANS}, a AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label)
  SELECT b.id, round(max({COS}), 6) AS similarity FROM a JOIN {VEC} b ON true GROUP BY b.id HAVING round(max({COS}), 9) >= 0.25""")  # fmt: skip
def high_value_messages(spark, d):
    v = vectors(spark, d)
    return R.classify_by_anchor(v, R.anchors_of(v)).where("similarity >= 0.25").select("id", F.round("similarity", 6).alias("similarity"))


@query("high_value_categories", f"""WITH {MEANS}, a AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label),
  b AS (SELECT b.id, a.label, round({COS}, 9) AS s FROM a JOIN {VEC} b ON true QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round({COS}, 9) DESC, a.label) = 1) SELECT label, count(*) AS n FROM b WHERE s >= 0.25 GROUP BY label""")  # fmt: skip
def high_value_categories(spark, d):
    v = vectors(spark, d)
    return R.classify_by_anchor(v, R.anchors_of(v)).where("similarity >= 0.25").groupBy("label").agg(F.count("*").alias("n"))


@query("centroid_compression")
def centroid_compression(spark, d):
    return R.compress_centroids(vectors(spark, d), "label", 0.5)


@query("entity_resolution", f"""WITH m AS (SELECT id, 'name' || id AS surface, v FROM {VEC} WHERE id % 20 = 0), e AS (SELECT id, v FROM {VEC} WHERE id % 20 <> 0),
  n AS (SELECT a.id, b.id AS near, {COS} AS s FROM m a JOIN e b ON a.id % 40 <> 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(1 - {COS}, 9), b.id) = 1)
  SELECT m.id, CASE WHEN m.id % 40 = 0 THEN m.id WHEN s >= 0.2 THEN near END AS entity_id, round(CASE WHEN m.id % 40 = 0 THEN 1 WHEN s >= 0.2 THEN s ELSE 0 END::DOUBLE, 6) AS score,
    CASE WHEN m.id % 40 = 0 THEN 'alias' WHEN s >= 0.2 THEN 'embedding' ELSE 'unknown' END AS stage FROM m LEFT JOIN n ON n.id = m.id""")  # fmt: skip
def entity_resolution(spark, d):
    v = vectors(spark, d)
    mentions = v.where("id % 20 = 0").select("id", F.concat(F.lit("Name "), F.col("id").cast("string")).alias("surface"), "vector")
    aliases = v.where("id % 40 = 0").select(F.concat(F.lit("ｎame"), F.col("id").cast("string")).alias("alias"), F.col("id").alias("entity_id"))
    out = R.resolve_entities(mentions, aliases, v.where("id % 20 <> 0").select("id", "vector"), 0.2)
    return out.select("id", "entity_id", F.round("score", 6).alias("score"), "stage")


@query("conflict_vector", f"""WITH n AS (SELECT a.id, b.id AS old_id, a.label, b.label AS old_label, {COS} AS s FROM {VEC} a JOIN {VEC} b ON a.id % 20 = 0 AND b.id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(1 - {COS}, 9), b.id) <= 5),
  h AS (SELECT * FROM n WHERE label = old_label AND round(s, 9) >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, old_id) = 1)
  SELECT q.id, CASE WHEN h.id IS NULL THEN 'insert' WHEN q.id % 7 / 10.0 > h.old_id % 7 / 10.0 THEN 'replace' ELSE 'keep_both' END AS action, CASE WHEN q.id % 7 / 10.0 > h.old_id % 7 / 10.0 THEN h.old_id END AS old_id
  FROM (SELECT DISTINCT id FROM n) q LEFT JOIN h ON h.id = q.id""")  # fmt: skip
def conflict_vector(spark, d):
    from engram.operators.distill import resolve_by_vector

    v = vectors(spark, d)
    own = lambda p: v.select(F.col("id").alias(f"{p}i"), F.col("label").cast("string").alias(f"{p}t"), (F.col("id") % 7 / 10.0).alias(f"{p}c"))
    near = R.nearest_each(v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 5)
    j = near.join(own("n"), F.col("query_id") == F.col("ni")).join(own("o"), F.col("id") == F.col("oi"))
    rows = j.select(F.col("query_id").alias("id"), F.col("nt").alias("memory_type"), F.col("nc").alias("importance"), F.col("oi").alias("old_id"), F.col("ot").alias("old_type"), F.col("oc").alias("old_confidence"), F.round(1.0 - F.col("distance"), 9).alias("similarity"))
    return resolve_by_vector(rows, 0.3)


@query("time_intent", f"SELECT doc_id, CASE WHEN {contains_sql('lower(text)', L.PAST_WORDS)} THEN 'past' WHEN {contains_sql('lower(text)', L.FUTURE_WORDS)} THEN 'future' ELSE 'current' END AS intent FROM documents")
def time_intents(spark, d):
    return C.Catalog(spark, d).table("documents").select("doc_id", S.time_intent(F.col("text")).alias("intent"))


@query("persona_cosine", f"SELECT a.id AS a, b.id AS b, round(greatest(0, least(1, {COS}))::DOUBLE, 6) AS similarity FROM {VEC} a JOIN {VEC} b ON a.label = b.label AND a.id < b.id AND b.id % 20 = 0")
def persona_cosine(spark, d):
    v = vectors(spark, d)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.col("label").alias("cell"))
    met = R.cosines_below(q, v.select("id", "vector", F.col("label").alias("cell")))
    return met.select(F.col("id").alias("a"), F.col("query_id").alias("b"), F.round("similarity", 6).alias("similarity"))


_big = "list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2)))"


@query("bigram_jaccard_match", f"""WITH p AS (SELECT p_partkey, p_brand, p_name AS n FROM part), b AS (SELECT *, {_big} AS g FROM p),
  j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE AS s FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
  SELECT a, b, round(s, 6) AS similarity FROM j WHERE round(s, 9) > 0.45 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) = 1""")  # fmt: skip
def bigram_jaccard_match(spark, d):
    p = C.Catalog(spark, d).table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("text"))
    return R.most_similar(p, 0.45).select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("similarity", 6).alias("similarity"))


@query("entity_stages", ORACLE["entity_resolution"])
def entity_stages(spark, d):
    """entity_resolution as a list of stages: words that are no names, aliases, vectors."""
    v = vectors(spark, d)
    mentions = v.where("id % 20 = 0").select("id", F.concat(F.lit("Name "), F.col("id").cast("string")).alias("surface"), "vector")
    aliases = v.where("id % 40 = 0").select(F.concat(F.lit("ｎame"), F.col("id").cast("string")).alias("alias"), F.col("id").alias("entity_id"))
    stages = [("stop", R.stop_stage(["he", "she"])), ("alias", R.alias_stage(aliases)), ("embedding", R.vector_stage(v.where("id % 20 <> 0").select("id", "vector"), 0.2))]
    return R.resolve_by_stages(mentions, stages).withColumn("score", F.round("score", 6))
