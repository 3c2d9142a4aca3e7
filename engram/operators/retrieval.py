"""Search over memories: keyword, vector and hybrid; vector classification and resolution; nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.scores import temporal_score, time_intent
from engram.functions.text import bm25, raw_tokens
from engram.functions.vectors import centroids, cosine
from engram.operators.graph import checkpointed


def query_terms(query: str, stop_words: Sequence[str] | None = None) -> list[str]:
    """A query's terms, as functions.text.tokenize cuts a column."""
    from engram.functions.lexicons import STOP_WORDS

    stop = STOP_WORDS if stop_words is None else stop_words
    runs = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return [t for t in runs if len(t.encode()) > 1 and t not in stop]


def matches_all(document: Column, terms: Sequence[str]) -> Column:
    """Are all terms among the document's tokens; false without terms."""
    return reduce(lambda a, b: a & b, [F.array_contains(document, t) for t in terms]) if terms else F.lit(False)


def contains_text(text: Column, query: str) -> Column:
    return F.lower(text).contains(query.lower())


def candidates(memories: DataFrame, query: str, tenant: str | None = None, kind: str | None = None) -> DataFrame:
    """Memories of the tenant and type that have all terms or hold the query as it is, with tokens, fts and score parts.

    Filters on plain columns come first, so they reach the scan.
    """
    m = memories
    for column, value in (("tenant_id", tenant), ("memory_type", kind)):
        m = m if value is None else m.where(F.col(column) == value)
    terms = query_terms(query)
    m = m.withColumn("tokens", raw_tokens(F.col("content")))
    m = m.withColumn("fts", matches_all(F.col("tokens"), terms)).where(F.col("fts") | contains_text(F.col("content"), query))
    return m.withColumn("bm25", bm25(F.col("tokens"), terms)).drop("tokens")


def keyword_search(memories: DataFrame, query: str, k: int = 10, tenant: str | None = None, kind: str | None = None) -> DataFrame:
    """The k best by .7 bm25 + .3 confidence; among equals the smallest id."""
    c = candidates(memories, query, tenant, kind)
    return c.withColumn("score", F.round(0.7 * F.col("bm25") + 0.3 * F.col("confidence"), 9)).orderBy(F.desc("score"), "id").limit(k)


def distances(vectors: DataFrame, query: Sequence[float], id_: str = "id", vector: str = "vector") -> DataFrame:
    """(id, distance): cosine distance of every vector from the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_).alias("id"), F.round(1.0 - F.coalesce(cosine(F.col(vector), q), F.lit(0.0)), 9).alias("distance"))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_: str = "id", vector: str = "vector") -> DataFrame:
    """The exact k nearest by cosine distance: (id, distance); ties by id. One pass, a top-k in each task."""
    return distances(vectors, query, id_, vector).orderBy("distance", "id").limit(k)


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The exact k nearest stored vectors of every query: (query_id, id, distance, rank); ties by id.

    queries and vectors have id and vector; null vectors are left out. Both sides are cut into blocks by a hash of the
    id, and a task compares one block of queries with one of vectors as matrices: never a pair a row, nothing through
    the driver. The work is the product of both sides, so queries should be few beside vectors.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.lit(0).alias("cell"))
    return nearest_in_cells(q, vectors.select("id", "vector", F.lit(0).alias("cell")), k)


def _grid(queries: DataFrame, vectors: DataFrame, query_block: int, vector_block: int):
    """Queries (query_id, q, cell) and vectors (id, vector, cell), grouped by the blocks of a grid for each cell: each query goes
    to every block of vectors of its cell, each vector to every block of queries."""
    blocks = lambda n: F.ceil(F.count("*") / n).cast("int")
    shape = queries.groupBy("cell").agg(blocks(query_block).alias("rows")).join(vectors.groupBy("cell").agg(blocks(vector_block).alias("cols")), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    cell = F.col("cell").alias("cell")  # a column of its own, should both sides come from one table
    q = queries.join(shape, "cell").select(cell, own("query_id", "rows").alias("r"), every("cols").alias("c"), "query_id", "q")
    v = vectors.join(shape, "cell").select(cell, every("rows").alias("r"), own("id", "cols").alias("c"), "id", "vector")
    return q.groupBy("cell", "r", "c").cogroup(v.groupBy("cell", "r", "c"))


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = 2048, vector_block: int = 16384) -> DataFrame:
    """The k nearest of each query (query_id, q, cell) among vectors (id, vector, cell) of its cells.

    A cell is a grid of blocks of about query_block by vector_block rows, however many rows it has: each query goes to
    every block of vectors of its cell, each vector to every block of queries.
    """
    queries, vectors = queries.where("q is not null"), vectors.where("vector is not null")
    met = _grid(queries, vectors, query_block, vector_block).applyInArrow(_best_of_block(k), "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of a column as rows of length 1; a zero vector stays zero."""
    flat = column.combine_chunks()
    v = np.asarray(flat.flatten(), float).reshape(len(flat), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _best_of_block(k: int, step: int = 1024):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        queries, q, ids, v = left["query_id"].to_numpy(), _unit(left["q"]), right["id"].to_numpy(), _unit(right["vector"])
        best_d, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for at in range(0, len(v), step):
            d = np.concatenate([best_d, np.round(1 - q @ v[at : at + step].T, 9)], 1)
            i = np.concatenate([best_i, np.broadcast_to(ids[at : at + step], (len(q), len(v[at : at + step])))], 1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        return pa.table([pa.array(np.repeat(queries, best_d.shape[1])), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names)

    return run


def cosines_below(queries: DataFrame, vectors: DataFrame, query_block: int = 512, vector_block: int = 4096) -> DataFrame:
    """(query_id, id, similarity): the cosine, in [0, 1], of every query (query_id, q, cell) with each vector (id, vector, cell) of
    its cell that has a smaller id; 0 where a vector is null, empty, zero or of another length. The result has a row a
    pair, and a task makes those of one block of each side as a product of matrices."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["query_id"].to_numpy(), right["id"].to_numpy()
        (x, n), (y, m) = _padded(left["q"]), _padded(right["vector"])
        width = max(x.shape[1], y.shape[1])
        wide = lambda v: np.pad(v, ((0, 0), (0, width - v.shape[1])))
        s = np.where(n[:, None] == m[None], np.clip(np.nan_to_num(wide(x) @ wide(y).T), 0, 1), 0.0)
        i, j = np.nonzero(a[:, None] > b[None])
        return pa.table([pa.array(a[i], pa.int64()), pa.array(b[j], pa.int64()), pa.array(s[i, j])], ["query_id", "id", "similarity"])

    ids = lambda df, c: df.where(F.col(c).isNotNull()).withColumn(c, F.col(c).cast("long"))
    return _grid(ids(queries, "query_id"), ids(vectors, "id"), query_block, vector_block).applyInArrow(run, "query_id long, id long, similarity double")


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, filled up with zeros, and how many numbers each has; null is one of none."""
    rows = [np.asarray(v if v is not None else [], float) for v in column.to_numpy()]
    n = np.array([len(v) for v in rows], np.int64)
    x = np.zeros((len(rows), int(n.max(initial=0))))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), n


def most_similar(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, other, similarity): the row of the same group whose text has the most letter pairs in common with a row's, by the
    Jaccard similarity of their sets, if that is over the threshold (0 to 1, not included); the smallest id of equals.

    rows has id, kind (the group) and text; ids are different. Rows of one text are one in the search, so many copies of a
    text cost no more than one. Texts of a group are compared if they share one of their rarest pairs: with a similarity over
    the threshold, at most (1 - threshold) of a set can be missing in the other, so the rest of it holds a common one.
    Texts without pairs are alike among themselves, null texts like nothing.
    """
    from engram.functions.text import bigram_set, jaccard

    rows = rows.where("text is not null").select("id", "kind", "text")
    own = ["kind", "text"]
    first = rows.groupBy(*own).agg(F.min("id").alias("first"))
    second = rows.join(first, own).where("id <> first").groupBy(*own).agg(F.min("id").alias("second"))
    texts = checkpointed(first.join(second, own, "left").withColumn("g", bigram_set(F.col("text"))))
    keys = texts.select("kind", "first", F.size("g").alias("n"), F.explode(F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.lit("")))).alias("k"))
    rare = keys.groupBy("kind", "k").agg(F.count("*").alias("c"))
    w = Window.partitionBy("kind", "first").orderBy("c", "k")
    most = F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    heads = checkpointed(keys.join(rare, ["kind", "k"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("kind", "k", "first"))
    met = heads.join(heads.withColumnRenamed("first", "b"), ["kind", "k"]).where("first < b").select("kind", "first", "b").distinct()
    sets = texts.select("kind", "first", "g")
    pairs = met.join(sets, ["kind", "first"]).join(sets.withColumnsRenamed({"first": "b", "g": "h"}), ["kind", "b"])
    pairs = pairs.select("kind", F.col("first").alias("a"), "b", F.round(jaccard(F.col("g"), F.col("h")), 9).alias("s")).where(F.col("s") > threshold)
    both = pairs.unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    best = both.groupBy("kind", F.col("a").alias("first")).agg(F.min(F.struct((-F.col("s")).alias("o"), F.col("b").alias("other"))).alias("best"))
    j = rows.join(texts.select("kind", "text", "first", "second"), own).join(best, ["kind", "first"], "left")
    twin = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    out = F.least(F.col("best"), F.when(twin.isNotNull() & (threshold < 1), F.struct(F.lit(-1.0).alias("o"), twin.alias("other"))))
    return j.select("id", out.alias("m")).where("m is not null").select("id", "m.other", (-F.col("m.o")).alias("similarity"))


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with each row's place in the whole order, from 0, in a column of that name; ties must not be left to chance.

    Rows are sorted by range over all tasks; a row's place is its place in its range plus the rows of the ranges before.
    Only the counts of the ranges meet in one task.
    """
    inner = F.monotonically_increasing_id()
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(inner, 33), "_place": inner.bitwiseAND(F.lit((1 << 33) - 1))})
    s = checkpointed(s)
    n = s.groupBy("_range").agg(F.count("*").alias("_n"))
    before = n.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    return s.join(before, "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def vector_search(memories: DataFrame, query: Sequence[float], k: int = 10, kind: str | None = None) -> DataFrame:
    """The k nearest, ordered by distance, score .6 similarity + .2 confidence; a type is filtered after the cut."""
    near = nearest(memories, query, k)
    got = memories.join(F.broadcast(near), "id")  # k rows
    got = got if kind is None else got.where(F.col("memory_type") == kind)
    similar = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("distance")))
    return got.withColumn("score", F.round(0.6 * similar + 0.2 * F.col("confidence"), 9)).orderBy("distance", "id")


def hybrid_search(memories: DataFrame, query: str, vector: Sequence[float], now: int, k: int = 10, tenant: str | None = None, kind: str | None = None, external: DataFrame | None = None) -> DataFrame:
    """Reciprocal ranks of keyword and vector order among keyword candidates, plus confidence and freshness: id, score.

    Ranks start at 0. A candidate has a vector hit if it is among the max(candidates, k) nearest memories of the tenant;
    vector ranks count candidates with a hit only, by similarity clamped to [0, 1] and then by id, and a candidate without
    a hit gets nothing for it. Whatever is ordered whole is sorted by range, never in one task. external has (id, source, score): each adds 1 / (60 + rank) + .2 score as `ext:source:id`.
    """
    c = checkpointed(candidates(memories, query, tenant, kind).drop("content"))
    depth = max(c.count(), k)
    c = global_rank(c, "r_kw", F.desc("bm25"), F.asc("id"))
    own = memories if tenant is None else memories.where(F.col("tenant_id") == tenant)
    hits = global_rank(distances(own, vector), "r", F.asc("distance"), F.asc("id")).where(F.col("r") < depth).drop("r")
    similar = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("distance")))
    near = global_rank(hits.join(c.select("id"), "id").withColumn("similar", similar), "r_vec", F.desc("similar"), F.asc("id")).select("id", "r_vec")
    fresh = temporal_score(time_intent(F.lit(query)), F.col("created_at"), F.col("expires_at"), F.lit(now))
    score = 1.0 / (60 + F.col("r_kw")) + F.coalesce(1.0 / (60 + F.col("r_vec")), F.lit(0.0)) + 0.2 * F.col("confidence") + 0.15 * fresh
    out = c.join(near, "id", "left").select(F.col("id").cast("string").alias("id"), F.round(score, 9).alias("score"))
    if external is not None:
        extra = global_rank(external, "r", F.desc("score"), F.asc("id"))
        extra = extra.select(F.concat(F.lit("ext:"), "source", F.lit(":"), F.col("id").cast("string")).alias("id"), F.round(1.0 / (60 + F.col("r")) + 0.2 * F.col("score"), 9).alias("score"))
        out = out.unionByName(extra)
    return out.orderBy(F.desc("score"), "id").limit(k)


def classify_by_anchor(vectors: DataFrame, anchors: DataFrame, most: int = 10_000) -> DataFrame:
    """Each vector's best anchor (label, centroid): id, label, similarity; ties to the smallest label; a vector without a
    direction has the smallest label, with similarity -2.

    Up to `most` anchors are one literal array, in which each row looks; more are compared in blocks, with the same result.
    """
    rows = anchors.select("label", "centroid").orderBy("label").limit(most + 1).collect()
    kind = anchors.schema["label"].dataType.simpleString()
    if len(rows) > most:
        cell = F.lit(0).alias("cell")
        near = nearest_in_cells(vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), cell), anchors.select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("vector"), cell), 1)
        near = near.select(F.col("query_id").alias("id"), F.col("id").cast(kind).alias("near"), F.round(1.0 - F.col("distance"), 9).alias("s"))
        no_way = F.coalesce(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda x, y: x + y * y) == 0, F.lit(True))
        j = vectors.select("id", no_way.alias("no_way")).join(near, "id", "left")
        lost = F.col("no_way") | F.col("s").isNull()
        return j.select("id", F.when(lost, F.lit(rows[0]["label"])).otherwise(F.col("near")).cast(kind).alias("label"), F.when(lost, -2.0).otherwise(F.col("s")).alias("similarity"))
    table = anchors.sparkSession.createDataFrame([([(r["label"], r["centroid"]) for r in rows],)], f"anchors array<struct<label:{kind},centroid:array<double>>>")
    each = F.transform("anchors", lambda a: F.struct((-F.round(F.coalesce(cosine(F.col("vector"), a["centroid"]), F.lit(-2.0)), 9)).alias("d"), a["label"].alias("label")))
    best = vectors.join(F.broadcast(table)).withColumn("best", F.array_min(each))  # one row
    return best.select("id", F.col("best.label").alias("label"), (-F.col("best.d")).alias("similarity"))


def anchors_of(vectors: DataFrame) -> DataFrame:
    return centroids(vectors, "label", "vector")


class Clusters:
    """Greedy clusters of vectors that come in order. A block of vectors meets all clusters in one product of matrices, by
    their centroids at its start; only the few that the block itself has changed are looked at again, vector by vector."""

    def __init__(self, eps: float, samples: int):
        self.eps, self.most = eps, samples
        self.sums, self.norms, self.n, self.members = np.zeros((0, 0)), np.zeros(0), [], []

    def near(self, i: int, v: np.ndarray) -> bool:
        size = np.linalg.norm(self.sums[i]) * np.linalg.norm(v)
        return bool(size) and 1 - self.sums[i] @ v / size <= self.eps

    def put(self, i: int, v: np.ndarray) -> None:
        if i == len(self.sums):  # room for twice as many
            more = np.zeros((max(256, len(self.sums)), len(v)))
            self.sums, self.norms = np.concatenate([self.sums.reshape(-1, len(v)), more]), np.concatenate([self.norms, np.zeros(len(more))])
        self.sums[i] += v
        self.norms[i] = np.linalg.norm(self.sums[i])

    def add(self, ids: list, block: np.ndarray) -> None:
        start = len(self.n)
        lengths = np.linalg.norm(block, axis=1)
        # the largest distance that rounding can hide: nearer ones are settled by the exact test
        reach = 1 - self.eps - 1e-9
        open_ = block @ self.sums[:start].T >= reach * np.outer(lengths, self.norms[:start]) if start else np.zeros((len(block), 0), bool)
        changed: list[int] = []
        for row, (id_, v) in enumerate(zip(ids, block)):
            hit = None
            if lengths[row]:
                old = open_[row]
                old[[c for c in changed if c < start]] = False
                again = np.sort(changed)
                s = np.flatnonzero(self.sums[again] @ v >= reach * lengths[row] * self.norms[again]) if len(again) else []
                own = next((int(again[c]) for c in s if self.near(int(again[c]), v)), None)
                for c in np.flatnonzero(old):
                    if own is not None and c > own:
                        break
                    if self.near(int(c), v):
                        hit = int(c)
                        break
                hit = own if hit is None else hit
            if hit is None:
                hit = len(self.n)
                self.n.append(0)
                self.members.append([])
            self.put(hit, v)
            self.n[hit] += 1
            if len(self.members[hit]) < self.most:
                self.members[hit].append(id_)
            if hit not in changed:
                changed.append(hit)


def compress_centroids(vectors: DataFrame, group: str, eps: float, samples: int = 3) -> DataFrame:
    """Greedy clusters within each group in id order: a vector joins the first cluster whose running centroid is within
    eps of cosine distance, else opens one. (group, cluster, n, centroid, members: up to `samples` ids).

    Order decides, so a group is read in one task, as a sorted stream that holds the clusters only.
    """
    kind = vectors.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clusters = None, None

        def close() -> pd.DataFrame:
            sums, n = clusters.sums, clusters.n
            return pd.DataFrame([{group: now, "cluster": i, "n": n[i], "centroid": (sums[i] / n[i]).tolist(), "members": m} for i, m in enumerate(clusters.members)])

        for b in batches:
            ids, labels = b["id"].tolist(), b[group].tolist()
            at = 0
            while at < len(ids):
                if clusters is None or labels[at] != now:
                    if clusters is not None:
                        yield close()
                    now, clusters = labels[at], Clusters(eps, samples)
                to = at + 1
                while to < len(ids) and to - at < 256 and labels[to] == now:
                    to += 1
                clusters.add(ids[at:to], np.array(b["vector"].iloc[at:to].tolist(), float))
                at = to
        if clusters is not None:
            yield close()

    rows = vectors.select(group, "id", "vector").repartition(group).sortWithinPartitions(group, "id")
    return rows.mapInPandas(run, f"{group} {kind}, cluster int, n long, centroid array<double>, members array<long>")


def fit_cells(vectors: DataFrame, k: int = 10, recall: float = 0.95, sample: int = 20_000, most_cells: int = 4096, seed: int = 1) -> tuple[np.ndarray, int]:
    """(centres, probes) of a cell index, fitted on at most `sample` rows, those of the smallest hash of their id.

    There are as many cells as the root of the number of rows, most_cells at most, with centres by spherical k-means. A
    query is to look into `probes` cells: the least number of which 500 rows of the sample find that share of their k
    nearest in it. Vectors without structure ask for many, grouped ones for few.
    """
    v = vectors.where("vector is not null")
    rows = v.select("vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0)), 1
    x, rng = _unit(rows["vector"]), np.random.default_rng(seed)
    cells = max(1, min(most_cells, int(v.count() ** 0.5), len(x)))
    centres = x[np.sort(rng.choice(len(x), cells, replace=False))]
    for _ in range(8):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n > 0, sums / np.maximum(n, 1e-30), centres)
    own, asked = (x @ centres.T).argmax(1), x[:500]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.empty((len(asked), cells), np.int64)  # place of each cell in the order that a query takes them
    np.put_along_axis(place, np.argsort(-(asked @ centres.T), axis=1, kind="stable"), np.arange(cells)[None], 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return centres, int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def _cells_of(rows: DataFrame, vector: str, centres, probes: int) -> DataFrame:
    """rows (id first) with the `probes` nearest cells of a vector, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(pa.chunked_array([b[vector]]))
            for at in range(0, len(x), 2048):
                part = b.slice(at, 2048)
                cells = np.argsort(-(x[at : at + 2048] @ centres.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.where(F.col(vector).isNotNull()).mapInArrow(run, f"{kinds}, cells array<int>").select(*rows.columns, F.explode("cells").alias("cell"))


def nearest_by_cells(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, sample: int = 20_000, most_cells: int = 4096, seed: int = 1) -> DataFrame:
    """Approximate k nearest, by exact cosines in the cells nearest to a query: (query_id, id, distance, rank).

    The index is fitted on a bounded sample (fit_cells) and holds every row; a crowded cell is cut into blocks. Empty
    tables give no rows.
    """
    centres, probes = fit_cells(vectors, k, recall, sample, most_cells, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # at most most_cells rows
    q = _cells_of(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "q", shared, probes)
    return nearest_in_cells(q, _cells_of(vectors.select("id", "vector"), "vector", shared, 1), k)


def resolve_entities(mentions: DataFrame, aliases: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """mentions (id, surface, vector) to entities: by alias with score 1, else the nearest entity vector at the threshold,
    else unknown: (id, entity_id, score, stage). aliases has (alias, entity_id), both sides normalised here."""
    from engram.functions.text import half_width

    norm = lambda c: F.lower(half_width(F.col(c)))
    a = aliases.select(norm("alias").alias("key"), "entity_id").groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    got = mentions.withColumn("key", norm("surface")).join(a, "key", "left")
    known = got.where("entity_id is not null").select("id", "entity_id", F.lit(1.0).alias("score"), F.lit("alias").alias("stage"))
    rest = got.where("entity_id is null").select("id", "vector")
    if vectors is None:
        return known.unionByName(rest.select("id", F.lit(None).cast("long").alias("entity_id"), F.lit(0.0).alias("score"), F.lit("unknown").alias("stage")))
    near = nearest_each(rest.where("vector is not null"), vectors, 1).select(F.col("query_id").alias("id"), F.col("id").alias("near"), (1.0 - F.col("distance")).alias("similar"))
    j = rest.select("id").join(near, "id", "left")
    hit = F.coalesce(F.col("similar") >= threshold, F.lit(False))
    return known.unionByName(j.select("id", F.when(hit, F.col("near")).alias("entity_id"), F.when(hit, F.round("similar", 9)).otherwise(0.0).alias("score"), F.when(hit, "embedding").otherwise("unknown").alias("stage")))


#: A stage of resolving: of mentions (id, surface, ...) it gives those it decides, as id, entity_id (null: it knows that there
#: is none) and score; mentions it says nothing of go to the next stage.
Stage = Callable[[DataFrame], DataFrame]


def alias_stage(aliases: DataFrame) -> Stage:
    """Mentions whose surface, normalised, is an alias (alias, entity_id), with score 1; the least entity of equals."""
    from engram.functions.text import half_width

    norm = lambda c: F.lower(half_width(F.col(c)))
    table = aliases.select(norm("alias").alias("key"), "entity_id").groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    return lambda m: m.select("id", norm("surface").alias("key")).join(table, "key").select("id", "entity_id", F.lit(1.0).alias("score"))


def stop_stage(words: Sequence[str]) -> Stage:
    """Mentions that are no names: words of a list, which no later stage is asked about."""
    return lambda m: m.where(F.col("surface").isin(list(words))).select("id", F.lit(None).cast("long").alias("entity_id"), F.lit(0.0).alias("score"))


def vector_stage(vectors: DataFrame, threshold: float = 0.85) -> Stage:
    """Mentions with a vector, by the nearest entity vector (id, vector) if its cosine reaches the threshold."""

    def find(m: DataFrame) -> DataFrame:
        near = nearest_each(m.where("vector is not null").select("id", "vector"), vectors, 1)
        return near.select(F.col("query_id").alias("id"), F.col("id").alias("entity_id"), F.round(1.0 - F.col("distance"), 9).alias("score")).where(F.col("score") >= threshold)

    return find


def resolve_by_stages(mentions: DataFrame, stages: Sequence[tuple[str, Stage]]) -> DataFrame:
    """(id, entity_id, score, stage): each mention by the first stage, in order, that decides it; unknown by the stage
    `unknown`, with score 0, if none does. Mentions have different ids, not null. What a stage leaves is written before the
    next one reads it, so plans stay short and no stage works on what is decided."""
    left, out = mentions, None
    for name, stage in stages:
        found = checkpointed(stage(left).select("id", F.col("entity_id").cast("long").alias("entity_id"), F.col("score").cast("double").alias("score"), F.lit(name).alias("stage")))
        out = found if out is None else out.unionByName(found)
        left = checkpointed(left.join(found.select("id"), "id", "left_anti"))
    rest = left.select("id", F.lit(None).cast("long").alias("entity_id"), F.lit(0.0).alias("score"), F.lit("unknown").alias("stage"))
    return rest if out is None else out.unionByName(rest)
