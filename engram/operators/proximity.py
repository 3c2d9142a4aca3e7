"""Approximate neighbours by proximity graphs: one graph for each part of the vectors, searched greedily, merged by rank.

A part holds about part_rows vectors, dealt by a hash. In it every vector is linked with its `links` nearest, both ways,
and some vectors are entries: a sample of the part's root, and one of every connected piece of the graph, so all can be
reached. A search compares the query with the entries, then always opens the nearest vector not opened yet and compares
its links, while it is among the `width` best so far. The width is fitted in each part: the least that finds the wanted
share of true neighbours for a bounded sample of its members.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.graph import checkpointed
from engram.operators.retrieval import nearest_by_cells, nearest_each

WIDTHS = (1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0)


def _unit(column) -> np.ndarray:
    """Vectors of a column as rows of length 1; a zero vector stays zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = np.asarray(flat.flatten(), float).reshape(len(flat), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def linked(x: np.ndarray, links: int, step: int = 512) -> list[np.ndarray]:
    """Each row's neighbours: its nearest by cosine, and the rows whose nearest it is."""
    n, m = len(x), min(links, len(x) - 1)
    near = np.empty((n, m), np.int64)
    for at in range(0, n, step):
        s = x[at : at + step] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at : at + step] = np.argpartition(-s, m - 1, 1)[:, :m] if m else near[at : at + step]
    a = np.concatenate([np.repeat(np.arange(n), m), near.ravel()])
    b = np.concatenate([near.ravel(), np.repeat(np.arange(n), m)])
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def entries_of(near: list[np.ndarray], rng: np.random.Generator) -> list[int]:
    """A sample of the root of all rows, and the first row of each connected piece that has none in it."""
    n = len(near)
    entries = sorted(rng.choice(n, max(1, int(n**0.5)), replace=False).tolist())
    seen = np.zeros(n, bool)
    for start in [*entries, *range(n)]:
        if seen[start]:
            continue
        if start not in entries:
            entries.append(start)
        seen[start], front = True, [start]
        while front:
            new = np.unique(np.concatenate([near[i] for i in front]))
            new = new[~seen[new]]
            seen[new] = True
            front = new.tolist()
    return entries


def search(x: np.ndarray, near: list[np.ndarray], entries: np.ndarray, q: np.ndarray, k: int, width: int) -> tuple[list[tuple[float, int]], int]:
    """The k nearest rows that a greedy search finds, as (similarity, row), and how many rows it compared."""
    seen = np.zeros(len(x), bool)
    best: list[tuple[float, int]] = []
    waiting: list[tuple[float, int]] = []

    def meet(rows: np.ndarray) -> None:
        seen[rows] = True
        for s, i in zip((x[rows] @ q).tolist(), rows.tolist()):
            if len(best) < width:
                heapq.heappush(best, (s, i))
                heapq.heappush(waiting, (-s, i))
            elif s > best[0][0]:
                heapq.heapreplace(best, (s, i))
                heapq.heappush(waiting, (-s, i))

    meet(entries)
    compared = len(entries)
    while waiting:
        s, i = heapq.heappop(waiting)
        if len(best) >= width and -s < best[0][0]:
            break
        new = near[i][~seen[near[i]]]
        if len(new):
            compared += len(new)
            meet(new)
    return heapq.nsmallest(k, best, key=lambda m: (-m[0], m[1])), compared


def fitted_width(x: np.ndarray, near: list[np.ndarray], entries: np.ndarray, k: int, recall: float, rng: np.random.Generator, sample: int = 64) -> int:
    """The least width of WIDTHS, times k, that finds this share of the k nearest of some of the rows; all rows if none does."""
    asked = rng.choice(len(x), min(sample, len(x)), replace=False)
    least = np.sort(-(x[asked] @ x.T), 1)[:, min(k, len(x)) - 1] + 1e-12  # similarity of the k-th nearest, negated
    for w in WIDTHS:
        width = int(np.ceil(w * k))
        found = sum(sum(-s <= low for s, _ in search(x, near, entries, x[i], k, width)[0]) for i, low in zip(asked, least))
        if found >= recall * len(asked) * min(k, len(x)):
            return width
    return len(x)


def graph_index(vectors: DataFrame, k: int = 10, recall: float = 0.95, part_rows: int = 16384, links: int = 10, seed: int = 1) -> DataFrame:
    """The index of all rows of vectors (id, vector): part, place, id, vector, near (places in the part), entry, width.

    Null vectors are left out. A part is built in one task from about part_rows rows; only its members are compared.
    """
    v = vectors.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-v.count() // part_rows))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x, rng = _unit(table["vector"]), np.random.default_rng(seed)
        near = linked(x, links)
        entries = entries_of(near, rng)
        width = fitted_width(x, near, np.array(entries), k, recall, rng)
        entry = np.zeros(len(x), bool)
        entry[entries] = True
        n = len(x)
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in near])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(near).astype(np.int32)))
        return pa.table([table["part"], pa.array(np.arange(n, dtype=np.int32)), table["id"], table["vector"], lists, pa.array(entry), pa.array(np.full(n, width, np.int32))], ["part", "place", "id", "vector", "near", "entry", "width"])

    rows = v.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int"))
    return rows.groupBy("part").applyInArrow(build, "part int, place int, id long, vector array<double>, near array<int>, entry boolean, width int")


def nearest_by_graph(queries: DataFrame, index: DataFrame, k: int = 10, query_block: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank, compared): the k nearest rows of the index that greedy searches of all its parts find
    for each query (id, vector), ties by id, and with how many vectors the query was compared in all.

    A task searches one part for one block of queries, so it holds a part of the index and a block; parts meet by rank.
    Null vectors have no neighbours; empty tables give no rows.
    """
    index = checkpointed(index)
    q = queries.where("vector is not null").select(F.col("id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q"))
    blocks = max(1, -(-q.count() // query_block))
    parts = index.select("part").distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    q = q.withColumn("block", block).join(parts.groupBy().agg(F.collect_list("part").alias("parts"))).select("query_id", "q", "block", F.explode("parts").alias("part"))  # one row: a number a part
    x = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, distances, compared = [], [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("place").combine_chunks()
            own, rows = _unit(right["vector"]), right["id"].to_numpy()
            lists = right["near"].chunk(0)
            near = np.split(lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))[:-1])
            entries, width = np.flatnonzero(right["entry"].to_numpy(zero_copy_only=False)), max(k, right["width"][0].as_py())
            for i, v in zip(left["query_id"].to_pylist(), _unit(left["q"])):
                got, n = search(own, near, entries, v, k, width)
                for at, (s, r) in enumerate(got):
                    ids.append(i)
                    found.append(int(rows[r]))
                    distances.append(round(1 - s, 9))
                    compared.append(0 if at else n)
        return pa.table([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(distances, pa.float64()), pa.array(compared, pa.int64())], ["query_id", "id", "distance", "compared"])

    met = q.groupBy("part", "block").cogroup(x.groupBy("part", "block")).applyInArrow(look, "query_id long, id long, distance double, compared long")
    w = Window.partitionBy("query_id")
    met = met.withColumns({"rank": F.row_number().over(w.orderBy("distance", "id")), "compared": F.sum("compared").over(w)})
    return met.where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "compared")


#: Ways to find the k nearest of each query among vectors, both id and vector: query_id, id, distance, rank. Others can be added.
INDEXES = {
    "exact": lambda queries, vectors, k: nearest_each(queries, vectors, k),
    "cells": lambda queries, vectors, k: nearest_by_cells(queries, vectors, k),
    "graph": lambda queries, vectors, k: nearest_by_graph(queries, graph_index(vectors, k), k).drop("compared"),
}


def nearest_by(kind: str, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by an index of INDEXES. ValueError: there is none of that name."""
    if kind not in INDEXES:
        raise ValueError(f"no such index: {kind}; there are {', '.join(INDEXES)}")
    return INDEXES[kind](queries, vectors, k)
