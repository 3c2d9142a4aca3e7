"""How the sources of each language differ in their words: term-block tiles, all pairs of sources, per-source heaps.

Every kept term belongs to a block of its language. A tile is a dense numpy int64 matrix, sources by terms of a block;
in it all pairs of sources are compared by broadcasting, and the terms of each source are compared with the language.
Partial pair sums of the tiles are added up by Spark, the tiles' best terms meet in one heap for each source and task,
and the heaps in two ranks. All arithmetic is exact.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import bytes_of, materialise, pieces, strings_of

# Letters of terms are A-Z, a-z and whatever is not ASCII; in UTF-8 that holds for bytes as well.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MAX = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _counts(docs: DataFrame, most: int = 600_000) -> DataFrame:
    """lang, source, term, n (places), df (documents): summed in each task as far as `most` terms at a time go, then by
    Spark. A row with an empty term and no places stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0

        def flush():
            for (lang, source), own in groups.items():
                terms, both = [*own], [*own.values()]
                for at in range(0, len(terms), 1 << 16):
                    t, v = terms[at : at + (1 << 16)], both[at : at + (1 << 16)]
                    n, df = np.fromiter((x >> 32 for x in v), np.int64, len(v)), np.fromiter((x & 0xFFFFFFFF for x in v), np.int64, len(v))
                    yield pa.record_batch([pa.repeat(lang, len(t)), pa.repeat(source, len(t)), pa.array(t, pa.binary()).cast(pa.string()), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

        for b in pieces(batches):
            for lang, source, text in zip(strings_of(b["lang"]), strings_of(b["source"]), bytes_of(b["text"])):
                own = groups.setdefault((lang, source), {b"": 0})
                before = len(own)
                for w, n in Counter(terms_of(text)).items():
                    own[w] = own.get(w, 0) + (n << 32 | 1)
                held += len(own) - before
            if held > most:
                yield from flush()
                groups, held = {}, 0
        yield from flush()

    rows = docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(counts: np.ndarray, totals: np.ndarray, v: int, alpha: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + alpha) / (total + alpha * v)), exact for counts up to 9e15."""
    top, below = counts + alpha, totals + alpha * v
    if top.size and int(top.max()) <= _MAX // scale:
        return 1 + top * scale // below
    whole, rest, left = top // below, top % below, scale
    while left > 1:  # long division, up to three decimal digits at a time
        step = min(left, 1000)
        if left % step:
            raise ValueError("scale has to be a power of ten")
        whole, rest, left = whole * step + rest * step // below, rest * step % below, left // step
    return 1 + whole


def _audit_tiles(rows: DataFrame, alpha: int, scale: int, top: int) -> DataFrame:
    """lang, source, part, item, value from rows sorted by tile: first the tile's sources with their totals (kind 0),
    then its counts. Sums of pairs are of one tile, terms the best of each source in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def out(lang: str, source: str, part: str, items, values) -> pa.RecordBatch:
            n = len(items)
            return pa.record_batch([pa.repeat(lang, n), pa.repeat(source, n), pa.repeat(part, n), pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])

        def tile(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            lang, head = t["lang"][0].as_py(), pc.equal(t["kind"], 0)
            h, t = t.filter(head), t.filter(pc.invert(head))
            sources, v = h["source"].to_pylist(), h["v"][0].as_py()
            totals, lang_total = h["n"].to_numpy(), h["m"][0].as_py()
            coded = t["term"].combine_chunks().dictionary_encode() if t.num_rows else pa.array([], pa.string()).dictionary_encode()
            terms = coded.dictionary.cast(pa.binary()).to_pylist()
            row, column = pc.index_in(t["source"], value_set=pa.array(sources)).to_numpy(), coded.indices.to_numpy()
            counts, whole = np.zeros((len(sources), len(terms)), np.int64), np.zeros(len(terms), np.int64)
            counts[row, column] = t["n"].to_numpy()
            whole[column] = t["m"].to_numpy()
            p, q = shares(counts, totals[:, None], v, alpha, scale), shares(whole, np.int64(lang_total), v, alpha, scale)
            step = max(1, (1 << 20) // max(1, p.size))
            for at in range(0, len(sources), step):
                gap = p[at : at + step, None, :] - p[None, :, :]
                sums = (gap * gap // p[None, :, :]).sum(2)
                for k, own in enumerate(sums, at):
                    yield out(lang, sources[k], "pair", sources[:k] + sources[k + 1 :], np.delete(own, k))
            for k, source in enumerate(sources):
                mine = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                gap = p[k, mine] - q[mine]
                value = gap * gap // q[mine]
                if len(mine) > top:  # all that tie with the last place stay until the terms decide
                    best = value >= np.partition(value, len(mine) - top)[len(mine) - top]
                    mine, value = mine[best], value[best]
                both = heaps.get((lang, source), []) + [(-f, terms[i]) for f, i in zip(value.tolist(), mine.tolist())]
                heaps[lang, source] = heapq.nsmallest(top, both)

        def best() -> Iterator[pa.RecordBatch]:
            for (lang, source), heap in heaps.items():
                if heap:
                    yield out(lang, source, "term", [w.decode() for _, w in heap], [-f for f, _ in heap])
            heaps.clear()

        parts: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            lang, block = b["lang"].to_pylist(), b["block"].to_numpy()
            change = [i for i in range(1, len(lang)) if block[i] != block[i - 1] or lang[i] != lang[i - 1]]
            for a, e in zip([0, *change], [*change, len(lang)]):
                if a == e:
                    continue
                if parts and (lang[a], block[a]) != last:
                    yield from tile(parts)
                    parts = []
                    if len(heaps) * top > 1 << 20:
                        yield from best()
                last = lang[a], block[a]
                parts.append(b.slice(a, e - a))
        if parts:
            yield from tile(parts)
        yield from best()

    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, alpha: int = 1, scale: int = 10**9, top: int = 200, block_terms: int = 4096, cells: int = 1 << 21) -> DataFrame:
    """lang, source, part, item, value, rank. Terms are runs of ASCII letters (in lower case) and non-ASCII characters.

    A language keeps the terms that are in at least min_docs of its rows. Each of its groups (language and source), and
    the language itself, gives each kept term a share p. Part `pair`: the distance of a source from each other source of
    the language, the sum of floor((p - q)^2 / q) over all kept terms, every rank. Part `term`: the terms a source uses
    more than its language (count over 0 and p > q), by the same measure, the first `top` ranks.

    Null text, lang and source are read as empty; rows that repeat a document count each; groups without a term, and
    languages that keep no term, have pairs of value 0; equal values are ranked by item in UTF-8; an empty table gives no
    rows. Other columns aren't read. Texts are taken whole, at any length.

    Counts are added up in the tasks before they are shuffled. A tile has at most `cells` cells, so with very many
    sources blocks get narrower; a source however large is one row of each tile of its language. The totals of a
    language reach its tiles as rows, so nothing is broadcast or collected. The result itself has a row for each pair.
    """
    read = docs.select(docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text"))
    term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    counts = _counts(read).withColumns({"in_docs": F.sum("df").over(term), "m": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")})
    counts = counts.where((F.col("term") == "") | (F.col("in_docs") >= min_docs)).drop("df", "in_docs")
    counts = materialise(counts, "divergence-counts")

    own = Window.partitionBy("lang")  # a row for each source
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if(F.col("first") & (F.col("term") != "")).alias("v"))
    groups = groups.withColumns({"m": F.sum("n").over(own), "v": F.sum("v").over(own), "width": F.least(F.lit(block_terms), F.greatest(F.lit(1), F.floor(F.lit(cells) / F.count(F.lit(1)).over(own))))})
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / F.col("width"))))
    groups = materialise(groups.select("lang", "source", "n", "m", "v", F.col("blocks").cast("int").alias("blocks")), "divergence-groups")
    head = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "source", F.lit("").alias("term"), "n", "m", "v")
    rows = counts.where("term <> ''").join(groups.select("lang", "blocks").distinct(), "lang")
    rows = rows.select("lang", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), F.lit(1).alias("kind"), "source", "term", "n", "m", F.lit(0).cast("long").alias("v"))
    rows = head.unionByName(rows).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "source")
    parts = materialise(_audit_tiles(rows, alpha, scale, top), "divergence-parts")

    order = (F.col("value").desc(), F.col("item"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    best = parts.where("part = 'term'").withColumn("salt", F.expr("pmod(xxhash64(item), 8)"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return pairs.unionByName(best)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source
  GROUP BY d.lang, d.source
), l AS (SELECT lang, sum(m) AS n, count(*) AS v FROM kept GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (kept.m + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
