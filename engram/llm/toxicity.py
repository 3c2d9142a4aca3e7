"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

The models are over the letters of words, so that a stem that is only met with some endings still counts; a letter's
context is the up to five letters before it in its word, and a word counts once for each document it is in. Both
classes back off to one shared model, an interpolated Kneser-Ney model of the pooled counts: a class's own discounted
counts are weighed against it by `strength` pooled observations, so rare expressions cost both classes nearly the same.

A word's log-likelihood ratio counts as far as it is beyond `margin` (differences below that are sampling noise), and
a text's gap is the sum over its words divided by their number (and a few neutral words). A logistic curve, fitted on labelled documents that
the counts didn't see, turns the gap into a score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from engram.llm.common import ids_and_texts, kept, pieces, release, strings_of

ORDER = 6
#: Neutral words added to every text's length, so that one odd word decides nothing in a text of a few words.
PRIOR_WORDS = 10
_EDGE, _END = "\x02", "\x03"


def grams(word: str) -> list[str]:
    """A gram of ORDER characters for each letter of the word and its end."""
    w = _EDGE * (ORDER - 1) + word + _END
    return [w[i : i + ORDER] for i in range(len(w) - ORDER + 1)]


class Gap:
    """Log-likelihoods of words under the toxic model less those under the ordinary one; remembered up to a bound."""

    def __init__(self, table: dict[str, float], contexts: dict[str, float], margin: float, most: int = 200_000):
        self.table, self.contexts, self.margin, self.most, self.known = table, contexts, margin, most, {}

    def word(self, w: str) -> float:
        t, c = self.table, self.contexts
        r = sum(t[g] if g in t else c.get(g[:-1], 0.0) for g in grams(w))
        return math.copysign(max(abs(r) - self.margin, 0.0), r)

    def texts(self, texts: list[str]) -> list[float]:
        """The gap of each text."""
        cut = [t.lower().split() for t in texts]
        known = self.known
        new = {w for ws in cut for w in ws if w not in known}
        got = {w: self.word(w) for w in new}
        if len(known) + len(got) <= self.most:
            known.update(got)
            got = known
        get, rest = known.get, got
        return [math.fsum(v if (v := get(w)) is not None else rest[w] for w in ws) / (len(ws) + PRIOR_WORDS) for ws in cut]


def _pooled(counts: dict[str, int]) -> dict[str, float]:
    """Interpolated Kneser-Ney probabilities of the grams, and of all their endings by continuation counts."""
    levels = [counts]
    for _ in range(ORDER - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    low: dict[str, float] = {"": 1.0 / (len(levels[-1]) + 1)}
    for level in reversed(levels):
        total, types = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        ones, twos = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        low = {g: (n - d + d * types[g[:-1]] * low[g[1:]]) / total[g[:-1]] for g, n in level.items()}
    return low


def kneser_ney_gap(rows: list[tuple[str, int, int]], strength: float = 10.0, discount: float = 0.75) -> tuple[dict[str, float], dict[str, float]]:
    """From (gram, toxic count, ordinary count): log ratio of each gram, and of the mass each context keeps for others."""
    shared = _pooled({g: t + o for g, t, o in rows})
    table, contexts = Counter(), Counter()
    for k, sign in ((1, 1), (2, -1)):
        total, types = Counter(), Counter()
        for r in rows:
            if r[k]:
                total[r[0][:-1]] += r[k]
                types[r[0][:-1]] += 1
        for r in rows:
            g, h = r[0], r[0][:-1]
            kept = strength + discount * types[h]
            table[g] += sign * math.log((max(r[k] - discount, 0) + kept * shared[g]) / (total[h] + strength))
        for h, n in total.items():
            contexts[h] += sign * math.log((strength + discount * types[h]) / (n + strength))
    return dict(table), dict(contexts)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (x, y) by Newton's method, x scaled to unit deviation.

    Outer values are drawn in to the second and 98th hundredth first: a few far ones would flatten the curve for all.
    """
    x = np.clip(x, *np.quantile(x, [0.02, 0.98]))
    m, s = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([(x - m) / s, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - y) / len(y) + ridge * w
        hess = (a * (q * (1 - q))[:, None]).T @ a / len(y) + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return w[0] / s, w[1] - w[0] * m / s


def _sum_grams(docs: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) of documents with a column toxic; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> pa.RecordBatch:
            by: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for k, words in sums.items():
                for w, n in words.items():
                    for g in grams(w):
                        by[g][1 - k] += n
                words.clear()
            return pa.record_batch([pa.array(list(by), pa.string()), pa.array([x[0] for x in by.values()], pa.int64()), pa.array([x[1] for x in by.values()], pa.int64())], ["gram", "toxic", "ordinary"])

        for b in pieces(batches):
            for t, k in zip(strings_of(b["text"]), b["toxic"].to_pylist()):
                sums[k].update(set(t.lower().split()))
            if len(sums[0]) + len(sums[1]) > 500_000:
                yield flush()
        yield flush()

    per_task = docs.select("text", "toxic").mapInArrow(run, "gram string, toxic long, ordinary long")
    return per_task.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Model:
    """table, contexts and margin of Gap, and the logistic curve."""

    def __init__(self, table, contexts, margin: float, slope: float, intercept: float):
        self.table, self.contexts, self.margin, self.slope, self.intercept = table, contexts, margin, slope, intercept
        self._shared = None

    def shared(self, spark: SparkSession) -> tuple:
        """A key and the broadcast tables: one for all passes of a session, so that no worker holds them twice."""
        sc = spark.sparkContext
        if self._shared is None or self._shared[0] is not sc:
            self._shared = sc, uuid.uuid4().hex, sc.broadcast((self.table, self.contexts, self.margin))
        return self._shared[1:]


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, per_class: int = 3000, strength: float = 10.0, margin: float = 2.0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled documents: at most per_class of each label, those with the smallest hash of their id.

    Three quarters of them give the counts, the rest the curve. All grams of those documents reach the driver: per_class
    bounds them and what is broadcast. use: rows that may be learnt from (default all). Labels that
    aren't 0 or 1, null ids and ids without a document count for nothing; an id with different labels counts as toxic.
    Without rows of both classes, or if the gap doesn't rise with toxicity on the rest, the model gives every text the
    share of toxic labels (0 if there are none). An id that repeats in docs counts each of its rows.
    """
    rows = ids_and_texts(docs if use is None else docs.where(use), doc_id, text).where("doc_id is not null")
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = rows.select("doc_id").distinct().join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(per_class).collect() for k in (1, 0)]
    picked = [(r["doc_id"], r["toxic"], i % 4 == 3) for part in chosen for i, r in enumerate(part)]
    n = [len(part) for part in chosen]
    share = n[0] / max(1, sum(n))
    constant = Model({}, {}, margin, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if min(n) < 4:
        return constant
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int, check boolean"))  # at most 2 * per_class rows
    labelled = rows.join(sample, "doc_id")
    counts = _sum_grams(labelled.where("not check")).toArrow()
    table, contexts = kneser_ney_gap(sorted(zip(*(counts[c].to_pylist() for c in ("gram", "toxic", "ordinary")))), strength)
    del counts
    model = Model(table, contexts, margin, 0.0, 0.0)
    got = _gaps(labelled.where("check").select("doc_id", "text", "toxic"), model).select("gap", "toxic").collect()
    model.slope, model.intercept = logistic(np.array([r["gap"] for r in got]), np.array([float(r["toxic"]) for r in got]))
    return model if model.slope > 0 else constant


def _gaps(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and a column gap of the text; columns stay as they are."""
    key, shared = model.shared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = kept(key, lambda: Gap(*shared.value))  # the tables are read when those kept before are gone
        for b in pieces(batches):
            yield b.append_column("gap", pa.array(gap.texts(strings_of(b[text])), pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("gap", DoubleType())]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, gap, score (0 to 1), predicted. One narrow pass, the model broadcast.

    Null and empty texts have gap 0; rows that repeat are scored each; a null id stays null.
    """
    out = _gaps(ids_and_texts(docs, doc_id, text), model).drop("text")
    return _verdict(out, model, threshold)


def _verdict(df: DataFrame, model: Model, threshold: float) -> DataFrame:
    p = 1 / (1 + F.exp(-(F.lit(float(model.slope)) * F.col("gap") + F.lit(float(model.intercept)))))
    return df.withColumn("score", p).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, whatever they are called.

    Null and empty texts have gap 0 and stay unless nearly all labels are toxic; repeated rows fare alike; an empty table
    gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    plain, read = docs.toDF(*names), names[at]
    if not isinstance(docs.schema[at].dataType, StringType):  # else the texts pass through Python once
        plain, read = plain.withColumn("text", F.col(read).cast("string")), "text"
    kept = _verdict(_gaps(plain, model, read), model, threshold).where("predicted = 0")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
