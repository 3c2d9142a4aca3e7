"""Language identification by hyperdimensional profiles.

Each symbol has a random vector of +1 and -1. A trigram's vector binds them: the product of the first letter's vector
permuted twice, the second's permuted once and the third's. A text's vector bundles (adds) those of its trigrams; a
language's prototype bundles the unit vectors of its texts, less what all languages share. A text goes to the
prototype with the largest cosine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ids_and_texts, kept, pieces

#: Symbols: 0 for all that is no letter, 1-26 for a-z, the rest shared by other letters by their code point.
SYMBOLS = 64


class Space:
    """Symbol table of the code points and vectors of all trigrams."""

    def __init__(self, dimensions: int, seed: int):
        points = np.zeros(0x110000, np.uint8)
        letters = np.array([chr(i).isalpha() for i in range(0x110000)])
        at = np.flatnonzero(letters)
        points[at] = 27 + at % (SYMBOLS - 27)
        points[97:123] = np.arange(1, 27)
        self.points = points
        rng = np.random.default_rng(seed)
        letter = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        twice, once = np.roll(letter, 2, 1), np.roll(letter, 1, 1)
        pairs = twice[:, None, :] * once[None, :, :]
        self.pairs, self.letter = pairs.reshape(SYMBOLS * SYMBOLS, dimensions), letter

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter. Trigrams count once for each time they occur."""
        s = self.points[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        if not s.any():
            return None
        s = np.concatenate([[0], s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])], [0]]).astype(np.int32)
        tri = s[:-2] * (SYMBOLS * SYMBOLS) + s[1:-1] * SYMBOLS + s[2:]
        kinds, n = np.unique(tri, return_counts=True) if len(tri) < 50_000 else (k := np.flatnonzero(c := np.bincount(tri)), c[k])
        out = np.zeros(self.letter.shape[1], np.float32)
        for i in range(0, len(kinds), 4096):  # long texts in slices of bounded size
            k = kinds[i : i + 4096]
            out += n[i : i + 4096].astype(np.float32) @ (self.pairs[k // SYMBOLS] * self.letter[k % SYMBOLS]).astype(np.float32)
        return out


def space(dimensions: int, seed: int) -> Space:
    return kept(f"letters {dimensions} {seed}", lambda: Space(dimensions, seed))


class Profiles:
    def __init__(self, langs: list[str], vectors: np.ndarray, centre: np.ndarray, dimensions: int, seed: int):
        self.langs, self.vectors, self.centre, self.dimensions, self.seed = langs, vectors, centre, dimensions, seed


def fit(docs: DataFrame, use: Column | None = None, dimensions: int = 512, seed: int = 11, max_langs: int = 4096, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes of all texts with a language. Each task bundles its own texts by language before the shuffle.

    Texts without letters and rows without a language count for nothing; repeated rows count each, and an empty table
    gives no prototypes. More than max_langs languages are an error:
    that bounds what is collected and broadcast.
    """
    rows = docs if use is None else docs.where(use)
    rows = rows.select(rows[text].cast("string").alias("text"), rows[lang].cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hd, sums = space(dimensions, seed), {}
        for b in pieces(batches):
            for t, k in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
                v = hd.bundle(t)
                if v is not None and (size := float(np.linalg.norm(v))):
                    sums[k] = sums.get(k, 0) + v.astype(np.float64) / size
        if sums:
            at = np.tile(np.arange(dimensions, dtype=np.int32), len(sums))
            yield pa.record_batch([pa.array(np.repeat(np.array(list(sums), object), dimensions), pa.string()), pa.array(at), pa.array(np.concatenate(list(sums.values())))], ["lang", "at", "x"])

    sums = rows.mapInArrow(run, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    got = sums.limit(max_langs * dimensions + 1).toPandas()
    langs = sorted(got["lang"].unique())
    if len(got) > max_langs * dimensions:
        raise ValueError(f"more than max_langs={max_langs} languages")
    vectors = np.zeros((len(langs), dimensions))
    vectors[[langs.index(x) for x in got["lang"]], got["at"]] = got["x"]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centre = vectors.mean(0) if len(langs) > 1 else np.zeros(dimensions)
    vectors = vectors - centre
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Profiles(langs, vectors, centre, dimensions, seed)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the exponentiated cosines, 0 to 1), cosine.

    Null texts and texts without a letter, and all texts when nothing was learned, are `und` with score 0. Ties go to
    the first language in order. Rows that repeat are predicted each; a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[1]
        hd = space(p.dimensions, p.seed)
        for b in pieces(batches):
            langs, scores, cosines = [], [], []
            for t in pc.fill_null(b["text"], "").to_pylist():
                v = hd.bundle(t) if p.langs else None
                if v is None or not (size := float(np.linalg.norm(v))):
                    langs.append("und")
                    scores.append(0.0)
                    cosines.append(0.0)
                    continue
                v = v / size - p.centre
                cos = p.vectors @ (v / max(float(np.linalg.norm(v)), 1e-12))
                k = int(cos.argmax())
                e = np.exp(8 * (cos - cos[k]))
                langs.append(p.langs[k])
                scores.append(float(1 / e.sum()))
                cosines.append(float(cos[k]))
            yield pa.record_batch([b["doc_id"], pa.array(langs, pa.string()), pa.array(scores), pa.array(cosines)], ["doc_id", "lang_pred", "score", "cosine"])

    return ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double")
