"""Token counts of a byte-level BPE, with a shortcut for pre-tokens that are one token as a whole.

Once, on the driver, every vocabulary string is encoded alone; those that come out as a single token form the
whole-token table. In the tasks a text is cut into pre-tokens, those in the table count 1 (or give their id)
without any merging, and only the rest is merged, by the library, once for each different pre-token.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ids_and_texts, kept, pieces, strings_of

# Letters, numbers and white space up to U+024F, as Unicode has them: the part of the pre-tokenizer's pattern that needs no Unicode tables.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_SIMPLE = re.compile(f"[\\x00-ɏ‐-‧“”…€]*")
# Words come first, as most pre-tokens are; none of them can start where an alternative after them would have matched.
_PRETOKEN = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class Encoder:
    """Encodes texts as the library does. ids(text) is a bytes object of little-endian unsigned 32-bit ids.

    Texts with characters past the simple range, or that hold an added token, go to the library as a whole.
    At most `most` pre-tokens are remembered; past that the rest is merged anew for each batch, so memory is bounded.
    """

    def __init__(self, spec: str, whole: dict[str, int], most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.known = {w: i.to_bytes(4, "little") for w, i in whole.items()}
        self.most = most + len(whole)
        added = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each pre-token, from the library's BPE model alone: cutting and offsets have no part in them."""
        merge = self.library.model.tokenize
        out = {}
        for w in words:
            chars = w.replace(" ", _BYTE_CHARS[32]) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_BYTE_CHARS)
            out[w] = array("I", [t.id for t in merge(chars)]).tobytes()
        return out

    def parts(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its pre-tokens (one part if the library took it whole)."""
        cut = [_PRETOKEN.findall(t) if _SIMPLE.fullmatch(t) and not (self.added and self.added.search(t)) else None for t in texts]
        get = self.known.get
        out = [self._library([t]) if ws is None else list(map(get, ws)) for t, ws in zip(texts, cut)]
        gaps = [(ws, ps, [i for i, p in enumerate(ps) if p is None]) for ws, ps in zip(cut, out) if None in ps]
        if gaps:
            ids = self._merged(list({ws[i] for ws, _, at in gaps for i in at}))
            if len(self.known) + len(ids) <= self.most:
                self.known.update(ids)
            for ws, ps, at in gaps:
                for i in at:
                    ps[i] = ids[ws[i]]
        return out


def whole_tokens(spec: str) -> dict[str, int]:
    """The vocabulary strings that encode alone as one token, and are one pre-token, with their id; by trying each."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    added = {t["id"] for t in json.loads(spec).get("added_tokens", [])}
    strings = [s for i in range(library.get_vocab_size()) if i not in added and "�" not in (s := library.decode([i], skip_special_tokens=False))]
    found = {}
    for s, e in zip(strings, library.encode_batch(strings, add_special_tokens=False)):
        if len(e.ids) == 1 and _SIMPLE.fullmatch(s) and _PRETOKEN.findall(s) == [s]:
            found[s] = e.ids[0]
    return found


def encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast (key, spec, whole tokens); later tasks of the worker find it ready."""
    key, *rest = shared.value
    return kept(key, lambda: Encoder(*rest))


def share_encoder(spark, path: str):
    """Broadcast the tokenizer file and its whole-token table: as large as the vocabulary file, whatever the data."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((f"encoder {zlib.crc32(spec.encode())}", spec, whole_tokens(spec)))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    One narrow pass over the texts, no shuffle. Null and empty texts have no tokens; a null id stays null; repeated
    rows are counted each; other columns aren't read; an empty table gives no rows.
    """
    shared = share_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in pieces(batches):
            texts = strings_of(b["text"])
            n = [sum(map(len, ps)) >> 2 for ps in enc.parts(texts)]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
