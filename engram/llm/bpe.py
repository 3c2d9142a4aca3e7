"""Encoding and decoding with a byte-pair vocabulary whose words end in a suffix, merged here by a priority queue.

A pre-token is a doubly linked list of symbols. Every neighbouring pair that the merge table holds waits in a heap by
(rank, place); the least is taken, and skipped if a merge has changed its pair meanwhile. What is left in the list are
the ids. Decoding looks up the vocabulary strings and joins them as the file's library does.

The library only cuts: its normaliser and pre-tokeniser serve texts with characters past U+024F; others are cut here.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import ids_and_texts, kept, pieces, strings_of
from engram.llm.token_count import _BYTE_CHARS, _L, _N, _S

# Up to U+024F: composed as they are, if their lower case stays in that range.
_SAME = "".join(re.escape(chr(c)) for c in range(0x250) if len(low := chr(c).lower()) == 1 and ord(low) < 0x250)
_SIMPLE = re.compile(f"[{_SAME}‐-‧“”…€]*")
_CUT = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")
_BYTE_OF = {c: b for b, c in _BYTE_CHARS.items()}


class WordBpe:
    """One tokenizer file. At most `most` pre-tokens are remembered, whatever the data; others are merged anew."""

    def __init__(self, spec: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        said = json.loads(spec)
        model, added = said["model"], said.get("added_tokens", [])
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or said.get("decoder"):
            raise ValueError("a byte-pair file with word suffixes and no decoder is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip, or match normalised text, are not handled")
        self.library, self.most = Tokenizer.from_str(spec), most
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.ranks: dict[int, int] = {}  # of a pair of ids
        self.made: list[int] = []  # the id that each rank makes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of a pre-token's symbols once no pair of neighbours can be merged."""
        n, rank_of, made = len(ids), self.ranks.get, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        now = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]  # the rank of the pair that starts at each place
        now.append(-1)
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != rank:
                continue  # stale: a merge has changed the pair since
            j = after[i]
            ids[i] = x = made[rank]
            ids[j] = now[j] = now[i] = -1
            after[i] = right = after[j]
            if right < n:
                before[right] = i
                now[i] = r = rank_of(x << 32 | ids[right], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            left = before[i]
            if left >= 0:
                now[left] = r = rank_of(ids[left] << 32 | x, -1)
                if r >= 0:
                    heappush(heap, r << 32 | left)
        return [x for x in ids if x >= 0]

    def word(self, text: str) -> list[int]:
        """The ids of one pre-token. A symbol that the vocabulary lacks has none."""
        chars = [*(text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(_BYTE_CHARS))]
        chars[-1] += self.suffix
        return self.merge([i for c in chars if (i := self.vocab.get(c)) is not None])

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if _SIMPLE.fullmatch(text):
            return _CUT.findall(text.lower())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(_BYTE_OF[c] for c in s).decode() for s, _ in cut]

    def spans(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """The text between added tokens, cut, each with the added token after it (the last has none)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield self.cut(text[at : m.start()]), m[0]
            at = m.end()
        yield self.cut(text[at:]), None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, added in self.spans(text):
            for w in words:
                out += self.word(w)
            if added is not None:
                out.append(self.added[added])
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, with the blank between them that the library puts where a file has no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def said(self, word: str) -> tuple[bytes, bytes]:
        """The decimal ids of a pre-token and what they decode to, remembered."""
        if not (got := self.known.get(word)):
            ids = self.word(word)
            got = b" ".join([b"%d" % i for i in ids]), self.decode(ids).encode()
            if len(self.known) < self.most:
                self.known[word] = got
        return got

    def ids_and_decoded(self, text: str) -> tuple[bytes, bytes]:
        """All decimal ids joined by one blank, and the decoded text."""
        parts: list[tuple[bytes, bytes]] = []
        get, said = self.known.get, self.said
        for words, added in self.spans(text):
            parts += [get(w) or said(w) for w in words]
            if added is not None:
                parts.append((b"%d" % self.added[added], added.encode()))
        return b" ".join([p for p, _ in parts if p]), b" ".join([d for p, d in parts if p])


def _share(spark, path: str):
    """Broadcast the tokenizer file: its size is the vocabulary's, whatever the data."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((f"word bpe {zlib.crc32(spec.encode())}", spec))


def _tokenizer(shared) -> WordBpe:
    key, spec = shared.value
    return kept(key, lambda: WordBpe(spec))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int), those of the library without special tokens of its own.

    One narrow pass. Null and empty texts have no ids; null ids stay null; repeated rows are encoded each; a text of
    any length is taken whole; other columns aren't read; an empty table gives no rows.
    """
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared)
        for b in pieces(batches):
            ids = [[int(i) for i in bpe.ids_and_decoded(t)[0].split()] for t in strings_of(b["text"])]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id, text. Null ids or an empty array give an empty text, an id that the vocabulary
    lacks fails; repeated rows are decoded each; an empty table gives no rows."""
    shared = _share(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared)
        for b in pieces(batches):
            texts = [bpe.decode(x or []) for x in b["ids"].to_pylist()]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, of encode() and of its decode().

    One narrow pass, in which the ids never leave the task. Edge cases are those of encode(); an empty text has no
    tokens and the digests of an empty string.
    """
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared)
        for b in pieces(batches):
            both = [bpe.ids_and_decoded(t) for t in strings_of(b["text"])]
            n = np.array([ids.count(b" ") + 1 if ids else 0 for ids, _ in both], np.int64)
            hexes = [[hashlib.sha256(x[k]).hexdigest() for x in both] for k in (0, 1)]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(n), *(pa.array(h, pa.string()) for h in hexes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
