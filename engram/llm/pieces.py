"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the lattice of pieces.

A text is the model's way of writing it: one space in front, spaces as U+2581. No piece of the models used here has a
space after another character, so the lattice falls apart into segments: spaces and what follows them up to the next
space or line break. Forward filtering gives, once for each different segment, the chance of every piece to be the last
one at every position; backward sampling then walks all segments of a batch at once from their ends to their starts.

Pieces have weight (rank + offset) ** -power by their place in the vocabulary, the only order a BPE model has.
Characters without a piece, line breaks and literal U+2581 are written by their UTF-8 byte pieces, so decoding gives
back every text. Random numbers are a hash of (seed, row key, segment, step): a row's segmentation does not depend on
batches, tasks or retries.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ids_and_texts, kept, pieces as slices, strings_of

SPACE = "▁"
#: Characters of new segments that are filtered in one go, about: some 300 bytes each are needed for it.
PART = 1 << 16
_SEGMENT = re.compile(r" *[^ \n▁]+| +|\n|▁")


class Vocabulary:
    """Pieces with their weights, and byte pieces, read from a SentencePiece model."""

    def __init__(self, proto: bytes, power: float, offset: float):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=proto)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain = p.replace(SPACE, " ")
                self.bytes_of.append(plain.encode())
                if not re.search(r"[^ ] |\n|▁", plain):
                    self.weight[plain] = i, (rank + offset) ** -power
                rank += 1
        self.byte_ids = np.array(self.byte_id)
        self.single = np.zeros(0x10000, bool)
        self.single[[ord(p) for p in self.weight if len(p) == 1 and ord(p) < 0xFFFF]] = True
        # hashes of the pieces, to look up all substrings of a length at once
        self.longest = max(map(len, self.weight), default=1)
        pieces = list(self.weight)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.numbers = np.array([self.weight[p][0] for p in pieces])[order]
        self.weights = np.array([self.weight[p][1] for p in pieces])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h ^ ord(c) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            h ^= h >> 29
        return h

    def find(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in the characters that don't pass `left` characters from their start: start, length, number, weight."""
        found = []
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = (h ^ chars[at + n - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            hit = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            same = self.hashes[k] == h[hit]
            hit, k = hit[same], k[same]
            found.append((at[hit], np.full(len(hit), n), self.numbers[k], self.weights[k]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Edges:
    """Filtered lattices of segments as flat arrays; a node is a position in a segment.

    Edges into node x have keys x + (cumulated chance), ascending over all nodes, so one search finds the edge that a
    random number picks.
    """

    def __init__(self, room: int):
        self.keys, self.back, self.piece = np.zeros(room), np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.n = self.nodes = 0
        self.number: dict[str, int] = {}
        self.ends = np.zeros(0, np.int64)

    def add(self, segments: list[str], v: Vocabulary) -> None:
        """Filter new segments, those of some PART characters in one go."""
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        cuts = np.unique(np.searchsorted(ends, np.arange(PART, ends[-1], PART)) + 1)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(segments)]):
            if a < b:
                self._filter(segments[a:b], v)

    def _filter(self, segments: list[str], v: Vocabulary) -> None:
        """Find all pieces in all segments, then go forward one position in all of them at a time."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters from each one to its segment's end
        first = np.arange(len(chars)) + np.repeat(np.arange(len(segments)), sizes)  # node before each character
        begin, length, piece, weight = v.find(chars, left)
        lone = np.flatnonzero(~v.single[np.minimum(chars, len(v.single) - 1)])  # written as bytes: piece -1 - code point
        begin, length = np.concatenate([begin, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
        code = chars[lone].astype(np.int64)
        piece = np.concatenate([piece, np.where(code < 128, v.byte_ids[np.minimum(code, 127)], -1 - code)])
        weight = np.concatenate([weight, np.full(len(lone), 1e-6)])
        into = first[begin] + length
        depth = into - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes)[begin]
        order = np.lexsort((into, depth))
        begin, length, piece, weight, into, depth = (x[order] for x in (begin, length, piece, weight, into, depth))
        log_forward = np.zeros(len(chars) + len(segments))
        share = np.zeros(len(begin))
        levels = np.searchsorted(depth, np.arange(1, int(sizes.max()) + 2))
        log_weight = np.log(weight)
        for x, y in zip(levels, levels[1:]):
            node, got = into[x:y], log_forward[into[x:y] - length[x:y]] + log_weight[x:y]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(got, heads)
            run = np.diff(np.append(heads, y - x))
            part = np.exp(got - np.repeat(top, run))
            total = np.add.reduceat(part, heads)
            log_forward[node[heads]] = top + np.log(total)
            c = np.cumsum(part / np.repeat(total, run))
            share[x:y] = c - np.repeat(c[heads] - (part[heads] / total), run)
        order = np.argsort(into, kind="stable")
        keys = self.nodes + into[order] + np.minimum(share[order], 1.0) * 0.999999
        for k, s in enumerate(segments, len(self.ends)):
            self.number[s] = k
        self.ends = np.concatenate([self.ends, self.nodes + ends + np.arange(len(segments))])
        self.nodes, m = self.nodes + len(log_forward), self.n + len(keys)
        if m > len(self.keys):
            for name in ("keys", "back", "piece"):  # one after the other, and room that isn't used yet takes no memory
                x = getattr(self, name)
                y = np.zeros(max(len(x) * 5 // 4, m), x.dtype)
                y[: self.n] = x[: self.n]
                setattr(self, name, y)
        self.keys[self.n : m], self.back[self.n : m], self.piece[self.n : m] = keys, length[order], piece[order]
        self.n = m

    def walk(self, number: np.ndarray, left: np.ndarray, base: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each step from the ends: the segments that still walk, and the piece each takes."""
        keys, at, left = self.keys[: self.n], self.ends[number], left.copy()
        live, step, found = np.arange(len(at)), 0, []
        while len(live):
            mixed = _mix(base[live] + np.array(step * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1, np.uint64))
            u = (mixed >> np.uint64(11)).astype(np.float64) / 2**53
            edge = np.searchsorted(keys, at[live] + u * 0.999998)
            found.append((live, self.piece[edge]))
            back = self.back[edge]
            at[live] -= back
            left[live] -= back
            live = live[left[live] > 0]
            step += 1
        return found


class Lattices:
    """Lattices of the segments met so far, up to `most` edges; past that, new segments are filtered for their batch only."""

    def __init__(self, vocabulary: Vocabulary, most: int = 3_000_000):
        self.v, self.most, self.store = vocabulary, most, Edges(1 << 20)

    def sample(self, rows: list[tuple[int, list[str]]], seed: int) -> list[np.ndarray]:
        """Piece numbers of each (key, segments), -1 - code point where bytes are to be written."""
        sizes = [len(ss) for _, ss in rows]
        flat = [s for _, ss in rows for s in ss]
        if not flat:
            return [np.zeros(0, np.int32) for _ in rows]
        keys = np.repeat(np.array([k for k, _ in rows], np.uint64), sizes)
        ordinal = np.concatenate([np.arange(n, dtype=np.uint64) for n in sizes])
        base = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) + ordinal * np.uint64(0xD1B54A32D192ED03)
        left = np.fromiter(map(len, flat), np.int64, len(flat))
        number = np.fromiter(map(self.store.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0)
        edges = self.store
        if len(missing):
            words = list(map(flat.__getitem__, missing.tolist()))
            new = list(dict.fromkeys(words))
            edges = self.store if self.store.n < self.most else Edges(1 << 12)
            edges.add(new, self.v)
            number[missing] = np.fromiter(map(edges.number.__getitem__, words), np.int64, len(words))
        if edges is self.store:
            found = edges.walk(number, left, base)
        else:
            known = np.flatnonzero(number >= 0)
            known = np.setdiff1d(known, missing, assume_unique=True)
            found = [(own[k], p) for own, part in ((known, self.store), (missing, edges)) for k, p in part.walk(number[own], left[own], base[own])]
        taken = np.bincount(np.concatenate([k for k, _ in found]), minlength=len(flat))
        free = np.cumsum(taken)
        out = np.zeros(int(free[-1]), np.int32)
        for k, p in found:  # the walk goes backwards: a segment's pieces fill its place from the end
            free[k] -= 1
            out[free[k]] = p
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.concatenate([[0], np.cumsum(taken)])[cuts]
        return [out[a:b] for a, b in zip(starts, starts[1:])]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well mixed bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    def __init__(self, proto: bytes, power: float, offset: float, seed: int):
        self.v, self.seed = Vocabulary(proto, power, offset), seed
        self.lattices = Lattices(self.v)

    def encode(self, rows: list[tuple[int | None, str]]) -> list[np.ndarray]:
        """Ids of each (row key, text). A null key counts as the text's checksum."""
        cut = [(zlib.crc32(t.encode()) if k is None else k & (1 << 64) - 1, _SEGMENT.findall(" " + t) if t else []) for k, t in rows]
        out = []
        for ids in self.lattices.sample(cut, self.seed):
            if (ids < 0).any():
                parts = [[self.v.byte_id[b] for b in chr(-1 - i).encode()] if i < 0 else [i] for i in ids.tolist()]
                ids = np.array([i for p in parts for i in p], np.int32)
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.bytes_of.__getitem__, ids.tolist())).decode()
        return text[1:] if text.startswith(" ") else text


def _sampler(shared) -> Sampler:
    key, *rest = shared.value
    return kept(key, lambda: Sampler(*rest))


def sample_pieces(docs: DataFrame, model: str, power: float = 0.6, offset: float = 10.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int). One narrow pass; the model file is broadcast.

    The row key is doc_id: rows that repeat an id and a text get the same ids. Null and empty texts have no ids; a
    null id stays null and its text's checksum is the key.
    """
    shared = _share(docs, model, power, offset, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(shared)
        for b in slices(batches, 128, 1 << 20):
            ids = s.encode(list(zip(b["doc_id"].to_pylist(), strings_of(b["text"]))))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.record_batch([b["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    return ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: doc_id, text. Null ids are the empty text."""
    shared = _share(encoded, model, 1.0, 1.0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(shared)
        for b in slices(batches, 128, 1 << 20):
            yield pa.record_batch([b["doc_id"], pa.array([s.decode(np.array(x or [], np.int32)) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, power: float = 0.6, offset: float = 10.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pieces, ids_crc32 (of the ids as 32-bit little-endian), lossless.

    Encodes as sample_pieces does and decodes at once, in the same pass; lossless says that the text came back.
    """
    shared = _share(docs, model, power, offset, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(shared)
        for b in slices(batches, 128, 1 << 20):
            texts = strings_of(b["text"])
            ids = s.encode(list(zip(b["doc_id"].to_pylist(), texts)))
            cols = [b["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
            cols += [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([s.decode(x) == t for x, t in zip(ids, texts)])]
            yield pa.record_batch(cols, ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "lossless"])

    return ids_and_texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean")


def _share(df: DataFrame, model: str, power: float, offset: float, seed: int):
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, f.read(), power, offset, seed))
