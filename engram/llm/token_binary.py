"""Token ids as binary blocks in Simple-8b: 64-bit words, each a 4-bit selector and up to 60 ids of equal width.

A file set is a Parquet folder whose rows are blocks; `image` is a block in the layout below, all little-endian:

    4s  magic "S8B1"      u32 documents   u32 ids   u32 words   u32 escapes
    i64 doc_id[documents]  u8 doc_id is null[documents]  u32 ids of the document[documents]
    u32 offsets[ceil(words / 64)]     ids before every 64th word, so a reader can start at any of them
    u64 words[words]
    u64 escapes[escapes]              ids of more than 60 bits; their word has selector 14 and the escape's index

Parquet as the container gives atomic commits and reads by every task; the ids themselves are only in the images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import ids_and_texts, pieces, strings_of
from engram.llm.token_count import encoder, share_encoder

#: Fixed by the coding: ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 0])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 0])
ESCAPE = 14
STRIDE = 64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and offsets of an array of unsigned ids. Each word takes as many ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    big = ids >> np.uint64(60) != 0
    escapes = ids[big]
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    narrow = padded.astype(np.uint32) if not n or ids.max() < 1 << 32 else padded
    selector = np.full(n, 13, np.int8)
    for s in range(12, -1, -1):  # what fits at a larger count fits at every smaller one
        fits = narrow < 1 << int(BITS[s]) if narrow is padded or BITS[s] < 32 else np.ones(n + 60, bool)
        if len(escapes):
            fits[:n] &= ~big
        width = 1
        while width < COUNTS[s]:  # ids from here on that fit, in windows of doubling width
            more = min(width, COUNTS[s] - width)
            fits[:-more] &= fits[more:]
            width += more
        if not fits[:n].any():
            break
        selector[fits[:n]] = s
    selector[big] = ESCAPE
    padded[:n][big] = np.arange(len(escapes), dtype=np.uint64)
    step, starts, i = COUNTS[selector].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s]):
            words[rows] |= padded[starts[rows] + j] << np.uint64(j * BITS[s])
    return words, escapes, starts[::STRIDE].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block, all words of a selector at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    out = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint64)
    starts = ends - COUNTS[chosen]
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        for j in range(COUNTS[s]):
            got = (words[rows] >> np.uint64(j * BITS[s])) & mask
            out[starts[rows] + j] = escapes[got.astype(np.int64)] if s == ESCAPE else got
    return out[:n]


def image(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    words, escapes, offsets = pack(ids)
    return b"".join(
        [
            struct.pack("<4sIIII", b"S8B1", len(doc_ids), len(ids), len(words), len(escapes)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array(sizes, "<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
        ]
    )


def read_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    magic, docs, n, words, escapes = struct.unpack_from("<4sIIII", data)
    if magic != b"S8B1":
        raise ValueError("not a block of token ids")
    at = 20

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, k, at)
        at += got.nbytes
        return got

    doc_ids, null, sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
    take("<u4", -(-words // STRIDE))
    ids = unpack(take("<u8", words), take("<u8", escapes), n)
    return [None if z else int(d) for d, z in zip(doc_ids, null)], sizes, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, block_ids: int = 1 << 16, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write blocks in ascending doc_id order: by range of doc_id, sorted inside a range.

    Null texts are empty; a document without tokens still has the end id. Null ids come first; rows that repeat an
    id are written each, ordered by text. A block closes at block_ids ids, a longer document has a block of its own.
    An id that very many rows have is dealt by the beginnings of their texts, so only equal beginnings share a task.
    """
    shared = share_encoder(docs.sparkSession, tokenizer)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before, block = encoder(shared), TaskContext.get().partitionId(), 0, 0
        docs_, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs_, sizes, parts, held, before, block
            data = image(docs_, sizes, np.frombuffer(b"".join(parts), "<u4"))
            out = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["shard", "block", "ids_before", "n_ids", "image"])
            before, block = before + held, block + 1
            docs_, sizes, parts, held = [], [], [], 0
            return out

        for b in pieces(batches):
            for d, ps in zip(b["doc_id"].to_pylist(), enc.parts(strings_of(b["text"]))):
                buffer = b"".join(ps) + end
                if held and held + len(buffer) // 4 > block_ids:
                    yield close()
                docs_.append(d)
                sizes.append(len(buffer) // 4)
                parts.append(buffer)
                held += len(buffer) // 4
        if docs_:
            yield close()

    rows = ids_and_texts(docs, doc_id, text).repartitionByRange("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "shard int, block long, ids_before long, n_ids long, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and ids (array) if asked for.

    Null and repeated ids come back as they were written, an empty file set gives no rows. `start` counts the ids of all
    documents before it: in its block, in the blocks before, and in the files before, of which there is one a task.
    """
    blocks = spark.read.parquet(path)
    schema = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, sizes, ids = read_image(r["image"])
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array([r["shard"]] * len(sizes), pa.int32()), pa.array(starts + r["ids_before"]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    rows = blocks.mapInArrow(run, schema)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # a row for each file
    return rows.join(base, "shard").withColumn("start", F.col("start") + F.col("base")).drop("shard", "base")
