"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. A pass over the texts hashes the word shingles of each once and keeps the least hash of each of BINS bins; an empty
   bin takes the value of the first filled one in a fixed pseudo-random order of its own. Bands of rows_per_band bins
   are the bucket keys, as many as leave a pair at the threshold unmet with a chance of `miss`.
2. Texts with the same set of shingles are one class, joined before any bucket is built, so thousands of copies count
   as one row in what follows.
3. In each bucket every class is paired with up to four centres: the smallest and largest id, and those of the smallest
   and largest hash of the id (stars). So a bucket gives at most four pairs for each member, however large it is; a
   bucket of three gives all of its pairs, and a pair that is alike shares many buckets with different members. Pairs
   whose set sizes rule out the threshold go at once, pairs whose signatures are far below it too (six deviations), and
   the rest are confirmed on their full shingle sets.
4. Connected classes are found by alternating large and small stars.
5. Members of buckets that have pairs no centre is part of, and more than one component, go through a prefix filter that
   loses no pair: of two sets at the threshold the smaller has one of the other's rarest shingles among its own rarest,
   n - ceil(2tn / (1 + t)) + 1 of the smaller and n - ceil(tn) + 1 of the larger. Rarity only orders shingles, so its
   estimate (a table of fixed size) bears on the cost, not on the result. Such members are dealt into chunks of bounded
   size, those of one bucket together; a text meets a chunk, not its members, where one of its rarest shingles is among
   theirs in another component. A block of texts is compared with a chunk on full sets in one go, and at most one link
   for a text and a component is kept: so rows stay few where many texts are alike just below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import bytes_of, ids_and_texts, kept, materialise, pieces, release


def bands(threshold: float, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of each word, remembered for up to `most` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.most:
            self[word] = h
        return h


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's runs of so many words; of the whole text if it has fewer."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(kept("word hashes", _Words).__getitem__, ws), np.uint64, len(ws))
    k = min(words, len(ws))
    out = np.zeros(len(ws) - k + 1, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


class Signer:
    """Signatures of sets of hashes."""

    def __init__(self, bins: int, tries: int = 64):
        self.bins = bins
        rng = np.random.default_rng(5)
        self.probe = rng.integers(0, bins, (bins, tries))
        self.rest = rng.permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)

    def sign(self, s: np.ndarray) -> np.ndarray:
        """The least hash of each bin, empty bins densified. s is sorted and has one hash at least."""
        order = _mix(s ^ np.uint64(0x5851F42D4C957F2D))
        order.sort()
        bin_ = ((order >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]]))
        out, full = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bin_[first]], full[bin_[first]] = order[first], True
        empty = np.flatnonzero(~full)
        if len(empty):
            for table in (self.probe, self.rest):
                hit = full[table[empty]]
                found = hit.any(1)
                own = empty[found]
                out[own] = out[table[own, hit[found].argmax(1)]]
                empty = empty[~found]
                if not len(empty):
                    break
        return out


def sign_documents(docs: DataFrame, words: int, n_bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), set_key (128-bit digest of the set), bands (array of 64-bit), sketch (a byte of each bin)."""
    bins = n_bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bins)
        salt = _mix(np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in pieces(batches):
            n, keys, sketches, band_values = [], [], [], []
            for t in bytes_of(b["text"]):
                s = shingles(t, words)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    sketches.append(None)
                    band_values.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signer.sign(s)
                sketches.append((sig & np.uint64(0xFF)).astype(np.uint8).tobytes())
                v = salt.copy()
                for j in range(rows):
                    v = _mix(v * np.uint64(0x9E3779B97F4A7C15) + sig[j::rows][:n_bands])
                band_values.append(v.view(np.int64))
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_values, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "set_key", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches don't rule out the threshold by six standard deviations."""
    side = classes.select("id", "n", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in pieces(batches, 8192, 16 << 20):
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("s_a", "s_b"))
            alike = (x == y).mean(1)
            least = np.minimum(b["n_a"].to_numpy(), b["n_b"].to_numpy())
            slack = 6 * np.sqrt(threshold * (1 - threshold) / np.minimum(least, x.shape[1])) + 0.01
            keep = pa.array(alike >= threshold - slack)
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Sets are made for the documents in pairs only."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return _alike(pairs, _sets(docs, ids, words), threshold)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents whose doc_id is in ids, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingles(t, words).tobytes() for t in bytes_of(b["text"])]
            yield pa.record_batch([b["doc_id"], pa.array(sets, pa.binary())], ["id", "shingles"])

    # the ids grow with the documents, so they are never broadcast: the plan is the same at every size
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    return materialise(texts.mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles")), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in pieces(batches):
            ok = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                shared = int((q[at] == p).sum()) if len(q) else 0
                ok.append(round(100 * threshold) * (len(p) + len(q) - shared) <= 100 * shared)
            yield pa.record_batch([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


#: Added to a key by xor, so that a join has exchanges of its own, which Spark can split where a key is hot.
_OWN = 0x5DEECE66D
#: Texts and shingles of a chunk or a block, about.
CHUNK, CHUNK_SHINGLES = 512, 1 << 18


def _dealt(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows (key, id, n, ...) with a column of that name: a key's rows are dealt by id, some CHUNK of them each."""
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES), F.lit(1))
    sizes = rows.groupBy(key).agg(parts.alias("parts")).select(F.col(key).bitwiseXOR(F.lit(_OWN)).alias("own"), "parts")
    met = rows.withColumn("own", F.col(key).bitwiseXOR(F.lit(_OWN))).join(sizes.hint("merge"), "own")
    return met.withColumn(name, F.xxhash64(key, F.pmod(F.xxhash64("id"), F.col("parts")))).drop("own", "parts")


def _crowded(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n, component, chunk) of the classes in buckets where a pair without a centre may join two components.

    A chunk has classes that share a bucket, the most crowded that each is in.
    """
    labelled = classes.select("id", "n", "bands").join(labels.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = labelled.select("id", "n", "component", F.explode("bands").alias("bucket"))
    mixed = F.struct(F.xxhash64("id").alias("h"), "id")
    centres = F.size(F.array_distinct(F.array(F.min("id"), F.max("id"), F.min(mixed)["id"], F.max(mixed)["id"])))
    found = members.groupBy("bucket").agg(F.count("*").alias("members"), centres.alias("centres"), F.min("component").alias("least"), F.max("component").alias("most"))
    left = found.where("members - centres >= 2 and least <> most").select(F.col("bucket").bitwiseXOR(F.lit(_OWN)).alias("own"), "members")
    met = members.withColumn("own", F.col("bucket").bitwiseXOR(F.lit(_OWN))).join(left.hint("merge"), "own")
    homes = met.groupBy("id", "n", "component").agg(F.max(F.struct("members", "bucket"))["bucket"].alias("home"))
    return _dealt(homes, "home", "chunk").drop("home")


def _maybe(docs: DataFrame, ids: DataFrame, slots: int = 1 << 25) -> DataFrame:
    """The documents whose id may be in ids, by a bitmap of fixed size, so that few texts are shuffled after it."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)) + 1
    maps = ids.select(slot("id").alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits")).collect()
    bits = np.zeros((slots >> 15, 4096), np.uint8)  # a bitmap of Spark has 2^15 bits
    for r in maps:
        bits[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = shared.value
        for b in batches:
            at = b["s"].to_numpy() - 1
            yield b.filter(pa.array((table[at >> 3] >> (at & 7) & 1).astype(bool))).select(["doc_id", "text"])

    return docs.where("doc_id is not null").withColumn("s", slot("doc_id")).mapInArrow(run, "doc_id long, text string")


def _rarest(sets: DataFrame, percent: int, slots: int = 1 << 21) -> DataFrame:
    """(token, id, n, component, chunk, lead): the rarest shingles of each set, those of the larger and, lead, of the smaller
    of two sets at the threshold."""
    shift = np.uint64(64 - slots.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n = np.zeros(slots, np.int64)
        for b in batches:
            for x in b["shingles"].to_pylist():
                np.add.at(n, (np.frombuffer(x, np.uint64) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    counts = sets.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most `slots` rows
    often = np.zeros(slots, np.uint32)
    often[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 2**32 - 1)
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = shared.value
        for batch in batches:
            for b in pieces([batch]):
                tokens, leads, row = [], [], []
                for k, x in enumerate(b["shingles"].to_pylist()):
                    s = np.frombuffer(x, np.uint64)
                    n = len(s)
                    probe = n + percent * n // -100 + 1
                    index = n + 2 * percent * n // -(100 + percent) + 1
                    tokens.append(s[np.lexsort((s, table[(s >> shift).astype(np.int64)]))[:probe]].view(np.int64))
                    leads.append(np.arange(probe) < index)
                    row.append(np.full(probe, k))
                if tokens:
                    own = b.select(["id", "n", "component", "chunk"]).take(pa.array(np.concatenate(row)))
                    yield pa.record_batch([pa.array(np.concatenate(tokens)), *own.columns, pa.array(np.concatenate(leads))], ["token", *own.schema.names, "lead"])

    return sets.mapInArrow(run, "token long, id long, n long, component long, chunk long, lead boolean")


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between sets (id, n, component, chunk, shingles) of different components: for every pair at the threshold
    one link at least between one of the pair and the other's component."""
    percent = round(100 * threshold)
    rare = materialise(_rarest(sets, percent), "near-rarest")
    theirs = rare.groupBy("token", F.col("chunk").alias("met")).agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    theirs = theirs.select(F.col("token").bitwiseXOR(F.lit(_OWN)).alias("own"), "met", "least", "most", "smallest", "largest")
    mine = rare.where("lead").select(F.col("token").bitwiseXOR(F.lit(_OWN)).alias("own"), "id", "n", "component")
    near = ((F.col("least") != F.col("component")) | (F.col("most") != F.col("component"))) & (F.col("n") <= F.col("largest")) & (F.col("n") * 100 >= percent * F.col("smallest"))
    meetings = mine.join(theirs.hint("merge"), "own").where(near).select("id", "n", "met").distinct()
    meetings = _dealt(meetings, "met", "block").select("id", "met", "block")
    whole = F.collect_list(F.struct("id", "component", "shingles"))
    texts = sets.select("id", "component", "shingles")
    xs = meetings.join(texts.hint("merge"), "id").groupBy("met", "block").agg(whole.alias("xs"))
    ys = sets.groupBy(F.col("chunk").alias("met")).agg(whole.alias("ys"))

    def unpack(row: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        v = row.values
        return v.field("id").to_numpy(), v.field("component").to_numpy(), [np.frombuffer(x, np.uint64) for x in v.field("shingles").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            a, b = [], []
            for xs, ys in zip(batch["xs"], batch["ys"]):
                ids, own, sets_ = unpack(ys)
                sizes = np.fromiter(map(len, sets_), np.int64, len(sets_))
                tokens, holder = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, holder = tokens[order], holder[order]
                for i, c, s in zip(*unpack(xs)):
                    first, last = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                    n = last - first
                    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    common = np.bincount(holder[at], minlength=len(ids))
                    hit = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (own != c))
                    if len(hit):
                        one = hit[np.unique(own[hit], return_index=True)[1]]
                        a.extend([i] * len(one))
                        b.extend(ids[one].tolist())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return xs.join(ys.hint("merge"), "met").select("xs", "ys").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (a, b).

    Alternates large stars (each larger neighbour to the least neighbour) and small stars (each smaller or equal
    neighbour to the least) until nothing changes; every round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    before = None
    own = F.col("u").bitwiseXOR(F.lit(_OWN))

    def meet(rows: DataFrame, least: DataFrame) -> DataFrame:
        """rows with their vertex's least neighbour; a vertex of many edges can be split over tasks."""
        return rows.withColumn("own", own).join(least.select(own.alias("own"), "m").hint("merge"), "own").drop("own")

    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = meet(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct()
        now = materialise(small, "near-edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_components(docs: DataFrame, words: int = 5, threshold: float = 0.8, rows: int = 5, miss: float = 1e-6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are texts whose shingle sets have a Jaccard similarity of the threshold (in whole hundredths) or more;
    component_id is the smallest doc_id reachable over links. Texts without words, and null texts, have no shingles and
    are linked with nothing; rows that repeat an id are one vertex; rows with a null id are linked with nothing, have a
    null component_id and are kept. An empty table gives no rows. Other columns of docs are not read.
    """
    plain = ids_and_texts(docs, doc_id, text)
    n_bands = bands(threshold, rows, miss)
    signed = materialise(sign_documents(plain, words, n_bands, rows), "near-signed")
    classes = materialise(
        signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).drop("set_key"),
        "near-classes",
    )
    buckets = classes.select("id", "n", F.explode("bands").alias("bucket"))
    mixed = F.xxhash64("id")
    ends = [F.min(F.struct("id", "n")), F.max(F.struct("id", "n")), F.min(F.struct(mixed.alias("h"), "id", "n")), F.max(F.struct(mixed.alias("h"), "id", "n"))]
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members"), *[e.alias(f"e{i}") for i, e in enumerate(ends)]).where("members > 1")
    key = F.col("bucket").bitwiseXOR(F.lit(_OWN))
    centres = shared.select(key.alias("k"), F.array_distinct(F.array(*[F.struct(F.col(f"e{i}.id").alias("a"), F.col(f"e{i}.n").alias("n_a")) for i in range(4)])).alias("c"))
    members = buckets.select(key.alias("k"), F.col("id").alias("b"), F.col("n").alias("n_b"))
    near = lambda c: (F.least(c["n_a"], F.col("n_b")) * 100 >= round(100 * threshold) * F.greatest(c["n_a"], F.col("n_b"))) & (c["a"] != F.col("b"))
    met = members.join(centres, "k").select("b", F.explode(F.transform(F.filter("c", near), lambda c: c["a"])).alias("a"))
    stars = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = materialise(_likely(stars, classes, threshold), "near-likely")
    labels = components(_confirmed(likely, plain, words, threshold))
    crowded = materialise(_crowded(classes, labels), "near-crowded")
    sets = _sets(_maybe(plain, crowded), crowded.select(F.col("id").alias("doc_id")), words)
    sets = materialise(crowded.join(sets.hint("merge"), "id"), "near-sets")
    labels = components(labels.toDF("a", "b").union(_links(sets, threshold)))

    # rows find their component by the set they have in common
    of_set = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    of_set = of_set.join(labels, "id", "left").select(F.hex("set_key").alias("k"), F.coalesce("component", "id").alias("component"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.hex("set_key")).alias("set_key"))
        .withColumn("k", F.coalesce("set_key", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .join(of_set, "k", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns. Rows with a null id stay."""
    gone = near_components(docs, words, threshold, doc_id=doc_id, text=text).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["doc_id"], "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""
