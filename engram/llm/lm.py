"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word has a restaurant as a context; all of them share one parent restaurant, of single words, whose own base is
uniform over the V known words and one unknown. A word of a text is a customer of its left neighbour's restaurant.
Seating is sampled by blocked Gibbs: in a sweep each (context, word) cell seats its customers anew, given
the tables elsewhere in its restaurant and the parent's probabilities; the tables are the parent's customers, and the
parent seats those in turn. Predictive probabilities are averaged over the sweeps after the first ones.

Every pair of words has its cell, pairs met once and rare words included, at every size of the corpus. Cells are dealt to
blocks of some block_tokens tokens, a row each of a table on disk that grows with the corpus; sweeps run over that table and only
totals by word come back. Words with a share of at least head_share of all tokens (at most 1 / head_share of them) are numbered
and held in memory; rare ones go by a hash of 63 bits, and a pair with one is in its word's block, so that its sums are made there
and only totals of rare contexts before rare words go between blocks. Gains of cells with a share of at least cell_share of all
pairs are looked up in memory, others in their block, with the same result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import bytes_of, kept, materialise, pieces

#: The end of a text as a token, and the context of its first word. No word has white space.
END = b"\n"
_SHIFT = 24
_LOW = (1 << _SHIFT) - 1
#: Marks the right word of a pair that its left word owns; see _owned().
_RIGHT = 1 << _SHIFT


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and one end."""
    return [*text.lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task adds up its own words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return out

        for b in pieces(batches):
            for t in bytes_of(b["text"]):
                sums.update(tokens(t))
            if len(sums) > 400_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_key(word: bytes) -> int:
    """The lookup key of a word without a number: a negative 63-bit hash, so that it never meets the key of a pair."""
    return -(xxhash.xxh3_64_intdigest(word) >> 1) - 1


def _held(shared) -> tuple:
    """The worker's copy of a broadcast (key, values...): the first value, a sorted list of words, becomes a dict."""
    key, words, *rest = shared.value
    return kept(key, lambda: ({w: i for i, w in enumerate(words)}, *rest))


def _ids(head: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))


def _keys(head: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """Numbers of words in head, and rare_key() of others."""
    keys = _ids(head, words)
    at = np.flatnonzero(keys < 0)
    keys[at] = np.fromiter((rare_key(words[i]) for i in at.tolist()), np.int64, len(at))
    return keys


def _summed(n: np.ndarray, *keys: np.ndarray) -> tuple:
    """Different keys, sorted, and the sum of n for each."""
    if not len(n):
        return (*keys, n)
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return (*(k[first] for k in keys), np.add.reduceat(n[order], first))


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "i" and len(a):
        for kind in (np.int8, np.int16, np.int32):
            if np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max:
                return a.astype(kind)
    return a


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of a block as one value; integers are as wide as they need."""
    raw = pickle.dumps({k: _narrow(a) for k, a in arrays.items()}, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(packed: bytes) -> SimpleNamespace:
    got = pickle.loads(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))
    return SimpleNamespace(**{k: a.astype(np.int64) if a.dtype.kind == "i" else a for k, a in got.items()})


def _steps(ordered: np.ndarray) -> np.ndarray:
    """What cumsum() makes the ordered numbers of, which are narrower."""
    return np.diff(ordered, prepend=0)


def _dealt(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each block and the places of its rows, in order."""
    if len(block):
        order = np.argsort(block.astype(np.int32), kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            yield int(block[at[0]]), at


def _block_of_pair(pair: np.ndarray, blocks: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _owned(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, other) of pairs with a rare word. The owner is the right word if that is rare, else the left one; a pair is in
    its owner's block. other is the left word, or the right word and _RIGHT where the left one is the owner."""
    return np.where(right < 0, right, left), np.where(right < 0, left, right + _RIGHT)


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _added(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, x, size) if len(at) else np.zeros(size)


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def count_pairs(train: DataFrame, shared, blocks: int) -> DataFrame:
    """(block, pairs) of neighbours: each row has a task's counts of some pairs of a block, those of head words as the context's
    number and the word's in one long, others as _owned()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head,) = _held(shared)
        end = head.get(END, rare_key(END))
        lefts, rights = [], []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not lefts:
                return
            left, right = np.concatenate(lefts), np.concatenate(rights)
            lefts.clear()
            rights.clear()
            both = (left >= 0) & (right >= 0)
            pair, n = np.unique(left[both] << _SHIFT | right[both], return_counts=True)
            owner, other = _owned(left[~both], right[~both])
            owner, other, times = _summed(np.ones(len(owner), np.int64), owner, other)
            out = [(k, _pack(pair=_steps(pair[at]), n=n[at])) for k, at in _dealt(_block_of_pair(pair, blocks))]
            out += [(k, _pack(owner=_steps(owner[at]), other=other[at], n=times[at])) for k, at in _dealt(owner % blocks)]
            yield pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "pairs"])

        for b in pieces(batches):
            for t in bytes_of(b["text"]):
                ids = _keys(head, tokens(t))
                lefts.append(np.concatenate([[end], ids[:-1]]))
                rights.append(ids)
                size += len(ids)
            if size > 3_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return train.select("text").mapInArrow(run, "block int, pairs binary")


def _gather(block: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A block from its counts: pairs met once, which have one table always; the state that sweeps change; for left words of
    rare pairs, whose totals another block adds to, what this block knows (u, c, ask; see hpy_scores)."""
    got = [_unpack(x) for x in part["pairs"]]
    heads, mixed = [x for x in got if hasattr(x, "pair")], [x for x in got if hasattr(x, "owner")]
    pair, pn = _summed(_joined([x.n for x in heads]), _joined([x.pair.cumsum() for x in heads]))
    owner, other, n = _summed(_joined([x.n for x in mixed]), _joined([x.owner.cumsum() for x in mixed]), _joined([x.other for x in mixed]))
    key, own = np.unique(owner, return_inverse=True)
    rights = other >> _SHIFT != 1  # the owner is the right word
    count = _added(own[rights], n[rights], len(key)).astype(np.int64)  # a word is the right one as often as it comes
    once, more = n == 1, n > 1
    rare, of_two = other < 0, count > 1
    less = _added(own[~rights & more], n[~rights & more], len(key))
    asks, spared = _summed(n[rare & more], other[rare & more])
    u = np.concatenate([key[of_two], asks])
    c = np.concatenate([(count - less)[of_two], -spared.astype(float)])
    zero = np.zeros(int((pn > 1).sum()), np.int64)
    state = _pack(
        pair=_steps(pair[pn > 1]), pn=pn[pn > 1], pt=zero, ps=zero,
        key=_steps(key), count=count, customers=count, tables=count, back=np.zeros(len(key)), mean=np.zeros(len(key)), less=less,
        own=own[more], other=other[more], n=n[more], t=np.zeros(int(more.sum()), np.int64), s=np.zeros(int(more.sum()), np.int64),
    )
    return pd.DataFrame({
        "block": [block[0]], "ones": [int((pn == 1).sum() + once.sum())], "twos": [int((pn == 2).sum() + (n == 2).sum())],
        "once": [_pack(pair=_steps(pair[pn == 1]), own=own[once], other=other[once])], "all_asks": [np.unique(other[rare])],
        "state": [state], "u": [u], "c": [c], "ask": [np.arange(len(u)) >= of_two.sum()],
    })


_GATHERED = "block int, ones long, twos long, once binary, all_asks array<long>, state binary, u array<long>, c array<double>, ask array<boolean>"


def seat(c: np.ndarray, b: np.ndarray | float, d: float, rng: np.random.Generator, exact: int = 48) -> np.ndarray:
    """Tables after c customers of a dish sat down one by one; b is the weight of a new table, d the discount.

    The first `exact` customers choose singly; after that in runs of a tenth of those seated, the run's number of new
    tables drawn as Poisson with the chance at its start. So a cell takes steps in the logarithm of its count.
    """
    c = np.asarray(c, np.float64)
    t = np.minimum(c, 1.0)
    b = np.broadcast_to(np.asarray(b, np.float64), c.shape)
    at, j = np.flatnonzero(c > 1), 1.0
    while len(at):
        run = 1.0 if j < exact else math.floor(j / 10)
        run_of = np.minimum(run, c[at] - j)
        chance = b[at] / (b[at] + j - d * t[at])
        new = rng.random(len(at)) < chance if run == 1 else np.minimum(rng.poisson(chance * run_of), run_of)
        t[at] += new
        j += run
        at = at[c[at] > j]
    return t


def _told(blocks: DataFrame) -> DataFrame:
    """(block, u, total): for left words of rare pairs, the sum of what blocks know of them, to each of these blocks."""
    said = blocks.select("block", F.explode(F.arrays_zip("u", "c", "ask")).alias("x")).select("block", "x.*")
    of = Window.partitionBy("u")
    sums = said.select("block", "u", F.sum("c").over(of).alias("total"), F.max("ask").over(of).alias("any")).where("any")
    return sums.groupBy("block").agg(F.collect_list(F.struct("u", "total")).alias("x")).select("block", F.col("x.u").alias("u"), F.col("x.total").alias("total"))


def _numbers(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)


def _spared(blocks: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers less tables of the cells of each head word, as a context and as a word: at most 1 / head_share rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led, came = np.zeros(size), np.zeros(size)
        for b in batches:
            for packed in b["state"].to_pylist():
                s = _unpack(packed)
                pair, more, spared = s.pair.cumsum(), s.pn - s.pt, s.n - s.t
                led += _added(pair >> _SHIFT, more, size)
                came += _added(pair & _LOW, more, size)
                for sums, kind in ((led, 0), (came, 1)):
                    at = s.other >> _SHIFT == kind
                    sums += _added(s.other[at] & _LOW, spared[at], size)
        at = np.flatnonzero(led + came)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(led[at]), pa.array(came[at])], ["at", "led", "came"])

    got = blocks.select("state").mapInArrow(run, "at int, led double, came double").groupBy("at").agg(F.sum("led").alias("led"), F.sum("came").alias("came")).toArrow()
    out = np.zeros((2, size))
    out[0][got["at"].to_numpy()] = got["led"].to_numpy()
    out[1][got["at"].to_numpy()] = got["came"].to_numpy()
    return out[0], out[1]


_SWEPT = "block int, state binary, u array<long>, c array<double>, ask array<boolean>, customers double, tables double"
_SWEPT_NAMES = ["block", "state", "u", "c", "ask", "customers", "tables"]
_SWEPT_KINDS = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.float64(), pa.float64())


def _resumed(packed: bytes, u: np.ndarray, told: np.ndarray, theta: float, d0: float, d1: float, spare: float, base: float, weight: float) -> SimpleNamespace:
    """A block as the last sweep left it: tables of its rare words as contexts and their parent probabilities, which enter the means by
    weight; u and told are the totals of left words of rare pairs."""
    s = _unpack(packed)
    s.pair, s.key = s.pair.cumsum(), s.key.cumsum()
    s.u, first = np.unique(u, return_index=True)
    s.told = told[first].astype(np.float64)
    s.total = s.count - s.less
    at, there = _at(s.key, s.u)
    s.total[at[there]] = s.told[there]
    s.parent = (s.customers - d0 * s.tables) * spare + base
    s.back = s.back + weight * (theta + d1 * s.total) / (theta + s.count)
    s.mean = s.mean + weight * s.parent
    return s


#: Spark's setting that removes a query's shuffle files when the query ends, not when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialise(), with shuffle files removed as soon as the table is there."""
    conf = df.sparkSession.conf
    old = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return materialise(df, name)
    finally:
        conf.unset(_CLEAN) if old is None else conf.set(_CLEAN, old)


def _removed(df: DataFrame) -> None:
    """Remove a table of _written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _gain(mass: np.ndarray | float, k: np.ndarray, scale: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """log10 of how much likelier a pair is by its own cell, beside what the parent gives it."""
    return np.log10(1 + mass / (scale[k >> _SHIFT] * parent[k & _LOW]))


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones and twos else 0.5, 0.1, 0.95))


def hpy_scores(
    docs: DataFrame,
    held_out: Column,
    head_share: float = 2.0**-19,
    cell_share: float = 2.0**-22,
    burn_in: int = 1,
    samples: int = 3,
    theta: float = 1.0,
    seed: int = 7,
    block_tokens: int = 2_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows that are not held_out, and scores all. perplexity is 10 ** (-score / n_tokens). Null and empty
    texts are one end token; rows that repeat are counted and scored each; a null id stays null; without rows to learn
    from every token has the uniform probability 1. Of the samples the tables of a cell, the context's back-off weight
    and the word's parent probability are averaged, and the probability is made of these averages.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = rows.where("not held_out")
    vocabulary = _written(count_words(train), "lm-words")
    one = vocabulary.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n_all, v, ones, twos = (int(x or 0) for x in one)
    d0 = _discount(ones, twos)
    least = max(1.0, n_all * head_share)
    frequent = vocabulary.where(F.col("n") >= least).toArrow().sort_by("word")  # at most 1 / head_share rows
    _removed(vocabulary)
    words = frequent["word"].to_pylist()
    n_head = frequent["n"].to_numpy().astype(np.float64)
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((key, words))
    size, blocks = len(words), max(64, n_all // block_tokens)

    # blocks of cells, a row each: pairs of head words by hash, others with their rare word, so that a rare word's customers and
    # tables are sums inside its block. Only what a rare left word has in cells of other blocks' rare words comes from outside
    start = _written(count_pairs(train, shared, blocks).groupBy("block").applyInPandas(_gather, _GATHERED), "lm-blocks")
    ones, twos = (int(x or 0) for x in start.agg(F.sum("ones"), F.sum("twos")).first())
    d1 = _discount(ones, twos)

    def sweep_of(now, sweep: int):
        sampled = sweep >= burn_in

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parent, total = (np.append(x, 0.0) for x in now.value[:2])
            for b in batches:
                for block, packed, u, told in zip(b["block"].to_pylist(), b["state"].to_pylist(), b["u"], b["total"]):
                    s = _resumed(packed, _numbers(u), _numbers(told), theta, d0, d1, *now.value[2:])
                    rng = np.random.default_rng([seed, sweep, block])
                    # tables of the last sweep are taken out of their context's before they are seated anew
                    weight = (theta + d1 * np.maximum(total[s.pair >> _SHIFT] - s.pt, 0)) * parent[s.pair & _LOW]
                    s.pt = seat(s.pn, weight, d1, rng).astype(np.int64)
                    rare, leads = s.other < 0, s.other >> _SHIFT == 1
                    head = np.where(rare, size, s.other & _LOW)
                    seated = np.where(leads, s.total[s.own], total[head])
                    seated[rare] = s.told[_at(s.u, s.other[rare])[0]]
                    weight = (theta + d1 * np.maximum(seated - s.t, 0)) * np.where(leads, parent[head], s.parent[s.own])
                    s.t = seat(s.n, weight, d1, rng).astype(np.int64)
                    spared = s.n - s.t
                    s.customers = s.count - _added(s.own[~leads], spared[~leads], len(s.key)).astype(np.int64)
                    s.tables = seat(s.customers, (theta + d0 * v) / (v + 1), d0, rng).astype(np.int64)
                    s.less = _added(s.own[leads], spared[leads], len(s.key))
                    at, there = _at(s.key, s.u)
                    at = at[there]
                    asks, less = _summed(spared[rare], s.other[rare])
                    state = _pack(
                        pair=_steps(s.pair), pn=s.pn, pt=s.pt, ps=s.ps + s.pt * sampled, key=_steps(s.key), count=s.count, customers=s.customers,
                        tables=s.tables, back=s.back, mean=s.mean, less=s.less, own=s.own, other=s.other, n=s.n, t=s.t, s=s.s + s.t * sampled,
                    )
                    us, cs = np.concatenate([s.key[at], asks]), np.concatenate([(s.count - s.less)[at], -less.astype(float)])
                    values = (block, state, us, cs, np.arange(len(us)) >= len(at), float(s.customers.sum()), float(s.tables.sum()))
                    yield pa.record_batch([pa.array([x], kind) for x, kind in zip(values, _SWEPT_KINDS)], _SWEPT_NAMES)

        return run

    # sweeps: blocks are seated in parallel, given last sweep's totals and parent; pairs met once have one table
    state, before = start, None
    led, _ = _spared(state, size)
    tables_of = n_head - led  # tables of each context's restaurant
    parent = (n_head + 1) / (n_all + v + 1)
    scalars = (1 / (1 - d0) / (n_all + v + 1), 1 / (n_all + v + 1), 0.0)  # of the parent of rare words, all of whose customers have tables
    mean = {"back": np.zeros(size), "parent": np.zeros(size), "base": 0.0}
    for sweep in range(burn_in + samples):
        now = spark.sparkContext.broadcast((parent, tables_of, *scalars))
        told = state.select("block", "state").join(_told(state), "block", "left")
        state, before = _written(told.mapInArrow(sweep_of(now, sweep), _SWEPT), "lm-sweep"), state
        if before is not start:
            _removed(before)
        now.unpersist()
        rare_customers, rare_tables = (float(x or 0) for x in state.agg(F.sum("customers"), F.sum("tables")).first())
        led, came = _spared(state, size)
        tables_of, customers = n_head - led, n_head - came
        tables = seat(customers, (theta + d0 * v) / (v + 1), d0, np.random.default_rng([seed, sweep, 1 << 20]))
        all_customers, all_tables = customers.sum() + rare_customers, tables.sum() + rare_tables
        base = (theta + d0 * all_tables) / (theta + all_customers) / (v + 1)
        parent = (customers - d0 * tables) / (theta + all_customers) + base
        sampled = sweep >= burn_in
        scalars = (float(1 / (theta + all_customers)), float(base), sampled / samples)
        if sampled:
            mean["back"] += (theta + d1 * tables_of) / (theta + n_head) / samples
            mean["parent"] += parent / samples
            mean["base"] += float(base) / samples

    # what cells are worth, and how much a context's back-off weighs
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed, u, told in zip(b["block"].to_pylist(), b["state"].to_pylist(), b["u"], b["total"]):
                s = _resumed(packed, _numbers(u), _numbers(told), theta, d0, d1, *scalars)
                scale = s.back * (theta + s.count)
                state = _pack(
                    pair=_steps(s.pair), pn=s.pn, pmass=s.pn - d1 * s.ps / samples, key=_steps(s.key), count=s.count, scale=scale, mean=s.mean,
                    own=s.own, other=s.other, mass=s.n - d1 * s.s / samples,
                )
                of_two = s.count > 1
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([state], pa.binary()), pa.array([s.key[of_two]], pa.list_(pa.int64())), pa.array([scale[of_two]], pa.list_(pa.float64()))], ["block", "state", "u", "scale"])

    told = state.select("block", "state").join(_told(state), "block", "left")
    ready = _written(told.mapInArrow(close, "block int, state binary, u array<long>, scale array<double>"), "lm-ready")
    if state is not start:
        _removed(state)
    # a rare left word of another block: its scale, which for a word met once is that of its one table
    asks = start.select("block", F.explode("all_asks").alias("u"))
    of_asked = asks.join(ready.select(F.explode(F.arrays_zip("u", "scale")).alias("x")).select("x.*"), "u", "left").withColumn("scale", F.coalesce("scale", F.lit(theta + d1)))
    answers = of_asked.groupBy("block").agg(F.collect_list(F.struct("u", "scale")).alias("x")).select("block", F.col("x.u").alias("u"), F.col("x.scale").alias("scale"))
    table = _written(ready.select("block", "state").join(start.select("block", "once"), "block").join(answers, "block", "left"), "lm-table")

    # gains of pairs of head words: the common ones in memory, the others and those of rare words in their blocks
    scale, mean_parent = mean["back"] * (theta + n_head), mean["parent"]
    weights = spark.sparkContext.broadcast((scale, mean_parent))
    least_common = max(2.0, n_all * cell_share)  # at most 1 / cell_share rows

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, mean_parent = weights.value
        for b in batches:
            for packed in b["state"].to_pylist():
                s = _unpack(packed)
                at = np.flatnonzero(s.pn >= least_common)
                k = s.pair.cumsum()[at]
                yield pa.record_batch([pa.array(k), pa.array(_gain(s.pmass[at], k, scale, mean_parent).astype(np.float32))], ["pair", "gain"])

    got = table.select("state").mapInArrow(common, "pair long, gain float").toArrow().sort_by("pair")
    _removed(ready)
    _removed(start)

    log = lambda x: np.log10(x).astype(np.float32)
    unit = math.log10(n_all + v + 1)
    model = spark.sparkContext.broadcast((key + "s", words, np.log10(n_head + 1), log(mean_parent), log(mean["back"]), got["pair"].to_numpy(), got["gain"].to_numpy()))
    del got
    shared.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block each: what some texts look up there, and facts of the texts themselves. In a text a word leads as often as
        it comes, the end before the first word, so that a rare word's own part is told where it is the right word."""
        head, log_n, log_p, log_b, keys, log_gain = _held(model)
        end = head.get(END, rare_key(END))
        out: dict[str, list] = {c: [] for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")}
        asked: dict[str, list] = {c: [] for c in ("pair", "of_pair", "owner", "other", "of_owner")}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not out["row"]:
                return
            x = {c: np.concatenate(parts) for c, parts in asked.items()}
            row = np.array(out["row"])
            facts = {c: np.array(out[c]) for c in ("held_out", "n_tokens", "n_known", "base", "score")}
            facts |= {"null": np.array([d is None for d in out["doc_id"]]), "doc_id": np.array([d or 0 for d in out["doc_id"]], np.int64)}
            to = [(int(row[0] % blocks), _pack(row=row, **facts))]
            of_pair, of_owner = np.argsort(x["pair"]), np.argsort(x["owner"])
            for cols, first, order, block in ((("pair", "of_pair"), "pair", of_pair, _block_of_pair(x["pair"][of_pair], blocks)), (("owner", "other", "of_owner"), "owner", of_owner, x["owner"][of_owner] % blocks)):
                for k, at in _dealt(block):
                    at = order[at]
                    docs, of = np.unique(x[cols[-1]][at], return_inverse=True)
                    to.append((k, _pack(row=row[docs], of=of, **{first: _steps(x[first][at])}, **{c: x[c][at] for c in cols[1:-1]})))
            for values in (*out.values(), *asked.values()):
                values.clear()
            for i in range(0, len(to), 64):
                yield pa.record_batch([pa.array([k for k, _ in to[i : i + 64]], pa.int32()), pa.array([y for _, y in to[i : i + 64]], pa.binary())], ["block", "asks"])

        for b in pieces(batches):
            for d, h, t in zip(b["doc_id"].to_pylist(), b["held_out"].to_pylist(), bytes_of(b["text"])):
                row = int.from_bytes(hashlib.blake2b(f"{d}\n".encode() + t, digest_size=8).digest(), "little", signed=True)
                ws = tokens(t)
                ids = _keys(head, ws)
                before = np.concatenate([[end], ids[:-1]])
                known, led = ids >= 0, before >= 0
                total = float(log_b[before[led]].sum(dtype=np.float64)) + float(log_p[ids[known]].sum(dtype=np.float64))
                both = known & led
                pair = before[both] << _SHIFT | ids[both]
                at, hit = _at(keys, pair)
                total += float(log_gain[at[hit]].sum(dtype=np.float64))
                owner, other = _owned(before[~both], ids[~both])
                n = len(out["row"])
                pair = pair[~hit]
                for parts, part in zip(asked.values(), (pair, np.full(len(pair), n), owner, other, np.full(len(owner), n))):
                    parts.append(part)
                facts = (row, d, h, len(ws), int(known.sum()), float(log_n[ids[known]].sum(dtype=np.float64)), total)
                for c, y in zip(out.values(), facts):
                    c.append(y)
                size += len(ws)
            if size > 3_000_000:
                yield from flush()
                size = 0
        yield from flush()

    unseen = math.log10(mean["base"] or 1.0)

    def look(asks: pa.Table, block: pa.Table) -> pa.Table:
        """What the texts' tokens of one block add to their rows: known words, base and score."""
        scale, mean_parent = (np.append(x, 1.0) for x in weights.value)
        zero, none = np.zeros(0, np.int64), np.zeros(0)
        pair, gain, key, cell, cell_gain, known = zero, none, zero, zero, none, SimpleNamespace(other=zero)
        if block.num_rows:
            s, once = (_unpack(block[c][0].as_py()) for c in ("state", "once"))
            pair = np.concatenate([s.pair.cumsum(), once.pair.cumsum()])
            order = np.argsort(pair)
            pair = pair[order]
            gain = _gain(np.concatenate([s.pmass, np.full(len(once.pair), 1 - d1)])[order], pair, scale, mean_parent)
            key, own, other = s.key.cumsum(), np.concatenate([s.own, once.own]), np.concatenate([s.other, once.other])
            u, first = np.unique(_numbers(block["u"][0]), return_index=True)
            rare, leads = other < 0, other >> _SHIFT == 1
            head = np.where(rare, size, other & _LOW)
            scales = np.where(leads, s.scale[own], scale[head])
            if rare.any():
                scales[rare] = _numbers(block["scale"][0])[first][_at(u, other[rare])[0]]
            mass = np.concatenate([s.mass, np.full(len(once.own), 1 - d1)])
            cell_gain = np.log10(1 + mass / (scales * np.where(leads, mean_parent[head], s.mean[own])))
            known = SimpleNamespace(other=np.unique(other), n=np.log10(s.count + 1.0), score=np.log10(s.scale / (theta + s.count) * s.mean))
            cell = own * len(known.other) + _at(known.other, other)[0]
            order = np.argsort(cell)
            cell, cell_gain = cell[order], cell_gain[order]
        outs = []
        for packed in asks["asks"].to_pylist():
            x = _unpack(packed)
            size_of = len(x.row)
            if hasattr(x, "doc_id"):
                values = (x.row, pa.array(x.doc_id, mask=x.null), x.held_out, x.n_tokens, x.n_known, x.base, x.score)
            elif hasattr(x, "pair"):
                at, hit = _at(pair, x.pair.cumsum())
                score = _added(x.of[hit], gain[at[hit]], size_of)
                values = (x.row, None, None, None, None, None, score)
            else:
                owner = x.owner.cumsum()
                at, there = _at(key, owner)
                comes = x.other >> _SHIFT != 1
                found = comes & there
                at_other, is_other = _at(known.other, x.other)
                at_cell, hit = _at(cell, at * len(known.other) + at_other)
                hit &= there & is_other
                score = _added(x.of[hit], cell_gain[at_cell[hit]], size_of) + _added(x.of[comes & ~there], np.full(int((comes & ~there).sum()), unseen), size_of)
                base = np.zeros(size_of)
                if found.any():
                    score += _added(x.of[found], known.score[at[found]], size_of)
                    base = _added(x.of[found], known.n[at[found]], size_of)
                values = (x.row, None, None, None, np.bincount(x.of[found], minlength=size_of), base, score)
            outs.append(pa.table([pa.nulls(size_of, f.type) if y is None else pa.array(y, f.type) for y, f in zip(values, fields)], schema=pa.schema(fields)))
        return pa.concat_tables(outs) if outs else pa.schema(fields).empty_table()

    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    fields = [pa.field(c, kind) for c, kind in zip(("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"), kinds)]
    asks = rows.mapInArrow(run, "block int, asks binary")
    joined = asks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(look, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    # a row's parts meet again by a hash of its id and text, whatever task made them; repeated rows count as copies
    copies = F.count("n_tokens")
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            copies.cast("int").alias("copies"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.sum("n_known") / copies).cast("long").alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.sum("base") / copies - F.max("n_tokens") * F.lit(unit)).alias("base_score"),
            (F.sum("score") / copies).alias("score"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .drop("row", "copies", "copy")
    )
