"""Conversation trie, source divergence and word BPE: brute force, the library, edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm import bpe, divergence, prefix_trie
from engram.llm.queries import QUERIES

WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, digest string, term string, n long, kind int, block int, item string, value long"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def brute_trie(turns, step=5, span=9):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    said = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % span
        built[c] = tuple(said.get(c - c % step, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(spark, turns):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, digest string, depth int")
    df = prefix_trie.turns_in_order(df)
    return sorted((tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(prefix_trie.rebuild(df)).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_brute_force(spark, seed):
    rng = random.Random(seed)
    turns = [(None, 0, "user", "of no conversation"), (7, None, "user", "null turn first"), (7, 1, None, None), (7, 1, "", "tie"), (7, 1, "user", "tie"), (7, 2, "user", "x" * 5000)]
    for c in rng.sample(range(60), 40):
        turns += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])) for t in range(rng.randrange(1, 14))]
    turns += [(1000 + c, t, "user", "same" * (t % 3)) for c in range(30) for t in range(12)] + turns[-3:]
    got = trie(spark, turns)
    assert got == brute_trie(turns) and len({(r[0], r[1]) for r in got}) == len(got)


def test_trie_of_nothing_and_of_a_turnless(spark):
    assert trie(spark, [(None, 1, "a", "b")]) == []
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert trie(spark, [(lone, 0, "user", "gone, as its base is absent")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_ends_in_ranges(spark):
    """A node's ids are hashed in order, however many ranges they are gathered in."""
    df = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(1).alias("pos"), F.unhex(F.lit("ab")).alias("digest"), F.lit(2).cast("long").alias("n_bytes"))
    prefixes = prefix_trie._chain(df)
    want = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in prefix_trie._ends(prefixes, width=7).collect()] == [want]


def brute_audit(rows, top=200, least=3, scale=10**9):
    df, n, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in low).split(" ")
        words = [w for w in words if w]
        for w in words:
            n[lang, source, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (k, w), x in df.items() if k == lang and x >= least]
        sources = [s for k, s in groups if k == lang]
        v = len(kept)

        def p(count, total, v=v):
            return 1 + scale * (count + 1) // (total + v)

        totals = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        whole = {w: sum(n[lang, s, w] for s in sources) for w in kept}
        own = {s: {w: p(n[lang, s, w], totals[s]) for w in kept} for s in sources}
        q = {w: p(whole[w], sum(totals.values())) for w in kept}
        for a in sources:
            pairs = [(-sum((own[a][w] - own[b][w]) ** 2 // own[b][w] for w in kept), b.encode(), b) for b in sources if b != a]
            terms = [(-((own[a][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if n[lang, a, w] and own[a][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, a, part, item, -f, r) for r, (f, _, item) in enumerate(found, 1)]
    return sorted(out)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("options", [{}, {"block_terms": 3}, {"cells": 8, "top": 2}, {"top": 1, "min_docs": 1}])
def test_audit_by_brute_force(spark, options):
    rng = random.Random(4)
    words = ["Alpha", "beta", "été", "ÉTÉ", "日本", "x", "don't", "a-b", "\x85", "q\x7fr", "ſ", "𝔸"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "z", None]), " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for _ in range(120)]
    rows += [("de", "only", None), ("xx", "a", ""), ("xx", "b", "once"), ("xx", None, "12 34"), ("en", "s1", "beta " * 20000)] + rows[:5]
    docs = spark.createDataFrame([(i, t, lang, s, "i", "d", "t", 1, 2, 3, "it", 4) for i, (lang, s, t) in enumerate(rows)], SCHEMA)
    got = divergence.audit(docs.repartition(5), **options)
    want = brute_audit(rows, options.get("top", 200), options.get("min_docs", 3))
    assert rows_of(got, *AUDIT) == want and divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact():
    rng = random.Random(5)
    counts = np.array([[rng.randrange(10**k) for k in range(1, 16)]])
    for total in (int(counts.sum()), 9 * 10**15):
        got = divergence.shares(counts, np.array([[total]]), 7, 1, 10**9)
        assert got.tolist() == [[1 + 10**9 * (c + 1) // (total + 7) for c in counts[0].tolist()]]


POOL = [chr(c) for c in range(0x250)] + list("‐—’“”…€日本語😀ΑΣσς́ẞ 　ﬁÅ한") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "  ", "the", "ing"]


def test_bpe_equals_library(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + ["".join(rng.choice("abcdeinrst '-") for _ in range(300)) for _ in range(200)]
    texts += [None, "", " \n", "x" * 3000, "ab" * 40000, "the one " * 20000, "the", "the"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "l", "s", "i", "d", "t", 1, 2, 3, "it", 4) for i, t in enumerate(texts)], SCHEMA)
    library = Tokenizer.from_file(WORD)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    back = [library.decode(x, skip_special_tokens=False) for x in ids]
    got = bpe.encode(docs, WORD)
    key = lambda r: (r[0] is None, r[0] or 0)
    by = [(None if i == 3 else i) for i in range(len(texts))]
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=key) == sorted(zip(by, ids), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decode(got, WORD).collect()), key=key) == sorted(zip(by, back), key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(b)) for i, x, b in zip(by, ids, back)]
    assert sorted((tuple(r) for r in bpe.digests(docs, WORD).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(docs.where("false"), WORD).count() == bpe.encode(docs.where("false"), WORD).count() == 0


def test_bpe_query(spark, sf):
    library = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_bpe"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in texts.items()}


def test_bpe_with_small_memory():
    """Merging is the same whether pre-tokens are remembered or not, and stale heap entries are skipped."""
    with open(WORD, encoding="utf-8") as f:
        spec = f.read()
    one, none = bpe.WordBpe(spec), bpe.WordBpe(spec, most=0)
    for text in ("banana bananas aaaa aaaaaaa", "mississippi", ""):
        assert one.ids_and_decoded(text) == none.ids_and_decoded(text) and one.encode(text) == none.encode(text)
    assert not none.known and one.known


def test_lm_words_below_the_share_have_cells(spark, monkeypatch):
    """With one table a word nothing is random: scores are the same whichever words are numbered, all, some or none, and are those
    of the formulas, for pairs met once and more often."""
    from engram.llm import lm

    monkeypatch.setattr(lm, "seat", lambda c, *_: np.minimum(np.asarray(c, float), 1.0))
    texts = ["a b c a b c", "B A d", "c\ta e f e f", "e f a b"]
    probes = ["a b c", "e f e f", "d d a", "q a q q", "", None]
    d = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(probes))], "doc_id long, text string")
    n = Counter(w for t in texts for w in lm.tokens(t.encode()))
    pairs = Counter(x for t in texts for x in zip([lm.END, *lm.tokens(t.encode())], lm.tokens(t.encode())))
    share = lambda c: lm._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    v, d0, d1 = len(n), share(n), share(pairs)
    after, before = Counter(u for u, _ in pairs), Counter(w for _, w in pairs)  # customers of the parent: one table a cell
    total = sum(before.values())
    base = (1 + d0 * v) / (1 + total) / (v + 1)
    parent = lambda w: (before[w] - d0) / (1 + total) + base if w in n else base
    chance = lambda u, w: (pairs[u, w] - d1 * ((u, w) in pairs) + (1 + d1 * after[u]) * parent(w)) / (1 + n[u])
    want = {}
    for i, t in [*enumerate(texts), *((100 + i, t or "") for i, t in enumerate(probes))]:
        ws = lm.tokens(t.encode())
        want[i] = sum(np.log10(chance(u, w)) for u, w in zip([lm.END, *ws], ws))
    for head_share in (2.0**-19, 0.15, 0.2, 1.0):
        got = {r["doc_id"]: r["score"] for r in lm.hpy_scores(d, F.col("doc_id") >= 100, head_share=head_share).collect()}
        assert got == pytest.approx(want, abs=1e-5), head_share


def test_lm_blocks_of_cells(spark, monkeypatch):
    """Pairs go to the shuffle as some rows of blocks, not one each; tables that are read no more are removed; the number of blocks
    changes nothing but the draws."""
    import os

    from engram.llm import lm
    from engram.llm.common import shared_dir

    monkeypatch.setattr(lm, "seat", lambda c, *_: np.minimum(np.asarray(c, float), 1.0))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 500) for _ in range(60)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    shared = spark.sparkContext.broadcast(("blocks", sorted({w.encode() for t in texts[:5] for w in t.split()})))
    assert lm.count_pairs(d, shared, 4).count() <= 8
    where = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(where)) if os.path.isdir(where) else set()
    read = lambda **k: {r["doc_id"]: r["score"] for r in lm.hpy_scores(d, F.col("doc_id") >= 50, head_share=5e-3, **k).collect()}
    few = read()
    left = {x.split("-")[1] for x in set(os.listdir(where)) - before if x.startswith("lm-")}
    assert left == {"table"}
    assert read(block_tokens=10) == pytest.approx(few, abs=1e-5)


def test_new_segments_are_filtered_in_parts():
    """What filtering takes beside its results is bounded, and the parts change no edge."""
    import tracemalloc

    from engram.llm import pieces

    v = pieces.Vocabulary(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), 0.6, 10.0)
    rng = random.Random(3)
    words = list(dict.fromkeys(" " + "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 14))) for _ in range(30_000)))
    one, parts = pieces.Edges(1 << 20), pieces.Edges(1 << 20)
    tracemalloc.start()
    parts.add(words, v)
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most - left < 30e6
    one._filter(words, v)
    assert np.array_equal(one.ends, parts.ends) and one.number == parts.number and one.n == parts.n
    assert np.allclose(one.keys[: one.n], parts.keys[: one.n], atol=1e-9, rtol=0) and np.array_equal(one.piece[: one.n], parts.piece[: one.n])


def test_tables_of_an_operator_before_are_dropped(monkeypatch):
    from engram.llm import common

    monkeypatch.setattr(common, "_KEPT", {})
    assert common.kept("a", lambda: 1) == 1 and common.kept("a", lambda: 2) == 1
    assert common.kept("b", lambda: len(common._KEPT)) == 0  # what was kept is gone before the new tables are made
    common.release()
    assert not common._KEPT


def test_toxicity_passes_texts_and_tables_once(spark, monkeypatch):
    from engram.llm import toxicity

    rows = [(i, "vile trash scum" if i % 2 else "calm river stone") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    assert model.shared(spark)[1] is model.shared(spark)[1]
    seen, gaps = [], toxicity._gaps
    monkeypatch.setattr(toxicity, "_gaps", lambda d, *rest: seen.append(d.columns) or gaps(d, *rest))
    staying = toxicity.drop_toxic(docs, model)
    assert seen == [["c0", "c1"]]
    binary = toxicity.drop_toxic(docs.withColumn("text", F.col("text").cast("binary")), model)
    assert rows_of(staying, "doc_id") == rows_of(binary, "doc_id") == [(i,) for i in range(0, 80, 2)]
