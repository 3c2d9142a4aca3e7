"""The operators of engram.llm on small documents: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import numbers
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from engram.llm import exact_dedup, langid, lm, mixing, neardup, quality, token_binary, token_count, toxicity
from engram.llm import pieces as pieces_
from engram.llm.queries import ORACLE, QUERIES

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, h string, norm string, key string, word string, n long, id long, gap double, topic string"
LONG = "the long one " * 20000
#: nulls in any column, empty and blank texts, a very long text, ties, repeated rows, no-letter and odd characters
TEXTS = [(0, None), (1, ""), (2, " \n\t "), (3, "a b c d"), (4, "abcd"), (5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (6, LONG), (7, LONG + "x"), (8, "Ünïcödé ▁ 日本 <|endoftext|> 😀\x1c"), (9, "12 34 $$ 56"), (-3, "one two"), (2**62, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, 0.5, "x", "y", "z", "k", "w", 1, 2, 0.1, "t") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE[name]).df()
    c = sorted(want.columns)
    say = lambda x: "" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, numbers.Number) else str(x)
    plain = lambda df: sorted(tuple(map(say, r)) for r in df[c].itertuples(index=False))
    assert sorted(got.columns) == c and plain(got) == plain(want)


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for i, t in TEXTS:
        by.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        norm = next(k for k in by if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = min(by[norm])
        assert (r["keep_id"], r["group_size"]) == (best[3], len(by[norm]))
    assert {r["doc_id"] for r in got if r["kept"]} == {2, 3, 6, 7, 8, 9, -3}
    assert exact_dedup.exact_groups(none).count() == 0


def test_one_rule_for_kept_rows(spark):
    """drop_copies keeps one of the rows that exact_groups marks, whatever ids are null or repeated."""
    rows = [(None, "a b"), (None, "ab"), (1, "x y"), (1, "x y"), (1, "xy"), (None, "q  r"), (2, "qr"), (3, "s\x0b\x0ct"), (4, "s t"), (None, None), (5, "")]
    d = spark.createDataFrame([(i, t, n % 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    marked = [(r["doc_id"], r["group_size"]) for r in exact_dedup.exact_groups(d).where("kept").collect()]
    assert sorted(marked, key=str) == sorted([(None, 2), (1, 3), (1, 3), (None, 2), (3, 2), (5, 2)], key=str)
    for k in (1, 3):
        assert sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(d.repartition(k)).collect()), key=str) == sorted([(None, "a b"), (1, "x y"), (None, "q  r"), (3, "s\x0b\x0ct"), (5, "")], key=str)


def test_quality_sql_takes_all_white_space(spark):
    """The SQL's classes are those of the contract, vertical tabs, form feeds and returns included."""
    texts = ["one\x0btwo\x0cthree\rfour\tfive six\nseven", "a\x0ba\x0ba a a a", "\x0b\x0c\r\n\x0b\x0c\r\nx", "", None, "é\x0bé " * 60]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed FROM ({ORACLE['op4_quality']})").fetchall()}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.quality(d).collect()}
    assert got == want and [got[i][:5] for i in range(len(texts))] == [brute_quality(t) for t in texts]


def test_drop_copies_keeps_columns(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [-3, 2, 3, 6, 7, 8, 9]
    assert exact_dedup.drop_copies(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(60)]
    bad = ["zokum", "zokuma", "vuxel"]
    rows, labels = [], []
    for i in range(400):
        ws = list(rng.choice(plain, 40))
        if i % 4 == 0:
            ws[5] = ws[20] = bad[i // 4 % 3]
        rows.append((i, " ".join(ws)))
        labels.append((i, 1 if i % 4 == 0 else 0))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab, use=F.col("doc_id") < 300)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).where("doc_id >= 300").collect()}
    assert all((got[i]["predicted"] == 1) == (i % 4 == 0) for i in got) and len(got) == 100
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and all(r["doc_id"] % 4 for r in kept.where("doc_id >= 300").collect())
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(docs, model).columns == docs.columns
    untrained = toxicity.fit(d, lab.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(d, untrained).collect()} == {0}


def brute_kneser_ney(counts):
    """A function (context, letter) to the interpolated Kneser-Ney probability, straight from the definition."""

    def at(n):  # counts of grams of n letters: as they are for the longest, else the number of letters met before them
        if n == toxicity.ORDER:
            return counts
        longer = at(n + 1)
        return Counter(g[1:] for g in longer)

    def p(h, c):
        n = len(h) + 1
        level = at(n)
        lower = p(h[1:], c) if n > 1 else 1 / (len(at(1)) + 1)
        ones, twos = (sum(x == k for x in level.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {g[-1]: x for g, x in level.items() if g[:-1] == h}
        if not own:
            return lower
        return (max(own.get(c, 0) - d, 0) + d * len(own) * lower) / sum(own.values())

    return p


def test_kneser_ney_by_brute_force():
    words_ = {"abc": (3, 0), "abd": (2, 1), "bcd": (0, 4), "ab": (1, 1), "dab": (0, 2)}
    toxic, plain = Counter(), Counter()
    for w, (t, o) in words_.items():
        for g in toxicity.grams(w):
            toxic[g] += t
            plain[g] += o
    both = toxic + plain
    p, letters = brute_kneser_ney(both), [*"abcd", "\x02", "\x03", "?"]
    shared = toxicity._pooled(dict(both))
    for g, x in shared.items():
        assert x == pytest.approx(p(g[:-1], g[-1]))
    for h in {g[:-1] for g in both}:
        assert sum(p(h, c) for c in letters if c in "?\x03abcd") == pytest.approx(1)
    table, contexts = toxicity.kneser_ney_gap([(g, toxic[g], plain[g]) for g in both], strength=10.0)
    gap = toxicity.Gap(table, contexts, margin=0.5)

    def side(own, w):  # log-likelihood of a word under one class, backing off to the shared model by 10 observations
        out = 0.0
        for g in toxicity.grams(w):
            rest = {x: n for x, n in own.items() if x[:-1] == g[:-1] and n}
            low = p(g[:-1], g[-1])
            out += np.log((max(own[g] - 0.75, 0) + (10 + 0.75 * len(rest)) * low) / (sum(rest.values()) + 10))
        return out

    for text in ("abc abd", "bcd zz abc", "dab ab abx", ""):
        ratios = [side(toxic, w) - side(plain, w) for w in text.split()]
        want = sum(np.sign(r) * max(abs(r) - 0.5, 0) for r in ratios) / (len(ratios) + toxicity.PRIOR_WORDS)
        assert gap.texts([text])[0] == pytest.approx(want)


def test_lm_counts_and_base(spark, corpus, docs, none):
    held = F.col("doc_id") % 7 == 2
    rows = corpus.collect()
    c = Counter(w for r in rows if r["doc_id"] % 7 != 2 for w in lm.tokens((r["text"] or "").encode()))
    n, v = sum(c.values()), len(c)
    better = total = 0
    for r in lm.hpy_scores(corpus, held).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        ws = lm.tokens((text or "").encode())
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        total, better = total + r["held_out"], better + (r["held_out"] and r["score"] > r["base_score"])
    assert better > 0.9 * total > 0
    out = lm.hpy_scores(docs, F.col("doc_id") == 3).collect()
    assert len(out) == len(TEXTS) and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in out)
    assert lm.hpy_scores(none, F.lit(False)).count() == 0
    assert {r["score"] for r in lm.hpy_scores(docs, F.lit(True)).collect()} == {0.0}


def test_lm_rows_and_partitions(spark, corpus):
    """Scores don't depend on partitions or the order of rows, and repeated rows each have the score of one."""
    held = F.col("doc_id") % 7 == 2
    read = lambda d: {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.hpy_scores(d, held).collect()}
    assert read(corpus.repartition(3)) == read(corpus.repartition(7, "text"))
    twice = corpus.union(corpus.where("doc_id = 2"))  # held out, so the model is the same
    out = [r for r in lm.hpy_scores(twice, held).collect() if r["doc_id"] == 2]
    assert len(out) == 2 and out[0] == out[1] and (out[0]["n_tokens"], out[0]["n_known"]) == read(corpus)[2][:2]


def test_lm_orders_words(spark):
    """After a context, words met more often after it are likelier, and unknown words least."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "a b b", "c a b a"] * 20 + ["d e"])]
    probe = [(100 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "d", "e", "unknown", ""])]
    d = spark.createDataFrame(train + probe + [(200, "a")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lm.hpy_scores(d, F.col("doc_id") >= 100, head_share=1e-3, cell_share=1e-3).collect()}
    # score("a w") = log p(a) p(w|a) p(end|w); the sum over w of p(w|a) needs p(end|w), so compare chains by their own ends
    one = spark.createDataFrame(train + [(300, w) for w in []] + [(400 + i, w) for i, w in enumerate(["a", "b", "c", "d", "e", "unknown"])], "doc_id long, text string")
    alone = {r["doc_id"]: r["score"] for r in lm.hpy_scores(one, F.col("doc_id") >= 100, head_share=1e-3, cell_share=1e-3).collect()}
    assert all(x < 0 for x in [*s.values(), *alone.values()]) and s[101] > s[103] > s[105]


def test_lm_brute_force(spark, monkeypatch):
    """With one table a word and every pair met once nothing is random: scores of training, held-out and unknown words are
    those of the formulas, whether gains are in memory or joined, and probabilities after every context add up to 1."""
    monkeypatch.setattr(lm, "seat", lambda c, *_: np.minimum(np.asarray(c, float), 1.0))
    texts = ["a b c", "B A d", "c\ta"]
    probes = ["a b c", "a d", "c b", "d d a", "q a", "a q q", "", None]
    d = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(probes))], "doc_id long, text string")
    n = Counter(w for t in texts for w in lm.tokens(t.encode()))
    pairs = Counter(x for t in texts for x in zip([lm.END, *lm.tokens(t.encode())], lm.tokens(t.encode())))
    assert set(pairs.values()) == {1}
    total, v, d0, d1 = sum(n.values()), len(n), 1 / 5, 0.5  # one word met once, two met twice; no pair met twice
    base = (1 + d0 * v) / (1 + total) / (v + 1)
    parent = lambda w: (n[w] - d0) / (1 + total) + base if w in n else base
    after = Counter(u for u, _ in pairs)

    def chance(u, w):
        return ((1 - d1) * pairs[u, w] + (1 + d1 * after[u]) * parent(w)) / (1 + n[u])

    for u in [*n, b"q"]:
        assert sum(chance(u, w) for w in [*n, b"unknown"]) == pytest.approx(1)
    for r in lm.hpy_scores(d, F.col("doc_id") >= 100).collect():
        ws = lm.tokens(((texts[r["doc_id"]] if r["doc_id"] < 100 else probes[r["doc_id"] - 100]) or "").encode())
        assert r["score"] == pytest.approx(sum(np.log10(chance(u, w)) for u, w in zip([lm.END, *ws], ws)), abs=1e-5)


def test_lm_joined_gains(spark, corpus):
    """Gains joined from the table are those held in memory, and a held-out copy of a training text has its score."""
    held = F.col("doc_id") % 7 == 2
    read = lambda d, **k: {r["doc_id"]: r["score"] for r in lm.hpy_scores(d, held, **k).collect()}
    id_, text = corpus.where("doc_id % 7 = 3 and length(text) > 100").select("doc_id", "text").first()
    both = corpus.select("doc_id", "text").union(spark.createDataFrame([(7_000_002, text)], "doc_id long, text string"))
    memory, joined = read(both), read(both, cell_share=1.0)
    assert memory == pytest.approx(joined, abs=1e-2, rel=1e-5)
    assert joined[7_000_002] == pytest.approx(joined[id_], abs=1e-2)


def test_seating():
    rng = np.random.default_rng(0)
    t = lm.seat(np.array([0, 1, 2, 1000, 10**7]), 0.5, 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] <= 2 and 1 <= t[3] <= 1000 and 1 <= t[4] <= 10**7


def brute_quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(docs, none, corpus):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for d in (docs, corpus):
        texts = {}
        for r in d.collect():
            texts.setdefault(r["doc_id"], []).append(brute_quality(r["text"]))
        out = quality.quality(d).collect()
        assert len(out) == sum(map(len, texts.values()))
        for r in out:
            got = tuple(r[c] for c in names)
            assert got in texts[r["doc_id"]]
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert 0 <= r["class_js"] <= 1 and 0 <= r["word_js"] <= 1 and not (r["kept"] and r["base_failed"])
    assert quality.quality(none).count() == 0


def test_quality_of_far_texts(spark):
    """Symbols after most words, and texts without a common word, are dropped; ordinary texts of both languages stay."""
    rng = np.random.default_rng(6)
    common = {"en": ["the", "of", "and", "to"], "fr": ["le", "de", "et", "la"]}
    rows = []
    for i in range(600):
        lang = ["en", "fr"][i % 2]
        own = ["".join(rng.choice(list("aeinrstlo"), int(rng.integers(6, 9)))) for _ in range(150)]
        ws = [w if rng.random() > 0.25 else str(rng.choice(common[lang])) for w in own]
        if i % 20 == 4:
            ws = [x for w in ws for x in (w, "%%%" if rng.random() < 0.5 else "&&&")]
        rows.append((i, " ".join(own if i % 20 == 7 else ws), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.quality(d).collect()
    assert not any(r["base_failed"] for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == {i for i in range(600) if i % 20 in (4, 7)}


def test_js_distance(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(quality.js_distance(a(1.0, 0.0), a(0.0, 1.0)).alias("x"), quality.js_distance(a(0.5, 0.5), a(0.5, 0.5)).alias("y")).first()
    assert tuple(r) == (1.0, 0.0)


def test_language(corpus, docs, none):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    p = langid.fit(corpus, use=~held)
    got = langid.predict(corpus, p).join(corpus, "doc_id").where(held)
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
    out = {(r["doc_id"]): r["lang_pred"] for r in langid.predict(docs, p).collect()}
    assert {out[i] for i in (0, 1, 2, 9)} == {"und"} and out[3] in p.langs
    assert langid.predict(none, p).count() == 0 and {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(corpus, max_langs=1)


def test_language_by_brute_force(spark):
    """Every vector from the definition: three permuted letter vectors bound by a product, trigrams added up."""
    rows = [(0, "the cat sat", "en"), (1, "a cat, the dog!", "en"), (2, "le chat est là", "fr"), (3, "un chien et le chat", "fr"), (4, "der hund", None), (5, "12", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hd = langid.Space(512, 11)

    def vector(text):
        s = [0]
        for c in text.lower():
            x = int(hd.points[ord(c)])
            if x or s[-1]:
                s.append(x)
        s.append(0)
        letter = hd.letter.astype(float)
        return sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(s, s[1:], s[2:]))

    unit = lambda v: v / np.linalg.norm(v)
    langs = ["en", "fr"]
    protos = np.array([unit(sum(unit(vector(t)) for _, t, k in rows if k == lang and any(c.isalpha() for c in t))) for lang in langs])
    centre = protos.mean(0)
    protos = np.array([unit(x - centre) for x in protos])
    got = {r["doc_id"]: r for r in langid.predict(d, langid.fit(d)).collect()}
    for i, t, _ in rows[:5]:
        cos = protos @ unit(unit(vector(t)) - centre)
        assert got[i]["lang_pred"] == langs[int(cos.argmax())] and got[i]["cosine"] == pytest.approx(cos.max(), abs=1e-6)
        assert got[i]["score"] == pytest.approx(np.exp(8 * cos.max()) / np.exp(8 * cos).sum(), abs=1e-5)
    assert got[5]["lang_pred"] == "und"


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,t", [(3, 0.85), (5, 0.8)])
def test_near(corpus, docs, none, k, t):
    texts = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_components(corpus, k, t).collect()}
    assert got == brute_components(texts, k, round(100 * t))
    out = neardup.near_components(docs, k, t).collect()
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert len(out) == len(TEXTS) and (by[0], by[1], by[2], by[5], by[7], by[2**62], by[None]) == (0, 1, 2, 3, 7, -3, None)  # 7 has one shingle of four more than 6
    assert neardup.near_components(none, k, t).count() == 0


def test_near_group_of_many(spark):
    """A large group of near copies of one text, in a chain of small changes, is one component."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        if i % 20 == 0:
            base[rng.integers(300)] = f"v{i}"
        w = list(base)
        w[rng.integers(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_components(d, 3, 0.85).collect()} == {c for _, c in brute_components(rows, 3, 85).values()}
    assert neardup.drop_near_copies(d, 3, 0.85).columns == d.columns


@pytest.mark.parametrize("k,t", [(3, 0.85), (5, 0.8)])
def test_near_texts_just_below_the_threshold(spark, k, t):
    """Copies of one text with one to nine changed words: some reach others, many are alone by a little."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.permutation(150)[: int(rng.integers(1, 10))]:
            w[at] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_components(d, k, t).collect()}
    assert got == brute_components(rows, k, round(100 * t))
    assert len({c for _, c in got.values()}) > 10


def test_near_pairs_in_crowded_buckets(spark):
    """Unrelated documents with 90 % boilerplate crowd every bucket; all of the pairs hidden among them are found."""
    rng = np.random.default_rng(4)
    shared = [f"b{i}" for i in range(452)]
    rows = []
    for i in range(1000):
        rows.append((i, " ".join([*shared, *(f"u{i}x{j}" for j in range(50))])))
    for i in range(100):
        own = [f"u{i}x{j}" for j in range(50)]
        rows.append((1000 + i, " ".join([*shared, *own[:14], *(f"v{i}x{j}" for j in range(36))])))
    rows = [(int(k), t) for k, (_, t) in zip(rng.permutation(len(rows)), rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(d, 3, 0.85).collect()}
    twin = {i: min(rows[i][0], rows[1000 + i][0]) for i in range(100)}
    want = {rows[k][0]: twin.get(k if k < 1000 else k - 1000, rows[k][0]) for k in range(len(rows))}
    assert got == want


def test_pieces(docs, none, corpus):
    for d in (docs, corpus):
        enc = pieces_.sample_pieces(d, PIECES)
        back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in pieces_.decode_pieces(enc, PIECES).collect())
        assert back == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in d.collect())
        assert all(r["lossless"] for r in pieces_.digests(d, PIECES).collect())
    a = {r["doc_id"]: r["ids"] for r in pieces_.sample_pieces(corpus.repartition(3), PIECES).collect()}
    b = {r["doc_id"]: r["ids"] for r in pieces_.sample_pieces(corpus.repartition(5), PIECES).collect()}
    c = {r["doc_id"]: r["ids"] for r in pieces_.sample_pieces(corpus, PIECES, seed=18).collect()}
    assert a == b != c and pieces_.sample_pieces(none, PIECES).count() == 0


def test_sampling_follows_the_lattice():
    with open(PIECES, "rb") as f:
        s = pieces_.Sampler(f.read(), 0.6, 10.0, 3)
    word, n = " there", 20000
    w = s.v.weight
    paths = {}

    def walk(i, ids, p):
        if i == len(word):
            paths[tuple(ids)] = p
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in w:
                walk(j, [*ids, w[word[i:j]][0]], p * w[word[i:j]][1])

    walk(0, [], 1.0)
    total = sum(paths.values())
    seen = Counter(tuple(x.tolist()) for x in s.lattices.sample([(i, [word]) for i in range(n)], 3))
    assert set(seen) <= set(paths)
    for ids, p in paths.items():
        assert abs(seen[ids] / n - p / total) < 5 * np.sqrt(p / total / n) + 1e-3


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, none, corpus):
    for d in (docs, corpus):
        rows = d.collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(ids)) for r, ids in zip(rows, library([r["text"] for r in rows])))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(d, BPE).collect()) == want
    assert token_count.count_tokens(none, BPE).count() == 0


def test_token_files(spark, docs, none, corpus, tmp_path):
    for name, d in (("odd", docs), ("corpus", corpus), ("none", none)):
        path = str(tmp_path / name)
        token_binary.write_tokens(d, path, BPE, block_ids=3000)
        got = token_binary.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
        rows = sorted(d.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        at = 0
        assert len(got) == len(rows)
        for r, x, ids in zip(rows, got, library([r["text"] for r in rows]) if rows else []):
            ids = [*ids, 2]
            assert (x["doc_id"], x["start"], x["n_tokens"], x["ids"]) == (r["doc_id"], at, len(ids), ids)
            assert x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)


def test_simple8b():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 300))
        ids = rng.integers(0, 2 ** int(rng.integers(1, 63)), n).astype(np.uint64)
        if n and rng.random() < 0.5:
            ids[rng.random(n) < 0.2] = np.uint64(2**64 - 1)
        w, e, offsets = token_binary.pack(ids)
        assert (token_binary.unpack(w, e, n) == ids).all() and len(offsets) == -(-len(w) // token_binary.STRIDE)


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (20 + i % 5), ["en", "fr"][i % 3 == 0], ["a", "b", "b", "b"][i % 4]) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}
    kept = mixing.mix(d, targets, rounds=12).where("selected")
    for m in ("source", "lang"):
        share = {r[m]: r["s"] for r in kept.groupBy(m).agg(F.sum("n_tokens").alias("s")).collect()}
        assert all(abs(x / sum(share.values()) - 0.5) < 0.04 for x in share.values())
    out = mixing.mix(docs).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["prob"] <= 1 for r in out)
    assert mixing.mix(none).count() == 0 and mixing.sample(docs).columns == docs.columns and mixing.sample(none).count() == 0


def test_pipeline(spark, sf):
    """The stages against their own decisions made one by one in plain Python."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain_ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    now = docs
    for name, stage in P.STAGES:
        before, now = now, stage(spark, now, sf)
        now = spark.createDataFrame(now.collect(), now.schema)
        if name != "pieces":
            assert now.columns == docs.columns
            old, new = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in now.collect()}
            assert new.items() <= old.items()
        if name == "toxicity":
            assert len(plain_ids & set(new)) >= 0.98 * len(plain_ids & set(old))
        if name == "exact dedup":
            norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
            assert sorted(map(norm, new.values())) == sorted(set(map(norm, old.values())))
        if name == "near dedup":
            assert set(new) == {c for _, c in brute_components(old.items(), 5, 80).values()}
        if name == "mixing":
            chance = {r["doc_id"]: r["prob"] for r in mixing.mix(before).collect()}
            draw = {i: int(hashlib.md5(f"{i}/3".encode()).hexdigest()[:8], 16) / 2**32 for i in old}
            assert set(new) == {i for i in old if draw[i] < chance[i]}
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(new)
    assert all(r["lossless"] for r in now.collect()) and sorted(r["doc_id"] for r in now.collect()) == sorted(r["doc_id"] for r in P.run(spark, sf).collect())


def test_pipeline_stages_of_odd_tables(spark, docs, none, sf):
    """Nulls, empty and long texts, repeated rows, clashing names and no rows at all, through every stage."""
    import corpus_pipeline as P

    for d in (docs, none):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == d.columns
            ids = [r["doc_id"] for r in out.collect()]
            assert set(ids) <= {i for i, _ in TEXTS} and (len(ids) == len(TEXTS) if name == "toxicity" and d is docs else True)
        assert P.STAGES[-1][1](spark, d, sf).count() == d.count()
