"""Text as Column expressions. All stay in the JVM; names follow what they compute."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.lexicons import FILE_ENDINGS, STOP_WORDS


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Does the text hold any of the words; false for no words or a null text."""
    found = text.contains(words[0]) if len(words) == 1 else text.rlike("|".join(map(_literal, words))) if words else F.lit(False)
    return F.coalesce(found, F.lit(False))


def _literal(word: str) -> str:
    """The word as a Java pattern."""
    return "\\Q" + word + "\\E"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it, and that doesn't grow the generated code."""
    return F.transform(F.array(value), f)[0]


def how_many_of(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text holds."""
    return let(text, lambda t: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.coalesce(F.contains(t, w), F.lit(False)))))


def starts_with_any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.startswith(w) for w in words], F.lit(False)), F.lit(False))


def tokenize(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits, without one-byte ones and stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(runs, lambda t: (F.octet_length(t) > 1) & ~t.isin(list(stop_words)))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bm25(document: Column, query: Sequence[str], k1: float = 1.2) -> Column:
    """Mean over the query's terms of tf / (tf + k1); 0 for an empty query. document is an array of tokens."""
    if not query:
        return F.lit(0.0)
    terms = []
    for t in query:
        tf = (F.size(document) - F.size(F.array_remove(document, t))).cast("double")
        terms.append(tf / (tf + F.lit(k1)))
    return reduce(lambda a, b: a + b, terms) / F.lit(float(len(query)))


def bigrams(text: Column) -> Column:
    """Adjacent character pairs in order, with repeats; empty below two characters."""
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_set(text: Column) -> Column:
    return F.array_distinct(bigrams(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 where a bigram set is empty or half the other's size at most, else shared over the smaller set."""
    x, y = bigram_set(a), bigram_set(b)
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return F.when(a == b, 1.0).when(small == 0, 0.0).when(small / large < 0.5, 0.0).otherwise(F.size(F.array_intersect(x, y)) / small)


def shared_bigrams(a: Column, b: Column) -> Column:
    """How many of b's bigrams, with repeats, are in a's set."""
    own = bigram_set(a)
    return F.size(F.filter(bigrams(b), lambda g: F.array_contains(own, g)))


def sentences(text: Column) -> Column:
    """Sentences with their terminators, trimmed, empty ones dropped."""
    runs = F.regexp_extract_all(text, F.lit("([^。！？；.!?;\n]+[。！？；.!?;\n]?)"), F.lit(1))
    return F.filter(F.transform(runs, lambda s: F.regexp_replace(s, r"^[\s]+|[\s]+$", "")), lambda s: s != "")


def chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of `size` characters, a new one every size - overlap while characters are left."""
    n, step = F.length(text), size - overlap
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def whole_word(text: Column, word: str) -> Column:
    """Does the word occur with no letter or digit next to it."""
    import re

    return text.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])")


def half_width(text: Column) -> Column:
    """Full-width ASCII as ASCII, white space removed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.translate(text, wide, plain), r"[\s　]+", "")


def file_names(text: Column, endings: Sequence[str] = FILE_ENDINGS) -> Column:
    """Different file names in the text, in order: words of at least four clean characters with a known ending."""
    words = F.transform(F.split(text, r"[\s，。、？?）(),;]+"), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9._/\-]", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & starts_with_any(F.reverse(w), [e[::-1] for e in endings])))


def truncate_bytes(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """The text if it has at most `limit` UTF-8 bytes, else its longest prefix of whole characters within them and an ellipsis."""
    head = F.substring(text, 1, limit)
    n = F.octet_length(head)
    ascii_only = n == F.length(head)
    cut = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(min(limit, 4 * limit))), lambda i: F.substring(text, F.lit(1), F.lit(limit) - i)), lambda p: F.octet_length(p) <= limit), 1)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.when(ascii_only, head).otherwise(cut), F.lit(ellipsis)))


def chapter_number(text: Column) -> Column:
    """The number of a header 第N回 or 第N章 at the start of the text, in digits or Chinese numerals up to the thousands; else null."""
    numeral = F.nullif(F.regexp_extract(text, r"^\s*第([0-9零〇一二两三四五六七八九十百千]+)[回章]", 1), F.lit(""))
    return F.when(numeral.rlike("^[0-9]+$"), numeral.cast("int")).otherwise(chinese_number(numeral))


def chinese_number(numeral: Column) -> Column:
    """Value of a Chinese numeral of 千百十 and units; a unit without a digit counts 1; null for anything else."""
    digits = F.translate(numeral, "零〇一二两三四五六七八九", "001223456789")

    def part(unit: str) -> Column:
        d = F.regexp_extract(digits, f"([0-9]?){unit}", 1)
        return F.when(digits.contains(unit), F.when(d == "", 1).otherwise(d.cast("int"))).otherwise(0)

    last = F.regexp_extract(digits, "([1-9])$", 1)
    ones = F.when(last != "", last.cast("int")).otherwise(0)
    return F.when(digits.rlike("^(?:[0-9]?千)?0?(?:[0-9]?百)?0?(?:[0-9]?十)?[0-9]?$") & (digits != ""), part("千") * 1000 + part("百") * 100 + part("十") * 10 + ones)


def year(text: Column) -> Column:
    """The first run of exactly four digits from 1700 to 2100; null if there is none."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(F.filter(runs, lambda r: F.length(r) == 4), lambda r: r.cast("int")), lambda y: y.between(1700, 2100)), F.lit(1))
