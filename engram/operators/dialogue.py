"""Relations that dialogue tells: who speaks to whom, and how they are addressed.

A text is read once, from quotation mark to quotation mark. Each opens a speech, with a speaker before it, perhaps an
addressee named between `to` word and mark, and the speaker of the last speech as the one who is answered otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicons as L
from engram.operators.lexicon import small, with_places

#: In bytes: how far a name may end before a mark, the window it has to lie in, where a poem is announced, a speech's most.
NEAR, WINDOW, POEM, SPEECH = 6, 50, 20, 300


def _floor(text: bytes, at: int) -> int:
    """The start of the character that the byte at this place belongs to."""
    at = max(0, min(at, len(text)))
    while at < len(text) and at and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _all(text: bytes, word: bytes) -> list[int]:
    """Places of a word that don't overlap."""
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + len(word))
    return out


def said(text: bytes, names: Sequence[tuple[int, int, str]], marks: Sequence[bytes], to_words: Sequence[bytes], poems: Sequence[bytes], rules: Sequence[tuple[Sequence[bytes], str]]) -> list[tuple[str, str, str]]:
    """(speaker, addressee, relation), each once, in order. names are all places of names: start, end, canonical name.

    The speaker is the name that ends last within NEAR bytes before the last `to` word of a kind, or before the mark where
    no kind gives one; of names with one end the longest. A kind that is there but gives no name ends the search if it is
    the last kind. The addressee is the longest name between a `to` word and the mark, the last of several, else the
    speaker before. A speech goes to the next mark, or SPEECH bytes; the first rule with a word in it decides.
    """
    at_marks = sorted((p, len(m)) for m in marks for p in _all(text, m))
    starts = [p for p, _ in at_marks]

    def near(ref: int) -> str | None:
        low = _floor(text, ref - WINDOW)
        found = [(e, e - s, name) for s, e, name in names if low <= s and e <= ref and ref - e <= NEAR]
        return max(found, key=lambda m: m[:2])[2] if found else None

    def speaker(pos: int) -> str | None:
        for i, w in enumerate(to_words):
            if (at := text.rfind(w, 0, pos)) >= 0:
                name = near(at)
                if name is not None or i == len(to_words) - 1:
                    return name
        return near(pos)

    def addressee(pos: int) -> str | None:
        for w in to_words:
            if (at := text.rfind(w, 0, pos)) >= 0:
                found = [(e - s, e, name) for s, e, name in names if at + len(w) <= s and e <= pos]
                if found:
                    return max(found, key=lambda m: m[:2])[2]
        return None

    out, last = set(), None
    for i, (pos, n) in enumerate(at_marks):
        before = text[_floor(text, pos - POEM) : pos]
        who = None if any(p in before for p in poems) else speaker(pos)
        if who is None:
            continue
        start = pos + n
        end = next((p for p in starts[i + 1 :] if p >= start), _floor(text, start + SPEECH))
        speech = text[start:end]
        relation = next((r for words, r in rules if any(w in speech for w in words)), None) if speech else None
        if relation is not None:
            to = addressee(pos) or last
            if to is not None and to != who:
                out.add((who, to, relation))
        last = who
    return sorted(out)


def dialogue_relations(texts: DataFrame, names: DataFrame, marks: Sequence[str] = L.DIALOG_MARKERS, to_words: Sequence[str] = L.DIALOG_TO_WORDS, poems: Sequence[str] = L.POEM_WORDS, rules: Sequence[tuple[Sequence[str], str]] = L.DIALOG_ADDRESS) -> DataFrame:
    """(doc_id, pos, speaker, addressee, relation), each once for a text of texts (doc_id, pos, text). names: alias, canonical.

    Null texts and texts without a mark give nothing; repeated rows repeat their relations. One narrow pass after that of
    the names' automaton: see operators.lexicon.
    """
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    rows = with_places(texts.where(marked).select("doc_id", "pos", "text"), names.select(F.col("alias").alias("form"), "canonical"), "text", "all")
    b = lambda words: [w.encode() for w in words]
    lists = b(marks), b(to_words), b(poems), [(b(words), r) for words, r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            each = [said(t.encode(), [(m["start"], m["end"], m["canonical"]) for m in found], *lists) for t, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist())]
            at = pa.array([i for i, rs in enumerate(each) for _ in rs], pa.int64())
            flat = [r for rs in each for r in rs]
            yield pa.record_batch([batch["doc_id"].take(at), batch["pos"].take(at), *(pa.array([r[k] for r in flat], pa.string()) for k in range(3))], ["doc_id", "pos", "speaker", "addressee", "relation"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select("doc_id", "pos").schema)
    return rows.select("doc_id", "pos", "text", "found").mapInArrow(run, f"{kinds}, speaker string, addressee string, relation string")


def overridden(generic: DataFrame, spoken: DataFrame) -> DataFrame:
    """Relations (doc_id, a, b, relation, source) of unordered pairs: what dialogue tells of a pair, its least relation, comes
    before what keywords tell."""
    a, b = F.least("speaker", "addressee").alias("a"), F.greatest("speaker", "addressee").alias("b")
    told = spoken.select("doc_id", a, b, "relation").groupBy("doc_id", "a", "b").agg(F.min("relation").alias("told"))
    j = generic.join(told, ["doc_id", "a", "b"], "full")
    return j.select("doc_id", "a", "b", F.coalesce("told", "relation").alias("relation"), F.when(F.col("told").isNotNull(), "dialogue").otherwise("keyword").alias("source"))
