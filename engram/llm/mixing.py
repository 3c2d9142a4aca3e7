"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed by cell (source, language, topic). Cell weights are raked to the target share of every source, then
language, then topic, again and again; a cell's ratio of raked to own share over the largest ratio is the chance of
each of its documents to stay, so the sample has the target shares in expectation. Only SQL functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import WORD, materialise

MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's surface: its length, by powers of four of its code points, digits and symbols apart."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    marks = F.regexp_count(text, F.lit(r"[0-9#*$%&|<>{}=]"))
    return F.when(n == 0, "empty").when(marks * 50 > n, "marked").when(n < 1024, "short").when(n < 4096, "middle").otherwise("long")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def _with(rows: DataFrame, total: Column, name: str) -> DataFrame:
    """rows with one figure of all of them: each task adds up its own, and the one row that results is broadcast."""
    return rows.join(F.broadcast(rows.agg(total.alias(name))))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.9, rounds: int = 8) -> DataFrame:
    """Cells with columns tokens, weight (raked share) and ratio (raked over own share).

    targets has a share for each value of a margin; values that it leaves out share what is left by their tokens.
    Without targets for a margin, shares are its token shares to the given power, made to add up to 1.
    Cells without tokens have weight 0 and ratio 1. There are as many cells as different (source, language, topic).
    """
    w = _with(cells, F.sum("tokens"), "total")
    w = w.withColumn("weight", F.coalesce(F.try_divide(F.col("tokens"), F.col("total")), F.lit(0.0))).withColumn("own", F.col("weight")).drop("total")
    for m in MARGINS:
        margin = cells.groupBy(m).agg(F.sum("tokens").alias("t")).where("t > 0")
        margin = _with(margin.withColumn("raised", F.pow(F.col("t"), F.lit(power))), F.sum("raised"), "all")
        goal = F.col("raised") / F.col("all")
        if targets and m in targets:
            given = targets[m]
            fixed = F.coalesce(*[F.when(F.col(m).eqNullSafe(F.lit(k)), F.lit(float(x))) for k, x in given.items()]) if given else F.lit(None).cast("double")
            rest = max(0.0, 1.0 - sum(given.values()))
            margin = margin.withColumn("fixed", fixed).withColumn("free", F.when(F.col("fixed").isNull(), F.col("t")))
            margin = _with(margin, F.sum("free"), "all_free")
            goal = F.coalesce("fixed", F.lit(rest) * F.col("free") / F.col("all_free"))
        margin = margin.withColumn(f"goal_{m}", goal).select(F.col(m).alias(f"{m}_"), f"goal_{m}")
        w = w.join(margin, w[m].eqNullSafe(margin[f"{m}_"]), "left").drop(f"{m}_")
    w = materialise(w, "mix-cells")
    for k in range(rounds):
        for m in MARGINS:
            sum_ = F.sum("weight").over(Window.partitionBy(m))
            w = w.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"goal_{m}"), sum_), F.lit(0.0)))
        if k % 4 == 3:
            w = materialise(w, "mix-cells")
    return w.select(*MARGINS, "tokens", "weight", F.coalesce(F.try_divide(F.col("weight"), F.col("own")), F.lit(1.0)).alias("ratio"))


def chance(cells: DataFrame) -> DataFrame:
    """Cells with the chance of their documents to stay; cells without tokens keep all of theirs."""
    cells = _with(cells, F.max(F.when(F.col("tokens") > 0, F.col("ratio"))), "largest")
    return cells.withColumn("prob", F.when(F.col("tokens") > 0, F.col("ratio") / F.col("largest")).otherwise(1.0)).drop("largest")


def _keyed(docs: DataFrame, topic: Column, source: str, lang: str, text: str) -> dict[str, Column]:
    return {
        "source": docs[source].cast("string"),
        "lang": docs[lang].cast("string"),
        "topic": topic,
        "n_tokens": F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long"),
    }


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed, the same in every run: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.9, rounds: int = 8, seed: int = 3, topic: Column | None = None, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, prob, selected.

    Null sources, languages and topics are values of their own. Documents without tokens are in cells by their values
    and count nothing. A row is selected by a hash of its id: rows that repeat an id fall together if in one cell. An empty
    table gives no rows. The sums of cells combine before the shuffle; documents meet their cell's chance in a join
    that Spark broadcasts while the cells are few.
    """
    topic = topic_of(docs[text]) if topic is None else topic
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), *[c.alias(k) for k, c in _keyed(docs, topic, source, lang, text).items()])
    cells = chance(rake(_cells(rows), targets, power, rounds)).select(*[F.col(m).alias(f"{m}_") for m in MARGINS], "prob")
    met = F.lit(True)
    for m in MARGINS:
        met = met & rows[m].eqNullSafe(cells[f"{m}_"])
    out = rows.join(cells, met).select("doc_id", *MARGINS, "n_tokens", F.round("prob", 9).alias("prob"))
    return out.withColumn("selected", uniform(F.col("doc_id"), seed) < F.col("prob"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.9, rounds: int = 8, seed: int = 3, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """The selected rows of docs, with all their columns, whatever they are called.

    Null sources, languages and topics are values of their own; empty texts count nothing, and stay where a cell has no
    tokens; rows that repeat an id fall together if in one cell; an empty table gives no rows.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[doc_id].alias("__id"), *[c.alias(f"__{k}") for k, c in _keyed(docs, topic_of(docs[text]), source, lang, text).items()])
    cells = chance(rake(_cells(keyed.select(*[F.col(f"__{k}").alias(k) for k in (*MARGINS, "n_tokens")])), targets, power, rounds))
    met = F.lit(True)
    for m in MARGINS:
        met = met & keyed[f"__{m}"].eqNullSafe(cells[m])
    return keyed.join(cells, met).where(uniform(F.col("__id"), seed) < F.round("prob", 9)).select("__row.*")


def oracle(power: float = 0.9, rounds: int = 8, seed: int = 3) -> str:
    """The query's rows as DuckDB SQL, rounds written out."""
    steps, last = [], "w0"
    for k in range(rounds):
        for m in MARGINS:
            name = f"w{k}_{m}"
            steps.append(f"{name} AS (SELECT * REPLACE (coalesce(weight * goal_{m} / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0) AS weight) FROM {last})")
            last = name
    margins = ", ".join(f"g_{m} AS (SELECT {m} AS k, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS goal_{m} FROM c GROUP BY {m} HAVING sum(tokens) > 0)" for m in MARGINS)
    joins = " ".join(f"LEFT JOIN g_{m} ON c.{m} IS NOT DISTINCT FROM g_{m}.k" for m in MARGINS)
    return rf"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>{{}}=]')) AS marks
  FROM documents
), r AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n = 0 THEN 'empty' WHEN marks * 50 > n THEN 'marked' WHEN n < 1024 THEN 'short' WHEN n < 4096 THEN 'middle' ELSE 'long' END AS topic FROM d
), c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM r GROUP BY source, lang, topic),
{margins},
w0 AS (SELECT c.*, {", ".join(f"goal_{m}" for m in MARGINS)}, tokens / sum(tokens) OVER () AS weight, tokens / sum(tokens) OVER () AS own FROM c {joins}),
{", ".join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / own / max(CASE WHEN tokens > 0 THEN weight / own END) OVER () ELSE 1 END AS prob FROM {last})
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(p.prob, 9) AS prob,
  CAST('0x' || substr(md5(CAST(r.doc_id AS VARCHAR) || '/{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < round(p.prob, 9) AS selected
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic IS NOT DISTINCT FROM p.topic
"""
