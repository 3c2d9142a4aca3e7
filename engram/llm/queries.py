"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from engram.llm import bpe, divergence, exact_dedup, langid, lm, mixing, neardup, prefix_trie, quality, toxicity, token_binary, token_count
from engram.llm import pieces as pieces_
from engram.llm.common import folded, materialise, shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = folded(docs, 3, 1)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=~held)
    out = toxicity.score(docs, model)
    return out.select("doc_id", folded(out, 3, 1).alias("held_out"), "score", "predicted", "gap")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lm.hpy_scores(docs, folded(docs, 7, 2))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profiles = langid.fit(docs, use=~folded(docs, 3, 1))
    out = langid.predict(docs, profiles)
    return out.select("doc_id", folded(out, 3, 1).alias("held_out"), "lang_pred", "score", "cosine")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(_documents(spark, sf_dir), words=3, threshold=0.85)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-blocks")
    token_binary.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_binary.read_tokens(spark, path)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(prefix_trie.turns_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return prefix_trie.prefix_trie(prefix_trie.rebuild(turns)).drop("digest")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_lm_scoring, op4_quality, op5_language_id, op6_near_dedup, op7_sentencepiece, op8_token_counts, op9_token_binary, op10_mixing, op11_prefix_trie, op12_divergence, op13_bpe)}

ORACLE = {"op1_exact_dedup": exact_dedup.ORACLE, "op4_quality": quality.ORACLE, "op6_near_dedup": neardup.ORACLE, "op10_mixing": mixing.oracle(), "op11_prefix_trie": prefix_trie.ORACLE, "op12_divergence": divergence.ORACLE}
