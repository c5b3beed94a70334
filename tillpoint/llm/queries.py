"""Registered queries of the training-data operators and their DuckDB twins.

Each ``opN_<name>`` applies its operator, with production parameters, to its
whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (ann_collision, bpe_duckdb, bwt_dedup, langid_ecoc, license_scan, line_chunks, lm_hpy, minhash_circulant, oracles, packing_pow2,
               periodic_runs, prefix_trie, quality_divergence, toxicity_mil)
from .common import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_distribution_divergence", oracles.QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.judge(table(spark, sf_dir, "documents"))


@register("op2_ann_collision")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_collision.search(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


@register("op3_toxicity_mil")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_minhash_circulant")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_circulant.link(table(spark, sf_dir, "documents"), percent=85).drop("text_md5")


@register("op5_langid_ecoc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ecoc.classify(table(spark, sf_dir, "documents"))


@register("op6_packing_pow2")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing_pow2.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing_pow2.digest(packed)


@register("op7_hpy_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_hpy.score(table(spark, sf_dir, "documents"))


@register("op8_bpe_duckdb")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe_duckdb.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@register("op10_line_chunks", oracles.LINES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.digest(table(spark, sf_dir, "documents"))


@register("op9_bwt_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(table(spark, sf_dir, "documents"))


@register("op11_prefix_trie", oracles.TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(table(spark, sf_dir, "documents"), reword=periodic_runs.looped))


@register("op13_license_scan", oracles.LICENSES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.classify(table(spark, sf_dir, "documents"))
