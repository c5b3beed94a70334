"""The corpus pipeline: toxicity, line dedup, near-duplicate dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; stages that
cut text also correct n_chars. A null n_chars or any other column passes as is.

* toxicity drops documents scored 0.5 or more; the model learns from the
  labelled rows among its input outside the held fold, as op3 does.
* line_dedup takes repeated multi-line chunks out of the text.
* near_dedup keeps one document, the least doc_id, of each group.
* substring_dedup cuts out bytes covered by repeated 200-byte strings.
* packing returns the power-of-two pieces.

The two cutting stages keep every document, with an empty text where nothing is
left of it. Empty tables pass through every stage. Null texts are kept until packing, which
gives them their end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillpoint.llm import bwt_dedup, line_chunks, minhash_circulant, packing_pow2, toxicity_mil
from tillpoint.llm.common import fold, materialise, table
from tillpoint.session import apply_defaults

TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity_mil.train(docs.filter(fold(F.col("doc_id"), 5) != 0), labels)
    return toxicity_mil.reject(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return _resized(line_chunks.dedup(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return minhash_circulant.dedup(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return _resized(bwt_dedup.dedup(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    import public_tokenizers
    packed = packing_pow2.pack(docs, public_tokenizers.path(TOKENIZER))
    return packing_pow2.digest(packed)


def _resized(got: DataFrame, docs: DataFrame) -> DataFrame:
    """The input's columns, n_chars following the text where both are there."""
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")) if "n_chars" in docs.columns else None
    return got.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

# Trained scores, MinHash and tokenization have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
