"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

#: Words are maximal runs of anything but ASCII white space.
SPACES = r"[ \t-\r]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a whole text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A higher-order function re-evaluates an outer expression for every element;
    binding it as a lambda variable does not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back."""
    return cut_lineage(df, f"llm-{name}")


_SAFE = re.compile(r" (?=\s|\Z)")


def space_chunks(text: str) -> list[str] | None:
    """Cut before every single space, or None where such a cut could change the
    pre-tokens (a space followed by white space or by the end).

    The pre-token pattern lets a space join the run that follows it, and splits
    a white-space run just before its last character. So when a space is
    followed by a non-space character, a pre-token boundary lies before it, and
    the matches of the whole text are the matches of the pieces in turn."""
    if _SAFE.search(text):
        return None
    return text.split(" ")
