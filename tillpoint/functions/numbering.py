"""Gapless numbers for all rows of a table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def numbered_from(rows: DataFrame, order: list[Column], start: int, out: str) -> DataFrame:
    """``rows`` with the numbers ``start``, ``start`` + 1, ... in ``order``.

    Rows are dealt out by ranges of ``order`` and written once (ranges are sampled and must not change between two
    readers). Each range numbers its own rows; what came before it is a sum over one row a range."""
    by = [f"_by{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(by, order))).repartitionByRange(*[F.col(b).asc_nulls_first() for b in by])
    dealt = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()), "numbered")
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    # one row a range: as many as shuffle partitions
    offsets = ranges.withColumn("_one", F.lit(1)).withColumn("_before", F.coalesce(F.sum("_rows").over(
        Window.partitionBy("_one").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    within = Window.partitionBy("_range").orderBy(*[F.col(b).asc_nulls_first() for b in by])
    return (dealt.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.row_number().over(within) - 1 + F.lit(start).cast("long"))
            .drop("_range", "_before", *by))
