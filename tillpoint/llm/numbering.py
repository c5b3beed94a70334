"""Row numbers within a key, where one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise


def numbered(rows: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``_n``, the number (from 1) of each row within ``key`` by ``order``.

    Rows are dealt out by ranges of (key, order, row), so that a key with a third of all
    rows is spread over as many tasks as its share. Each range numbers its own rows; only
    a key that runs over several ranges needs the counts of its earlier ones, one row a
    range. The ranges are written once: they are sampled, and must not change between
    two readers or after a lost task. ``order`` should make equal only rows that are
    interchangeable."""
    cols = [c for c in rows.columns if not c.startswith("_by")]
    by = [f"_by{i}" for i in range(len(order))]
    dealt = rows.select(*cols, *[o.alias(b) for o, b in zip(order, by)], F.monotonically_increasing_id().alias("_row"))
    dealt = dealt.repartitionByRange(*[F.col(k) for k in key], *[F.col(b).asc_nulls_first() for b in by], F.col("_row"))
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()).drop("_row"), name)
    within = Window.partitionBy("_range", *key).orderBy(*[F.col(b).asc_nulls_first() for b in by])
    own = dealt.withColumn("_n", F.row_number().over(within).cast("long"))
    # every key's rows of a range in one row: as many rows as keys, plus one a range
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = (dealt.groupBy(*key, "_range").agg(F.count("*").alias("_rows"))
             .withColumn("_before", F.sum("_rows").over(before)).filter("_before is not null").drop("_rows"))
    return (own.join(later, [*key, "_range"], "left")
            .withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0)))
            .select(*cols, "_n"))
