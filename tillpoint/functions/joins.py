"""Join helpers with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A dimension is broadcast only when the optimizer's size estimate of the
# (already projected and filtered) side is below this bound; beyond it the
# join is left to the shuffle strategies and AQE's runtime conversion.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return None


def small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` when its estimated size is proven small, else return it unchanged."""
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def top_k_per_key(df: DataFrame, keys: list[str], order_col: str, k: int) -> DataFrame:
    """The k rows of each key with the largest ``order_col``. Spark keeps k rows of a key per
    task before it shuffles them, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order_col))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
