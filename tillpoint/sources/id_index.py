"""Index of loaded transaction ids, kept beside the fact.

``<path>/ids`` is a table bucketed by a hash of the id. A batch's ids are dealt out by the same
hash, so a batch is compared bucket by bucket: only the batch is shuffled, the
warehouse's ids are read where they lie.

``<path>/filters`` holds, for every bucket, a bitmap of the hashes of its ids (a Bloom filter of one
hash). An id whose bit is not set was never loaded; buckets in which no id of the batch has its
bit set are not read. Filters only spare work: what they let through is compared by id.

Both are appended to by every load; bitmaps of several loads are or-ed when read. ``<path>/layout`` records
the number of buckets and bits, which never change.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import small
from ..session import cut_lineage, path_exists

BUCKETS = 64
#: Bits per bucket; a chunk of Spark's bitmaps has 32,768.
BITS = 1 << 20


def _bucket(id_: Column, buckets: int) -> Column:
    """The bucket Spark writes an id to: its own bucketing hash."""
    return F.pmod(F.hash(id_), F.lit(buckets))


class IdIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bits: int = BITS):
        self.spark, self.path = spark, path
        layout = os.path.join(path, "layout")
        if path_exists(spark, layout):
            buckets, bits = spark.read.parquet(layout).select("buckets", "bits").first()
        else:
            spark.createDataFrame([(buckets, bits)], "buckets int, bits int").coalesce(1).write.parquet(layout)
        self.buckets, self.bits = buckets, bits
        # the bucketing of files is known to Spark through a table over them
        self.table = f"id_index_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (transaction_id STRING) USING parquet "
                  f"CLUSTERED BY (transaction_id) INTO {buckets} BUCKETS LOCATION '{os.path.join(path, 'ids')}'")

    def _bits(self, ids: DataFrame) -> DataFrame:
        """transaction_id with its bucket, and the chunk and bit (from 0) of its hash."""
        place = F.pmod(F.xxhash64("transaction_id"), F.lit(self.bits)) + 1
        return ids.select("transaction_id", _bucket(F.col("transaction_id"), self.buckets).alias("bucket"),
                          F.bitmap_bucket_number(place).alias("chunk"), F.bitmap_bit_position(place).alias("bit"))

    def append(self, ids: DataFrame) -> None:
        """Add ids (a ``transaction_id`` column without nulls). Ids that are there already do no harm."""
        new = ids.select(F.col("transaction_id").cast("string").alias("transaction_id"))
        # one file a bucket and load
        new.repartition(self.buckets, "transaction_id").write.insertInto(self.table)
        (self._bits(new).groupBy("bucket", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
         .write.mode("append").parquet(os.path.join(self.path, "filters")))

    def _candidates(self, ids: DataFrame) -> DataFrame:
        """The ids whose bit is set."""
        filters = os.path.join(self.path, "filters")
        if not path_exists(self.spark, filters):
            return ids.select("transaction_id").limit(0)
        maps = self.spark.read.parquet(filters).groupBy("bucket", "chunk").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        is_set = F.lit(1).bitwiseAND(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int"))) == 1
        return self._bits(ids.select("transaction_id")).join(small(maps), ["bucket", "chunk"]).filter(is_set).select("transaction_id", "bucket")

    def known(self, ids: DataFrame) -> DataFrame:
        """Those of ``ids`` (distinct, column ``transaction_id``) that were loaded before."""
        maybe = cut_lineage(self._candidates(ids), "id-candidates")
        live = [r["bucket"] for r in maybe.select("bucket").distinct().collect()] if "bucket" in maybe.columns else []  # at most one row a bucket
        if not live:
            return maybe.select("transaction_id")
        loaded = self.spark.table(self.table)
        if len(live) < self.buckets:  # files of other buckets are left out when the scan lists them
            wanted = "|".join(f"{b:05d}" for b in sorted(live))
            loaded = loaded.filter(F.col("_metadata.file_name").rlike(f"_({wanted})\\."))
        return loaded.select("transaction_id").join(maybe.select("transaction_id").hint("shuffle_hash"), "transaction_id").distinct()
