"""Dimension tables: seeds, versioned upserts and ordered lookups.

Plain Parquet has no UPDATE/MERGE. A dimension is a snapshot and an append-only log of changes, each with
a version of its own; its present state is the snapshot with every key's changes
applied in the order of their versions (``DimensionLog``). ``compact`` writes that state as the next snapshot,
to a fresh path (never over the path being read).

A change is one of: ``insert`` (a key that is there already is a conflict: reported, not applied), ``update``
(columns it leaves null keep their value; of a key that isn't there: a conflict), ``replace`` (the whole row; columns
it leaves null get their defaults).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import numbered_from
from ..session import path_exists

BRANCH_SCHEMA = T.StructType([
    T.StructField("branch_pk", T.IntegerType()),
    T.StructField("branch_code", T.StringType()),
    T.StructField("branch_name", T.StringType()),
    T.StructField("location_type", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("district", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("holiday_effect", T.DoubleType()),
    T.StructField("is_active", T.IntegerType()),
])

RECIPE_SCHEMA = T.StructType([
    T.StructField("item_name", T.StringType()),
    T.StructField("beans_g", T.DoubleType()),
    T.StructField("milk_ml", T.DoubleType()),
    T.StructField("choco_g", T.DoubleType()),
    T.StructField("ice_g", T.DoubleType()),
    T.StructField("whip_g", T.DoubleType()),
    T.StructField("cup_type", T.StringType()),
    T.StructField("custom_ingredients", T.StringType()),
    T.StructField("is_active", T.IntegerType()),
])


def branches_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, BRANCH_SCHEMA)


def recipes_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RECIPE_SCHEMA)


def upsert(base: DataFrame, changes: DataFrame, key: str, version_col: str = "_version",
           defaults: dict | None = None) -> DataFrame:
    """Latest row per key: changes win over base, among changes the higher ``version_col``. Changes
    without versions must have one row a key; of several, the least by its values stays, in whatever
    order they come. ``defaults`` re-applies column
    defaults for columns the change rows leave NULL (replace semantics)."""
    b = base.withColumn(version_col, F.lit(-1).cast("long"))
    c = changes
    if version_col not in c.columns:
        c = c.withColumn(version_col, F.lit(0).cast("long"))
    for col, val in (defaults or {}).items():
        c = c.withColumn(col, F.coalesce(F.col(col), F.lit(val)))
    u = b.unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(version_col), F.struct(*[c for c in u.columns if c != version_col]))
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", version_col)


OPS = ("insert", "update", "replace")


class DimensionLog:
    """A dimension kept under ``path``: ``snapshot/upto=N`` (state after version N) and ``log`` (later changes)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, defaults: dict | None = None):
        self.spark, self.path, self.schema, self.key, self.defaults = spark, path, schema, key, dict(defaults or {})
        self.columns = [f.name for f in schema.fields]

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        where = os.path.join(self.path, part)
        if path_exists(self.spark, where):
            return self.spark.read.schema(schema).option("basePath", where).parquet(where)
        return self.spark.createDataFrame([], schema)

    def snapshot(self) -> tuple[DataFrame, int]:
        """The last snapshot and the version it goes up to (-1: none)."""
        all_ = self._read("snapshot", T.StructType([*self.schema.fields, T.StructField("upto", T.LongType())]))
        upto = all_.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        return all_.filter(F.col("upto") == upto).drop("upto"), upto

    def log(self) -> DataFrame:
        return self._read("log", T.StructType([T.StructField("version", T.LongType()), T.StructField("op", T.StringType()), *self.schema.fields]))

    def seed(self, rows: DataFrame) -> bool:
        """Write ``rows`` as the first snapshot of a dimension that has no rows; a dimension with rows is left as it is."""
        base, upto = self.snapshot()
        if not base.isEmpty() or not self.log().isEmpty():
            return False
        self._write_snapshot(rows.select(*self.columns), upto + 1)
        return True

    def append(self, changes: DataFrame, order: list[str]) -> None:
        """Append changes (``op`` and any of the columns). They are numbered on from the last version by ``order``, whose columns
        must tell the changes of a key apart; so the versions don't depend on how the rows are spread."""
        last = self.log().agg(F.max("version")).first()[0]
        start = max(self.snapshot()[1], -1 if last is None else last) + 1
        out = numbered_from(changes, [F.col(c) for c in order], start, "version")
        for f in self.schema.fields:
            if f.name not in out.columns:
                out = out.withColumn(f.name, F.lit(None))
        out.select("version", "op", *[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("append").parquet(os.path.join(self.path, "log"))

    def _events(self) -> tuple[DataFrame, int]:
        """All rows that make up the present state with ``_there`` (whether the key existed before) and ``_conflict``."""
        base, upto = self.snapshot()
        new = self.log().filter(F.col("version") > upto)
        every = base.withColumn("version", F.lit(upto).cast("long")).withColumn("op", F.lit("base")).unionByName(new)
        earlier = Window.partitionBy(self.key).orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
        # a key is there once it was in the base, inserted or replaced; an insert that fails finds it there already
        e = every.withColumn("_there", F.coalesce(F.max(F.col("op") != "update").over(earlier), F.lit(False)))
        return e.withColumn("_conflict", ((F.col("op") == "insert") & F.col("_there")) | ((F.col("op") == "update") & ~F.col("_there"))), upto

    def conflicts(self) -> DataFrame:
        """Changes that were not applied: version, op and the row."""
        return self._events()[0].filter("_conflict").select("version", "op", *self.columns)

    def state(self) -> DataFrame:
        """The present rows."""
        e = self._events()[0].filter("not _conflict")
        whole = Window.partitionBy(self.key)
        # a value holds from the last whole row (base, insert, replace) on
        e = e.withColumn("_whole", F.max(F.when(F.col("op") != "update", F.col("version"))).over(whole)).filter(F.col("version") >= F.col("_whole"))

        def value(c: str):
            last = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("version")))
            if c not in self.defaults:
                return last.alias(c)
            # only a row that was written whole gets a default, not one of the base
            written = F.max(F.when((F.col("version") == F.col("_whole")) & (F.col("op") != "base"), 1)).isNotNull()
            return F.coalesce(last, F.when(written, F.lit(self.defaults[c]))).alias(c)
        return e.groupBy(self.key).agg(*[value(c) for c in self.columns if c != self.key]).select(
            *[F.col(f.name).cast(f.dataType) for f in self.schema.fields])

    def _write_snapshot(self, rows: DataFrame, upto: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, "snapshot", f"upto={upto}"))

    def compact(self) -> None:
        """Write the present state as the next snapshot; the log stays, as history."""
        last = self.log().agg(F.max("version")).first()[0]
        if last is not None and last > self.snapshot()[1]:
            self._write_snapshot(self.state(), last)


def insert_conflicts(base: DataFrame, inserts: DataFrame, key: str) -> DataFrame:
    """Insert rows whose key already exists (reported as conflicts, not applied)."""
    return inserts.join(base.select(key), key, "left_semi")


def set_active(base: DataFrame, key: str, key_value: str, active: int) -> DataFrame:
    return base.withColumn("is_active", F.when(F.col(key) == key_value, F.lit(active)).otherwise(F.col("is_active")))


def active_branches_ordered(branches: DataFrame) -> DataFrame:
    return branches.filter(F.col("is_active") == 1).orderBy("branch_name", "branch_code")


def branch_profile(branches: DataFrame) -> DataFrame:
    """Persona text and holiday effect per branch with the documented defaults."""
    return branches.select("branch_code",
                           F.coalesce(F.col("description"), F.lit("Standard outlet profile")).alias("persona"),
                           F.coalesce(F.col("holiday_effect"), F.lit(0.0)).alias("holiday_effect"))
