"""Session defaults and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (the POS timestamps are naive
# local times), AQE for runtime re-planning and skew splitting, dynamic
# partition overwrite for per-branch forecast replacement.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts may be long: bound what a Python worker holds of a batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tillpoint", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime-settable defaults on an existing session (only where
    they differ) and make the package importable on its workers."""
    for k, v in DEFAULTS.items():
        if spark.conf.isModifiable(k) and spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of ``spark``, once per application.

    Functions that run on workers are pickled by reference to their module, so
    the module must be importable there whatever the working directory is."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_tillpoint_shipped", None) == root:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tillpoint-pkg-"), "tillpoint_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._tillpoint_shipped = root


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and streaming checkpoints.

    On a cluster this is the operator-provided ``spark.checkpoint.dir``; only
    when it is unset on a local master (tests) do we pick a private scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tillpoint-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` once as a Parquet table in the shared checkpoint
    folder and continue from it.

    Survives executor loss (the data lives in shared storage, unlike a local
    checkpoint), computes the plan exactly once (an eager RDD checkpoint
    without persist runs it twice) and the re-read table carries real size
    statistics for the planner."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._table_path = path
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_table(df: DataFrame) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing lazy reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Sections(dict):
    """Named result tables of a composite operator, planned on first access.

    Some sections materialise a small table or read one scalar while their
    plan is built; deferring them means a caller that asks for one section
    never pays for the others. Iteration resolves every section."""

    def __init__(self, ready: dict | None = None, deferred: dict | None = None):
        super().__init__(ready or {})
        self._deferred = dict(deferred or {})

    def __missing__(self, key):
        if key in self._deferred:
            value = self._deferred.pop(key)()
            self[key] = value
            return value
        raise KeyError(key)

    def _resolve(self) -> None:
        for key in list(self._deferred):
            self[key]

    def __contains__(self, key) -> bool:
        return super().__contains__(key) or key in self._deferred

    def __len__(self) -> int:
        return super().__len__() + len(self._deferred)

    def __iter__(self):
        self._resolve()
        return super().__iter__()

    def keys(self):
        self._resolve()
        return super().keys()

    def values(self):
        self._resolve()
        return super().values()

    def items(self):
        self._resolve()
        return super().items()

    def get(self, key, default=None):
        return self[key] if key in self else default
