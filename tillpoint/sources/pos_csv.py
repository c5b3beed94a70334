"""Raw point-of-sale CSV files → one DataFrame with a ``source_file`` column.

Files of one batch may have their columns in any order. The batch is read once, as lines of
text, and staged. A file's layout is one row: the places of the required columns in its
header, which is its first line that isn't blank. Lines are joined to their file's layout and parsed by
it, so a thousand layouts in a batch cost one scan and one join, and no header passes
through the driver.

A line break inside quotes ends the record, as in a file that is split between tasks: both parts lack
columns, are parsed as such, and are rejected by the checks on keys and measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import small
from ..session import cut_lineage

# The 17 columns a raw POS file must carry, in file order.
REQUIRED_COLUMNS = [
    "Transaction_ID", "Timestamp", "Register_ID", "Cashier_Name",
    "Store_ID", "Item_Name", "Item_Category", "Quantity_Sold",
    "Modifiers", "Order_Type", "Gross_Sales", "Discount_Amount",
    "Promo_Code", "Discount_Reason", "Tax_Amount", "Net_Sales", "Payment_Type",
]


def _one_spelling(uri):
    """A file's URI with three slashes and nothing escaped, however it was written."""
    return F.regexp_replace(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def listing(spark: SparkSession, paths) -> DataFrame:
    """source_file, file_size and modified of every file. No content is read. Spark's scans leave out files of
    zero bytes, so the names are those it lists for the scan."""
    seen = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("file_size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    names = spark.createDataFrame([(f,) for f in spark.read.text(paths).inputFiles()], "listed string")
    return (names.withColumn("_key", _one_spelling(F.col("listed"))).join(seen.withColumn("_key", _one_spelling(F.col("source_file"))), "_key", "left")
            .select(F.coalesce("source_file", "listed").alias("source_file"), F.coalesce("file_size", F.lit(0)).alias("file_size"), "modified"))


def lines(spark: SparkSession, paths) -> DataFrame:
    """source_file, from_start (in the file's first block), at (rising within a file's block) and line, without blank lines."""
    return (spark.read.text(paths).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.file_block_start") == 0).alias("from_start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))


def layouts(staged: DataFrame) -> DataFrame:
    """One row per file: at (of its header), width, places (of REQUIRED_COLUMNS in it, from 1; 0: missing) and missing_columns.
    Header names are compared without case, quotes and outer blanks; the first of equal names counts."""
    first = staged.filter("from_start").groupBy("source_file").agg(F.min(F.struct("at", "line")).alias("h"))
    names = F.transform(F.split(F.replace(F.col("h.line"), F.lit('"'), F.lit("")), ","), lambda n: F.lower(F.trim(n)))
    wanted = F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    out = first.select("source_file", F.col("h.at").alias("header_at"), names.alias("names"))
    return out.select("source_file", "header_at", F.size("names").alias("width"),
                      F.transform(wanted, lambda c: F.coalesce(F.array_position(F.col("names"), F.lower(c)), F.lit(0)).cast("int")).alias("places"),
                      F.filter(wanted, lambda c: ~F.array_contains(F.col("names"), F.lower(c))).alias("missing_columns"))


def read_pos_files(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Read raw POS CSV files.

    Returns ``(rows, files)``: ``rows`` has ``source_file`` and the required columns as strings (null where
    the file lacks one), read from a staged table; ``files`` lists every file with its ``missing_columns`` (empty
    when complete, and for a file without a header), ``file_size`` and ``modified``."""
    if isinstance(paths, str):
        paths = [paths]
    staged = cut_lineage(lines(spark, paths), "pos-lines")
    layout = cut_lineage(layouts(staged), "pos-layouts")
    width = max(layout.agg(F.max("width")).first()[0] or 1, 1)  # one number
    schema = ", ".join(f"_c{i} string" for i in range(width))
    cells = F.from_csv("line", schema, {"escape": '"'})
    j = staged.join(small(layout.select("source_file", "header_at", "places")), "source_file").filter(F.col("at") != F.col("header_at"))
    # inline keeps a line from being parsed once per column
    as_list = F.transform(F.array(cells), lambda r: F.array(*[r[f"_c{i}"] for i in range(width)]))
    rows = j.select("source_file", F.inline(F.transform(as_list, lambda a: F.struct(
        *[F.get(a, F.get("places", F.lit(i)) - 1).alias(c) for i, c in enumerate(REQUIRED_COLUMNS)]))))
    files = (listing(spark, paths).join(layout.select("source_file", "missing_columns"), "source_file", "left")
             .withColumn("missing_columns", F.coalesce("missing_columns", F.array().cast("array<string>"))))
    return rows, files
