"""Ingestion of raw POS rows into the typed sales fact.

Many files per job; one file is one unit of acceptance. Verdicts follow the
reference order: EMPTY → MISSING_COLUMNS → DUPLICATE_IDS → ALL_INVALID →
BAD_TIMESTAMP → NO_ACTIVE_BRANCH → (load) ALREADY_LOADED / PARTIAL / LOADED.

One narrow table of the batch (file, id, outlet, fault, how its stamp parses) is kept for the checks. Per file
there is one row of them; per id that is loaded already or comes twice there is one narrow row. With these
two, every raw row is tagged with one reason, or none when it is loaded (``REASONS``); loaded rows, rejects
and counts follow the same tags, so they always add up to the rows that came in.

Everything per file is computed with grouped aggregates over the rows (no
per-file driver loop).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..session import Sections, cut_lineage
from ..functions.text import modifiers_text, sku_from_name, upper_trim
from ..sources.id_index import IdIndex
from ..sources.pos_csv import REQUIRED_COLUMNS

MONEY = "decimal(18,2)"

# Timestamp layouts tried in order after the ISO default.
ISO_FORMATS = ["yyyy/MM/dd HH:mm:ss"]
DAY_FIRST_FORMATS = ["dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
MONTH_FIRST_FORMATS = ["MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]

#: Why a row is not loaded. The first five hold for a whole file, the next three for a row of
#: an accepted file, the last two for a row whose id is known (these rows are skipped, not faulty).
REASONS = ["MISSING_COLUMNS", "DUPLICATE_IDS", "ALL_INVALID", "BAD_TIMESTAMP", "NO_ACTIVE_BRANCH",
           "NULL_KEY", "NOT_POSITIVE", "INACTIVE_BRANCH", "ALREADY_LOADED", "REPEATED_IN_BATCH"]
SKIPPED = ["ALREADY_LOADED", "REPEATED_IN_BATCH"]

FACT_COLUMNS = [
    "transaction_id", "branch_id", "transaction_ts", "transaction_date", "transaction_time", "hour", "day_name",
    "month_name", "month", "item_name", "product_id", "product_category", "product_detail", "transaction_qty",
    "order_type", "unit_price", "gross_sales", "discount_amount", "promo_code", "sst_amount", "total_bill",
    "payment_method", "store_location", "location_type", "district", "state", "weather_condition",
    "is_public_holiday",
]


_PARTS = {"yyyy": "[^ /]+", "dd": "(0[1-9]|[12][0-9]|3[01])", "MM": "(0[1-9]|1[0-2])", "HH": "([01][0-9]|2[0-3])", "mm": "[0-5][0-9]", "ss": "[0-5][0-9]"}


def _shape(fmt: str) -> str:
    """A pattern that every text of a layout matches: two digits in range for each part, a year of any length."""
    return "^" + re.sub("yyyy|dd|MM|HH|mm|ss", lambda m: _PARTS[m[0]], fmt) + "$"


def _parsed(col: Column, formats: list[str]) -> Column:
    # a layout that fails costs an exception: only those that the text looks like are tried
    return F.coalesce(*[F.when(col.rlike(_shape(f)), F.try_to_timestamp(col, F.lit(f))) for f in formats])


def iso_timestamp(c) -> Column:
    """A stamp that starts with the year; it means the same in every file."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_timestamp(col), _parsed(col, ISO_FORMATS))


def parse_timestamp(c, day_first: Column | None = None) -> Column:
    """A stamp by its file's order of day and month (day first unless told)."""
    col = F.col(c) if isinstance(c, str) else c
    by_day, by_month = _parsed(col, DAY_FIRST_FORMATS), _parsed(col, MONTH_FIRST_FORMATS)
    slashed = by_day if day_first is None else F.when(day_first, by_day).otherwise(by_month)
    return F.coalesce(iso_timestamp(col), slashed).cast("timestamp_ntz")


def standardise(raw: DataFrame) -> DataFrame:
    """Trim / upper-case the key text columns; typed measures; ``_fault`` (NULL_KEY, NOT_POSITIVE or
    null) and ``_valid``. The raw columns stay under their own names."""
    return raw.withColumns({
        "store": upper_trim("Store_ID"), "item": F.trim("Item_Name"),
        "qty": F.col("Quantity_Sold").try_cast("double"),
        "gross": F.col("Gross_Sales").try_cast(MONEY),
        "discount": F.col("Discount_Amount").try_cast(MONEY),
        "tax": F.col("Tax_Amount").try_cast(MONEY),
        "net": F.col("Net_Sales").try_cast(MONEY),
    }).withColumn("_fault", F.when(
        F.col("Transaction_ID").isNull() | F.col("Timestamp").isNull() | F.col("Store_ID").isNull() | F.col("Item_Name").isNull(), "NULL_KEY")
        .when(~F.coalesce((F.col("qty") > 0) & (F.col("gross") > 0) & (F.col("net") > 0), F.lit(False)), "NOT_POSITIVE")
    ).withColumn("_valid", F.col("_fault").isNull())


def _active_codes(branches: DataFrame) -> DataFrame:
    return small(branches.filter(F.col("is_active") == 1).select(F.col("branch_code").alias("_code")).distinct())


def _first_few(rows: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """The k smallest values per file as an array; a task keeps k rows of a file before they are shuffled."""
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy(col))
    return (rows.select("source_file", col).withColumn("_nth", nth).filter(F.col("_nth") <= k)
            .groupBy("source_file").agg(F.array_sort(F.collect_list(col)).alias(out)))


def row_flags(std: DataFrame) -> DataFrame:
    """What the checks need of every row: source_file, Transaction_ID, store, _fault, and of a valid row whose stamp does not start
    with the year (``_slashed``) whether it parses with the day or the month first."""
    slashed = F.when(F.col("_valid") & iso_timestamp("Timestamp").isNull(), F.col("Timestamp"))
    f = std.select("source_file", "Transaction_ID", "store", "_fault", slashed.alias("_stamp"))
    return f.select("source_file", "Transaction_ID", "store", "_fault", F.col("_stamp").isNotNull().alias("_slashed"),
                    _parsed(F.col("_stamp"), DAY_FIRST_FORMATS).isNotNull().alias("_by_day"),
                    _parsed(F.col("_stamp"), MONTH_FIRST_FORMATS).isNotNull().alias("_by_month"))


def file_checks(flags: DataFrame, files: DataFrame, branches: DataFrame) -> DataFrame:
    """One row per file: counts, examples, the order of day and month that its stamps speak for, and the
    pre-load verdict (or NULL when accepted).

    Stamps that start with the year are clear. For the others a file has one order: the one
    under which more of its rows parse, day first when both do as well. So a file is read alike in all its
    rows, and a day above 12 in one row decides for the rest."""
    valid = F.col("_fault").isNull()
    # a file with any number of rows or repeated ids stays spread: one row per (file, outlet), all of which a verdict lists,
    # and per (file, repeated id), of which a task keeps the few that serve as examples
    stores = cut_lineage(flags.groupBy("source_file", F.when(valid, F.col("store")).alias("store")).agg(
        F.count("*").alias("rows_in"), F.count(F.when(valid, 1)).alias("rows_clean"),
        *[F.count(F.when(F.col(c), 1)).alias(c) for c in ("_slashed", "_by_day", "_by_month")]), "ingest-outlets")
    act = _active_codes(branches)
    per = stores.join(act, stores.store == act._code, "left").groupBy("source_file").agg(
        *[F.sum(c).alias(c) for c in ("rows_in", "rows_clean", "_slashed", "_by_day", "_by_month")],
        F.sum(F.when(F.col("_code").isNotNull(), F.col("rows_clean")).otherwise(0)).alias("rows_active"),
        F.count("store").alias("n_detected"), F.array_sort(F.collect_list("store")).alias("detected_ids"))
    # the (file, id) aggregate is the one big shuffle here; only repeated ids leave it
    dup_ids = cut_lineage(flags.filter(valid).groupBy("source_file", "Transaction_ID").count()
                          .filter(F.col("count") > 1).select("source_file", "Transaction_ID"), "ingest-dup-ids")
    dups = (dup_ids.groupBy("source_file").agg(F.count("*").alias("duplicate_ids"))
            .join(_first_few(dup_ids, "Transaction_ID", 3, "dup_examples"), "source_file"))
    counts = ["rows_in", "rows_clean", "rows_active", "n_detected", "duplicate_ids", "_slashed", "_by_day", "_by_month"]
    v = (files.join(per, "source_file", "left").join(dups, "source_file", "left").fillna(0, counts)
         .withColumn("day_first", F.col("_by_day") >= F.col("_by_month"))
         .withColumn("bad_timestamps", F.col("_slashed") - F.greatest("_by_day", "_by_month")).drop("_slashed", "_by_day", "_by_month"))
    none = F.array().cast("array<string>")
    status = (F.when(F.col("rows_in") == 0, F.lit("EMPTY"))
              .when(F.size("missing_columns") > 0, F.lit("MISSING_COLUMNS"))
              .when(F.col("duplicate_ids") > 0, F.lit("DUPLICATE_IDS"))
              .when(F.col("rows_clean") == 0, F.lit("ALL_INVALID"))
              .when(F.col("bad_timestamps") > 0, F.lit("BAD_TIMESTAMP"))
              .when(F.col("rows_active") == 0, F.lit("NO_ACTIVE_BRANCH")))
    return v.withColumns({"status": status, "detected_ids": F.coalesce("detected_ids", none), "dup_examples": F.coalesce("dup_examples", none)})


def known_rows(accepted: DataFrame, existing: DataFrame | IdIndex | None) -> DataFrame:
    """(source_file, Transaction_ID, known) of the accepted rows that must not be loaded: their id is in the
    warehouse (ALREADY_LOADED) or in an earlier file of the batch, by name (REPEATED_IN_BATCH). Ids are unique
    inside an accepted file.

    The ids of the batch and the known ones are counted in one shuffle, as (id, files, loaded); of the warehouse's, an
    ``IdIndex`` gives only those that the batch has. File names are compared only for ids that are met again."""
    ids = accepted.select("source_file", "Transaction_ID")
    if isinstance(existing, IdIndex):
        existing = existing.known(ids.select(F.col("Transaction_ID").alias("transaction_id")))
    every = ids.select("Transaction_ID", F.lit(1).alias("_new"), F.lit(False).alias("_old"))
    if existing is not None:
        every = every.union(existing.select("transaction_id", F.lit(0), F.lit(True)))
    met = (every.groupBy("Transaction_ID").agg(F.sum("_new").alias("_files"), F.max("_old").alias("_old"))
           .filter((F.col("_files") > 1) | ((F.col("_files") > 0) & F.col("_old"))).select("Transaction_ID", "_old"))
    first = F.min("source_file").over(Window.partitionBy("Transaction_ID"))
    return (ids.join(met, "Transaction_ID").withColumn("_first", first).filter(F.col("_old") | (F.col("source_file") != F.col("_first")))
            .select("source_file", "Transaction_ID", F.when(F.col("_old"), "ALREADY_LOADED").otherwise("REPEATED_IN_BATCH").alias("known")))


def tag_rows(std: DataFrame, checks: DataFrame, branches: DataFrame) -> DataFrame:
    """Every row with its ``reason`` as far as the row and its file tell; null: accepted, to be loaded unless its id is known."""
    c = small(checks.select("source_file", F.col("status").alias("_file")))
    act = _active_codes(branches)
    t = std.join(c, "source_file", "left").join(act, std.store == act._code, "left")
    return t.withColumn("reason", F.coalesce("_file", "_fault", F.when(F.col("_code").isNull(), "INACTIVE_BRANCH"))).drop("_file", "_code")


def to_fact(rows: DataFrame, branches: DataFrame, weather_daily: DataFrame | None = None,
            holidays: DataFrame | None = None, zero_coord: DataFrame | None = None) -> DataFrame:
    """17 raw columns (standardised, valid, active rows, with ``day_first``) → the 27-column fact."""
    from .weather_ops import attach_weather, zero_coordinate_branches

    rows = rows.withColumn("_ts", parse_timestamp("Timestamp", F.col("day_first")))
    ts = F.col("_ts")
    d = ts.cast("date")
    item = upper_trim("Item_Name")
    b = small(branches.filter(F.col("is_active") == 1).select(
        F.col("branch_code").alias("_bc"), F.col("branch_name").alias("store_location"),
        "location_type", "district", "state"))
    j = rows.join(b, rows.store == b._bc, "left")
    carry = [F.col("source_file")] if "source_file" in rows.columns else []
    fact = j.select(
        *carry,
        F.col("Transaction_ID").alias("transaction_id"),
        F.col("store").alias("branch_id"),
        ts.alias("transaction_ts"), d.alias("transaction_date"),
        F.date_format(ts, "HH:mm:ss").alias("transaction_time"), F.hour(ts).cast("int").alias("hour"),
        F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MM").alias("month"),
        item.alias("item_name"), sku_from_name(item).alias("product_id"),
        F.trim("Item_Category").alias("product_category"),
        modifiers_text("Modifiers").alias("product_detail"),
        F.col("qty").cast("int").alias("transaction_qty"),
        F.col("Order_Type").alias("order_type"),
        (F.col("gross").cast("double") / F.col("qty")).alias("unit_price"),
        F.col("gross").alias("gross_sales"),
        F.coalesce(F.col("discount"), F.lit(0).cast(MONEY)).alias("discount_amount"),
        upper_trim(F.coalesce(F.col("Promo_Code"), F.lit("NONE"))).alias("promo_code"),
        F.coalesce(F.col("tax"), F.lit(0).cast(MONEY)).alias("sst_amount"),
        F.col("net").alias("total_bill"),
        upper_trim("Payment_Type").alias("payment_method"),
        *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in ("store_location", "location_type", "district", "state")],
    )
    if weather_daily is not None:
        if zero_coord is None and {"latitude", "longitude"} <= set(branches.columns):
            zero_coord = zero_coordinate_branches(branches)
        fact = attach_weather(fact, weather_daily, zero_coord)
    else:
        fact = fact.withColumn("weather_condition", F.lit("Cloudy"))
    if holidays is not None:
        hol = F.broadcast(holidays.select(F.col("holiday_date").alias("_hd")).distinct())
        fact = (fact.join(hol, fact.transaction_date == hol._hd, "left")
                .withColumn("is_public_holiday", F.col("_hd").isNotNull().cast("int")).drop("_hd"))
    else:
        fact = fact.withColumn("is_public_holiday", F.lit(0))
    return fact.select(*(["source_file"] if carry else []), *FACT_COLUMNS)


def ingest_batch(raw: DataFrame, files: DataFrame | None, branches: DataFrame, existing: DataFrame | IdIndex | None = None,
                 weather_daily: DataFrame | None = None, holidays: DataFrame | None = None, zero_coord: DataFrame | None = None,
                 recipes: DataFrame | None = None) -> Sections:
    """Clean, validate and dedupe raw rows of many files. Results, each planned when it is asked for:

    * ``loaded`` — new fact rows with ``source_file``, ready for ``sinks.append_fact``;
    * ``verdicts`` — one row per file with counts, examples and the final status;
    * ``rejects`` — every row that is not loaded, as it came, with its ``reason``;
    * ``missing_recipes`` — item names without a recipe (with ``recipes``).

    ``files`` lists every input file with its ``missing_columns`` (header-only
    files have no rows, so the CSV reader supplies it from the headers) and anything else to be kept
    with the verdict; ``None`` takes the files present in the batch. ``existing`` is the warehouse's id
    index, or a table of its ids. ``raw`` is read once for the checks and once for each of ``loaded`` and ``rejects``
    that is asked for; ``read_pos_files`` gives rows that are staged already."""
    std = standardise(raw.select("source_file", *REQUIRED_COLUMNS))
    flags = cut_lineage(row_flags(std), "ingest-flags")
    if files is None:
        files = (flags.select("source_file").distinct()
                 .withColumn("missing_columns", F.array().cast("array<string>")))
    checks = cut_lineage(file_checks(flags, files, branches), "ingest-checks")
    ok = small(checks.filter(F.col("status").isNull()).select("source_file"))
    act = _active_codes(branches)
    accepted = (flags.filter("_fault is null").join(ok, "source_file", "left_semi")
                .join(act, flags.store == act._code, "left_semi"))
    known = cut_lineage(known_rows(accepted, existing), "ingest-known")
    tagged = tag_rows(std, checks, branches)
    # rows of other files are left out before their texts are typed, and only accepted rows are compared with the known ids
    taken = small(checks.filter(F.col("status").isNull()).select("source_file", "day_first"))
    valid = standardise(raw.select("source_file", *REQUIRED_COLUMNS).join(taken, "source_file")).filter("_valid")
    to_load, key = valid.join(act, valid.store == act._code, "left_semi"), ["source_file", "Transaction_ID"]

    def verdicts() -> DataFrame:
        skipped = known.groupBy("source_file").agg(F.count("*").alias("rows_skipped"))
        v = checks.join(skipped, "source_file", "left").fillna(0, ["rows_skipped"])
        # the rows of an accepted file that are valid and whose outlet is active
        v = v.withColumn("rows_accepted", F.when(F.col("status").isNull(), F.col("rows_active")).otherwise(0))
        final = (F.when(F.col("status").isNotNull(), F.col("status"))
                 .when(F.col("rows_skipped") == F.col("rows_accepted"), F.lit("ALREADY_LOADED"))
                 .when(F.col("rows_skipped") > 0, F.lit("PARTIAL"))
                 .otherwise(F.lit("LOADED")))
        kept = [c for c in files.columns if c not in ("source_file", "missing_columns")]
        return v.select("source_file", final.alias("status"), "missing_columns", "rows_in", "rows_clean", "duplicate_ids", "dup_examples",
                        "bad_timestamps", "rows_active", "n_detected", "detected_ids", F.col("rows_accepted").cast("bigint").alias("rows_accepted"),
                        "rows_skipped", (F.col("rows_accepted") - F.col("rows_skipped")).cast("bigint").alias("rows_loaded"),
                        (F.col("rows_in") - F.col("rows_accepted")).cast("bigint").alias("rows_rejected"), *kept)

    def rejects() -> DataFrame:
        skipped = to_load.join(small(known.withColumnRenamed("known", "reason")), key)
        return (tagged.filter("reason is not null").select("source_file", "reason", *REQUIRED_COLUMNS)
                .union(skipped.select("source_file", "reason", *REQUIRED_COLUMNS)))

    out = {"loaded": lambda: to_fact(to_load.join(small(known.select(*key)), key, "left_anti"), branches, weather_daily, holidays, zero_coord),
           "verdicts": verdicts,
           "rejects": rejects}
    if recipes is not None:
        out["missing_recipes"] = lambda: missing_recipes(std, recipes)
    return Sections(deferred=out)


def ingest(raw: DataFrame, files: DataFrame | None, branches: DataFrame, existing_ids: DataFrame | IdIndex | None = None,
           weather_daily: DataFrame | None = None, holidays: DataFrame | None = None,
           zero_coord: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(loaded, verdicts)`` of ``ingest_batch``."""
    r = ingest_batch(raw, files, branches, existing_ids, weather_daily, holidays, zero_coord)
    return r["loaded"], r["verdicts"]


def missing_recipes(std_rows: DataFrame, recipes: DataFrame) -> DataFrame:
    """Distinct uploaded item names (cleaned rows, before the branch filter)
    without a recipe, compared upper/trim-insensitively."""
    items = std_rows.filter("_valid").select(F.col("item").alias("item_name")).distinct()
    keys = recipes.select(upper_trim("item_name").alias("_k")).distinct()
    return items.join(keys, upper_trim("item_name") == keys._k, "left_anti")
