"""Weather enrichment: archive documents → hourly rows → daylight class per
(branch, date) → left join onto the fact; forecast documents → daily summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import weather as W

ARCHIVE_SCHEMA = T.StructType([
    T.StructField("branch_id", T.StringType()),
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("weathercode", T.ArrayType(T.IntegerType())),
        T.StructField("precipitation", T.ArrayType(T.DoubleType())),
    ])),
])

FORECAST_SCHEMA = T.StructType([
    T.StructField("branch_id", T.StringType()),
    T.StructField("list", T.ArrayType(T.StructType([
        T.StructField("dt_txt", T.StringType()),
        T.StructField("weather", T.ArrayType(T.StructType([T.StructField("main", T.StringType())]))),
        T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType())])),
        T.StructField("pop", T.DoubleType()),
    ]))),
])


def read_archive_documents(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(ARCHIVE_SCHEMA).json(paths)


def archive_to_hourly(docs: DataFrame) -> DataFrame:
    """Parallel arrays → one row per reading; readings whose time lacks 'T' are dropped."""
    z = docs.select("branch_id", F.explode(F.arrays_zip(
        F.col("hourly.time").alias("time"), F.col("hourly.weathercode").alias("weathercode"),
        F.col("hourly.precipitation").alias("precipitation"))).alias("z"))
    t = F.col("z.time")
    return (z.filter(t.contains("T"))
            .select("branch_id",
                    F.to_timestamp_ntz(t).alias("time"),
                    F.to_date(F.split(t, "T").getItem(0)).alias("date"),
                    F.split(F.split(t, "T").getItem(1), ":").getItem(0).cast("int").alias("hour"),
                    F.col("z.weathercode").alias("weathercode"),
                    F.col("z.precipitation").alias("precipitation")))


def daylight_conditions(hourly: DataFrame) -> DataFrame:
    """(branch_id, date, weather_condition) from readings in hours 7..19.

    One partial-aggregated groupBy; a date with no daylight readings has no
    row (the fact join defaults it to Cloudy)."""
    day = hourly.filter(F.col("hour").between(W.DAYLIGHT_FIRST_HOUR, W.DAYLIGHT_LAST_HOUR))
    agg = day.groupBy("branch_id", "date").agg(*W.daylight_aggregates("weathercode", "precipitation"))
    return agg.select("branch_id", "date", W.classify_daylight().alias("weather_condition"))


def attach_weather(fact: DataFrame, daily: DataFrame, zero_coord_branches: DataFrame | None = None) -> DataFrame:
    """Fact ⟕ daily weather on (branch, date), default Cloudy. Branches at
    (0, 0) are removed from the weather side so they stay Cloudy.

    The daily table has one row per (branch, day) — bounded by outlets × days,
    far smaller than the fact — so AQE may broadcast it; no hint is forced."""
    w = daily.select(F.col("branch_id").alias("_wb"), F.col("date").alias("_wd"),
                     F.col("weather_condition").alias("_wc"))
    if zero_coord_branches is not None:
        w = w.join(zero_coord_branches.select(F.col("branch_code").alias("_wb")), "_wb", "left_anti")
    return (fact.join(w, (fact.branch_id == w._wb) & (fact.transaction_date == w._wd), "left")
            .withColumn("weather_condition", F.coalesce(F.col("_wc"), F.lit(W.DEFAULT_CONDITION)))
            .drop("_wb", "_wd", "_wc"))


def zero_coordinate_branches(branches: DataFrame) -> DataFrame:
    return branches.filter((F.col("latitude") == 0) & (F.col("longitude") == 0)).select("branch_code")


def read_forecast_documents(spark: SparkSession, paths) -> DataFrame:
    return spark.read.schema(FORECAST_SCHEMA).json(paths)


def forecast_to_slots(docs: DataFrame) -> DataFrame:
    """3-hourly forecast slots: date, hour, mapped condition, temp, pop % (missing pop → 0)."""
    e = docs.select("branch_id", F.explode("list").alias("e"))
    dt = F.split(F.col("e.dt_txt"), " ")
    return e.select(
        "branch_id",
        F.to_date(dt.getItem(0)).alias("date"),
        F.split(dt.getItem(1), ":").getItem(0).cast("int").alias("hour"),
        W.map_forecast_condition(F.col("e.weather").getItem(0).getField("main")).alias("condition"),
        F.col("e.main.temp").alias("temp"),
        (F.coalesce(F.col("e.pop"), F.lit(0.0)) * 100).alias("pop"),
    )


def forecast_daily_summary(slots: DataFrame) -> DataFrame:
    """Business hours 9..21: dominant condition (most slots, tie → label order),
    mean temp (1 dp), mean pop (0 dp), rain level on the unrounded mean pop."""
    biz = slots.filter(F.col("hour").between(W.BUSINESS_FIRST_HOUR, W.BUSINESS_LAST_HOUR))
    counts = biz.groupBy("branch_id", "date", "condition").agg(F.count("*").alias("n"))
    dominant = (counts.groupBy("branch_id", "date")
                .agg(F.max_by("condition", F.struct(F.col("n"), F.col("condition"))).alias("condition")))
    means = biz.groupBy("branch_id", "date").agg(F.avg("temp").alias("t"), F.avg("pop").alias("p"))
    return (means.join(dominant, ["branch_id", "date"])
            .select("branch_id", "date", "condition",
                    F.round("t", 1).alias("temp"), F.round("p", 0).alias("pop"),
                    W.rain_level(F.col("p")).alias("rain_level")))
