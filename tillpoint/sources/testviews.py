"""POS-shaped views derived from the given TPC-H-like tables.

Each view is defined twice, side by side: as a Spark plan (used by the
registered queries) and as DuckDB SQL (used by the oracles). Both read the
whole tables; nothing is sampled.

* ``pos_lines``  — lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region ⋈ orders.
  One sale line per lineitem row; outlet = supplier nation; dates are midnight.
* ``pos_events`` — events ⋈ customer ⋈ nation ⋈ region ⋈ part. Real times of
  day; outlet = customer nation; weather comes from ``weather_hourly``.
* ``weather_hourly`` — one archive-style reading per event (code picked from
  the WMO list by the event's ``k``, precipitation = value / 100 mm).
* ``branches`` / ``recipes`` / calendars — dimensions derived from nation,
  region, part and the fact's own year range.
* ``raw_pos`` — lineitem re-expressed as the 17 raw text columns (ingest input).
* ``forecast_weather_docs`` — forecast-service style documents, one per event
  (a single 3-hourly entry: time, main condition, temperature, rain chance).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.text import sku_from_name
from ..session import cut_lineage

MONEY = "decimal(18,2)"

# WMO codes assigned to events by k mod 16 (test-view rule).
WMO_CODES = [0, 1, 2, 3, 45, 48, 51, 53, 55, 61, 63, 65, 80, 95, 96, 99]
# Month-day of the fixed-date holidays of the test calendar.
TEST_HOLIDAY_MONTH_DAYS = ["01-01", "05-01", "08-31", "09-16", "12-25"]
# Forecast-service main conditions assigned to events by k mod 8 (test-view rule).
FORECAST_MAINS = ["Clear", "Clouds", "Rain", "Thunderstorm", "Mist", "Drizzle", "Haze", "Snow"]
# Test season: one window per year, March 1 .. March 30 ("Season YYYY").
TEST_SEASON_START, TEST_SEASON_END = "03-01", "03-30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _branch_code(nationkey) -> F.Column:
    return F.concat(F.lit("BR"), F.lpad(nationkey.cast("string"), 2, "0"))


def _time_parts(ts) -> list:
    d = ts.cast("date")
    return [
        ts.alias("transaction_ts"),
        d.alias("transaction_date"),
        F.date_format(ts, "HH:mm:ss").alias("transaction_time"),
        F.hour(ts).cast("int").alias("hour"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MM").alias("month"),
    ]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region: 25 rows by definition — a proven-small broadcast side."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", "n_name", "n_regionkey", "r_name"))


def pos_lines(spark: SparkSession, sf_dir: str, calendar: DataFrame | None = None, payment: bool = True) -> DataFrame:
    """The sales view. ``payment=False`` leaves out payment_method, the one column that needs lineitem joined to
    orders; without a ``calendar`` the holiday flag is an expression on the date. So neither costs
    a query that doesn't ask for it."""
    li = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    g = geo(spark, sf_dir)
    # part / supplier / orders grow with the data: no hint, the planner (and
    # AQE at runtime) chooses broadcast only when the measured side is small.
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(supp, li.l_suppkey == supp.s_suppkey)
         .join(g, F.col("s_nationkey") == g.n_nationkey))
    if payment:
        orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        j = j.join(orders, li.l_orderkey == orders.o_orderkey)
    gross = F.col("l_extendedprice").cast(MONEY)
    disc = F.round(gross * F.col("l_discount").cast("decimal(4,2)"), 2).cast(MONEY)
    tax = F.round(gross * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY)
    item = F.upper(F.trim(F.col("p_name")))
    pct = F.round(F.col("l_discount") * 100).cast("int")
    out = j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        _branch_code(F.col("s_nationkey")).alias("branch_id"),
        *_time_parts(F.col("l_shipdate")),
        item.alias("item_name"),
        sku_from_name(item).alias("product_id"),
        F.col("p_type").alias("product_category"),
        F.replace(F.col("p_name"), F.lit("cold"), F.lit("iced")).alias("product_detail"),
        F.col("l_quantity").cast("int").alias("transaction_qty"),
        F.col("l_returnflag").alias("order_type"),
        gross.alias("gross_sales"),
        disc.alias("discount_amount"),
        F.when(F.col("l_discount") == 0, F.lit("NONE"))
         .otherwise(F.concat(F.lit("DISC_"), F.lpad(pct.cast("string"), 2, "0"))).alias("promo_code"),
        tax.alias("sst_amount"),
        (gross - disc).cast(MONEY).alias("total_bill"),
        *([F.col("o_orderpriority").alias("payment_method")] if payment else []),
        F.col("n_name").alias("store_location"),
        F.col("r_name").alias("location_type"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("state"),
        F.lit("Cloudy").alias("weather_condition"),
    )
    if calendar is None:
        return out.withColumn("is_public_holiday", fixed_holiday(F.col("transaction_date")))
    return add_holiday_flag(out, calendar)


def fixed_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """The test calendar's holidays of some years, without reading data."""
    import datetime as _dt
    rows = [(_dt.date(y, int(md[:2]), int(md[3:])), f"Holiday {md}")
            for y in range(first_year, last_year + 1) for md in TEST_HOLIDAY_MONTH_DAYS]
    return spark.createDataFrame(rows, "holiday_date date, holiday_name string")


def fixed_holiday(day: F.Column) -> F.Column:
    """The flag of the test calendar, whose holidays fall on the same dates every year."""
    return F.date_format(day, "MM-dd").isin(TEST_HOLIDAY_MONTH_DAYS).cast("int")


def pos_events(spark: SparkSession, sf_dir: str, calendar: DataFrame | None = None,
               weather_daily: DataFrame | None = None) -> DataFrame:
    from ..operators.weather_ops import attach_weather, daylight_conditions

    ev = read(spark, sf_dir, "events")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    g = geo(spark, sf_dir)
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    j = (ev.join(cust, ev.user_id == cust.c_custkey)
         .join(part, k == part.p_partkey)
         .join(g, F.col("c_nationkey") == g.n_nationkey))
    item = F.upper(F.trim(F.col("p_name")))
    amount = F.col("value").cast(MONEY)
    out = j.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        _branch_code(F.col("c_nationkey")).alias("branch_id"),
        *_time_parts(F.col("ts")),
        item.alias("item_name"),
        sku_from_name(item).alias("product_id"),
        F.col("p_type").alias("product_category"),
        F.replace(F.col("p_name"), F.lit("cold"), F.lit("iced")).alias("product_detail"),
        (F.col("event_id") % 4 + 1).cast("int").alias("transaction_qty"),
        F.col("event_type").alias("order_type"),
        amount.alias("gross_sales"),
        F.lit(0).cast(MONEY).alias("discount_amount"),
        F.lit("NONE").alias("promo_code"),
        F.lit(0).cast(MONEY).alias("sst_amount"),
        amount.alias("total_bill"),
        F.upper(F.col("event_type")).alias("payment_method"),
        F.col("n_name").alias("store_location"),
        F.col("r_name").alias("location_type"),
        F.col("n_name").alias("district"),
        F.col("r_name").alias("state"),
    )
    if weather_daily is None:
        weather_daily = daylight_conditions(weather_hourly(spark, sf_dir))
    out = attach_weather(out, weather_daily)
    if calendar is None:
        return out.withColumn("is_public_holiday", fixed_holiday(F.col("transaction_date")))
    return add_holiday_flag(out, calendar)


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    codes = F.array(*[F.lit(c) for c in WMO_CODES])
    return (ev.join(cust, ev.user_id == cust.c_custkey)
            .select(_branch_code(F.col("c_nationkey")).alias("branch_id"),
                    F.col("ts").alias("time"),
                    F.col("ts").cast("date").alias("date"),
                    F.hour("ts").cast("int").alias("hour"),
                    F.element_at(codes, (k % 16 + 1).cast("int")).alias("weathercode"),
                    (F.col("value").cast(MONEY) * F.lit(0.01).cast("decimal(3,2)")).alias("precipitation")))


def forecast_weather_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast document per event with a single entry. Temperatures step
    by 0.5 °C and rain chances by 0.25 (every 13th event has none), so means
    and band thresholds are exact in any engine."""
    ev = read(spark, sf_dir, "events")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    mains = F.array(*[F.lit(m) for m in FORECAST_MAINS])
    eid = F.col("event_id")
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt_txt"),
        F.array(F.struct(F.element_at(mains, (k % len(FORECAST_MAINS) + 1).cast("int")).alias("main"))).alias("weather"),
        F.struct(((eid % 20).cast("double") * F.lit(0.5) + F.lit(24.0)).alias("temp")).alias("main"),
        F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise((eid % 5).cast("double") * F.lit(0.25)).alias("pop"))
    return (ev.join(cust, ev.user_id == cust.c_custkey)
            .select(_branch_code(F.col("c_nationkey")).alias("branch_id"), F.array(entry).alias("list")))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlet dimension: one outlet per nation; region 4 outlets are inactive."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").cast("int").alias("branch_pk"),
                    _branch_code(F.col("n_nationkey")).alias("branch_code"),
                    F.col("n_name").alias("branch_name"),
                    F.col("r_name").alias("location_type"),
                    F.col("n_nationkey").cast("double").alias("latitude"),
                    F.col("n_regionkey").cast("double").alias("longitude"),
                    F.col("n_name").alias("district"),
                    F.col("r_name").alias("state"),
                    F.concat(F.lit("Outlet in "), F.col("n_name")).alias("description"),
                    F.lit(0.0).alias("holiday_effect"),
                    F.when(F.col("n_regionkey") == 4, 0).otherwise(1).cast("int").alias("is_active")))


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe registry: one recipe per distinct product name (its lowest part
    key decides the amounts); names starting with 'new ' have no recipe.
    Custom ingredients use both JSON forms: a number with the unit in the
    name, and {"val", "unit"}."""
    p = read(spark, sf_dir, "part")
    first = (p.groupBy("p_name")
             .agg(F.min_by(F.struct("p_size", "p_type", "p_brand", "p_retailprice"), F.col("p_partkey")).alias("r"))
             .filter(~F.col("p_name").startswith("new ")))
    size = F.col("r.p_size").cast("double")
    name = F.col("p_name")
    custom = F.concat(
        F.lit('{"'), F.col("r.p_type"), F.lit(' Syrup (ml)": '), (F.col("r.p_size") % 10).cast("string"),
        F.lit(', "'), F.col("r.p_brand"), F.lit('": {"val": '), (F.col("r.p_size") / 10).cast("int").cast("string"), F.lit("."),
        (F.col("r.p_size") % 10).cast("string"),
        F.lit(', "unit": "g"}}'))
    return first.select(
        F.upper(F.trim(name)).alias("item_name"),
        size.alias("beans_g"),
        (size * 4).alias("milk_ml"),
        F.when(F.col("r.p_type") == "PROMO", size / 2).otherwise(0.0).alias("choco_g"),
        F.when(name.startswith("cold "), size * 2).otherwise(0.0).alias("ice_g"),
        F.when(F.col("r.p_type") == "LARGE", F.lit(5.0)).otherwise(0.0).alias("whip_g"),
        F.when(name.startswith("cold "), F.lit("Cold")).when(name.startswith("hot "), F.lit("Hot"))
         .otherwise(F.lit("Other")).alias("cup_type"),
        custom.alias("custom_ingredients"),
        F.lit(1).alias("is_active"),
    )


def date_source(spark: SparkSession, sf_dir: str, view: str = "pos_lines") -> DataFrame:
    """The raw date column behind a view (for deriving calendars cheaply)."""
    if view == "pos_lines":
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
            F.col("l_shipdate").cast("date").alias("transaction_date"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("date").alias("transaction_date"))


def _year_range(dates: DataFrame, date_col: str) -> tuple[int, int]:
    r = dates.agg(F.min(F.year(date_col)), F.max(F.year(date_col))).first()  # two numbers
    return int(r[0]), int(r[1])


def holiday_calendar_from(dates: DataFrame, date_col: str = "transaction_date") -> DataFrame:
    """Fixed-date holidays for every year the data spans. The year range is
    one two-number aggregate; the calendar itself is a tiny local table
    (years × 5 rows), so joins with it never re-read the data."""
    import datetime as _dt
    y0, y1 = _year_range(dates, date_col)
    rows = [(_dt.date(y, int(md[:2]), int(md[3:])), f"Holiday {md}")
            for y in range(y0, y1 + 1) for md in TEST_HOLIDAY_MONTH_DAYS]
    return dates.sparkSession.createDataFrame(rows, "holiday_date date, holiday_name string")


def season_calendar_from(dates: DataFrame, date_col: str = "transaction_date") -> DataFrame:
    """One season window per year the data spans: Season YYYY = Mar 1 .. Mar 30."""
    import datetime as _dt
    y0, y1 = _year_range(dates, date_col)
    sm, sd = (int(x) for x in TEST_SEASON_START.split("-"))
    em, ed = (int(x) for x in TEST_SEASON_END.split("-"))
    rows = [(f"Season {y}", y, _dt.date(y, sm, sd), _dt.date(y, em, ed)) for y in range(y0, y1 + 1)]
    return dates.sparkSession.createDataFrame(rows, "season_name string, season_year int, start_date date, end_date date")


def add_holiday_flag(fact: DataFrame, calendar: DataFrame, date_col: str = "transaction_date") -> DataFrame:
    """is_public_holiday = date ∈ calendar (calendar is bounded: days × years)."""
    hol = F.broadcast(calendar.select(F.col("holiday_date").alias("_hd")).distinct())
    return (fact.join(hol, F.col(date_col) == F.col("_hd"), "left")
            .withColumn("is_public_holiday", F.when(F.col("_hd").isNotNull(), 1).otherwise(0).cast("int"))
            .drop("_hd"))


def _export(day: str) -> F.Column:
    return F.concat(F.lit("pos_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv"))


def _stamp(day: str) -> F.Column:
    return F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns behind ``raw_pos``: lineitem ⋈ part ⋈ supplier ⋈ orders."""
    li = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(supp, li.l_suppkey == supp.s_suppkey)
         .join(orders, li.l_orderkey == orders.o_orderkey))
    return j.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                    "s_nationkey", "p_name", "p_type", "o_orderpriority")


def raw_pos(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    """lineitem as raw 17-column POS text rows plus a ``source_file`` (one
    export per ship day). Transaction_ID = orderkey-linenumber, which repeats
    within some days and across many. ``staged`` writes the joined columns once, for callers that read the
    rows more than once."""
    j = raw_lines(spark, sf_dir)
    return raw_texts(cut_lineage(j, "raw-pos") if staged else j)


def raw_texts(j: DataFrame) -> DataFrame:
    """``raw_lines`` as texts."""
    gross = F.col("l_extendedprice").cast(MONEY)
    disc = F.round(gross * F.col("l_discount").cast("decimal(4,2)"), 2).cast(MONEY)
    s = lambda c: c.cast("string")
    return j.select(
        _export("l_shipdate").alias("source_file"),
        F.concat(s(F.col("l_orderkey")), F.lit("-"), s(F.col("l_linenumber"))).alias("Transaction_ID"),
        _stamp("l_shipdate").alias("Timestamp"),
        F.concat(F.lit("REG"), s(F.col("l_linenumber"))).alias("Register_ID"),
        F.lit("Cashier").alias("Cashier_Name"),
        F.lower(_branch_code(F.col("s_nationkey"))).alias("Store_ID"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("Item_Name"),
        F.col("p_type").alias("Item_Category"),
        s(F.col("l_quantity").cast("int")).alias("Quantity_Sold"),
        F.concat(F.lit('["'), F.col("p_name"), F.lit('"]')).alias("Modifiers"),
        F.col("l_returnflag").alias("Order_Type"),
        s(gross).alias("Gross_Sales"),
        s(gross - disc).alias("Net_Sales"),
        s(disc).alias("Discount_Amount"),
        s(F.round(gross * F.col("l_tax").cast("decimal(4,2)"), 2)).alias("Tax_Amount"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("disc_"), s(F.round(F.col("l_discount") * 100).cast("int")))).alias("Promo_Code"),
        F.lit("None").alias("Discount_Reason"),
        F.lower(F.col("o_orderpriority")).alias("Payment_Type"),
    )


# ---------------------------------------------------------------------------
# DuckDB definitions of the same views (oracle side). Keep in step with the
# Spark plans above.
# ---------------------------------------------------------------------------

_SKU_SQL = "'SKU-' || lpad(CAST(('0x' || substr(md5({x}), 1, 8))::BIGINT % 10000 AS VARCHAR), 4, '0')"


def _time_sql(ts: str) -> str:
    d = f"CAST({ts} AS DATE)"
    return (f"{ts} AS transaction_ts, {d} AS transaction_date, strftime({ts}, '%H:%M:%S') AS transaction_time, "
            f"CAST(hour({ts}) AS INTEGER) AS hour, dayname({d}) AS day_name, monthname({d}) AS month_name, "
            f"strftime({d}, '%m') AS month")


_HOLIDAY_SQL = "(" + ", ".join(f"'{x}'" for x in TEST_HOLIDAY_MONTH_DAYS) + ")"

POS_LINES_SQL = f"""
pos_lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
         'BR' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS branch_id,
         {_time_sql('l_shipdate')},
         upper(trim(p_name)) AS item_name,
         {_SKU_SQL.format(x='upper(trim(p_name))')} AS product_id,
         p_type AS product_category,
         replace(p_name, 'cold', 'iced') AS product_detail,
         CAST(l_quantity AS INTEGER) AS transaction_qty,
         l_returnflag AS order_type,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS discount_amount,
         CASE WHEN l_discount = 0 THEN 'NONE'
              ELSE 'DISC_' || lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 2, '0') END AS promo_code,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS sst_amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              - round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS total_bill,
         o_orderpriority AS payment_method,
         n_name AS store_location, r_name AS location_type, n_name AS district, r_name AS state,
         'Cloudy' AS weather_condition,
         CASE WHEN strftime(CAST(l_shipdate AS DATE), '%m-%d') IN {_HOLIDAY_SQL} THEN 1 ELSE 0 END AS is_public_holiday
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

WEATHER_HOURLY_SQL = f"""
weather_hourly AS (
  SELECT 'BR' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS branch_id,
         ts AS time, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
         ([{', '.join(str(c) for c in WMO_CODES)}])[CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 + 1] AS weathercode,
         CAST(value AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS precipitation
  FROM events JOIN customer ON user_id = c_custkey
),
weather_daily AS (
  SELECT branch_id, date,
         CASE WHEN sum(precipitation) < 2.5
                   THEN CASE WHEN count(CASE WHEN weathercode IN (3, 45, 48, 51, 53, 55) THEN 1 END)
                                > count(CASE WHEN weathercode IN (0, 1, 2) THEN 1 END)
                             THEN 'Cloudy' ELSE 'Fair / Sunny' END
              WHEN count(CASE WHEN weathercode IN (95, 96, 99) THEN 1 END) > 0 THEN 'Thunderstorm'
              ELSE 'Raining' END AS weather_condition
  FROM weather_hourly WHERE hour BETWEEN 7 AND 19
  GROUP BY branch_id, date
)"""

POS_EVENTS_SQL = f"""
{WEATHER_HOURLY_SQL.strip()},
pos_events_base AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         'BR' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS branch_id,
         {_time_sql('ts')},
         upper(trim(p_name)) AS item_name,
         {_SKU_SQL.format(x='upper(trim(p_name))')} AS product_id,
         p_type AS product_category,
         replace(p_name, 'cold', 'iced') AS product_detail,
         CAST(event_id % 4 + 1 AS INTEGER) AS transaction_qty,
         event_type AS order_type,
         CAST(value AS DECIMAL(18,2)) AS gross_sales,
         CAST(0 AS DECIMAL(18,2)) AS discount_amount,
         'NONE' AS promo_code,
         CAST(0 AS DECIMAL(18,2)) AS sst_amount,
         CAST(value AS DECIMAL(18,2)) AS total_bill,
         upper(event_type) AS payment_method,
         n_name AS store_location, r_name AS location_type, n_name AS district, r_name AS state
  FROM events
  JOIN customer ON user_id = c_custkey
  JOIN part ON CAST(json_extract_string(props, '$.k') AS BIGINT) = p_partkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
pos_events AS (
  SELECT b.*, coalesce(w.weather_condition, 'Cloudy') AS weather_condition,
         CASE WHEN strftime(b.transaction_date, '%m-%d') IN {_HOLIDAY_SQL} THEN 1 ELSE 0 END AS is_public_holiday
  FROM pos_events_base b LEFT JOIN weather_daily w
    ON b.branch_id = w.branch_id AND b.transaction_date = w.date
)"""

FORECAST_SLOTS_SQL = f"""
forecast_slots AS (
  SELECT 'BR' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS branch_id,
         CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
         ([{', '.join(repr(m) for m in FORECAST_MAINS)}])[CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(FORECAST_MAINS)} + 1] AS main,
         CAST(event_id % 20 AS DOUBLE) * 0.5 + 24.0 AS temp,
         coalesce(CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) * 0.25 END, 0.0) * 100 AS pop
  FROM events JOIN customer ON user_id = c_custkey
)"""

SEASONS_SQL_TEMPLATE = """
seasons_{v} AS (
  SELECT 'Season ' || CAST(y AS VARCHAR) AS season_name, y AS season_year,
         make_date(y, 3, 1) AS start_date, make_date(y, 3, 30) AS end_date
  FROM (SELECT unnest(range(min(year(transaction_date)), max(year(transaction_date)) + 1)) AS y FROM {v})
)"""

BRANCHES_SQL = """
branches AS (
  SELECT CAST(n_nationkey AS INTEGER) AS branch_pk,
         'BR' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS branch_code,
         n_name AS branch_name, r_name AS location_type, n_name AS district, r_name AS state,
         0.0 AS holiday_effect, CASE WHEN n_regionkey = 4 THEN 0 ELSE 1 END AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""


def with_views(body: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs it needs (``pos_lines``, ``pos_events``…)."""
    parts = []
    for v in views:
        if v == "pos_lines":
            parts.append(POS_LINES_SQL.strip())
        elif v == "pos_events":
            parts.append(POS_EVENTS_SQL.strip())
        elif v == "branches":
            parts.append(BRANCHES_SQL.strip())
        elif v == "forecast_like":
            parts.append(FORECAST_LIKE_SQL.strip())
        elif v == "recipes":
            parts.append(RECIPES_SQL.strip())
        elif v == "raw_pos":
            parts.append(RAW_POS_SQL.strip())
        elif v == "raw_damaged":
            parts.append(RAW_DAMAGED_SQL.strip())
        elif v == "pos_offers":
            parts.append(POS_OFFERS_SQL.strip())
        elif v == "pos_young":
            parts.append(POS_YOUNG_SQL.strip())
        elif v == "pos_recent":
            parts.append(POS_RECENT_SQL.strip())
        elif v == "long_turns":
            parts.append(LONG_TURNS_SQL.strip())
        elif v == "forecast_prior":
            parts.append(FORECAST_PRIOR_SQL.strip())
        elif v == "forecast_slots":
            parts.append(FORECAST_SLOTS_SQL.strip())
        elif v.startswith("seasons_"):
            parts.append(SEASONS_SQL_TEMPLATE.format(v=v[len("seasons_"):]).strip())
        else:
            raise ValueError(v)
    body = body.strip()
    if body[:4].upper() == "WITH":  # merge the query's own CTEs after the views
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body

RAW_POS_SQL = """
raw_pos AS (
  SELECT 'pos_' || strftime(l_shipdate, '%Y-%m-%d') || '.csv' AS source_file,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS Transaction_ID,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS Timestamp,
         'REG' || CAST(l_linenumber AS VARCHAR) AS Register_ID, 'Cashier' AS Cashier_Name,
         lower('BR' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS Store_ID,
         ' ' || p_name || ' ' AS Item_Name, p_type AS Item_Category,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS Quantity_Sold,
         '["' || p_name || '"]' AS Modifiers, l_returnflag AS Order_Type,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS Gross_Sales,
         CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2))
              - round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS Net_Sales,
         CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS Discount_Amount,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS VARCHAR) AS Tax_Amount,
         CASE WHEN l_discount = 0 THEN NULL ELSE 'disc_' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) END AS Promo_Code,
         'None' AS Discount_Reason, lower(o_orderpriority) AS Payment_Type
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey
)"""

RECIPES_SQL = """
rp AS (SELECT p_name, arg_min(p_size, p_partkey) AS sz, arg_min(p_type, p_partkey) AS ty,
              arg_min(p_brand, p_partkey) AS br FROM part GROUP BY p_name),
recipes AS (
  SELECT upper(trim(p_name)) AS item_name, CAST(sz AS DOUBLE) AS beans_g, CAST(sz AS DOUBLE) * 4 AS milk_ml,
         CASE WHEN ty = 'PROMO' THEN sz / 2 ELSE 0.0 END AS choco_g,
         CASE WHEN p_name LIKE 'cold %' THEN CAST(sz AS DOUBLE) * 2 ELSE 0.0 END AS ice_g,
         CASE WHEN ty = 'LARGE' THEN 5.0 ELSE 0.0 END AS whip_g,
         CASE WHEN p_name LIKE 'cold %' THEN 'Cold' WHEN p_name LIKE 'hot %' THEN 'Hot' ELSE 'Other' END AS cup_type,
         '{"' || ty || ' Syrup (ml)": ' || CAST(sz % 10 AS VARCHAR) || ', "' || br || '": {"val": '
           || CAST(sz // 10 AS VARCHAR) || '.' || CAST(sz % 10 AS VARCHAR) || ', "unit": "g"}}' AS custom_ingredients,
         1 AS is_active
  FROM rp WHERE p_name NOT LIKE 'new %'
)"""


FORECAST_LEAD_DAYS = 120


def forecast_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored forecast per (branch, date) derived from orders, FORECAST_LEAD_DAYS
    ahead, so it runs past the last sale: predicted = 1 % of the day's order
    value of the branch's customers; bounds ×0.8 / ×1.2."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per = (o.join(c, o.o_custkey == c.c_custkey)
           .groupBy(_branch_code(F.col("c_nationkey")).alias("branch_id"),
                    F.date_add(F.col("o_orderdate").cast("date"), FORECAST_LEAD_DAYS).alias("forecast_date"))
           .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("_t")))
    pred = F.round(F.col("_t") * F.lit(0.01).cast("decimal(3,2)"), 2)
    return per.select("branch_id", "forecast_date", pred.alias("predicted_revenue"),
                      F.round(pred * F.lit(0.8).cast("decimal(2,1)"), 2).alias("lower_bound_revenue"),
                      F.round(pred * F.lit(1.2).cast("decimal(2,1)"), 2).alias("upper_bound_revenue"))


FORECAST_LIKE_SQL = """
forecast_like AS (
  SELECT branch_id, forecast_date, pred AS predicted_revenue, round(pred * CAST(0.8 AS DECIMAL(2,1)), 2) AS lower_bound_revenue,
         round(pred * CAST(1.2 AS DECIMAL(2,1)), 2) AS upper_bound_revenue
  FROM (SELECT 'BR' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS branch_id, CAST(o_orderdate AS DATE) + 120 AS forecast_date,
               round(sum(CAST(o_totalprice AS DECIMAL(18,2))) * CAST(0.01 AS DECIMAL(3,2)), 2) AS pred
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
)"""


# ---------------------------------------------------------------------------
# A damaged batch: raw_pos with every fault an upload can have, dealt out by the file's
# day of the year (a file is a ship day) and the line number.
# ---------------------------------------------------------------------------

#: Fault of a file by its day of the year modulo 9 (test-view rule).
FILE_FAULTS = ["none", "bad rows", "day first", "month first", "bad stamp", "all invalid", "unknown outlets", "missing column", "mixed outlets"]


def raw_damaged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, files): the raw rows with faults, and the file list with ``missing_columns``, ``file_size`` and ``modified``; one
    header-only file a year has no rows. The joined rows are staged once, and so is the list of the files that have rows."""
    lines = cut_lineage(raw_lines(spark, sf_dir), "raw-pos")
    raw = raw_texts(lines)
    day = F.to_date(F.substring("Timestamp", 1, 10))
    fault = F.dayofyear("_day") % len(FILE_FAULTS)
    line = F.substring("Register_ID", 4, 9).cast("int")
    r = raw.withColumn("_day", day).withColumn("_fault", fault).withColumn("_line", line)
    is_ = lambda name: F.col("_fault") == FILE_FAULTS.index(name)
    none = F.lit(None).cast("string")
    rows = r.select(
        "source_file",
        F.when(is_("bad rows") & (F.col("_line") == 1), none).otherwise(F.col("Transaction_ID")).alias("Transaction_ID"),
        F.when(is_("day first"), F.date_format("_day", "dd/MM/yyyy HH:mm"))
         .when(is_("month first"), F.date_format("_day", "MM/dd/yyyy HH:mm"))
         .when(is_("bad stamp") & (F.col("_line") == 2), F.lit("yesterday")).otherwise(F.col("Timestamp")).alias("Timestamp"),
        "Register_ID", "Cashier_Name",
        F.when(is_("unknown outlets"), F.lit("zz-99"))
         .when(is_("mixed outlets") & (F.col("_line") == 3), F.concat(F.lit("zz-"), F.col("Register_ID"))).otherwise(F.col("Store_ID")).alias("Store_ID"),
        "Item_Name", "Item_Category",
        F.when(is_("all invalid") | (is_("bad rows") & (F.col("_line") == 2)), F.lit("0"))
         .when(is_("bad rows") & (F.col("_line") == 3), F.lit("many")).otherwise(F.col("Quantity_Sold")).alias("Quantity_Sold"),
        "Modifiers", "Order_Type", "Gross_Sales", "Discount_Amount", "Promo_Code", "Discount_Reason",
        F.when(is_("missing column"), none).otherwise(F.col("Tax_Amount")).alias("Tax_Amount"), "Net_Sales", "Payment_Type")
    # item names are summed by ship time before files are named
    sizes = lines.groupBy("l_shipdate").agg(F.sum(F.length("p_name") + 2).alias("_size"))
    named = sizes.select(_export("l_shipdate").alias("source_file"), _stamp("l_shipdate").alias("Timestamp"), "_size")
    named = named.withColumn("_day", day).withColumn("_fault", fault)
    per = cut_lineage(named.groupBy("source_file", "_day", "_fault").agg(F.sum("_size").alias("file_size")), "raw-files")
    empty = F.array().cast("array<string>")
    files = per.select("source_file", F.when(is_("missing column"), F.array(F.lit("Tax_Amount"))).otherwise(empty).alias("missing_columns"),
                       "file_size", F.col("_day").cast("timestamp_ntz").alias("modified"))
    headers = per.select(F.year("_day").alias("_y")).distinct().select(
        F.format_string("pos_%d-header.csv", F.col("_y")).alias("source_file"), empty.alias("missing_columns"),
        F.lit(300).cast("long").alias("file_size"), F.make_date(F.col("_y"), F.lit(12), F.lit(31)).cast("timestamp_ntz").alias("modified"))
    return rows, files.unionByName(headers)


_F = {name: i for i, name in enumerate(FILE_FAULTS)}
RAW_DAMAGED_SQL = f"""
rd AS (SELECT *, CAST(substr(Timestamp, 1, 10) AS DATE) AS d, dayofyear(CAST(substr(Timestamp, 1, 10) AS DATE)) % {len(FILE_FAULTS)} AS f,
              CAST(substr(Register_ID, 4) AS INTEGER) AS ln FROM raw_pos),
raw_damaged AS (
  SELECT source_file, CASE WHEN f = {_F['bad rows']} AND ln = 1 THEN NULL ELSE Transaction_ID END AS Transaction_ID,
         CASE WHEN f = {_F['day first']} THEN strftime(d, '%d/%m/%Y 00:00') WHEN f = {_F['month first']} THEN strftime(d, '%m/%d/%Y 00:00')
              WHEN f = {_F['bad stamp']} AND ln = 2 THEN 'yesterday' ELSE Timestamp END AS Timestamp,
         CASE WHEN f = {_F['unknown outlets']} THEN 'zz-99' WHEN f = {_F['mixed outlets']} AND ln = 3 THEN 'zz-' || Register_ID ELSE Store_ID END AS Store_ID,
         Item_Name,
         CASE WHEN f = {_F['all invalid']} OR (f = {_F['bad rows']} AND ln = 2) THEN '0' WHEN f = {_F['bad rows']} AND ln = 3 THEN 'many'
              ELSE Quantity_Sold END AS Quantity_Sold, Gross_Sales, Net_Sales, Item_Category, Modifiers, Order_Type, Discount_Amount, Promo_Code,
         CASE WHEN f = {_F['missing column']} THEN NULL ELSE Tax_Amount END AS Tax_Amount, Payment_Type
  FROM rd),
damaged_files AS (
  SELECT source_file, f = {_F['missing column']} AS lacks, sum(length(Item_Name)) AS file_size, CAST(d AS TIMESTAMP) AS modified FROM rd GROUP BY source_file, f, d
  UNION ALL SELECT DISTINCT 'pos_' || CAST(year(d) AS VARCHAR) || '-header.csv', false, 300, CAST(make_date(year(d), 12, 31) AS TIMESTAMP) FROM rd)"""


# ---------------------------------------------------------------------------
# Offers: pos_events with promotions of every class, dealt out by event id.
# ---------------------------------------------------------------------------

#: Promotion code and discount percent of an event by its id modulo 10 (test-view rule).
OFFERS = [("NONE", 0), ("NONE", 0), ("CAMPAIGN_RAYA_15", 15), ("B1F1_LATTE", 50), ("BUY1FREE1", 50), ("QTY_2FOR1", 45), ("CNY-SPECIAL", 12),
          ("DISC_10", 10), ("DEEPAVALI_FIX", 0), ("buy-1-free-1", 40)]


def pos_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pos_events(spark, sf_dir)
    at = (F.col("transaction_id").cast("long") % len(OFFERS) + 1).cast("int")
    pct = F.element_at(F.array(*[F.lit(p) for _, p in OFFERS]), at).cast("decimal(3,0)")
    disc = F.round(F.col("gross_sales") * pct * F.lit(0.01).cast("decimal(3,2)"), 2).cast(MONEY)
    return f.withColumns({"promo_code": F.element_at(F.array(*[F.lit(c) for c, _ in OFFERS]), at), "discount_amount": disc,
                          "total_bill": (F.col("gross_sales") - disc).cast(MONEY)})


_AT = f"[CAST(CAST(transaction_id AS BIGINT) % {len(OFFERS)} AS INTEGER) + 1]"
_OFF = f"CAST(round(gross_sales * CAST(([{', '.join(str(p) for _, p in OFFERS)}]){_AT} AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))"
POS_OFFERS_SQL = f"""
pos_offers AS (
  SELECT * REPLACE (([{', '.join(repr(c) for c, _ in OFFERS)}]){_AT} AS promo_code, {_OFF} AS discount_amount,
                    CAST(gross_sales - {_OFF} AS DECIMAL(18,2)) AS total_bill)
  FROM pos_events)"""


def forecast_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored forecast on the scale of the sales: each branch's revenue 364 days before; bounds x0.8 / x1.2."""
    per = (pos_lines(spark, sf_dir, payment=False).groupBy("branch_id", F.date_add("transaction_date", 364).alias("forecast_date"))
           .agg(F.sum("total_bill").cast(MONEY).alias("_t")))
    return per.select("branch_id", "forecast_date", F.col("_t").alias("predicted_revenue"),
                      F.round(F.col("_t") * F.lit(0.8).cast("decimal(2,1)"), 2).alias("lower_bound_revenue"),
                      F.round(F.col("_t") * F.lit(1.2).cast("decimal(2,1)"), 2).alias("upper_bound_revenue"))


FORECAST_PRIOR_SQL = """
forecast_prior AS (
  SELECT branch_id, forecast_date, t AS predicted_revenue, round(t * CAST(0.8 AS DECIMAL(2,1)), 2) AS lower_bound_revenue,
         round(t * CAST(1.2 AS DECIMAL(2,1)), 2) AS upper_bound_revenue
  FROM (SELECT branch_id, transaction_date + 364 AS forecast_date, CAST(sum(total_bill) AS DECIMAL(18,2)) AS t FROM pos_lines GROUP BY 1, 2))"""


# ---------------------------------------------------------------------------
# Young outlets, sales of the product calendars' years, and long chat turns.
# ---------------------------------------------------------------------------

#: Days of history an outlet gets per step of its number (test-view rule); outlet 01 sells on holidays only.
YOUNG_STEP = 40


def pos_young(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_lines where outlet k has only its last YOUNG_STEP * k days, and outlet 01 only its holidays."""
    f = pos_lines(spark, sf_dir, payment=False)
    last = date_source(spark, sf_dir).agg(F.max("transaction_date")).scalar()
    k = F.substring("branch_id", 3, 9).cast("int")
    young = F.col("transaction_date") > F.date_sub(last, k * YOUNG_STEP)
    return f.filter(F.when(k == 1, F.col("is_public_holiday") == 1).otherwise(young))


POS_YOUNG_SQL = f"""
pos_young AS (
  SELECT * FROM pos_lines
  WHERE CASE WHEN branch_id = 'BR01' THEN is_public_holiday = 1
             ELSE transaction_date > (SELECT max(transaction_date) FROM pos_lines) - CAST(CAST(substr(branch_id, 3) AS INTEGER) * {YOUNG_STEP} AS INTEGER) END)"""

#: 28 years: the same weekdays, in the years of the product calendars.
RECENT_MONTHS = 336


def pos_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_lines moved by 28 years, without time and calendar columns."""
    return pos_lines(spark, sf_dir, payment=False).select(
        "transaction_id", "branch_id", F.add_months("transaction_date", RECENT_MONTHS).alias("transaction_date"), "total_bill", "transaction_qty")


POS_RECENT_SQL = f"""
pos_recent AS (
  SELECT transaction_id, branch_id, CAST(transaction_date + INTERVAL {RECENT_MONTHS} MONTH AS DATE) AS transaction_date, total_bill, transaction_qty
  FROM pos_lines)"""


def long_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with a chart payload in every third turn and texts three times as long in every second conversation."""
    c = read(spark, sf_dir, "conversations")
    payload = F.concat(F.lit('[CHART_DATA={"labels": ["a", "b"], "data": [1, '), F.col("turn").cast("string"), F.lit("]}] "))
    body = F.when(F.col("conv_id") % 2 == 0, F.repeat("text", 3)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 1, F.concat(payload, body)).otherwise(body).alias("text"))


LONG_TURNS_SQL = """
long_turns AS (
  SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN '[CHART_DATA={"labels": ["a", "b"], "data": [1, ' || CAST(turn AS VARCHAR) || ']}] ' ELSE '' END
         || CASE WHEN conv_id % 2 = 0 THEN repeat(text, 3) ELSE text END AS text
  FROM conversations)"""
