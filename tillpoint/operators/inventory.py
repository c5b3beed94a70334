"""Recipe explosion: item quantities → ingredient demand.

Items are keyed by any columns (branch, day, month …); the recipe registry is
a small dimension (one row per menu item) joined on the normalised name. Base
ingredients are unpivoted with ``stack``; custom ingredients come from a JSON
map whose values are either a number (unit written in the name, "Syrup (ml)")
or an object {"val", "unit"}; both normalise to "name (unit)". Amounts are
DECIMAL so sums are exact. Inactive recipes still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.text import upper_trim

AMT = "decimal(20,4)"
# Base ingredient columns with their units, and cup types.
BASE_INGREDIENTS = [("beans_g", "g"), ("milk_ml", "ml"), ("choco_g", "g"), ("ice_g", "g"), ("whip_g", "g")]
CUP_TYPES = [("Hot", "cup_hot"), ("Cold", "cup_cold")]
UNIT_IN_NAME = r"(?i)\((ml|g|pcs)\)"


def item_key(items: DataFrame) -> F.Column:
    """Item key: item_name when present, else product_id; upper/trim."""
    name = F.col("item_name") if "item_name" in items.columns else F.lit(None).cast("string")
    pid = F.col("product_id") if "product_id" in items.columns else F.lit(None).cast("string")
    return upper_trim(F.coalesce(F.nullif(name, F.lit("")), pid, F.lit("")))


def recipe_lines(recipes: DataFrame) -> DataFrame:
    """(_item, ingredient, unit, per_item): every recipe exploded into its
    base, cup and custom ingredient lines — work on the small dimension,
    not per sale."""
    r = recipes.select(upper_trim("item_name").alias("_item"),
                       *[F.col(c).cast(AMT).alias(c) for c, _ in BASE_INGREDIENTS],
                       "cup_type", "custom_ingredients")
    stack_args = ", ".join(f"'{c}', '{u}', {c}" for c, u in BASE_INGREDIENTS)
    base = r.select("_item", F.expr(f"stack({len(BASE_INGREDIENTS)}, {stack_args}) as (ingredient, unit, per_item)"))
    cups = r.select("_item",
                    F.when(F.col("cup_type") == CUP_TYPES[0][0], F.lit(CUP_TYPES[0][1]))
                     .when(F.col("cup_type") == CUP_TYPES[1][0], F.lit(CUP_TYPES[1][1])).alias("ingredient"),
                    F.lit("cup").alias("unit"), F.lit(1).cast(AMT).alias("per_item")).filter(F.col("ingredient").isNotNull())
    custom = custom_lines(r.select("_item", "custom_ingredients"))
    return base.unionByName(cups).unionByName(custom)


def ingredient_demand(items: DataFrame, recipes: DataFrame, keys: list[str], qty_col: str = "quantity") -> DataFrame:
    """Long table (keys…, ingredient, unit, amount) of summed demand.

    Items without a recipe are skipped. The item quantities are aggregated
    per (keys, item) before ONE join with the recipe lines, so the items
    are scanned once and the join sees one row per menu item and key."""
    q = (items.withColumn("_item", item_key(items))
         .groupBy(*keys, "_item").agg(F.sum(F.col(qty_col).cast(AMT)).alias("_qty")))
    j = q.join(small(recipe_lines(recipes)), "_item")
    return (j.groupBy(*keys, "ingredient", "unit")
            .agg(F.sum(F.col("_qty") * F.col("per_item")).alias("_amt"))
            .select(*keys, "ingredient", "unit", F.col("_amt").cast("double").alias("amount")))


def custom_lines(rows: DataFrame) -> DataFrame:
    """Explode the custom-ingredient JSON map into (ingredient, unit, per_item)."""
    keep = [c for c in rows.columns if c != "custom_ingredients"]
    m = F.from_json(F.coalesce(F.col("custom_ingredients"), F.lit("{}")), "map<string,string>")
    e = rows.select(*keep, F.explode(m).alias("_k", "_v"))
    is_obj = F.trim(F.col("_v")).startswith("{")
    new_val = F.coalesce(F.get_json_object("_v", "$.val").cast(AMT), F.lit(0).cast(AMT))
    new_unit = F.coalesce(F.get_json_object("_v", "$.unit"), F.lit("unit"))
    old_unit = F.lower(F.regexp_extract("_k", UNIT_IN_NAME, 1))
    old_name = F.trim(F.regexp_replace("_k", UNIT_IN_NAME, ""))
    name = F.when(is_obj, F.col("_k")).when(old_unit != "", old_name).otherwise(F.col("_k"))
    unit = F.when(is_obj, new_unit).when(old_unit != "", old_unit).otherwise(F.lit("unit"))
    val = F.when(is_obj, new_val).otherwise(F.coalesce(F.col("_v").try_cast(AMT), F.lit(0).cast(AMT)))
    return e.select(*keep, F.concat(name, F.lit(" ("), unit, F.lit(")")).alias("ingredient"),
                    F.lit("custom").alias("unit"), val.alias("per_item"))


def ops_units(demand: DataFrame) -> DataFrame:
    """Base ml → L and g → kg (÷1000, 2 dp); cups and custom unchanged."""
    ing, amt = F.col("ingredient"), F.col("amount")
    is_ml = (F.col("unit") == "ml")
    is_g = (F.col("unit") == "g")
    return demand.select(
        *[c for c in demand.columns if c not in ("ingredient", "unit", "amount")],
        F.when(is_ml, F.regexp_replace(ing, "_ml$", "_L")).when(is_g, F.regexp_replace(ing, "_g$", "_kg"))
         .otherwise(ing).alias("ingredient"),
        F.when(is_ml, F.lit("L")).when(is_g, F.lit("kg")).otherwise(F.col("unit")).alias("unit"),
        F.when(is_ml | is_g, F.round(amt.cast("decimal(30,4)") * F.lit(0.001).cast("decimal(4,3)"), 2).cast("double")).otherwise(amt).alias("amount"))


# Stock alert thresholds in operational units (manual).
STOCK_ALERTS = [("beans_kg", 5.0), ("milk_L", 30.0), ("ice_kg", 40.0)]


def stock_alerts(ops: DataFrame) -> DataFrame:
    """Rows whose operational demand exceeds the alert threshold."""
    th = ops.sparkSession.createDataFrame(STOCK_ALERTS, "ingredient string, threshold double")
    return ops.join(F.broadcast(th), "ingredient").filter(F.col("amount") > F.col("threshold"))


def display_unit(amount, unit) -> F.Column:
    """Display choice: base g/ml stay below 1000 (and above 0), else kg/L."""
    a = F.col(amount) if isinstance(amount, str) else amount
    u = F.col(unit) if isinstance(unit, str) else unit
    big = (a >= 1000) | (a <= 0)
    return (F.when(u.isin("g", "ml") & big,
                   F.concat(F.format_number(a / 1000, 2), F.lit(" "), F.when(u == "g", F.lit("kg")).otherwise(F.lit("L"))))
            .otherwise(F.concat(F.format_number(a, 2), F.lit(" "), u)))
