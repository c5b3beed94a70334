"""Scalar text expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def python_title(c) -> Column:
    """Title case as Python's ``str.title``: a letter is upper-cased when the
    previous character is not a letter, lower-cased otherwise. (``initcap``
    only breaks on spaces: 'B1F1 10OFF' must become 'B1F1 10Off'.)"""
    runs = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))),
        "",
    )


def shorten_promo_code(c) -> Column:
    """Display label of a promo code.

    NULL / '' / 'NONE' → 'None'; BOGOF, BUY1FREE1, BUY-1-FREE-1 → B1F1;
    '_' and '-' → space; trim; Python-style title case; 'B1f1' → 'B1F1'.
    """
    code = _c(c)
    up = F.upper(code)
    # The three spellings that mean buy-one-free-one, in order.
    for alias in ("BOGOF", "BUY1FREE1", "BUY-1-FREE-1"):
        up = F.replace(up, F.lit(alias), F.lit("B1F1"))
    spaced = F.trim(F.translate(up, "_-", "  "))
    titled = F.replace(python_title(spaced), F.lit("B1f1"), F.lit("B1F1"))
    return F.when(code.isNull() | (code == "") | (code == "NONE"), F.lit("None")).otherwise(titled)


def sku_from_name(item) -> Column:
    """Deterministic 4-digit surrogate SKU from the item name: 'SKU-' +
    (first 32 bits of md5 as an integer) mod 10000, zero padded."""
    h = F.conv(F.substring(F.md5(_c(item)), 1, 8), 16, 10).cast("bigint") % 10000
    return F.concat(F.lit("SKU-"), F.lpad(h.cast("string"), 4, "0"))


def modifiers_text(c) -> Column:
    """Modifiers JSON → product detail text.

    A JSON list becomes its items joined by ', '; another valid JSON value
    keeps its JSON text; missing or invalid JSON gives ''.
    """
    raw = _c(c)
    as_list = F.from_json(raw, T.ArrayType(T.StringType()))
    as_obj = F.from_json(raw, T.MapType(T.StringType(), T.StringType()))
    return (F.when(as_list.isNotNull(), F.array_join(as_list, ", "))
            .when(as_obj.isNotNull(), F.trim(raw))
            .otherwise(F.lit("")))


def upper_trim(c) -> Column:
    return F.upper(F.trim(_c(c)))


# The chart payload marker and its replacement text.
CHART_MARKER_PATTERN = r"\[CHART_DATA=.*?\]"
CHART_PLACEHOLDER = "[Visual Chart Component Sent]"
# Payload-aware variant: the payload is a JSON object, so match up to the
# closing '}]' instead of the first ']' (which leaves a tail for nested arrays).
CHART_PAYLOAD_PATTERN = r"\[CHART_DATA=\{.*?\}\]"


def scrub_chart_payload(c, legacy: bool = False) -> Column:
    pattern = CHART_MARKER_PATTERN if legacy else CHART_PAYLOAD_PATTERN
    return F.regexp_replace(_c(c), pattern, CHART_PLACEHOLDER)


def sanitize_doubles(df: DataFrame) -> DataFrame:
    """NaN / ±Infinity → NULL in every double/float column (JSON-safe output)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = F.col(f.name)
            bad = F.isnan(col) | col.isin(float("inf"), float("-inf"))
            out.append(F.when(bad, F.lit(None).cast(f.dataType)).otherwise(col).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
