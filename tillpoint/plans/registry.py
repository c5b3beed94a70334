"""Query registry shared by the catalog modules.

``QUERIES[name] = (builder(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Every builder reads the whole given tables through the test views and runs
one library operator; the oracle is its DuckDB twin (None → rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


def money(expr: str) -> str:
    """Oracle twin of ``edge(dsum(x))``: exact DECIMAL sum as DOUBLE."""
    return f"CAST(sum({expr}) AS DOUBLE)"


def div(num: str, den: str) -> str:
    """Oracle twin of ``ratio``: double division, NULL on zero."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


REPORT_YEAR = 1998


def round_div(num: str, den: str, scale: int) -> str:
    """Oracle twin of ``exact_round`` for non-negative 2-dp money values:
    HALF_UP rounding of num/den done in integer (cent) arithmetic."""
    n = f"CAST(({num}) * 100 AS HUGEINT)"
    d = f"CAST(({den}) * 100 AS HUGEINT)"
    k = 10 ** scale
    return f"(CAST((2 * {n} * {k} + {d}) // NULLIF(2 * {d}, 0) AS DOUBLE) / {k})"


def promo_label(code: str) -> str:
    """Oracle twin of ``shorten_promo_code``."""
    up = f"upper({code})"
    for a in ("BOGOF", "BUY1FREE1", "BUY-1-FREE-1"):
        up = f"replace({up}, '{a}', 'B1F1')"
    spaced = f"trim(translate({up}, '_-', '  '))"
    titled = (f"array_to_string(list_transform(regexp_extract_all({spaced}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
              f"lambda r: upper(r[1]) || lower(r[2:])), '')")
    return (f"CASE WHEN {code} IS NULL OR {code} = '' OR {code} = 'NONE' THEN 'None' "
            f"ELSE replace({titled}, 'B1f1', 'B1F1') END")
