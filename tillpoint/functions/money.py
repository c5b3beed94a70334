"""Exact money arithmetic.

Amounts arrive as float64. Summing doubles depends on partition order and
``round(double)`` differs between engines at .5, so money is cast to
DECIMAL(18,2) before any SUM and cast back to DOUBLE only at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c) -> Column:
    """Money column as DECIMAL(18,2)."""
    return _c(c).cast(MONEY)


def cents(c) -> Column:
    """Money as a LONG count of cents (exact for |x| < 9e13)."""
    return F.round(dec(c).cast("double") * 100).cast("long")


def dsum(c) -> Column:
    """Exact sum of a money column as DECIMAL(28,2); empty groups give NULL.

    Summed as LONG cents (a primitive add in the aggregation buffer instead
    of DECIMAL objects), rebuilt as DECIMAL once per group."""
    x = cents(c)
    # high and low parts summed apart: a LONG sum of whole cents would overflow at 9.2e18
    high, low = F.sum(F.shiftright(x, 13)), F.sum(x.bitwiseAND(F.lit(8191)))
    total = high.cast("decimal(28,0)") * F.lit(8192) + low.cast("decimal(28,0)")
    return (total.cast("decimal(28,0)") / 100).cast("decimal(28,2)")


def cents_total(c) -> Column:
    """Exact DECIMAL(28,2) total of a column of LONG cent partials (the second
    level of a two-level money aggregate)."""
    return (F.sum(_c(c).cast("decimal(28,0)")).cast("decimal(28,0)") / 100).cast("decimal(28,2)")


def edge(c, scale: int = 2) -> Column:
    """Round a DECIMAL result and hand it out as DOUBLE."""
    return F.round(_c(c), scale).cast("double")



def ratio(num, den) -> Column:
    """Safe division as DOUBLE (NULL on a zero or NULL denominator).

    Both operands are exact (DECIMAL sums, counts) before the single IEEE
    division, so the value is reproducible by any engine; rounding for
    display is left to the presentation layer."""
    d = _c(den).cast("double")
    return F.try_divide(_c(num).cast("double"), F.when(d != 0, d))


def exact_round(num, den, scale: int) -> Column:
    """Quotient of two money values, rounded HALF_UP once (for thresholds).

    Done on whole cents: a DECIMAL division would first round to its own scale, and the second
    rounding could then lift a value over a threshold. NULL on a zero or NULL denominator."""
    n, d = (_c(x).cast("decimal(28,2)") * 100 for x in (num, den))
    n, d = n.cast("decimal(29,0)") * F.sign(d).cast("decimal(1,0)"), F.abs(d).cast("decimal(29,0)")
    up = (F.abs(n) * (2 * 10 ** scale)).cast("decimal(38,0)") + d.cast("decimal(38,0)")
    twice = F.when(d != 0, (d * 2).cast("decimal(31,0)"))
    whole = F.call_function("div", up, twice)
    return (F.when(n < 0, -whole).otherwise(whole) / 10 ** scale).cast(f"decimal(28,{scale})")
