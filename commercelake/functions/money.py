"""Exact money.

Amounts travel as BIGINT cents, so sums and rate splits are long arithmetic inside
generated code; DECIMAL(18,2) appears only in results. Rounding is half-even.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column) -> Column:
    """Any number to DECIMAL(18,2), half-even."""
    return F.bround(col.cast("decimal(28,6)"), 2).cast("decimal(18,2)")


def cents(col: Column) -> Column:
    """Whole cents of a DOUBLE that carries at most two decimals.

    rint stays on the double; round would build a BigDecimal for every row.
    """
    return F.rint(col * F.lit(100.0)).cast("bigint")


def as_money(cents_col: Column) -> Column:
    return (cents_col.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def half_even_div(num: Column, den: int) -> Column:
    """num / den to the nearest integer, ties to even, for even den; the sign does not matter."""
    size = F.abs(num)
    q = _div(size, den)
    rest = size - q * F.lit(den)
    half = den // 2
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    return F.signum(num).cast("bigint") * (q + up.cast("bigint"))


def _div(num: Column, den: int) -> Column:
    return F.call_function("div", num, F.lit(den))


def percent_of(cents_col: Column, pct: Column | int) -> Column:
    """Whole-percent share of an amount in cents, rounded half-even to a cent."""
    pct = F.lit(pct) if isinstance(pct, int) else pct
    return half_even_div(cents_col * pct, 100)


def ratio(num: Column, den: Column, places: int = 4) -> Column:
    """num / den as DECIMAL with half-even rounding; NULL-free for an empty denominator."""
    value = F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)
    return F.bround(value.cast("decimal(28,12)"), places).cast(f"decimal(18,{places})")
