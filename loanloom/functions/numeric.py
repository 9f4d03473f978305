"""Exact ratios and roundings.

Decimal division in Spark rounds to a derived scale first, and doubles differ at ties, so a
ratio rounded to n places is done as one integer division. It runs on aggregated rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, Window, functions as F

WIDE = "decimal(38,2)"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num, den, digits: int = 2, scale: int = 1) -> Column:
    """``scale * num / den`` rounded half away from zero, as decimal; NULL for a zero divisor."""
    n = _col(num).cast(WIDE)
    d = F.nullif(_col(den).cast(WIDE), F.lit(Decimal("0.00")).cast(WIDE))
    # round(x / d) = floor((2x + d) / 2d). `div` would give a BIGINT, which can overflow unseen;
    # dividing an exact multiple keeps all digits.
    top = F.abs(n) * F.lit(2 * scale * 10**digits) + F.abs(d)
    bottom = F.abs(d) * F.lit(2)
    q = ((top - top % bottom) / bottom).cast("decimal(32,0)")
    q = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return (q * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(28,{digits})")


def pct(num, den, digits: int = 2) -> Column:
    """``num`` as a percentage of ``den``."""
    return ratio(num, den, digits, scale=100)


def mean(value, digits: int = 2) -> Column:
    """Rounded average over the non-NULL values of a group."""
    return ratio(F.sum(_col(value)), F.count(_col(value)), digits)


def rounded(value, digits: int) -> Column:
    """A double rounded half up as a decimal; six places first, to drop noise in the last bits."""
    return F.round(_col(value).cast("decimal(28,6)"), digits)


def share_of(value, window) -> Column:
    """``value`` as a percentage of its sum over ``window``."""
    return pct(_col(value), F.sum(_col(value)).over(window))


def everything():
    """Window over all rows. Only for aggregates of a few rows, never over loans."""
    return Window.partitionBy()


def currency(value) -> Column:
    """Report label of an amount: $1.2B, $3.4M or $5,678."""
    v = _col(value).cast("double")
    return (
        F.when(v >= 1e9, F.concat(F.lit("$"), F.format_number(v / 1e9, 1), F.lit("B")))
        .when(v >= 1e6, F.concat(F.lit("$"), F.format_number(v / 1e6, 1), F.lit("M")))
        .when(v.isNotNull(), F.concat(F.lit("$"), F.format_number(v, 0)))
    )
