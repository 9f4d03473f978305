"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def as_of_date(as_of: dt.date | None) -> Column:
    """The reporting date: the given one, else today."""
    return F.current_date() if as_of is None else F.lit(as_of)


def _forward_months(start: Column, end: Column) -> Column:
    partial = (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - partial


def whole_months(start: Column, end: Column) -> Column:
    """Completed months from start to end, toward zero when end comes first.

    ``months_between`` treats two month ends as whole months, which is not wanted here.
    """
    return F.when(end >= start, _forward_months(start, end)).when(
        end < start, -_forward_months(end, start)
    )


def months_to_default() -> Column:
    """From the disbursement, or else the approval, to the charge-off."""
    start = F.coalesce(F.col("disbursement_date"), F.col("approval_date"))
    return whole_months(start, F.col("chargeoff_date"))


def years_seasoned() -> Column:
    """Started years from approval to charge-off; 0 within the first month."""
    return F.ceil(whole_months(F.col("approval_date"), F.col("chargeoff_date")) / 12)
