"""Bands and labels."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Upper or lower edges with the label of the band, and the last label.
LOAN_SIZES = [
    (50_000, "Micro (<$50K)"),
    (150_000, "Small ($50K-$150K)"),
    (350_000, "Medium ($150K-$350K)"),
    (1_000_000, "Large ($350K-$1M)"),
]
LARGEST_SIZE = "Jumbo (>$1M)"
TERMS = [
    (12, "Short (<=1yr)"),
    (60, "Medium (1-5yr)"),
    (120, "Long (5-10yr)"),
]
LONGEST_TERM = "Extended (>10yr)"
STAFF_SIZES = [(10, "Micro (1-10)"), (50, "Small (11-50)"), (250, "Medium (51-250)")]
LARGEST_STAFF = "Large (250+)"
STAFF_RANGES = [(0, "0 employees"), (10, "1-10"), (50, "11-50"), (100, "51-100"), (500, "101-500")]
GUARANTEES = [(90, "90-100%"), (80, "80-89%"), (75, "75-79%"), (50, "50-74%")]
LOWEST_GUARANTEE = "<50%"
SEVERITIES = [
    (25, "Low (1-24%)"),
    (50, "Medium (25-49%)"),
    (75, "High (50-74%)"),
    (100, "Severe (75-99%)"),
]
NO_LOSS = "No Loss (0%)"
TOTAL_LOSS = "Total Loss (100%)"
SEASONING = [
    (12, "0-12 months"),
    (24, "13-24 months"),
    (36, "25-36 months"),
    (48, "37-48 months"),
    (60, "49-60 months"),
    (84, "61-84 months"),
]
LONGEST_SEASONING = "85+ months"
PERIODS = [
    (2005, 2006, "Pre-2008 Crisis"),
    (2007, 2009, "During 2008 Crisis"),
    (2010, 2019, "Post-2008 Recovery"),
    (2020, 2020, "COVID Year"),
    (2021, 9999, "Post-COVID"),
]
OTHER_PERIOD = "Earlier Vintages"
NUMBERED_PERIODS = [
    (2005, 2006, "1. Pre-2008 Crisis"),
    (2007, 2009, "2. During Crisis"),
    (2010, 2019, "3. Post-Crisis Recovery"),
    (2020, 2020, "4. COVID Year"),
    (2021, 9999, "5. Post-COVID"),
]
OTHER_NUMBERED_PERIOD = "0. Earlier Vintages"

UNKNOWN = "Unknown"
SIZE_ORDER = [label for _, label in LOAN_SIZES] + [LARGEST_SIZE]
TERM_ORDER = [label for _, label in TERMS] + [LONGEST_TERM, UNKNOWN]
GUARANTEE_ORDER = [label for _, label in GUARANTEES] + [LOWEST_GUARANTEE]
SEVERITY_ORDER = [NO_LOSS] + [label for _, label in SEVERITIES] + [TOTAL_LOSS]
SEASONING_ORDER = [label for _, label in SEASONING] + [LONGEST_SEASONING]


def band(
    value: Column, compare: Callable, edges: Sequence[tuple[int, str]], last: str
) -> Column:
    """Label of the first edge for which ``compare(value, edge)`` holds; NULL gets ``last``."""
    label = F
    for edge, name in edges:
        label = label.when(compare(value, F.lit(edge)), F.lit(name))
    return label.otherwise(F.lit(last))


def position(label: Column, order: Sequence[str]) -> Column:
    """Place of a label in its display order."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), label)


def loan_size(amount: Column, when_null: str) -> Column:
    """Size bucket. Which bucket a NULL amount falls in differs between reports."""
    return F.when(amount.isNull(), F.lit(when_null)).otherwise(
        band(amount, operator.lt, LOAN_SIZES, LARGEST_SIZE)
    )


def numbered_loan_size(amount: Column) -> Column:
    """Size bucket with its number in front; NULL counts as the largest."""
    plain = loan_size(amount, LARGEST_SIZE)
    return F.concat(position(plain, SIZE_ORDER).cast("string"), F.lit(". "), plain)


def term_category(months: Column) -> Column:
    return F.when(months.isNull(), F.lit(UNKNOWN)).otherwise(
        band(months, operator.le, TERMS, LONGEST_TERM)
    )


def business_size(employees: Column) -> Column:
    return F.when(F.coalesce(employees, F.lit(0)) == 0, F.lit(UNKNOWN)).otherwise(
        band(employees, operator.le, STAFF_SIZES, LARGEST_STAFF)
    )


def employee_range(employees: Column) -> Column:
    return (
        F.when(employees.isNull(), F.lit("NULL"))
        .when(employees < 0, F.lit("Negative (invalid)"))
        .otherwise(band(employees, operator.le, STAFF_RANGES, ">500 (potential issue)"))
    )


def guarantee_band(percentage: Column) -> Column:
    return band(percentage, operator.ge, GUARANTEES, LOWEST_GUARANTEE)


def severity_band(percentage: Column) -> Column:
    return F.when(percentage == 0, F.lit(NO_LOSS)).otherwise(
        band(percentage, operator.lt, SEVERITIES, TOTAL_LOSS)
    )


def seasoning_band(months: Column) -> Column:
    return band(months, operator.le, SEASONING, LONGEST_SEASONING)


def economic_period(year: Column, periods=tuple(PERIODS), other: str = OTHER_PERIOD) -> Column:
    label = F
    for first, last, name in periods:
        label = label.when(year.between(first, last), F.lit(name))
    return label.otherwise(F.lit(other))


# Public helpers on single loans.


def calculate_guarantee_pct(guaranteed: Column, gross: Column) -> Column:
    """Guaranteed share of a loan in percent; NULL if the amount is NULL or 0."""
    return F.when(gross != 0, F.round(guaranteed * 100 / gross, 2))


def categorize_loan_size(amount: Column) -> Column:
    return loan_size(amount, UNKNOWN)


def get_naics_sector(code: Column) -> Column:
    return F.when(F.length(code) >= 2, F.substring(code, 1, 2)).otherwise(F.lit(UNKNOWN))
