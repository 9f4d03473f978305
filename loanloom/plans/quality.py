"""Data quality of the typed loan table.

Fixed values: the labels of checks and verdicts in its reports.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.dimensions import SECTOR_CODES, state_regions
from loanloom.functions import buckets as B
from loanloom.functions.dates import as_of_date
from loanloom.functions.metrics import OUTCOMES, loan_count
from loanloom.functions.numeric import everything, mean, pct, ratio, rounded, share_of
from loanloom.operators.duplicates import repeated
from loanloom.operators.percentiles import exact_percentiles


PROFILED = (
    "loan_id", "business_name", "state", "naics", "approval_date", "gross_approved", "loan_status",
)


def _nulls(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def null_profile(loans: DataFrame, columns: Sequence[str] = PROFILED) -> DataFrame:
    """Rows, NULLs and NULL share per column; one scan for all columns."""
    counted = loans.agg(loan_count().alias("total_rows"), *[_nulls(c).alias(c) for c in columns])
    return (
        counted.unpivot(["total_rows"], list(columns), "column_name", "null_count")
        .withColumn("null_pct", pct("null_count", "total_rows"))
        .select("column_name", "total_rows", "null_count", "null_pct")
        .orderBy(F.desc("null_pct"), "column_name")
    )


def null_profile_wide(
    loans: DataFrame, columns: Sequence[str] = ("loan_id", "naics", "loan_status")
) -> DataFrame:
    """The same for some columns, side by side in one row."""
    counted = loans.agg(
        loan_count().alias("total_rows"), *[_nulls(c).alias(f"{c}_nulls") for c in columns]
    )
    for c in columns:
        counted = counted.withColumn(f"{c}_null_pct", pct(f"{c}_nulls", "total_rows"))
    pairs = [name for c in columns for name in (f"{c}_nulls", f"{c}_null_pct")]
    return counted.select("total_rows", *pairs)


def amount_distribution(loans: DataFrame) -> DataFrame:
    """Spread of the approved amount, with exact percentiles."""
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    gross = F.col("gross_approved")
    amount = gross.cast("double")
    parts = {
        "_n": loan_count(), "_min": F.min(gross), "_max": F.max(gross), "_sum": F.sum(gross),
        "_mean": F.avg(amount), "_var": F.var_pop(amount),
    }
    n, mean_here = F.col("_n"), F.col("_mean")
    totals = {
        "total_records": F.sum("_n"), "min_value": F.min("_min"), "max_value": F.max("_max"),
        "_all": F.sum("_sum"), "_first": F.sum(n * mean_here),
        "_second": F.sum(n * (F.col("_var") + mean_here * mean_here)),
    }
    count = F.col("total_records")
    spread = F.col("_second") - F.col("_first") * F.col("_first") / count
    return exact_percentiles(loans, "gross_approved", probs, parts=parts, totals=totals).select(
        F.lit("Gross Approved Amount").alias("metric"),
        F.coalesce(count, F.lit(0)).alias("total_records"),
        "min_value", "p25", "median",
        ratio("_all", "total_records").alias("mean"),
        "p75", "p95", "p99", "max_value",
        rounded(F.sqrt(spread / F.nullif(count - 1, F.lit(0))), 2).alias("std_dev"),
    )


def iqr_outliers(loans: DataFrame, reach: float = 1.5) -> DataFrame:
    """Amounts outside the quartiles by more than ``reach`` times their distance."""
    points = exact_percentiles(loans, "gross_approved", {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * reach
    bounds = points.select(
        F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    ).scalar()
    gross = F.col("gross_approved")
    return (
        loans.filter(gross.isNotNull())
        .agg(
            loan_count().alias("rows"),
            F.count_if(gross < bounds["low"]).alias("below_lower_bound"),
            F.count_if(gross > bounds["high"]).alias("above_upper_bound"),
            F.count_if(gross.between(bounds["low"], bounds["high"])).alias("within_bounds"),
        )
        .select(
            F.lit("Loan Amount Outliers").alias("analysis"),
            "below_lower_bound",
            "above_upper_bound",
            "within_bounds",
            pct("above_upper_bound", "rows").alias("pct_high_outliers"),
        )
    )


def term_outliers(loans: DataFrame, extreme: int = 300) -> DataFrame:
    """Spread of the terms and how many are extreme or not positive.

    All of it follows from the number of loans per term, a few hundred rows of whole months.
    """
    term, n = F.col("term_months"), F.col("_n")
    upto = F.sum("_n").over(Window.orderBy(term).rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.sum("_n").over(everything()) - 1) * 0.5
    terms = (
        loans.filter(term.isNotNull())
        .groupBy(term)
        .agg(loan_count().alias("_n"))
        .withColumns({"_upto": upto, "_middle": middle})
    )
    lower = F.min(F.when(F.col("_upto") > F.floor("_middle"), term))
    upper = F.min(F.when(F.col("_upto") > F.ceil("_middle"), term))
    count = F.coalesce(F.sum("_n"), F.lit(0))
    return terms.agg(
        F.lit("Loan Term (Months)").alias("metric"),
        count.alias("total_records"),
        F.min(term).alias("min_term"),
        F.round((lower + upper) / 2.0, 4).alias("median_term"),
        ratio(F.sum(term * n), F.sum("_n"), 1).alias("avg_term"),
        F.max(term).alias("max_term"),
        F.coalesce(F.sum(F.when(term > extreme, n)), F.lit(0)).alias("extreme_terms"),
        F.coalesce(F.sum(F.when(term <= 0, n)), F.lit(0)).alias("invalid_terms"),
    )


def _counted_share(loans: DataFrame, label: Column, name: str, count: str) -> DataFrame:
    return (
        loans.groupBy(label.alias(name))
        .agg(loan_count().alias(count))
        .withColumn("pct_of_total", share_of(count, everything()))
        .orderBy(F.desc(count), name)
    )


def employee_buckets(loans: DataFrame) -> DataFrame:
    """Loans per range of employee counts, with missing and negative ones apart."""
    label = B.employee_range(F.col("num_employees"))
    return _counted_share(loans, label, "employee_bucket", "loan_count")


def invalid_states(loans: DataFrame, top_k: int = 20) -> DataFrame:
    """State codes that are missing, malformed or not in the lookup."""
    state = F.col("state")
    lookup = state_regions(loans.sparkSession).select("state_code")
    problem = (
        F.when(state.isNull(), "NULL")
        .when(F.length(state) != 2, "Invalid length")
        .when(~state.rlike(r"^[A-Z]{2}\z"), "Invalid format")
        .when(F.col("state_code").isNull(), "Unknown state")
        .otherwise("Valid")
    )
    return (
        loans.groupBy("state")
        .agg(loan_count().alias("occurrences"))
        .join(F.broadcast(lookup), state == F.col("state_code"), "left")
        .select("state", "occurrences", problem.alias("validation_status"))
        .filter("validation_status != 'Valid'")
        .orderBy(F.desc("occurrences"), F.asc_nulls_last("state"))
        .limit(top_k)
    )


def naics_validity(loans: DataFrame) -> DataFrame:
    """Loans per verdict on the industry code."""
    code = F.col("naics")
    label = (
        F.when(code.isNull(), "NULL")
        .when(~code.rlike(r"^[0-9]+\z"), "Non-numeric")
        .when(F.length(code) < 2, "Too short")
        .when(F.length(code) > 6, "Too long")
        .when(~F.substring(code, 1, 2).isin(*SECTOR_CODES), "Invalid sector")
        .otherwise("Valid")
    )
    return _counted_share(loans, label, "naics_status", "record_count")


def date_checks(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Counters of dates that are missing, out of range or out of order."""
    approved, disbursed = F.col("approval_date"), F.col("disbursement_date")
    charged_off, fy = F.col("chargeoff_date"), F.col("approval_fy")
    gap = fy - F.year(approved)
    checks = {
        "future_approval_dates": approved > as_of_date(as_of),
        "ancient_approval_dates": approved < F.lit(dt.date(1990, 1, 1)),
        "disbursement_before_approval": disbursed < approved,
        "chargeoff_before_disbursement": charged_off < disbursed,
        "missing_approval_date": approved.isNull(),
        "fy_mismatch": ~gap.isin(0, 1),
    }
    return loans.agg(
        F.max(F.lit("Date Validation")).alias("check_type"),
        loan_count().alias("total_loans"),
        *[F.count_if(broken).alias(name) for name, broken in checks.items()],
    )


def status_distribution(loans: DataFrame) -> DataFrame:
    """Count, share, average and volume per loan status."""
    return (
        loans.groupBy("loan_status")
        .agg(
            loan_count().alias("loan_count"),
            mean("gross_approved").alias("avg_loan_amount"),
            F.sum("gross_approved").alias("total_volume"),
        )
        .select(
            F.coalesce("loan_status", F.lit("NULL/Unknown")).alias("status"),
            "loan_count",
            share_of("loan_count", everything()).alias("pct_of_total"),
            "avg_loan_amount",
            "total_volume",
        )
        .orderBy(F.desc("loan_count"), "status")
    )


def duplicate_ids(loans: DataFrame, top_k: int = 10) -> DataFrame:
    """Loan ids that occur more than once, most frequent first."""
    return (
        loans.groupBy("loan_id")
        .agg(loan_count().alias("duplicate_count"))
        .filter("duplicate_count > 1")
        .orderBy(F.desc("duplicate_count"), "loan_id")
        .limit(top_k)
    )


def potential_duplicates(loans: DataFrame, top_k: int = 20) -> DataFrame:
    """Named loans that agree on borrower, place, day and amount. Missing values agree too."""
    same = ["business_name", "city", "state", "approval_date", "gross_approved"]
    return (
        repeated(loans.filter("business_name IS NOT NULL"), same, "potential_duplicates")
        .orderBy(F.desc("potential_duplicates"), *[F.asc_nulls_last(c) for c in same])
        .limit(top_k)
    )


def guarantee_categories(loans: DataFrame) -> DataFrame:
    """Loans per verdict on the guaranteed share of the amount."""
    gross, covered = F.col("gross_approved"), F.col("sba_approved")
    label = (
        F.when(F.coalesce(gross, F.lit(0)) == 0, "Cannot calculate")
        .when(covered.isNull(), "Missing SBA amount")
        .when(covered > gross, "SBA > Gross (invalid)")
        .when(covered * 10 > gross * 9, "High guarantee (>90%)")
        .when(covered * 10 >= gross * 7, "Standard (70-90%)")
        .when(covered * 2 < gross, "Low guarantee (<50%)")
        .otherwise("Normal (50-70%)")
    )
    share = F.when(gross > 0, covered * 100 / gross)
    return (
        loans.groupBy(label.alias("guarantee_category"))
        .agg(loan_count().alias("loan_count"), F.round(F.avg(share), 2).alias("avg_guarantee_pct"))
        .orderBy(F.desc("loan_count"), "guarantee_category")
    )


def chargeoff_consistency(loans: DataFrame) -> DataFrame:
    """Counters of loans whose status and charge-off fields contradict each other."""
    bad, paid = F.col("loan_status") == "CHGOFF", F.col("loan_status") == "PIF"
    day, amount = F.col("chargeoff_date"), F.col("chargeoff_amount")
    checks = {
        "chgoff_missing_date": bad & day.isNull(),
        "chgoff_missing_amount": bad & amount.isNull(),
        "chgoff_zero_amount": bad & (amount == 0),
        "pif_with_chgoff_date": paid & day.isNotNull(),
        "pif_with_chgoff_amount": paid & (amount > 0),
    }
    return loans.agg(
        F.max(F.lit("Chargeoff Validation")).alias("check_type"),
        *[F.count_if(broken).alias(name) for name, broken in checks.items()],
    )


def _validity(as_of: dt.date | None) -> dict[str, Column]:
    c = F.col
    return {
        "pct_with_loan_id": c("loan_id").isNotNull(),
        "pct_valid_state": F.length("state") == 2,
        "pct_valid_naics": F.length("naics") >= 2,
        "pct_valid_date": c("approval_date") <= as_of_date(as_of),
        "pct_valid_amount": c("gross_approved") > 0,
        "pct_known_outcome": c("loan_status").isin(*OUTCOMES),
        "pct_valid_term": c("term_months").between(1, 360),
    }


def field_validity(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Share of valid values for seven fields, in one row."""
    checks = _validity(as_of)
    return loans.agg(
        loan_count().alias("total_records"),
        *[pct(F.count_if(ok), loan_count()).alias(name) for name, ok in checks.items()],
    )


def quality_scorecard(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """The shares of ``field_validity`` and their mean, taken before rounding."""
    checks = _validity(as_of)
    valid = sum((F.count_if(ok) for ok in checks.values()), F.lit(0))
    return loans.agg(
        F.max(F.lit("Data Quality Summary")).alias("report"),
        loan_count().alias("total_records"),
        *[pct(F.count_if(ok), loan_count()).alias(name) for name, ok in checks.items()],
        pct(valid, loan_count() * len(checks)).alias("overall_quality_score"),
    )


def exclusion_flags(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """0/1 flags per loan. An open loan (NULL status) is not excluded for its outcome."""
    gross, state = F.col("gross_approved"), F.col("state")
    no_amount = F.coalesce(gross <= 0, F.lit(True))
    other_outcome = F.coalesce(~F.col("loan_status").isin(*OUTCOMES), F.lit(False))
    no_date = F.coalesce(F.col("approval_date") > as_of_date(as_of), F.lit(True))
    no_state = F.coalesce(F.length(state) != 2, F.lit(True))
    flags = {
        "exclude_invalid_amount": no_amount,
        "exclude_unknown_outcome": other_outcome,
        "exclude_invalid_date": no_date,
        "exclude_invalid_state": no_state,
        "exclude_from_analysis": no_amount | other_outcome | no_date,
    }
    return loans.select("loan_id", *[v.cast("int").alias(k) for k, v in flags.items()])


def exclusion_summary(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Totals of the exclusion flags and the share of usable loans."""
    out = F.sum("exclude_from_analysis")
    totals = ("invalid_amount", "unknown_outcome", "invalid_date", "invalid_state")
    return exclusion_flags(loans, as_of).agg(
        F.max(F.lit("Exclusion Summary")).alias("report"),
        loan_count().alias("total_records"),
        *[F.sum(f"exclude_{t}").alias(f"excluded_{t}") for t in totals],
        out.alias("total_excluded"),
        (loan_count() - out).alias("records_for_analysis"),
        pct(loan_count() - out, loan_count()).alias("pct_usable"),
    )


def helper_values(loans: DataFrame) -> DataFrame:
    """The three public loan helpers, summarised per size label and sector."""
    guarantee = B.calculate_guarantee_pct(F.col("sba_approved"), F.col("gross_approved"))
    return (
        loans.groupBy(
            B.categorize_loan_size(F.col("gross_approved")).alias("size_category"),
            B.get_naics_sector(F.col("naics")).alias("sector_code"),
        )
        .agg(
            loan_count().alias("loan_count"),
            ratio(F.sum(guarantee), F.lit(1)).alias("guarantee_pct_sum"),
        )
        .orderBy("size_category", "sector_code")
    )
