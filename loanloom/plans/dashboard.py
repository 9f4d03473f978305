"""Executive views over the clean loan table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions import buckets as B
from loanloom.functions.dates import as_of_date
from loanloom.functions.metrics import (
    OUTCOMES, by_vintage, defaults, known, known_sums, loan_count, losses, per_value, volume,
)
from loanloom.functions.numeric import everything, mean, pct, ratio
from loanloom.plans.kpis import counted, growth, last_five_years, month, summed
from loanloom.plans.risk import exact_rate
from loanloom.sources.store import stored


# Fixed value: name shown on the snapshot.
PORTFOLIO_NAME = "SBA 7(a) Loan Portfolio"

# Dimensions of the watch list.
WATCHED = {"State": "state", "Industry": "industry_sector", "Vintage Year": "vintage_year"}

# Names of the drill-down dimensions and their columns.
DIMENSIONS = {
    "State": "state",
    "Industry": "industry_sector",
    "Loan Size": "loan_size_bucket",
    "Business Type": "business_type",
    "Term Category": "term_category",
    "Location Type": "location_type",
    "Vintage Year": "vintage_year",
}

# Columns whose values the summary counts, by the name of the count.
REPRESENTED = {
    "active_lenders": "bank_name",
    "states_with_loans": "state",
    "industries_represented": "industry_sector",
}


def executive_summary(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One row: the portfolio, its risk, the latest vintage and the one before."""
    sums = (
        "defaults", "volume", "exposure", "terms", "guarantees", "created", "retained", "losses",
        "bad_volume",
    )
    return summary_of(by_vintage(clean, sums, REPRESENTED), as_of)


def summary_of(years: DataFrame, as_of: dt.date | None) -> DataFrame:
    """The summary from rows as ``by_vintage`` gives them."""
    def rate_in(years_back: int) -> Column:
        return pct(summed("defaults", years_back), summed("loans", years_back))

    return (
        years
        .agg(
            counted("loans").alias("total_loans"),
            summed("volume").alias("total_volume"),
            summed("exposure").alias("total_sba_exposure"),
            ratio(summed("volume"), summed("loans")).alias("avg_loan_size"),
            ratio(summed("terms"), summed("loans"), 1).alias("avg_term_months"),
            ratio(summed("guarantees"), summed("loans")).alias("avg_guarantee_pct"),
            summed("created").alias("total_jobs_created"),
            summed("retained").alias("total_jobs_retained"),
            (summed("created") + summed("retained")).alias("total_jobs_impacted"),
            counted("defaults").alias("total_defaults"),
            summed("losses").alias("total_chargeoff"),
            pct(summed("defaults"), summed("loans")).alias("default_rate"),
            pct(summed("losses"), summed("volume")).alias("loss_rate"),
            pct(summed("losses"), summed("bad_volume")).alias("loss_given_default"),
            counted("loans", 0).alias("ytd_loans"),
            summed("volume", 0).alias("ytd_volume"),
            counted("defaults", 0).alias("ytd_defaults"),
            rate_in(0).alias("ytd_default_rate"),
            counted("loans", 1).alias("prior_loans"),
            summed("volume", 1).alias("prior_volume"),
            rate_in(1).alias("prior_default_rate"),
            *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in REPRESENTED],
        )
        .withColumn("volume_growth_pct", growth("ytd_volume", F.col("prior_volume")))
        .withColumn("default_rate_change", F.col("ytd_default_rate") - F.col("prior_default_rate"))
        .withColumn("as_of_date", as_of_date(as_of).cast("timestamp"))
    )


def monthly_trends(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Months of the last five years with changes and rolling figures.

    All windows step over listed months, so a month without loans shifts the comparison.
    """
    return trends_of(
        last_five_years(known(clean), as_of)
        .groupBy(month())
        .agg(
            loan_count().alias("loans"),
            volume().alias("volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("defaults"),
            losses().alias("chargeoff"),
        )
    )


def trends_of(months: DataFrame) -> DataFrame:
    """The trends from sums per month."""
    by_month = Window.orderBy("month")
    quarter, year = by_month.rowsBetween(-2, 0), by_month.rowsBetween(-11, 0)

    def back(column: str, months: int) -> Column:
        return F.lag(column, months).over(by_month)

    def rolling_mean(column: str) -> Column:
        return ratio(F.sum(column).over(quarter), F.count(column).over(quarter))

    year_loans, year_bad = F.sum("loans").over(year), F.sum("defaults").over(year)
    return (
        months.select(
            "*",
            back("loans", 1).alias("prev_month_loans"),
            growth("loans", back("loans", 1)).alias("mom_loan_growth"),
            back("volume", 1).alias("prev_month_volume"),
            growth("volume", back("volume", 1)).alias("mom_volume_growth"),
            rolling_mean("loans").alias("rolling_3mo_avg_loans"),
            rolling_mean("volume").alias("rolling_3mo_avg_volume"),
            year_loans.alias("rolling_12mo_loans"),
            F.sum("volume").over(year).alias("rolling_12mo_volume"),
            year_bad.alias("rolling_12mo_defaults"),
            pct(year_bad, year_loans).alias("rolling_12mo_default_rate"),
            back("loans", 12).alias("same_month_prior_year_loans"),
            back("volume", 12).alias("same_month_prior_year_volume"),
            growth("loans", back("loans", 12)).alias("yoy_loan_growth"),
            growth("volume", back("volume", 12)).alias("yoy_volume_growth"),
        )
        .orderBy(F.desc("month"))
    )


def ytd_comparison(clean: DataFrame) -> DataFrame:
    """Loans and volume per calendar month for the latest vintage and the two before."""
    sums = known_sums()
    return to_date_of(
        clean.groupBy("vintage_year", F.col("vintage_month").alias("month"))
        .agg(sums["loans"].alias("_loans"), sums["volume"].alias("_volume"))
    )


def to_date_of(months: DataFrame) -> DataFrame:
    """The comparison from loans and volume per vintage year and calendar month."""
    months = months.withColumn(
        "_age", F.max("vintage_year").over(everything()) - F.col("vintage_year")
    )
    shown = {0: "cy", 1: "py", 2: "py2"}
    columns = []
    for years_back, prefix in shown.items():
        here = F.col("_age") == years_back
        columns.append(F.max(F.when(here, F.col("_loans"))).alias(f"{prefix}_loans"))
        columns.append(F.max(F.when(here, F.col("_volume"))).alias(f"{prefix}_volume"))
    return (
        months.filter((F.col("_age") <= max(shown)) & (F.col("_loans") > 0))
        .groupBy("month")
        .agg(*columns)
        .withColumn("yoy_loan_change_pct", growth("cy_loans", F.col("py_loans")))
        .withColumn("yoy_volume_change_pct", growth("cy_volume", F.col("py_volume")))
        .orderBy("month")
    )


def segment_totals(clean: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Known loans summed along each dimension on its own, from one scan."""
    return per_value(
        known(clean),
        dimensions,
        loan_count().alias("total_loans"),
        defaults().alias("defaults"),
        volume().alias("volume"),
        losses().alias("loss"),
    ).withColumnRenamed("side", "dimension")


def dimension_drilldown(clean: DataFrame, dimensions: dict[str, str] | None = None) -> DataFrame:
    """The same figures along each of seven dimensions."""
    return drilldown_of(segment_totals(clean, dimensions or DIMENSIONS))


def drilldown_of(totals: DataFrame) -> DataFrame:
    """The drill-down from ``segment_totals``."""
    return totals.select(
        "dimension",
        F.col("value").alias("dimension_value"),
        F.col("total_loans").alias("loans"),
        "volume",
        ratio("volume", "total_loans").alias("avg_loan_size"),
        pct("defaults", "total_loans").alias("default_rate"),
        pct("loss", "volume").alias("loss_rate"),
    )


def top_rankings(clean: DataFrame, top_k: int = 10) -> DataFrame:
    """States with the largest volume."""
    states = known(clean).groupBy(F.col("state").alias("entity"))
    return top_states_of(states.agg(volume().alias("metric_value")), top_k)


def top_states_of(states: DataFrame, top_k: int) -> DataFrame:
    """The list from the volume per state."""
    return (
        states.select(
            F.lit("Top States by Volume").alias("ranking_category"),
            "entity",
            "metric_value",
            F.lit("volume").alias("metric_type"),
            F.rank().over(Window.orderBy(F.desc("metric_value"))).alias("rank"),
        )
        .orderBy(F.desc("metric_value"), "entity")
        .limit(top_k)
    )


def comprehensive_rankings(clean: DataFrame, min_loans: int = 500, top_k: int = 10) -> DataFrame:
    """Five top lists over states and sectors, from one aggregate.

    The cut goes by the rounded value; ranks go by the exact one.
    """
    sides = {"State": "state", "Industry": "industry_sector"}
    return rankings_of(segment_totals(clean, sides), min_loans, top_k)


def rankings_of(totals: DataFrame, min_loans: int = 500, top_k: int = 10) -> DataFrame:
    """The lists from ``segment_totals``."""
    totals = totals.filter(
        F.col("dimension").isin("State", "Industry")
        & ((F.col("dimension") != "Industry") | (F.col("value") != B.UNKNOWN))
    )
    state, industry = F.col("dimension") == "State", F.col("dimension") == "Industry"
    enough = F.col("total_loans") >= min_loans
    millions = ratio("volume", F.lit(10**6))
    rate = pct("defaults", "total_loans")
    amount = F.col("volume").cast("double")
    # Category names. (category, rows, shown value, exact value, largest first)
    lists = [
        ("Top 10 States by Volume", state, millions, amount, True),
        ("Top 10 Industries by Volume", industry, millions, amount, True),
        ("Highest Default Rate States", state & enough, rate, exact_rate(), True),
        ("Lowest Default Rate States", state & enough, rate, exact_rate(), False),
        ("Highest Default Rate Industries", industry & enough, rate, exact_rate(), True),
    ]
    entries = [
        F.when(
            rows,
            F.struct(
                F.lit(name).alias("category"),
                shown.cast("decimal(24,2)").alias("value_millions"),
                # Negative values turn "largest first" into the one ascending order below.
                (-shown if descending else shown).cast("decimal(24,2)").alias("cut"),
                (-exact if descending else exact).alias("by"),
            ),
        )
        for name, rows, shown, exact, descending in lists
    ]
    in_list = Window.partitionBy("_entry.category")
    return (
        totals.withColumn("_entry", F.explode(F.array_compact(F.array(*entries))))
        .select(
            "_entry.category",
            F.col("value").alias("entity"),
            "_entry.value_millions",
            F.rank().over(in_list.orderBy("_entry.by")).alias("rank"),
            F.row_number().over(in_list.orderBy("_entry.cut", "value")).alias("_place"),
        )
        .filter(F.col("_place") <= top_k)
        .drop("_place")
        .orderBy("category", "rank", "entity")
    )


# Sides of the snapshot: values are counted, or the most common one is shown.
SNAPSHOT_SIDES = {
    "Lender": "bank_name",
    "State": "state",
    "Industry": "industry_sector",
    "Loan Size": "loan_size_bucket",
}


def portfolio_snapshot(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One row for quick reference, from one scan: figures of all loans, and modes."""
    sums = [column.alias(name) for name, column in known_sums().items()]
    days = [F.min("approval_date").alias("first_day"), F.max("approval_date").alias("last_day")]
    return snapshot_of(per_value(known(clean), SNAPSHOT_SIDES, *sums, *days, total="all"), as_of)


def snapshot_of(totals: DataFrame, as_of: dt.date | None) -> DataFrame:
    """The snapshot from sums and days per side, and those of all loans."""
    billion, million = F.lit(10**9), F.lit(10**6)

    def on(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)

    def whole(name: str) -> Column:
        return F.max(on("all", F.col(name)))

    def most_common(side: str) -> Column:
        # Smallest (-count, value): the most loans, then the first name.
        return F.min(on(side, F.struct((-F.col("loans")).alias("n"), F.col("value"))))["value"]

    loans, amount = whole("loans"), whole("volume")
    return totals.agg(
        F.lit(PORTFOLIO_NAME).alias("portfolio_name"),
        as_of_date(as_of).alias("snapshot_date"),
        F.coalesce(loans, F.lit(0)).alias("total_loans"),
        ratio(amount, billion).alias("total_volume_billions"),
        ratio(whole("exposure"), billion).alias("sba_exposure_billions"),
        ratio(amount, loans, 0).alias("avg_loan_size"),
        ratio(whole("terms"), loans, 0).alias("avg_term_months"),
        ratio(whole("guarantees"), loans, 1).alias("avg_guarantee_pct"),
        pct(whole("defaults"), loans).alias("default_rate_pct"),
        ratio(whole("losses"), million).alias("total_chargeoff_millions"),
        pct(whole("losses"), amount, 3).alias("loss_rate_pct"),
        whole("created").alias("total_jobs_created"),
        whole("retained").alias("total_jobs_retained"),
        whole("first_day").alias("earliest_loan"),
        whole("last_day").alias("latest_loan"),
        F.year(whole("first_day")).alias("first_vintage"),
        F.year(whole("last_day")).alias("latest_vintage"),
        F.count(on("Lender", F.col("loans"))).alias("num_lenders"),
        F.count(on("State", F.col("loans"))).alias("num_states"),
        F.count(on("Industry", F.col("loans"))).alias("num_industries"),
        most_common("Loan Size").alias("most_common_size_bucket"),
        most_common("Industry").alias("largest_industry"),
        most_common("State").alias("largest_state"),
    )


def risk_watchlist(
    clean: DataFrame, min_loans: int = 100, elevated: int = 12, high: int = 15
) -> DataFrame:
    """States, sectors and vintages that default clearly more often than the portfolio.

    ``elevated`` and ``high`` are tenths of the portfolio's rate. Vintages need no minimum.
    """
    totals = segment_totals(clean, WATCHED)
    return watchlist_of(totals, min_loans, elevated, high)


def watchlist_of(
    totals: DataFrame, min_loans: int = 100, elevated: int = 12, high: int = 15
) -> DataFrame:
    """The list from ``segment_totals``."""
    totals = totals.filter(F.col("dimension").isin(*WATCHED))
    kind, by_year = F.col("dimension"), F.col("dimension") == "Vintage Year"

    def overall(column: str) -> Column:
        return F.sum(F.when(by_year, F.col(column))).over(everything())

    rate, usual = F.col("default_rate"), F.col("portfolio_avg")
    listed = by_year | (
        (F.col("total_loans") >= min_loans)
        & ((kind != "Industry") | (F.col("value") != B.UNKNOWN))
    )
    return (
        totals.select(
            kind.alias("segment_type"),
            F.col("value").alias("segment_value"),
            F.col("total_loans").alias("loans"),
            "volume",
            pct("defaults", "total_loans").alias("default_rate"),
            pct(overall("defaults"), overall("total_loans")).alias("portfolio_avg"),
            listed.alias("_listed"),
        )
        .filter(F.col("_listed") & (rate * 10 > usual * elevated))
        .drop("_listed")
        .withColumn("vs_portfolio_avg", rate - usual)
        .withColumn(
            "risk_classification",
            F.when(rate * 10 > usual * high, "HIGH RISK").otherwise("ELEVATED"),
        )
        .orderBy(F.desc("default_rate"), "segment_type", F.asc_nulls_last("segment_value"))
    )


def dashboard_counts(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Rows of each view on this page.

    The sums per dimension, and the counts per month, are stored and serve several views.
    """
    totals = stored(segment_totals(clean, DIMENSIONS), "segment_totals")
    start = F.add_months(as_of_date(as_of), -60)
    is_known = known_sums()["loans"]
    recent = F.count_if(F.col("loan_status").isin(*OUTCOMES) & (F.col("approval_date") >= start))
    months = stored(
        clean.groupBy(month(), "vintage_year", "vintage_month").agg(
            is_known.alias("loans"), recent.alias("recent")
        ),
        "month_counts",
    )
    age = F.max("vintage_year").over(everything()) - F.col("vintage_year")
    to_date = months.withColumn("_age", age).filter("_age <= 2 AND loans > 0")
    one_row = F.lit(1).cast("bigint")

    def rows_of(view: DataFrame) -> Column:
        return view.agg(loan_count()).scalar()

    # Names of the views.
    counts = {
        "Executive Summary": one_row,
        "Monthly Trends": rows_of(months.filter("recent > 0").select("month").distinct()),
        "YTD Comparison": rows_of(to_date.select("vintage_month").distinct()),
        "Dimension Drilldown": rows_of(drilldown_of(totals)),
        "Top Rankings": rows_of(totals.filter("dimension = 'State'").limit(10)),
        "Comprehensive Rankings": rows_of(rankings_of(totals)),
        "Portfolio Snapshot": one_row,
        "Risk Watchlist": rows_of(watchlist_of(totals)),
    }
    rows = [
        F.struct(F.lit(name).alias("view_name"), n.alias("record_count"))
        for name, n in counts.items()
    ]
    return clean.sparkSession.range(1).select(F.inline(F.array(*rows)))
