"""Vintage cohorts and seasoning over the clean loan table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions import buckets as B
from loanloom.functions.dates import as_of_date, months_to_default, years_seasoned
from loanloom.functions.metrics import (
    default_rate, defaults, known, loan_count, loss_rate, losses, volume,
)
from loanloom.functions.numeric import everything, mean, pct, rounded, share_of

RECENT = F.desc_nulls_first


def by_year():
    return Window.orderBy(F.asc_nulls_last("vintage_year"))


def by_vintage(clean: DataFrame, *metrics: Column) -> DataFrame:
    return known(clean).groupBy("vintage_year").agg(*metrics)


def vintage_performance(clean: DataFrame) -> DataFrame:
    """Volume, defaults and losses per vintage, next to the vintage listed before."""
    return (
        by_vintage(
            clean,
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
        )
        .withColumn("prev_year_loans", F.lag("total_loans").over(by_year()))
        .withColumn("prev_year_default_rate", F.lag("default_rate").over(by_year()))
        .orderBy(RECENT("vintage_year"))
    )


def compared(rate: Column, benchmark: Column, better: str, worse: str, same: str) -> Column:
    """Label of a rate more than a fifth below or above its benchmark."""
    return (
        F.when(rate * 10 < benchmark * 8, better)
        .when(rate * 10 > benchmark * 12, worse)
        .otherwise(same)
    )


def vintage_vs_portfolio(clean: DataFrame) -> DataFrame:
    """Rates per vintage against the portfolio; both come from one aggregate by vintage."""
    vintages = by_vintage(
        clean,
        loan_count().alias("loans"),
        defaults().alias("_bad"),
        volume().alias("_volume"),
        losses().alias("_loss"),
    )

    def over_all(part: str, whole: str) -> Column:
        return pct(F.sum(part).over(everything()), F.sum(whole).over(everything()))

    rate, usual = F.col("default_rate"), F.col("portfolio_avg_default")
    return (
        vintages.select(
            "vintage_year",
            "loans",
            pct("_bad", "loans").alias("default_rate"),
            pct("_loss", "_volume").alias("loss_rate"),
            over_all("_bad", "loans").alias("portfolio_avg_default"),
            over_all("_loss", "_volume").alias("portfolio_avg_loss"),
        )
        .withColumn("default_vs_avg", rate - usual)
        .withColumn("loss_vs_avg", F.col("loss_rate") - F.col("portfolio_avg_loss"))
        .withColumn(
            "vintage_performance",
            compared(rate, usual, "Outperformer", "Underperformer", "Average"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def quarterly_vintage(clean: DataFrame, min_year: int = 2015) -> DataFrame:
    """Default rate per quarter, next to the quarter listed before in the same year."""
    year, quarter = F.col("vintage_year"), F.col("vintage_quarter")
    before = F.lag("default_rate").over(Window.partitionBy(year).orderBy(quarter))
    return (
        known(clean)
        .filter(year >= min_year)
        .groupBy(year, quarter)
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
        )
        .withColumn("cohort", F.concat(year, F.lit("-Q"), quarter))
        .withColumn("prev_quarter_default_rate", before)
        .orderBy(F.desc(year), F.desc(quarter))
    )


def timed_defaults(clean: DataFrame, needs_approval: bool) -> DataFrame:
    """Defaulted loans with a charge-off day and the completed months up to it, at least 0."""
    rows = clean.filter("is_defaulted AND chargeoff_date IS NOT NULL")
    if needs_approval:
        rows = rows.filter("approval_date IS NOT NULL")
    return rows.withColumn("months", months_to_default()).filter("months >= 0")


def seasoning_distribution(clean: DataFrame) -> DataFrame:
    """Defaults by age band of the loan."""
    return (
        timed_defaults(clean, needs_approval=True)
        .groupBy(B.seasoning_band(F.col("months")).alias("seasoning_bucket"))
        .agg(
            loan_count().alias("default_count"),
            mean("gross_approved").alias("avg_loan_size"),
            losses().alias("total_loss"),
            mean("months", 1).alias("avg_months_to_default"),
        )
        .withColumn("pct_of_defaults", share_of("default_count", everything()))
        .orderBy(B.position(F.col("seasoning_bucket"), B.SEASONING_ORDER))
    )


def seasoning_by_vintage(clean: DataFrame, years: int = 5) -> DataFrame:
    """Defaults per vintage and year of age, later years together."""
    age = F.greatest(F.ceil(F.col("months") / 12), F.lit(1))
    spread = [F.count_if(age == y).alias(f"year_{y}_defaults") for y in range(1, years + 1)]
    return (
        timed_defaults(clean, needs_approval=False)
        .groupBy("vintage_year")
        .agg(
            *spread,
            F.count_if(age > years).alias(f"year_{years + 1}_plus_defaults"),
            loan_count().alias("total_defaults"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def plausible_defaults(clean: DataFrame, needs_approval: bool, max_months: int) -> DataFrame:
    return timed_defaults(clean, needs_approval).filter(F.col("months") < max_months)


def month_percentile(p: float) -> Column:
    """Percentile of the months. They are whole and capped, so a group holds few values."""
    return rounded(F.percentile("months", p), 1)


def time_to_default_stats(clean: DataFrame, max_months: int = 360) -> DataFrame:
    return plausible_defaults(clean, True, max_months).agg(
        F.max(F.lit("Time to Default Statistics")).alias("metric"),
        loan_count().alias("total_defaults"),
        mean("months", 1).alias("avg_months"),
        month_percentile(0.25).alias("p25_months"),
        month_percentile(0.5).alias("median_months"),
        month_percentile(0.75).alias("p75_months"),
        month_percentile(0.9).alias("p90_months"),
        F.min("months").alias("min_months"),
        F.max("months").alias("max_months"),
    )


def _time_to_default_by(clean: DataFrame, column: str, max_months: int) -> DataFrame:
    return (
        plausible_defaults(clean, False, max_months)
        .groupBy(column)
        .agg(
            loan_count().alias("default_count"),
            mean("months", 1).alias("avg_months_to_default"),
            month_percentile(0.5).alias("median_months"),
        )
        .orderBy("avg_months_to_default", column)
    )


def ttd_by_size(clean: DataFrame, max_months: int = 360) -> DataFrame:
    return _time_to_default_by(clean, "loan_size_bucket", max_months)


def ttd_by_term(clean: DataFrame, max_months: int = 360) -> DataFrame:
    return _time_to_default_by(clean, "term_category", max_months)


def _running(order: str):
    return (
        Window.partitionBy("vintage_year")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )


def _defaults_by_age(clean: DataFrame, age: Column, name: str) -> DataFrame:
    """Dated defaults per vintage and age, with the size of the vintage, from one scan."""
    dated = F.col("is_defaulted") & F.col("chargeoff_date").isNotNull()
    return (
        known(clean)
        .groupBy("vintage_year", F.when(dated, age).alias(name))
        .agg(loan_count().alias("_loans"), losses().alias("_loss"))
        .withColumn("total_loans", F.sum("_loans").over(Window.partitionBy("vintage_year")))
        .filter(F.col(name).isNotNull())
    )


def cumulative_default_by_year(clean: DataFrame, min_year: int = 2005) -> DataFrame:
    """Defaults and losses of a vintage, summed up to each charge-off year."""
    so_far = _running("default_year")
    bad = F.sum("_loans").over(so_far)
    recent = clean.filter(F.col("vintage_year") >= min_year)
    return (
        _defaults_by_age(recent, F.year("chargeoff_date"), "default_year")
        .select(
            "vintage_year",
            "default_year",
            (F.col("default_year") - F.col("vintage_year")).alias("years_since_origination"),
            "total_loans",
            F.col("_loans").alias("defaults_in_year"),
            bad.alias("cumulative_defaults"),
            pct(bad, "total_loans").alias("cumulative_default_rate"),
            F.sum("_loss").over(so_far).alias("cumulative_loss"),
        )
        .orderBy("vintage_year", "default_year")
    )


def cumulative_default_curve(
    clean: DataFrame, years: tuple[int, int] = (2010, 2020), max_age: int = 10
) -> DataFrame:
    """Defaults of a vintage by age, summed from the first year on.

    Loans charged off within their first month have age 0 and stay out of the sums.
    """
    bad = F.sum("_loans").over(_running("years_seasoned"))
    shown = clean.filter(F.col("vintage_year").between(*years))
    return (
        _defaults_by_age(shown, years_seasoned(), "years_seasoned")
        .filter(F.col("years_seasoned").between(1, max_age))
        .select(
            "vintage_year",
            "years_seasoned",
            F.col("_loans").alias("defaults"),
            bad.alias("cumulative_defaults"),
            pct(bad, "total_loans").alias("cumulative_default_rate_pct"),
        )
        .orderBy("vintage_year", "years_seasoned")
    )


def vintage_heatmap(clean: DataFrame, min_year: int = 2005, ages: int = 5) -> DataFrame:
    """Default rate per vintage and year of age; one aggregate, 0 where nothing defaulted."""
    age = years_seasoned()
    dated = F.col("is_defaulted") & F.col("chargeoff_date").isNotNull()
    rates = [
        pct(F.count_if(dated & (age == a)), loan_count()).alias(f"yr{a}_default_rate")
        for a in range(1, ages + 1)
    ]
    return by_vintage(
        clean.filter(F.col("vintage_year") >= min_year),
        *rates,
        loan_count().alias("total_loans"),
    ).orderBy(F.desc("vintage_year"))


def vintage_outcomes(clean: DataFrame) -> DataFrame:
    """Outcomes of all loans per vintage, with running totals over the vintages."""
    status = F.col("loan_status")
    up_to = by_year().rangeBetween(Window.unboundedPreceding, 0)
    return (
        clean.groupBy("vintage_year")
        .agg(
            loan_count().alias("total_originated"),
            F.count_if(status == "PIF").alias("paid_in_full"),
            F.count_if(status == "CHGOFF").alias("charged_off"),
        )
        .select(
            "*",
            (F.col("total_originated") - F.col("paid_in_full") - F.col("charged_off")).alias(
                "other_unknown"
            ),
            pct("paid_in_full", "total_originated").alias("pif_rate"),
            pct("charged_off", "total_originated").alias("chargeoff_rate"),
            F.sum("total_originated").over(up_to).alias("cumulative_originated"),
            F.sum("charged_off").over(up_to).alias("cumulative_chargeoffs"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def survival_curve(
    clean: DataFrame, years: tuple[int, int] = (2010, 2018), horizon: int = 10
) -> DataFrame:
    """Share of a vintage not yet charged off n years after approval, n = 0..horizon.

    A default without a charge-off day survives no year. Loans are counted per vintage and
    age before the rows are multiplied by the years.
    """
    never = 99
    age = F.when(F.col("is_defaulted"), years_seasoned()).otherwise(never)
    n = F.col("years_since_origination")
    counts = (
        known(clean)
        .filter(F.col("vintage_year").between(*years))
        .groupBy("vintage_year", age.alias("_age"))
        .agg(loan_count().alias("_loans"))
    )
    surviving = F.sum(F.when(F.col("_age") > n, F.col("_loans")).otherwise(0))
    return (
        counts.withColumn(
            "years_since_origination", F.explode(F.sequence(F.lit(0), F.lit(horizon)))
        )
        .groupBy("vintage_year", n)
        .agg(surviving.alias("surviving"), F.sum("_loans").alias("total"))
        .withColumn("survival_rate_pct", pct("surviving", "total"))
        .orderBy("vintage_year", n)
    )


def economic_periods(clean: DataFrame, periods: Sequence[tuple] = tuple(B.PERIODS)) -> DataFrame:
    """Vintages grouped by economic period; unknown years count as earlier."""
    return (
        known(clean)
        .groupBy(B.economic_period(F.col("vintage_year"), periods).alias("economic_period"))
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
            F.min("vintage_year").alias("_first"),
        )
        .orderBy(F.asc_nulls_last("_first"))
        .drop("_first")
    )


def cohort_summary(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Lifetime figures per vintage and its age at the reporting date."""
    return (
        by_vintage(
            clean,
            loan_count().alias("cohort_size"),
            volume().alias("cohort_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("total_defaults"),
            default_rate().alias("lifetime_default_rate"),
            losses().alias("total_chargeoff"),
            loss_rate().alias("lifetime_loss_rate"),
        )
        .withColumn("cohort_age_years", F.year(as_of_date(as_of)) - F.col("vintage_year"))
        .orderBy(RECENT("vintage_year"))
    )
