"""Default and loss risk over the clean loan table, for loans with a known outcome.

Default rate = defaulted / all loans; loss rate = charge-offs / approved amount; loss given
default = charge-offs / approved amount of the defaulted loans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions import buckets as B
from loanloom.functions.metrics import (
    by_vintage, default_exposure, default_rate, defaulted, defaults, known, loan_count, loss_given_default,
    loss_rate, losses, volume,
)
from loanloom.functions.numeric import everything, mean, pct, ratio, share_of
from loanloom.plans.kpis import counted, month, named_lenders, summed, with_states

RECENT = F.desc_nulls_first


def portfolio_default(clean: DataFrame) -> DataFrame:
    return known(clean).agg(
        F.max(F.lit("Portfolio Default Summary")).alias("metric"),
        loan_count().alias("total_loans"),
        defaults().alias("defaulted_loans"),
        F.count_if("is_paid_in_full").alias("paid_in_full"),
        default_rate().alias("default_rate_pct"),
        volume().alias("total_approved_volume"),
        default_exposure().alias("defaulted_volume"),
        pct(default_exposure(), volume()).alias("default_rate_by_volume_pct"),
    )


def default_by_vintage(clean: DataFrame) -> DataFrame:
    """Loans, defaults, volume and losses per vintage year."""
    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate_pct"),
            volume().alias("total_volume"),
            losses().alias("total_chargeoff"),
            loss_rate().alias("loss_rate_pct"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def monthly_default_trend(clean: DataFrame, since: dt.date = dt.date(2010, 1, 1)) -> DataFrame:
    """Default rate per approval month and over the last 12 listed months."""
    rolling = Window.orderBy("month").rowsBetween(-11, 0)
    loans, bad = F.sum("total_loans").over(rolling), F.sum("defaults").over(rolling)
    return (
        known(clean)
        .filter((F.col("approval_date") >= F.lit(since)) & (F.col("vintage_year") >= since.year))
        .groupBy(month())
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("monthly_default_rate"),
        )
        .withColumn("rolling_12mo_loans", loans)
        .withColumn("rolling_12mo_defaults", bad)
        .withColumn("rolling_12mo_default_rate", pct(bad, loans))
        .orderBy(F.desc("month"))
    )


def chargeoff_by_year(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            defaults().alias("defaulted_loans"),
            losses().alias("gross_chargeoff"),
            mean(defaulted("chargeoff_amount")).alias("avg_chargeoff_per_default"),
            default_exposure("sba_approved").alias("sba_exposure_on_defaults"),
            default_exposure().alias("gross_exposure_on_defaults"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def chargeoff_by_industry(clean: DataFrame, min_loans: int = 100) -> DataFrame:
    return (
        known(clean)
        .filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("industry_sector")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_chargeoff"),
            mean(defaulted("chargeoff_amount")).alias("avg_chargeoff"),
            volume().alias("total_exposure"),
            loss_rate().alias("loss_rate_pct"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(F.desc("default_rate"), "industry_sector")
    )


def chargeoff_by_size(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("loan_size_bucket")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_chargeoff"),
            mean(defaulted("chargeoff_amount")).alias("avg_chargeoff"),
            loss_rate().alias("loss_rate_pct"),
        )
        .orderBy(B.position(F.col("loan_size_bucket"), B.SIZE_ORDER))
    )


def lgd_overall(clean: DataFrame) -> DataFrame:
    """Loss given default; the loss includes charge-offs booked on repaid loans."""
    return known(clean).agg(
        F.max(F.lit("Loss Given Default Analysis")).alias("metric"),
        defaults().alias("defaulted_loans"),
        default_exposure().alias("defaulted_exposure"),
        losses().alias("total_loss"),
        loss_given_default().alias("lgd_pct"),
        mean(defaulted("loss_severity_pct")).alias("avg_loss_severity_pct"),
    )


def lgd_by_vintage(clean: DataFrame) -> DataFrame:
    """Loss given default and the recovered rest of 100 %, each rounded on its own."""
    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            defaults().alias("defaults"),
            default_exposure().alias("exposure_at_default"),
            losses().alias("actual_loss"),
            loss_given_default().alias("lgd_pct"),
            pct(default_exposure() - losses(), default_exposure()).alias("recovery_rate_pct"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def severity_distribution(clean: DataFrame) -> DataFrame:
    return (
        clean.filter("is_defaulted")
        .groupBy(B.severity_band(F.col("loss_severity_pct")).alias("loss_severity_bucket"))
        .agg(
            loan_count().alias("default_count"),
            losses().alias("total_loss"),
            mean("loss_severity_pct").alias("avg_severity_in_bucket"),
        )
        .withColumn("pct_of_defaults", share_of("default_count", everything()))
        .orderBy(B.position(F.col("loss_severity_bucket"), B.SEVERITY_ORDER))
        .select(
            "loss_severity_bucket", "default_count", "pct_of_defaults", "total_loss",
            "avg_severity_in_bucket",
        )
    )


def exact_rate() -> Column:
    """Default rate without rounding, to rank by."""
    return F.col("defaults").cast("double") / F.col("total_loans")


def risk_matrix(clean: DataFrame, min_loans: int = 50) -> DataFrame:
    """Sector by loan size, ranked by default rate within the sector."""
    rank = F.rank().over(Window.partitionBy("industry_sector").orderBy(F.desc(exact_rate())))
    return (
        known(clean)
        .filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("industry_sector", "loan_size_bucket")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .withColumn("risk_rank_in_industry", rank)
        .orderBy("industry_sector", F.desc("default_rate"), "loan_size_bucket")
    )


def minus_mean(value: str) -> Column:
    """Distance of a value to the mean over all rows of a small aggregate, not rounded."""
    v, n = F.col(value), F.count(value).over(everything())
    return (v * n - F.sum(value).over(everything())).cast("double") / n


def geographic_risk(clean: DataFrame, min_loans: int = 100) -> DataFrame:
    """State rates against their plain mean, ranked in the region and nationally."""
    worst_first = F.desc("default_rate")
    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
    )
    return (
        with_states(states)
        .select(
            "state", "region", "total_loans", "defaults", "default_rate", "loss_rate",
            minus_mean("default_rate").alias("vs_portfolio_avg"),
            F.rank().over(Window.partitionBy("region").orderBy(worst_first)).alias(
                "rank_in_region"
            ),
            F.rank().over(Window.orderBy(worst_first)).alias("national_rank"),
        )
        .orderBy(worst_first, "state")
    )


def risk_new_vs_existing(clean: DataFrame, min_year: int = 2010) -> DataFrame:
    return (
        known(clean)
        .filter(F.col("vintage_year") >= min_year)
        .groupBy("business_type", "vintage_year")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            mean("gross_approved").alias("avg_loan_size"),
            mean(defaulted("loss_severity_pct")).alias("avg_lgd"),
        )
        .orderBy(F.desc("vintage_year"), "business_type")
    )


def risk_by_term(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("term_category")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            volume().alias("total_volume"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
            mean(defaulted("term_months"), 1).alias("avg_term_of_defaults"),
        )
        .orderBy(F.desc("default_rate"), "term_category")
    )


def sba_loss_by_vintage(clean: DataFrame) -> DataFrame:
    """Charge-offs split between guarantor and lender by each loan's guaranteed share."""
    loss = defaulted("chargeoff_amount")
    share = (F.col("sba_guarantee_pct") * 100).cast("decimal(20,0)")  # hundredths of a percent

    def part(hundredths: Column) -> Column:
        split = ratio(F.sum(loss * hundredths), F.lit(10_000))
        return F.coalesce(split, F.lit(0))

    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            defaults().alias("defaults"),
            default_exposure("sba_approved").alias("sba_guaranteed_on_defaults"),
            losses().alias("total_chargeoff"),
            part(share).alias("estimated_sba_loss"),
            part(10_000 - share).alias("estimated_lender_loss"),
        )
        .orderBy(RECENT("vintage_year"))
    )


def default_by_guarantee(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .filter("gross_approved > 0")
        .groupBy(B.guarantee_band(F.col("sba_guarantee_pct")).alias("guarantee_bucket"))
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            volume().alias("total_exposure"),
            F.sum("sba_approved").alias("sba_exposure"),
            losses().alias("total_loss"),
        )
        .orderBy(F.desc("default_rate"), "guarantee_bucket")
    )


def riskiest_sectors(clean: DataFrame, min_loans: int = 500, top_k: int = 10) -> DataFrame:
    return (
        known(clean)
        .groupBy("naics_sector", "industry_sector")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            volume().alias("total_volume"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(F.desc("default_rate"), "naics_sector")
        .limit(top_k)
    )


def lender_risk(clean: DataFrame, min_loans: int = 100, top_k: int = 25) -> DataFrame:
    """Lenders with the highest default rates.

    Rounding keeps the order of the rates, so with the exact rate as second sort key nobody
    outside the first rows can outrank one of them: ranking these rows alone is exact.
    """
    worst_first = F.desc(exact_rate())
    return (
        named_lenders(clean)
        .groupBy("bank_name", "bank_state")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            volume().alias("total_volume"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(F.desc("default_rate"), worst_first, "bank_name", "bank_state")
        .limit(top_k)
        .withColumn("risk_rank", F.rank().over(Window.orderBy(worst_first)))
        .orderBy(F.desc("default_rate"), worst_first, "bank_name", "bank_state")
    )


def expected_loss(clean: DataFrame, min_loans: int = 50, top_k: int = 20) -> DataFrame:
    """Default probability x loss given default x exposure per sector and size.

    Both factors are rounded to four places before they are multiplied.
    """
    lgd = F.coalesce(ratio(losses(), F.sum(defaulted("gross_approved")), 4), F.lit(0))
    # Product of two 4-place factors and cents, as an integer number of 10^-10 units.
    expected = (
        (F.col("_pd") * 10_000).cast("decimal(5,0)")
        * (F.col("_lgd") * 10_000).cast("decimal(12,0)")
        * F.col("total_exposure").cast("decimal(20,2)")
    )
    return (
        known(clean)
        .filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("industry_sector", "loan_size_bucket")
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            ratio(defaults(), loan_count(), 4).alias("_pd"),
            lgd.alias("_lgd"),
            volume().alias("total_exposure"),
            losses().alias("actual_loss"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .withColumn("_expected", expected)
        .select(
            "industry_sector", "loan_size_bucket", "total_loans", "defaults",
            ratio(F.col("_pd") * 100, F.lit(1)).alias("pd_pct"),
            ratio(F.col("_lgd") * 100, F.lit(1)).alias("lgd_pct"),
            "total_exposure",
            ratio("_expected", F.lit(10**8)).alias("expected_loss"),
            "actual_loss",
            ratio(F.col("actual_loss") * 10**8 - F.col("_expected"), F.lit(10**8)).alias(
                "variance"
            ),
        )
        .orderBy(F.desc("expected_loss"), "industry_sector", "loan_size_bucket")
        .limit(top_k)
    )


def risk_summary(clean: DataFrame) -> DataFrame:
    """One row of portfolio risk figures, with the defaults of the latest vintage."""
    sums = ("defaults", "volume", "exposure", "losses", "bad_volume")
    return by_vintage(clean, sums, {}).agg(
        counted("loans").alias("total_loans"),
        counted("defaults").alias("total_defaults"),
        summed("volume").alias("total_exposure"),
        summed("exposure").alias("total_sba_exposure"),
        summed("losses").alias("total_loss"),
        pct(summed("defaults"), summed("loans")).alias("portfolio_default_rate"),
        pct(summed("losses"), summed("volume")).alias("portfolio_loss_rate"),
        pct(summed("losses"), summed("bad_volume")).alias("portfolio_lgd"),
        counted("defaults", 0).alias("ytd_defaults"),
        pct(summed("defaults", 0), summed("loans", 0)).alias("ytd_default_rate"),
    )
