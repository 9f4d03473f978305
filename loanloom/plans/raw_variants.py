"""Reports over the typed table, with amounts that are missing left missing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.dimensions import naics_codes
from loanloom.functions import buckets as B
from loanloom.functions.dates import months_to_default
from loanloom.functions.metrics import (
    default_exposure, default_rate, defaults, known, loan_count, loss_given_default, loss_rate,
    losses, volume,
)
from loanloom.functions.numeric import everything, mean, pct, ratio, share_of
from loanloom.plans import quality
from loanloom.plans.kpis import with_states



def known_raw(loans: DataFrame) -> DataFrame:
    """Typed loans with a known outcome, with the default flag the metrics expect."""
    return known(loans).withColumn("is_defaulted", F.col("loan_status") == "CHGOFF")


def nb_quality(loans: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return quality.field_validity(loans, as_of)


def nb_status(loans: DataFrame) -> DataFrame:
    return (
        loans.groupBy("loan_status")
        .agg(loan_count().alias("loan_count"), volume().alias("total_volume"))
        .select(
            F.coalesce("loan_status", F.lit(B.UNKNOWN)).alias("status"),
            "loan_count",
            share_of("loan_count", everything()).alias("pct_of_total"),
            "total_volume",
        )
        .orderBy(F.desc("loan_count"), "status")
    )


def nb_kpis(loans: DataFrame) -> DataFrame:
    """One row of portfolio figures."""
    gross = F.col("gross_approved")
    share = F.when(gross > 0, F.col("sba_approved") * 100 / gross)
    return known(loans).agg(
        loan_count().alias("total_loans"),
        volume().alias("total_volume"),
        F.sum("sba_approved").alias("total_sba_guaranteed"),
        mean(gross).alias("avg_loan_size"),
        mean("term_months", 1).alias("avg_term_months"),
        F.round(F.avg(share), 2).alias("avg_guarantee_pct"),
        F.countDistinct("bank_name").alias("unique_lenders"),
        F.countDistinct("state").alias("states_served"),
        F.min("approval_date").alias("earliest_loan"),
        F.max("approval_date").alias("latest_loan"),
    )


def _fiscal_years(loans: DataFrame, first_year: int) -> DataFrame:
    return known_raw(loans).filter(F.col("approval_fy") >= first_year)


def nb_annual(loans: DataFrame, first_year: int = 1991) -> DataFrame:
    return (
        _fiscal_years(loans, first_year)
        .groupBy(F.col("approval_fy").alias("fiscal_year"))
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
        )
        .orderBy("fiscal_year")
    )


def nb_size_mix(loans: DataFrame) -> DataFrame:
    """Loans per size; a missing amount counts as the largest size."""
    size = B.loan_size(F.col("gross_approved"), B.LARGEST_SIZE)
    return (
        known_raw(loans)
        .groupBy(size.alias("loan_size_bucket"))
        .agg(loan_count().alias("loan_count"), volume().alias("total_volume"))
        .withColumn("pct_of_count", share_of("loan_count", everything()))
        .withColumn("pct_of_volume", share_of("total_volume", everything()))
        .orderBy(B.position(F.col("loan_size_bucket"), B.SIZE_ORDER))
    )


def nb_risk(loans: DataFrame) -> DataFrame:
    return known_raw(loans).agg(
        loan_count().alias("total_loans"),
        defaults().alias("defaulted_loans"),
        F.count_if(~F.col("is_defaulted")).alias("paid_in_full"),
        default_rate().alias("default_rate_pct"),
        volume().alias("total_exposure"),
        default_exposure().alias("defaulted_volume"),
        losses().alias("total_chargeoff"),
        loss_rate().alias("loss_rate_pct"),
        loss_given_default().alias("lgd_pct"),
    )


def nb_vintage_risk(loans: DataFrame, first_year: int = 1991) -> DataFrame:
    """Risk per fiscal year, with the plain mean of the yearly default rates."""
    return (
        _fiscal_years(loans, first_year)
        .groupBy(F.col("approval_fy").alias("vintage_year"))
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_chargeoff"),
            loss_rate().alias("loss_rate"),
        )
        .withColumn(
            "avg_default_rate",
            F.sum("default_rate").over(everything()).cast("double") / F.count("default_rate").over(everything()),
        )
        .orderBy("vintage_year")
    )


def nb_industry_risk(loans: DataFrame, min_loans: int = 1000) -> DataFrame:
    """Sectors found in the lookup. Loans are summed per code before the lookup is joined."""
    codes = (
        known_raw(loans)
        .groupBy(F.substring("naics", 1, 2).alias("_code"))
        .agg(
            loan_count().alias("_loans"), defaults().alias("_bad"), volume().alias("_volume")
        )
    )
    sectors = naics_codes(loans.sparkSession).select("naics_code", "sector_name")
    return (
        codes.join(F.broadcast(sectors), F.col("_code") == F.col("naics_code"))
        .groupBy(F.col("sector_name").alias("industry"))
        .agg(
            F.sum("_loans").alias("total_loans"),
            F.sum("_bad").alias("defaults"),
            pct(F.sum("_bad"), F.sum("_loans")).alias("default_rate"),
            F.sum("_volume").alias("total_volume"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(F.desc("default_rate"), "industry")
    )


def nb_size_risk(loans: DataFrame) -> DataFrame:
    return (
        known_raw(loans)
        .groupBy(B.numbered_loan_size(F.col("gross_approved")).alias("loan_size_bucket"))
        .agg(
            loan_count().alias("total_loans"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .orderBy("loan_size_bucket")
    )


def nb_economic_periods(loans: DataFrame, first_year: int = 1991) -> DataFrame:
    period = B.economic_period(
        F.col("approval_fy"), tuple(B.NUMBERED_PERIODS), B.OTHER_NUMBERED_PERIOD
    )
    return (
        _fiscal_years(loans, first_year)
        .groupBy(period.alias("economic_period"))
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_chargeoff"),
        )
        .orderBy("economic_period")
    )


def nb_time_to_default(loans: DataFrame) -> DataFrame:
    return (
        loans.filter(
            "loan_status = 'CHGOFF' AND chargeoff_date IS NOT NULL AND approval_date IS NOT NULL"
        )
        .withColumn("months", months_to_default())
        .filter("months >= 0")
        .groupBy(B.seasoning_band(F.col("months")).alias("seasoning_bucket"))
        .agg(loan_count().alias("default_count"))
        .withColumn("pct_of_defaults", share_of("default_count", everything()))
        .orderBy(B.position(F.col("seasoning_bucket"), B.SEASONING_ORDER))
    )


def _states(loans: DataFrame, min_loans: int, *metrics: Column) -> DataFrame:
    return (
        known_raw(loans)
        .groupBy("state")
        .agg(loan_count().alias("total_loans"), default_rate().alias("default_rate"), *metrics)
        .filter(F.col("total_loans") >= min_loans)
    )


def nb_state_performance(loans: DataFrame, min_loans: int = 500, top_k: int = 20) -> DataFrame:
    states = _states(
        loans,
        min_loans,
        volume().alias("total_volume"),
        mean("gross_approved").alias("avg_loan_size"),
        defaults().alias("defaults"),
    )
    return (
        with_states(states)
        .select(
            "state", "state_name", "region", "total_loans", "total_volume", "avg_loan_size",
            "defaults", "default_rate",
        )
        .orderBy(F.desc_nulls_first("total_volume"), F.asc_nulls_last("state"))
        .limit(top_k)
    )


def nb_state_default_map(loans: DataFrame, min_loans: int = 100) -> DataFrame:
    return _states(loans.filter("state IS NOT NULL"), min_loans)


def nb_regions(loans: DataFrame) -> DataFrame:
    """Regions of the states in the lookup; summed per state before the join."""
    states = (
        known_raw(loans)
        .groupBy("state")
        .agg(
            loan_count().alias("_loans"),
            volume().alias("_volume"),
            F.count("gross_approved").alias("_sized"),
            defaults().alias("_bad"),
        )
    )
    return (
        with_states(states, "inner")
        .groupBy("region")
        .agg(
            F.sum("_loans").alias("total_loans"),
            F.sum("_volume").alias("total_volume"),
            ratio(F.sum("_volume"), F.sum("_sized")).alias("avg_loan_size"),
            pct(F.sum("_bad"), F.sum("_loans")).alias("default_rate"),
        )
        .orderBy(F.desc("total_volume"), "region")
    )


def nb_top_bottom_states(loans: DataFrame, min_loans: int = 1000, top_k: int = 5) -> DataFrame:
    """The states with the lowest and the highest default rates."""
    rate, state = F.col("default_rate"), F.asc_nulls_last("state")
    best = F.row_number().over(Window.orderBy(rate, state))
    worst = F.row_number().over(Window.orderBy(F.desc(rate), state))
    lists = F.array(
        F.when(F.col("_best") <= top_k, F.lit("Best (Lowest Default)")),
        F.when(F.col("_worst") <= top_k, F.lit("Worst (Highest Default)")),
    )
    return (
        _states(loans, min_loans)
        .withColumn("_best", best)
        .withColumn("_worst", worst)
        .select(
            F.explode(F.array_compact(lists)).alias("category"),
            "state", "total_loans", "default_rate", "_best", "_worst",
        )
        .orderBy("category", F.when(F.col("category").startswith("Best"), F.col("_best")).otherwise(F.col("_worst")))
        .drop("_best", "_worst")
    )


def nb_top_lenders(loans: DataFrame, min_loans: int = 100, top_k: int = 15) -> DataFrame:
    return (
        known_raw(loans)
        .filter("bank_name IS NOT NULL")
        .groupBy("bank_name", "bank_state")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(
            F.desc_nulls_first("total_volume"), "bank_name", F.asc_nulls_last("bank_state")
        )
        .limit(top_k)
    )
