"""Portfolio KPIs over the clean loan table, for loans with a known outcome."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.dimensions import state_regions
from loanloom.functions import buckets as B
from loanloom.functions.dates import as_of_date
from loanloom.functions.metrics import by_vintage, jobs, known, loan_count, volume
from loanloom.functions.numeric import everything, mean, pct, ratio, rounded, share_of
from loanloom.operators.percentiles import exact_percentiles

NO_LENDER = "Unknown Lender"


def growth(now: Column | str, before: Column | str) -> Column:
    """Change in percent of the earlier value."""
    now = F.col(now) if isinstance(now, str) else now
    return pct(now - before, before)


def with_states(df: DataFrame, how: str = "left") -> DataFrame:
    """Join the 54-row state lookup."""
    return df.join(
        F.broadcast(state_regions(df.sparkSession)), F.col("state") == F.col("state_code"), how
    )


def month() -> Column:
    return F.trunc("approval_date", "MM").alias("month")


def last_five_years(loans: DataFrame, as_of: dt.date | None) -> DataFrame:
    """Loans approved in the five years before the day; the year alone prunes stored files."""
    start = F.add_months(as_of_date(as_of), -60)
    return loans.filter((F.col("approval_date") >= start) & (F.col("vintage_year") >= F.year(start)))


def annual_originations(clean: DataFrame) -> DataFrame:
    """Originations per fiscal year with growth over all loans of the year before."""
    is_known = F.col("loan_status").isin("PIF", "CHGOFF")

    def of_known(c: str) -> Column:
        return F.when(is_known, F.col(c))

    years = (
        clean.filter("approval_fy IS NOT NULL")
        .groupBy("approval_fy")
        .agg(
            F.count_if(is_known).alias("loan_count"),
            F.sum(of_known("gross_approved")).alias("total_approved"),
            F.sum(of_known("sba_approved")).alias("total_sba_guaranteed"),
            mean(of_known("gross_approved")).alias("avg_loan_size"),
            volume().alias("_volume"),
        )
    )
    # RANGE 1 PRECEDING..1 PRECEDING is the calendar year before, also if a year has no loans.
    before = F.sum("_volume").over(Window.orderBy("approval_fy").rangeBetween(-1, -1))
    return (
        years.withColumn("yoy_growth_pct", growth("total_approved", before))
        .filter("loan_count > 0")
        .select(
            F.col("approval_fy").alias("fiscal_year"), "loan_count", "total_approved",
            "total_sba_guaranteed", "avg_loan_size", "yoy_growth_pct",
        )
        .orderBy(F.desc("fiscal_year"))
    )


def monthly_originations(clean: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Months of the last five years with the volume of the last 12 listed months."""
    rolling = Window.orderBy("month").rowsBetween(-11, 0)
    return (
        last_five_years(known(clean), as_of)
        .groupBy(month())
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("monthly_volume"),
            mean("gross_approved").alias("avg_loan_size"),
        )
        .withColumn("rolling_12mo_volume", F.sum("monthly_volume").over(rolling))
        .orderBy(F.desc("month"))
    )


def quarterly_originations(clean: DataFrame) -> DataFrame:
    quarter = ["vintage_year", "vintage_quarter"]
    return (
        known(clean)
        .groupBy(*quarter)
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            mean("sba_guarantee_pct").alias("avg_guarantee_pct"),
            jobs().alias("total_jobs_impacted"),
        )
        .orderBy(*[F.desc_nulls_first(c) for c in quarter])
    )


def loan_size_by_industry(clean: DataFrame, min_loans: int = 100) -> DataFrame:
    """Size statistics of the larger sectors; shares are of the sectors shown."""
    loans = known(clean).filter(F.col("industry_sector") != B.UNKNOWN)
    # Per interval of amounts, then per sector.
    parts = {
        "_n": loan_count(), "_min": F.min("gross_approved"), "_max": F.max("gross_approved"),
        "_sum": volume(),
    }
    totals = {
        "loan_count": F.sum("_n"), "min_loan": F.min("_min"), "max_loan": F.max("_max"),
        "total_volume": F.sum("_sum"),
    }
    sectors = exact_percentiles(
        loans, "gross_approved", {"median": 0.5}, by=["industry_sector"], digits=6, parts=parts, totals=totals
    )
    return (
        sectors.filter(F.col("loan_count") >= min_loans)
        .withColumn("avg_loan_size", ratio("total_volume", "loan_count"))
        .withColumn("pct_of_portfolio", share_of("total_volume", everything()))
        .select(
            "industry_sector", "loan_count", "avg_loan_size",
            rounded("median", 2).alias("median_loan_size"), "min_loan", "max_loan",
            "total_volume", "pct_of_portfolio",
        )
        .orderBy(F.desc("avg_loan_size"), "industry_sector")
    )


def loan_size_by_state(clean: DataFrame, top_k: int = 20) -> DataFrame:
    """States with the largest volume; shares are of all loans."""
    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("loan_count"),
            mean("gross_approved").alias("avg_loan_size"),
            volume().alias("total_volume"),
        )
        .withColumn("pct_of_loans", share_of("loan_count", everything()))
    )
    return (
        with_states(states)
        .select(
            "state", "state_name", "region", "loan_count", "avg_loan_size", "total_volume",
            "pct_of_loans",
        )
        .orderBy(F.desc("total_volume"), "state")
        .limit(top_k)
    )


def size_by_year_business_type(clean: DataFrame, min_year: int = 2010) -> DataFrame:
    return (
        known(clean)
        .filter(F.col("vintage_year") >= min_year)
        .groupBy("vintage_year", "business_type")
        .agg(
            loan_count().alias("loan_count"),
            mean("gross_approved").alias("avg_loan_size"),
            mean("term_months", 1).alias("avg_term_months"),
            mean("sba_guarantee_pct").alias("avg_guarantee_pct"),
        )
        .orderBy(F.desc("vintage_year"), "business_type")
    )


def loan_size_trends(clean: DataFrame) -> DataFrame:
    """Average size per vintage, overall and for four kinds of borrowers."""

    def of(column: str, value: str) -> Column:
        return mean(F.when(F.col(column) == value, F.col("gross_approved")))

    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            mean("gross_approved").alias("avg_loan_size"),
            of("business_type", "New").alias("avg_new_business"),
            of("business_type", "Existing").alias("avg_existing_business"),
            of("location_type", "Urban").alias("avg_urban"),
            of("location_type", "Rural").alias("avg_rural"),
        )
        .orderBy(F.asc_nulls_last("vintage_year"))
    )


def yoy_growth(clean: DataFrame) -> DataFrame:
    """Vintages with count and volume of the vintage listed before."""
    by_year = Window.orderBy(F.asc_nulls_last("vintage_year"))
    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
        )
        .withColumn("prev_year_count", F.lag("loan_count").over(by_year))
        .withColumn("count_growth_pct", growth("loan_count", F.col("prev_year_count")))
        .withColumn("prev_year_volume", F.lag("total_volume").over(by_year))
        .withColumn("volume_growth_pct", growth("total_volume", F.col("prev_year_volume")))
        .orderBy(F.desc_nulls_first("vintage_year"))
    )


def segment_cagr(clean: DataFrame, min_years: int = 6) -> DataFrame:
    """Yearly growth per sector between the portfolio's first and last vintage.

    The exponent is the number of vintages the sector has, not the distance in years.
    """
    years = known(clean).groupBy("industry_sector", "vintage_year").agg(volume().alias("_volume"))
    first, last = F.min("vintage_year").over(everything()), F.max("vintage_year").over(everything())
    year = F.col("vintage_year")
    flagged = years.select("*", (year == first).alias("_first"), (year == last).alias("_last"))
    start, end = F.col("start_volume").cast("double"), F.col("end_volume").cast("double")
    factor = F.pow(end / start, 1 / F.col("num_years"))
    return (
        flagged.filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("industry_sector")
        .agg(
            F.min(year).alias("start_year"),
            F.max(year).alias("end_year"),
            F.sum(F.when(F.col("_first"), F.col("_volume")).otherwise(0)).alias("start_volume"),
            F.sum(F.when(F.col("_last"), F.col("_volume")).otherwise(0)).alias("end_volume"),
            F.count(year).alias("num_years"),
        )
        .filter((F.col("num_years") >= min_years) & (F.col("start_volume") > 0))
        .withColumn("cagr_pct", F.when(F.col("end_volume") > 0, rounded((factor - 1) * 100, 2)))
        .orderBy(F.desc(F.coalesce("cagr_pct", F.lit(0.0))), "industry_sector")
    )


def mix_by_size(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("loan_size_bucket")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_in_bucket"),
            mean("term_months", 1).alias("avg_term_months"),
        )
        .withColumn("pct_of_count", share_of("loan_count", everything()))
        .withColumn("pct_of_volume", share_of("total_volume", everything()))
        .orderBy(B.position(F.col("loan_size_bucket"), B.SIZE_ORDER))
        .select(
            "loan_size_bucket", "loan_count", "pct_of_count", "total_volume", "pct_of_volume",
            "avg_in_bucket", "avg_term_months",
        )
    )


def mix_by_term(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("term_category")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            mean("sba_guarantee_pct").alias("avg_guarantee_pct"),
        )
        .withColumn("pct_of_count", share_of("loan_count", everything()))
        .withColumn("pct_of_volume", share_of("total_volume", everything()))
        .orderBy(B.position(F.col("term_category"), B.TERM_ORDER))
        .select(
            "term_category", "loan_count", "pct_of_count", "total_volume", "pct_of_volume",
            "avg_loan_size", "avg_guarantee_pct",
        )
    )


def mix_by_business(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("business_size", "business_type")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            F.sum("jobs_created").alias("total_jobs_created"),
            F.sum("jobs_retained").alias("total_jobs_retained"),
        )
        .withColumn("pct_of_total", share_of("loan_count", everything()))
        .orderBy("business_size", "business_type")
    )


def urban_rural_mix(clean: DataFrame, min_year: int = 2010) -> DataFrame:
    """Locations per vintage; shares are of the vintage."""
    return (
        known(clean)
        .filter(F.col("vintage_year") >= min_year)
        .groupBy("location_type", "vintage_year")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
        )
        .withColumn("pct_of_year", share_of("loan_count", Window.partitionBy("vintage_year")))
        .orderBy(F.desc("vintage_year"), "location_type")
    )


def guarantee_distribution(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .filter("gross_approved > 0")
        .groupBy(B.guarantee_band(F.col("sba_guarantee_pct")).alias("guarantee_bucket"))
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_gross"),
            F.sum("sba_approved").alias("total_sba_exposure"),
            mean("gross_approved").alias("avg_loan_size"),
        )
        .withColumn("pct_of_loans", share_of("loan_count", everything()))
        .orderBy(B.position(F.col("guarantee_bucket"), B.GUARANTEE_ORDER))
    )


def guarantee_by_year(clean: DataFrame) -> DataFrame:
    """Guaranteed share per vintage, weighted by volume and averaged over loans."""
    return (
        known(clean)
        .groupBy("vintage_year")
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_gross_approved"),
            F.sum("sba_approved").alias("total_sba_guaranteed"),
            pct(F.sum("sba_approved"), volume()).alias("portfolio_guarantee_pct"),
            mean("sba_guarantee_pct").alias("avg_loan_guarantee_pct"),
        )
        .orderBy(F.desc_nulls_first("vintage_year"))
    )


def named_lenders(clean: DataFrame) -> DataFrame:
    return known(clean).filter(F.col("bank_name") != NO_LENDER)


def top_lenders(clean: DataFrame, min_loans: int = 50, top_k: int = 25) -> DataFrame:
    """Lenders with the largest volume; market shares are of the lenders above the minimum.

    Loans are first summed per lender and state, which makes the distinct count a plain count.
    The totals are a scalar subquery: no window over all lenders.
    """
    lender = ["bank_name", "bank_state"]
    lenders = (
        named_lenders(clean)
        .groupBy(*lender, "state")
        .agg(loan_count().alias("_loans"), volume().alias("_volume"))
        .groupBy(*lender)
        .agg(
            F.sum("_loans").alias("loan_count"),
            F.sum("_volume").alias("total_volume"),
            F.count(F.lit(1)).alias("states_served"),
        )
        .filter(F.col("loan_count") >= min_loans)
    )
    total = lenders.agg(
        F.struct(F.sum("loan_count").alias("loans"), F.sum("total_volume").alias("volume"))
    ).scalar()
    return (
        lenders.orderBy(F.desc("total_volume"), *lender)
        .limit(top_k)
        .select(
            *lender, "loan_count", "total_volume",
            ratio("total_volume", "loan_count").alias("avg_loan_size"),
            pct("loan_count", total["loans"], 4).alias("market_share_count"),
            pct("total_volume", total["volume"], 4).alias("market_share_volume"),
            "states_served",
        )
        .orderBy(F.desc("total_volume"), *lender)
    )


def lender_concentration(clean: DataFrame, cuts: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """Volume of the top lenders (each cut includes the smaller ones) and of all others.

    Shares are of all loans with a known outcome, those without a lender name too. Only the
    lenders within the largest cut are ranked.
    """
    lenders = (
        known(clean)
        .groupBy("bank_name")
        .agg(volume().alias("_all"))
        .withColumn("_volume", F.when(F.col("bank_name") != NO_LENDER, F.col("_all")))
    )
    sums = F.struct(
        F.sum("_all").alias("all"),
        F.sum("_volume").alias("named"),
        F.count("_volume").alias("lenders"),
    )
    total = lenders.agg(sums).scalar()
    # Loans without a lender sort last; a filter before the limit would be pushed into the scan,
    # and the totals could not share it.
    order = [F.desc_nulls_last("_volume"), F.asc("bank_name")]
    top = (
        lenders.orderBy(*order)
        .limit(max(cuts))
        .withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    )
    parts = [
        (f"Top {cut} Lenders", F.sum(F.when(F.col("_rank") <= cut, F.col("_volume"))))
        for cut in cuts
    ]
    others = F.when(total["lenders"] > max(cuts), total["named"] - F.sum("_volume"))
    parts.append(("All Other Lenders", others))
    segments = F.array(
        *[
            F.struct(F.lit(name).alias("segment"), amount.cast("decimal(35,2)").alias("segment_volume"))
            for name, amount in parts
        ]
    )
    return (
        top.agg(segments.alias("_segments"))
        .select(F.inline("_segments"))
        .withColumn("pct_of_portfolio", pct("segment_volume", total["all"]))
    )


def summed(name: str, years_back: int | None = None) -> Column:
    """A sum of ``by_vintage`` over all years, or in the latest year or one before it."""
    if years_back is None:
        return F.sum(name)
    here = F.col("vintage_year") == F.col("latest") - years_back
    return F.sum(F.when(here, F.col(name)))


def counted(name: str, years_back: int | None = None) -> Column:
    return F.coalesce(summed(name, years_back), F.lit(0))


# Columns whose values the summary counts, by the name of the count.
ACTIVE = {"active_lenders": "bank_name", "states_with_loans": "state"}


def portfolio_kpi_summary(clean: DataFrame) -> DataFrame:
    """One row of portfolio figures with the latest vintage and the one before it."""
    sums = ("volume", "exposure", "terms", "guarantees", "created", "retained")
    return kpis_of(by_vintage(clean, sums, ACTIVE))


def kpis_of(years: DataFrame) -> DataFrame:
    """The summary from rows as ``by_vintage`` gives them."""
    listed = F.when(F.col("loans") > 0, F.col("vintage_year"))
    return (
        years
        .agg(
            F.max(listed).alias("current_year"),
            counted("loans").alias("total_loans"),
            summed("volume").alias("total_volume"),
            summed("exposure").alias("total_sba_exposure"),
            ratio(summed("volume"), summed("loans")).alias("avg_loan_size"),
            ratio(summed("terms"), summed("loans"), 1).alias("avg_term_months"),
            ratio(summed("guarantees"), summed("loans")).alias("avg_guarantee_pct"),
            (summed("created") + summed("retained")).alias("total_jobs_impacted"),
            counted("loans", 0).alias("ytd_loan_count"),
            summed("volume", 0).alias("ytd_volume"),
            counted("loans", 1).alias("prior_ytd_count"),
            summed("volume", 1).alias("prior_ytd_volume"),
            *[F.max(name).alias(name) for name in ACTIVE],
        )
        .withColumn("ytd_vs_prior_pct", growth("ytd_volume", F.col("prior_ytd_volume")))
    )
