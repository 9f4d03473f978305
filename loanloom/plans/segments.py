"""States, industries and lenders compared, over clean loans with a known outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions import buckets as B
from loanloom.functions.metrics import (
    default_rate, defaults, jobs, known, loan_count, loss_rate, losses, volume,
)
from loanloom.functions.numeric import everything, mean, pct, ratio, share_of
from loanloom.operators.ranks import ranked
from loanloom.plans.cohort import compared
from loanloom.plans.kpis import NO_LENDER, named_lenders, with_states
from loanloom.plans.risk import exact_rate, minus_mean
from loanloom.sources.store import stored

LENDER = ["bank_name", "bank_state"]


def state_ranking(clean: DataFrame, min_loans: int = 100) -> DataFrame:
    """States ranked by volume and default rate, with their quartile by rate."""
    rate = F.col("default_rate").cast("double")

    def quartile(p: float) -> Column:
        return F.round(F.percentile(rate, p).over(everything()), 6)

    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
    )
    return (
        with_states(states)
        .select(
            "state", "state_name", "region", "total_loans", "total_volume", "avg_loan_size",
            "default_rate", "loss_rate",
            F.rank().over(Window.orderBy(F.desc("total_volume"))).alias("volume_rank"),
            F.rank().over(Window.orderBy("default_rate")).alias("best_default_rank"),
            F.rank().over(Window.orderBy(F.desc("default_rate"))).alias("worst_default_rank"),
            minus_mean("default_rate").alias("default_vs_national"),
            F.when(rate < quartile(0.25), "Top Quartile")
            .when(rate < quartile(0.5), "Second Quartile")
            .when(rate < quartile(0.75), "Third Quartile")
            .otherwise("Bottom Quartile")
            .alias("performance_quartile"),
        )
        .orderBy(F.desc("total_volume"), "state")
    )


def best_worst_states(clean: DataFrame, min_loans: int = 500, top_k: int = 10) -> DataFrame:
    """The states with the lowest and the highest default rates; one aggregate for both lists."""
    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("total_loans"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
    )
    best = F.struct(F.lit(f"Top {top_k} Best").alias("category"), F.col("_best").alias("rank"))
    worst = F.struct(F.lit(f"Top {top_k} Worst").alias("category"), F.col("_worst").alias("rank"))
    return (
        states.withColumn("_best", F.row_number().over(Window.orderBy("default_rate", "state")))
        .withColumn(
            "_worst", F.row_number().over(Window.orderBy(F.desc("default_rate"), "state"))
        )
        .withColumn("_list", F.explode(F.array(best, worst)))
        .select("_list.category", "state", "total_loans", "default_rate", "loss_rate", "_list.rank")
        .filter(F.col("rank") <= top_k)
        .orderBy("category", "rank")
    )


def regional_performance(clean: DataFrame) -> DataFrame:
    """Regions; loans of states outside the lookup are left out.

    Loans are summed per state first, so the lookup is joined to a few rows and the distinct
    states are a plain count.
    """
    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("_loans"),
            volume().alias("_volume"),
            defaults().alias("_bad"),
            losses().alias("_loss"),
        )
    )
    return (
        with_states(states, "inner")
        .groupBy("region")
        .agg(
            F.sum("_loans").alias("total_loans"),
            F.sum("_volume").alias("total_volume"),
            ratio(F.sum("_volume"), F.sum("_loans")).alias("avg_loan_size"),
            F.sum("_bad").alias("defaults"),
            pct(F.sum("_bad"), F.sum("_loans")).alias("default_rate"),
            F.sum("_loss").alias("total_loss"),
            pct(F.sum("_loss"), F.sum("_volume")).alias("loss_rate"),
            loan_count().alias("states_in_region"),
        )
        .withColumn("pct_of_portfolio", share_of("total_loans", everything()))
        .orderBy(F.desc("total_volume"), "region")
    )


def industry_performance(clean: DataFrame) -> DataFrame:
    """Sectors with their share, rates and ranks by exact default rate."""
    return (
        known(clean)
        .filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("industry_sector")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            losses().alias("total_loss"),
            loss_rate().alias("loss_rate"),
        )
        .withColumn("pct_of_portfolio", share_of("total_loans", everything()))
        .withColumn("risk_rank_best", F.rank().over(Window.orderBy(exact_rate())))
        .withColumn("risk_rank_worst", F.rank().over(Window.orderBy(F.desc(exact_rate()))))
        .orderBy(F.desc("total_volume"), "industry_sector")
    )


def subsector_vs_sector(clean: DataFrame, min_loans: int = 100, top_k: int = 25) -> DataFrame:
    """Two-digit sectors against the whole industry they belong to.

    The industry's rate is a window over the sectors, taken before the small ones are dropped;
    the difference of the two exact rates is rounded once.
    """
    industry = Window.partitionBy("industry_sector")
    n, bad = F.col("total_loans"), F.col("defaults")
    all_n, all_bad = F.col("_industry_loans"), F.col("_industry_defaults")
    wide = "decimal(19,0)"
    gap = bad.cast(wide) * all_n.cast(wide) - all_bad.cast(wide) * n.cast(wide)
    return (
        known(clean)
        .groupBy("naics_sector", "industry_sector")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            mean("term_months", 1).alias("avg_term_months"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .withColumn("_industry_loans", F.sum("total_loans").over(industry))
        .withColumn("_industry_defaults", F.sum("defaults").over(industry))
        .filter(n >= min_loans)
        .withColumn("vs_sector_avg", pct(gap, n.cast(wide) * all_n.cast(wide)))
        .drop("_industry_loans", "_industry_defaults")
        .orderBy(F.desc("total_volume"), "naics_sector")
        .limit(top_k)
    )


def running_share(amount: str, name: str) -> Column:
    """Sum of the rounded shares down to this row's amount; equal amounts share the sum."""
    down_to = Window.orderBy(F.desc(amount)).rangeBetween(Window.unboundedPreceding, 0)
    return F.sum(name).over(down_to)


def industry_concentration(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("industry_sector")
        .agg(volume().alias("sector_volume"))
        .withColumn("pct_of_portfolio", share_of("sector_volume", everything()))
        .withColumn("cumulative_concentration", running_share("sector_volume", "pct_of_portfolio"))
        .orderBy(F.desc("sector_volume"), "industry_sector")
    )


def industry_trend(clean: DataFrame, min_year: int = 2010, min_loans: int = 50) -> DataFrame:
    """Default rate per sector and vintage, with the change to the vintage listed before."""
    series = Window.partitionBy("industry_sector").orderBy("vintage_year")
    wide = "decimal(18,0)"
    n, bad = F.col("loans").cast(wide), F.col("_bad").cast(wide)
    old_n, old_bad = F.lag(n).over(series), F.lag(bad).over(series)
    return (
        known(clean)
        .filter((F.col("industry_sector") != B.UNKNOWN) & (F.col("vintage_year") >= min_year))
        .groupBy("industry_sector", "vintage_year")
        .agg(
            loan_count().alias("loans"),
            defaults().alias("_bad"),
            default_rate().alias("default_rate"),
        )
        .filter(F.col("loans") >= min_loans)
        .withColumn("yoy_change", pct(bad * old_n - old_bad * n, n * old_n))
        .drop("_bad")
        .orderBy("industry_sector", F.desc("vintage_year"))
    )


def lenders_served(clean: DataFrame) -> DataFrame:
    """Figures per lender with the number of states and sectors."""
    return (
        named_lenders(clean)
        .groupBy(*LENDER)
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
            F.countDistinct("state").alias("states_served"),
            F.countDistinct("industry_sector").alias("industries_served"),
            F.min("approval_date").alias("first_loan_date"),
            F.max("approval_date").alias("last_loan_date"),
        )
    )


def lender_ranking(clean: DataFrame, min_loans: int = 100, top_k: int = 50) -> DataFrame:
    """The largest lenders, ranked among all lenders above the minimum.

    No window runs over all lenders. Rounded rates take at most 10,001 values, so counting
    lenders per rate gives every rank. Quartiles break ties by volume, largest first: whoever
    precedes a shown lender within its rate is larger and therefore shown too. Lenders are
    summed once and stored, one row each.
    """
    lenders = stored(lenders_served(clean).filter(F.col("total_loans") >= min_loans), "lenders")
    below = Window.orderBy("default_rate").rowsBetween(Window.unboundedPreceding, -1)
    rates = (
        lenders.groupBy("default_rate")
        .agg(loan_count().alias("_here"))
        .withColumn("_below", F.coalesce(F.sum("_here").over(below), F.lit(0)))
        .withColumn("_lenders", F.sum("_here").over(everything()))
        .withColumn("_rate_sum", F.sum(F.col("_here") * F.col("default_rate")).over(everything()))
        .drop("_here")
    )
    largest = [F.desc("total_volume"), *[F.asc(c) for c in LENDER]]
    top = lenders.orderBy(*largest).limit(top_k)
    same_rate = Window.partitionBy("default_rate").orderBy(*largest)
    place = F.col("_below") + F.row_number().over(same_rate) - 1
    total = F.col("_lenders")
    # The first (total % 4) quarters get one lender more than the others.
    small, larger = F.floor(total / 4), total % 4
    in_larger = larger * (small + 1)
    quarter = F.when(place < in_larger, F.floor(place / (small + 1))).otherwise(
        larger + F.floor((place - in_larger) / small)
    )
    return (
        top.join(F.broadcast(rates), "default_rate")
        .select(
            *LENDER, "total_loans", "total_volume", "avg_loan_size", "default_rate", "loss_rate",
            "states_served", "industries_served",
            F.rank().over(Window.orderBy(F.desc("total_volume"))).alias("volume_rank"),
            (F.col("_below") + 1).alias("performance_rank"),
            (quarter + 1).cast("int").alias("performance_quartile"),
            ((F.col("default_rate") * total - F.col("_rate_sum")).cast("double") / total).alias(
                "vs_avg_default_rate"
            ),
        )
        .orderBy(*largest)
    )


def lender_ranks(clean: DataFrame, min_loans: int = 1) -> DataFrame:
    """Every lender with at least the minimum: rank by volume, rank and quartile by default rate.

    Lenders may be many, so neither order is a window over all of them. Equal rates share a rank;
    quartiles take the larger of two lenders with one rate first.
    """
    lenders = stored(
        lenders_served(clean)
        .filter(F.col("total_loans") >= min_loans)
        .select(*LENDER, "total_loans", "total_volume", "default_rate"),
        "all_lenders",
    )
    names = dict.fromkeys(LENDER, False)
    by_volume = ranked(lenders, {"total_volume": True}, names, rank="volume_rank")
    return ranked(
        by_volume,
        {"default_rate": False},
        {"total_volume": True, **names},
        rank="performance_rank",
        dense_rank="rate_step",
        ntile=("performance_quartile", 4),
    )


def lender_vs_state(
    clean: DataFrame, min_loans: int = 100, min_lenders: int = 3, top_k: int = 30
) -> DataFrame:
    """Lenders against the plain mean of the lenders of their home state."""
    lenders = (
        named_lenders(clean)
        .groupBy(*LENDER)
        .agg(loan_count().alias("total_loans"), default_rate().alias("default_rate"))
        .filter(F.col("total_loans") >= min_loans)
    )
    homes = (
        lenders.groupBy("bank_state")
        .agg(mean("default_rate").alias("state_avg_default_rate"), loan_count().alias("_lenders"))
        .filter(F.col("_lenders") >= min_lenders)
        .drop("_lenders")
    )
    rate, usual = F.col("default_rate"), F.col("state_avg_default_rate")
    return (
        lenders.join(homes, "bank_state")
        .select(
            "bank_name", "bank_state", "total_loans", "default_rate", "state_avg_default_rate",
            (rate - usual).alias("vs_state_avg"),
            compared(
                rate, usual, "Outperforms State", "Underperforms State", "Average for State"
            ).alias("state_performance"),
        )
        .orderBy(F.desc("total_loans"), *LENDER)
        .limit(top_k)
    )


def lender_specialisation(clean: DataFrame, min_loans: int = 20, top_k: int = 20) -> DataFrame:
    """Sectors of the largest lenders, as shares of each lender's known sectors.

    Lenders and sectors are summed once and stored, one row per pair.
    """
    lender = Window.partitionBy("bank_name")
    pairs = stored(
        named_lenders(clean)
        .groupBy("bank_name", "industry_sector")
        .agg(
            loan_count().alias("loans_in_industry"),
            default_rate().alias("industry_default_rate"),
            volume().alias("_volume"),
        ),
        "lender_sectors",
    )
    top = (
        pairs.groupBy("bank_name")
        .agg(F.sum("_volume").alias("_volume"))
        .orderBy(F.desc("_volume"), "bank_name")
        .limit(top_k)
    )
    return (
        pairs.filter(F.col("industry_sector") != B.UNKNOWN)
        .join(F.broadcast(top.select("bank_name")), "bank_name", "left_semi")
        .withColumn("pct_of_lender_portfolio", share_of("loans_in_industry", lender))
        .filter(F.col("loans_in_industry") >= min_loans)
        .select(
            "bank_name", "industry_sector", "loans_in_industry", "pct_of_lender_portfolio",
            "industry_default_rate",
            F.rank().over(lender.orderBy(F.desc("loans_in_industry"))).alias("industry_rank"),
        )
        .orderBy("bank_name", F.desc("loans_in_industry"), "industry_sector")
    )


def _state_totals(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("state")
        .agg(loan_count().alias("state_loans"), volume().alias("state_volume"))
    )


def _squared_share() -> Column:
    amount = F.col("state_volume")
    share = amount.cast("double") * 100 / F.sum(amount).over(everything()).cast("double")
    return share * share


def state_concentration(clean: DataFrame) -> DataFrame:
    """Shares per state, their running sum and their squares."""
    return (
        _state_totals(clean)
        .withColumn("pct_of_loans", share_of("state_loans", everything()))
        .withColumn("pct_of_volume", share_of("state_volume", everything()))
        .withColumn("cumulative_volume_pct", running_share("state_volume", "pct_of_volume"))
        .withColumn("hhi_contribution", _squared_share())
        .orderBy(F.desc("state_volume"), "state")
    )


def geographic_hhi(
    clean: DataFrame, moderate_from: float = 1500, high_from: float = 2500
) -> DataFrame:
    """Herfindahl-Hirschman index over the states: the sum of squared percentage shares."""
    index = F.col("_hhi")
    level = (
        F.when(index < moderate_from, "Unconcentrated")
        .when(index < high_from, "Moderately Concentrated")
        .otherwise("Highly Concentrated")
    )
    return (
        _state_totals(clean)
        .withColumn("_square", _squared_share())
        .agg(F.sum("_square").alias("_hhi"), loan_count().alias("num_states"))
        .select(
            F.lit("Geographic Concentration (HHI)").alias("metric"),
            F.round(index, 2).alias("hhi_score"),
            level.alias("concentration_level"),
            "num_states",
        )
    )


def cross_state_flows(clean: DataFrame, min_loans: int = 50, top_k: int = 30) -> DataFrame:
    """Lender state to borrower state. Two unknown states count as the same one."""
    home, away = F.col("lender_home_state"), F.col("borrower_state")
    return (
        known(clean)
        .groupBy(F.col("bank_state").alias("lender_home_state"), F.col("state").alias("borrower_state"))
        .agg(
            loan_count().alias("loan_count"),
            volume().alias("total_volume"),
            default_rate().alias("default_rate"),
        )
        .filter(F.col("loan_count") >= min_loans)
        .withColumn("lending_type", F.when(home == away, "In-State").otherwise("Out-of-State"))
        .orderBy(F.desc("loan_count"), home, away)
        .limit(top_k)
    )


def in_out_of_state(clean: DataFrame) -> DataFrame:
    same = F.col("bank_state") == F.col("state")
    label = F.when(same, "In-State Lending").otherwise("Out-of-State Lending")
    return (
        known(clean)
        .groupBy(label.alias("lending_type"))
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            defaults().alias("defaults"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .withColumn("pct_of_portfolio", share_of("total_loans", everything()))
        .orderBy(F.desc("total_loans"))
    )


def state_industry_matrix(clean: DataFrame, min_loans: int = 50, top_k: int = 50) -> DataFrame:
    """State and sector pairs, ranked within the state and within the sector."""
    most = F.desc("loans")
    return (
        known(clean)
        .filter(F.col("industry_sector") != B.UNKNOWN)
        .groupBy("state", "industry_sector")
        .agg(
            loan_count().alias("loans"),
            volume().alias("volume"),
            default_rate().alias("default_rate"),
        )
        .filter(F.col("loans") >= min_loans)
        .withColumn("industry_rank_in_state", F.rank().over(Window.partitionBy("state").orderBy(most)))
        .withColumn(
            "state_rank_in_industry",
            F.rank().over(Window.partitionBy("industry_sector").orderBy(most)),
        )
        .orderBy(most, "state", "industry_sector")
        .limit(top_k)
    )


def business_location_size(clean: DataFrame, min_loans: int = 100) -> DataFrame:
    keys = ["business_type", "location_type", "loan_size_bucket"]
    return (
        known(clean)
        .groupBy(*keys)
        .agg(
            loan_count().alias("total_loans"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
        )
        .filter(F.col("total_loans") >= min_loans)
        .orderBy(*keys)
    )


def geographic_summary(clean: DataFrame) -> DataFrame:
    states = (
        known(clean)
        .groupBy("state")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
            jobs().alias("total_jobs_impacted"),
        )
    )
    return with_states(states).select(
        "state", "state_name", "region", "division", "total_loans", "total_volume",
        "avg_loan_size", "default_rate", "loss_rate", "total_jobs_impacted",
    )


def industry_summary(clean: DataFrame) -> DataFrame:
    return (
        known(clean)
        .groupBy("naics_sector", "industry_sector")
        .agg(
            loan_count().alias("total_loans"),
            volume().alias("total_volume"),
            mean("gross_approved").alias("avg_loan_size"),
            default_rate().alias("default_rate"),
            loss_rate().alias("loss_rate"),
            mean("term_months", 1).alias("avg_term_months"),
        )
    )


def lender_summary(clean: DataFrame) -> DataFrame:
    return lenders_served(clean)


def summary_counts(clean: DataFrame) -> DataFrame:
    """Rows of the three summaries: the distinct keys of each, from one scan."""
    views = {
        "Geographic Summary": ["state"],
        "Industry Summary": ["naics_sector", "industry_sector"],
        "Lender Summary": LENDER,
    }
    columns = [c for keys in views.values() for c in keys]
    view = F
    for name, keys in views.items():
        view = view.when(F.grouping(keys[0]) == 0, F.lit(name))
    return (
        known(clean)
        .groupingSets(list(views.values()), *columns)
        .agg(view.alias("view_name"))
        .filter((F.col("view_name") != "Lender Summary") | (F.col("bank_name") != NO_LENDER))
        .groupBy("view_name")
        .agg(loan_count().alias("record_count"))
    )
