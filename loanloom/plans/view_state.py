"""State of the executive views, kept with a stored loan table and carried on by every load.

Three small tables per version, written by the load that makes it and published with its rows:

    sums    figures per vintage year and value of a side: day, lender, state, sector and so on, and all loans
    codes   the dictionary of lenders, states and sectors (``operators.bitmaps``)
    words   which of these occur among the loans of a vintage year, state or sector, as bits

A load reads its own rows and the state of the version before, never the older rows. Sums are exact
decimals and whole numbers, so adding them load by load gives what one pass over all rows gives. Days are kept,
not months, since reports of the last five years may begin within a month. The state grows with the
days and lenders times years, not with the loans.

The reports below have the results of their namesakes in ``dashboard`` and ``kpis``, from the state alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loanloom.functions.dates import as_of_date
from loanloom.functions.metrics import known, known_sums, per_value
from loanloom.functions.numeric import ratio
from loanloom.operators import bitmaps
from loanloom.operators.clean import clean
from loanloom.plans import dashboard, kpis
from loanloom.sources.store import stored
from loanloom.sources.versions import Table

BY_YEAR = "Vintage Year"
SIDES = {"Day": "approval_date", "Lender": "bank_name"} | {
    name: column for name, column in dashboard.DIMENSIONS.items() if name != BY_YEAR
}
COUNTED = {"Lender": "bank_name", "State": "state", "Industry": "industry_sector"}
WITHIN = {"State": "state", "Industry": "industry_sector"}

MONEY = "decimal(38,2)"
SUMS = {
    "loans": "bigint", "defaults": "bigint", "volume": MONEY, "exposure": MONEY, "terms": "bigint",
    "guarantees": MONEY, "created": "bigint", "retained": "bigint", "losses": MONEY, "bad_volume": MONEY,
}
GROUP = "vintage_year int, side string, value string"
TABLES = {
    "sums": f"{GROUP}, booked bigint, {', '.join(f'{n} {t}' for n, t in SUMS.items())}",
    "codes": "of string, value string, code bigint",
    "words": f"{GROUP}, of string, word bigint, bits bigint",
}
KEY = ["vintage_year", "side", "value"]


def summed(loans: DataFrame) -> DataFrame:
    """The sums of a clean table, from one scan."""
    figures = [column.cast(SUMS[name]).alias(name) for name, column in known_sums().items()]
    booked = F.count(F.lit(1)).alias("booked")
    return per_value(loans, SIDES, booked, *figures, total="all", by=["vintage_year"]).select(
        *KEY, "booked", *SUMS
    )


def added(sums: DataFrame) -> DataFrame:
    """Sums of the same group, from several loads, as one."""
    return sums.groupBy(*KEY).agg(
        F.sum("booked").alias("booked"), *[F.sum(name).cast(kind).alias(name) for name, kind in SUMS.items()]
    )


def occurring(loans: DataFrame, codes: DataFrame) -> DataFrame:
    """The words of a clean table: lenders, states and sectors of its loans with a known outcome."""
    return bitmaps.words(known(loans), COUNTED, codes, WITHIN, total="all", by=["vintage_year"])


class ViewState:
    """The state of a version: its three tables as frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.sums, self.codes, self.words = (
            spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()
        )

    def on(self, *sides: str) -> DataFrame:
        return self.sums.filter(F.col("side").isin(*sides))

    def distinct(self, *by: str) -> DataFrame:
        """Numbers of lenders, states and sectors per group, merged over years unless ``by`` has them."""
        return bitmaps.distinct_counts(bitmaps.merged(self.words, by), list(COUNTED), by)


def extend(table: Table, load: str, rows: DataFrame, replace: bool = False) -> None:
    """Write the state after a load: that of the table's version, and the load's accepted rows.

    With ``replace`` the rows are all there is. A table that has rows but no state is read once as a whole.
    """
    spark, folder = table.spark, table.views(load)
    before = None if replace or table.views() is None else ViewState(spark, table.views())
    if before is None and not replace and table.loads:
        rows = table.rows().unionByName(rows)
    loans = clean(rows)
    own = stored(summed(loans), "view_sums")
    sums = own if before is None else added(before.sums.unionByName(own))
    sums.write.parquet(f"{folder}/sums")

    found = own.filter(F.col("side").isin(*COUNTED) & (F.col("loans") > 0))
    counts = found.groupBy(F.col("side").alias("of"), "value").agg(F.sum("loans").alias("n"))
    codes = bitmaps.dictionary(counts, before.codes if before else None)
    codes.write.parquet(f"{folder}/codes")

    words = occurring(loans, spark.read.schema(TABLES["codes"]).parquet(f"{folder}/codes"))
    if before is not None:
        words = bitmaps.merged(before.words.unionByName(words), KEY)
    words.write.parquet(f"{folder}/words")


def read_state(table: Table) -> ViewState:
    """The state at the table's version."""
    folder = table.views()
    if folder is None:
        raise ValueError(f"{table.path} keeps no state of views at version {table.version}")
    return ViewState(table.spark, folder)


# Reports from the state.


def _years(state: ViewState, distinct: dict[str, str]) -> DataFrame:
    """What ``metrics.by_vintage`` gives: sums per year, the latest year, and counts of distinct values."""
    kinds = {column: kind for kind, column in COUNTED.items()}
    whole = state.distinct("side").filter("side = 'all'")
    counts = whole.agg(F.struct(*[F.max(kind).alias(kind) for kind in COUNTED])).scalar()
    return state.on("all").select(
        "vintage_year",
        *SUMS,
        F.max("vintage_year").over(Window.partitionBy()).alias("latest"),
        *[counts[kinds[column]].alias(name) for name, column in distinct.items()],
    )


def _totals(state: ViewState) -> DataFrame:
    """What ``dashboard.segment_totals`` gives, for all dimensions."""
    by_year = F.col("side") == "all"
    return (
        state.on("all", *dashboard.DIMENSIONS)
        .groupBy(
            F.when(by_year, BY_YEAR).otherwise(F.col("side")).alias("dimension"),
            F.when(by_year, F.col("vintage_year").cast("string")).otherwise(F.col("value")).alias("value"),
        )
        .agg(
            F.sum("loans").alias("total_loans"),
            F.sum("defaults").alias("defaults"),
            F.sum("volume").alias("volume"),
            F.sum("losses").alias("loss"),
        )
        .filter("total_loans > 0")
    )


def _days(state: ViewState) -> DataFrame:
    return state.on("Day").withColumn("day", F.to_date("value"))


def executive_summary(state: ViewState, as_of: dt.date | None = None) -> DataFrame:
    return dashboard.summary_of(_years(state, dashboard.REPRESENTED), as_of)


def portfolio_kpi_summary(state: ViewState) -> DataFrame:
    return kpis.kpis_of(_years(state, kpis.ACTIVE))


def monthly_trends(state: ViewState, as_of: dt.date | None = None) -> DataFrame:
    days = _days(state).filter((F.col("loans") > 0) & (F.col("day") >= F.add_months(as_of_date(as_of), -60)))
    months = days.groupBy(F.trunc("day", "MM").alias("month")).agg(
        F.sum("loans").alias("loans"),
        F.sum("volume").alias("volume"),
        ratio(F.sum("volume"), F.sum("loans")).alias("avg_loan_size"),
        F.sum("defaults").alias("defaults"),
        F.sum("losses").alias("chargeoff"),
    )
    return dashboard.trends_of(months)


def ytd_comparison(state: ViewState) -> DataFrame:
    months = _days(state).groupBy("vintage_year", F.month("day").alias("month"))
    return dashboard.to_date_of(months.agg(F.sum("loans").alias("_loans"), F.sum("volume").alias("_volume")))


def dimension_drilldown(state: ViewState) -> DataFrame:
    return dashboard.drilldown_of(_totals(state))


def top_rankings(state: ViewState, top_k: int = 10) -> DataFrame:
    states = _totals(state).filter("dimension = 'State'")
    return dashboard.top_states_of(
        states.select(F.col("value").alias("entity"), F.col("volume").alias("metric_value")), top_k
    )


def comprehensive_rankings(state: ViewState, min_loans: int = 500, top_k: int = 10) -> DataFrame:
    return dashboard.rankings_of(_totals(state), min_loans, top_k)


def risk_watchlist(state: ViewState, min_loans: int = 100, elevated: int = 12, high: int = 15) -> DataFrame:
    return dashboard.watchlist_of(_totals(state), min_loans, elevated, high)


def portfolio_snapshot(state: ViewState, as_of: dt.date | None = None) -> DataFrame:
    # the days together have the sums of all loans, and the first and the last day
    sides = state.on("Day", *dashboard.SNAPSHOT_SIDES).filter("loans > 0")
    of_days = F.col("side") == "Day"
    day = F.when(of_days, F.to_date("value"))
    totals = sides.groupBy(
        F.when(of_days, "all").otherwise(F.col("side")).alias("side"),
        F.when(~of_days, F.col("value")).alias("value"),
    ).agg(
        *[F.sum(name).alias(name) for name in SUMS], F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    return dashboard.snapshot_of(totals, as_of)


def lenders_reached(state: ViewState) -> DataFrame:
    """Distinct lenders, states and sectors among known loans: in all, per state and sector, each also per year."""
    per_year = state.distinct(*KEY)
    whole = state.distinct("side", "value").withColumn("vintage_year", F.lit(None).cast("int"))
    return per_year.withColumn("span", F.lit("year")).unionByName(whole.withColumn("span", F.lit("all"))).select(
        "span", "vintage_year", "side", "value",
        F.col("Lender").alias("lenders"), F.col("State").alias("states"), F.col("Industry").alias("industries"),
    )


REPORTS = {
    fn.__name__: fn
    for fn in (
        executive_summary, portfolio_kpi_summary, monthly_trends, ytd_comparison, dimension_drilldown,
        top_rankings, comprehensive_rankings, risk_watchlist, portfolio_snapshot,
    )
}
DATED = ("executive_summary", "monthly_trends", "portfolio_snapshot")
