"""Aggregate columns shared by the portfolio queries, over the clean loan table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions.numeric import pct

OUTCOMES = ("PIF", "CHGOFF")


def known(loans: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """Loans whose outcome is known."""
    return loans.filter(F.col("loan_status").isin(*outcomes))


def loan_count() -> Column:
    return F.count(F.lit(1))


def defaults() -> Column:
    return F.count_if(F.col("is_defaulted"))


def volume() -> Column:
    return F.sum("gross_approved")


def losses() -> Column:
    return F.sum("chargeoff_amount")


def defaulted(column: str) -> Column:
    """The column on defaulted loans, NULL elsewhere."""
    return F.when(F.col("is_defaulted"), F.col(column))


def default_exposure(column: str = "gross_approved") -> Column:
    """Sum over the defaulted loans; 0 if there are none."""
    return F.coalesce(F.sum(defaulted(column)), F.lit(0))


def default_rate() -> Column:
    return pct(defaults(), loan_count())


def loss_rate(digits: int = 2) -> Column:
    return pct(losses(), volume(), digits)


def loss_given_default() -> Column:
    """Losses of all loans in the group over the exposure of the defaulted ones."""
    return pct(losses(), F.sum(defaulted("gross_approved")))


def jobs() -> Column:
    return F.sum(F.col("jobs_created") + F.col("jobs_retained"))


def per_value(
    loans: DataFrame,
    sides: dict[str, str],
    *metrics: Column,
    total: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Metrics per value of each column on its own: columns ``side`` and ``value``, then metrics.

    Grouping sets: one scan, and what is shuffled is one row per task and value. Grouping by
    the combination of the columns first would shuffle nearly every loan. ``total`` names a
    side with one row of all loans. Columns ``by``, which come first, divide every group further.
    """
    columns = list(sides.values())
    side = value = F.when(F.lit(False), "")  # so that there may be no sides
    for name, column in sides.items():
        own = F.grouping(column) == 0
        side = side.when(own, F.lit(name))
        value = value.when(own, F.col(column).cast("string"))
    sets = [[c, *by] for c in columns] + ([[*by]] if total else [])
    return (
        loans.groupingSets(sets, *columns, *by)
        .agg(side.otherwise(F.lit(total)).alias("side"), value.alias("value"), *metrics)
        .drop(*columns)
    )


def distinct_counts(loans: DataFrame, columns: dict[str, str]) -> Column:
    """Numbers of distinct values as one struct, a field per entry of ``columns``."""
    values = per_value(loans, columns, loan_count().alias("_loans"))
    return values.agg(
        F.struct(*[F.count_if(F.col("side") == name).alias(name) for name in columns])
    ).scalar()


def known_sums() -> dict[str, Column]:
    """Sums over the loans with a known outcome, for groups of all loans."""
    is_known = F.col("loan_status").isin(*OUTCOMES)
    bad = is_known & F.col("is_defaulted")

    def total(column: str, where: Column = is_known) -> Column:
        return F.sum(F.when(where, F.col(column)))

    return {
        "loans": F.count_if(is_known),
        "defaults": F.count_if(bad),
        "volume": total("gross_approved"),
        "exposure": total("sba_approved"),
        "terms": total("term_months"),
        "guarantees": total("sba_guarantee_pct"),
        "created": total("jobs_created"),
        "retained": total("jobs_retained"),
        "losses": total("chargeoff_amount"),
        "bad_volume": total("gross_approved", bad),
    }


def by_vintage(clean: DataFrame, sums: Sequence[str], distinct: dict[str, str]) -> DataFrame:
    """One row per vintage year of all loans, and the latest of those years, from one scan.

    ``sums`` are entries of ``known_sums``. ``distinct`` counts the values of columns among the
    loans with a known outcome; every row has those counts. Values of the columns are one row
    per task and value in the shuffle, years and columns one row each after it.
    """
    wanted = known_sums()
    year = F.when(F.col("side") == "year", F.col("value").cast("int"))
    names = dict.fromkeys(["loans", *sums])
    rows = per_value(
        clean, {"year": "vintage_year", **distinct}, *[wanted[n].alias(n) for n in names]
    )
    few = rows.groupBy("side", year.alias("vintage_year")).agg(
        *[F.sum(n).alias(n) for n in names], F.count_if(F.col("loans") > 0).alias("_values")
    )
    whole = Window.partitionBy()
    counts = [
        F.sum(F.when(F.col("side") == name, F.col("_values"))).over(whole).alias(name)
        for name in distinct
    ]
    return few.select(
        "*", F.max("vintage_year").over(whole).alias("latest"), *counts
    ).filter(F.col("side") == "year")
