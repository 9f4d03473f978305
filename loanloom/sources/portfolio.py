"""The two tables the queries read, each stored on first use."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.operators.clean import clean
from loanloom.sources.star_mapping import loans_from_orders, staging_from_orders
from loanloom.sources.ingest import incremental_load, loan_table, write_loans
from loanloom.sources.store import input_state, new_table_path, stored
from loanloom.sources.versions import Table

INPUTS = ("orders", "customer", "supplier", "lineitem")


class Portfolio:
    """The typed loans and their clean form, so filters and columns reach the files.

    The clean table is stored by vintage year: reports over a range of years open only those. It is written by
    the tasks that make the loans: shuffling its wide rows by year would move more bytes than making them does.
    """

    def __init__(self, make: Callable[[], DataFrame], as_of: dt.date | None = None):
        self._make, self._as_of = make, as_of

    @cached_property
    def loans(self) -> DataFrame:
        return stored(self._make(), "loans")

    @cached_property
    def clean(self) -> DataFrame:
        return stored(clean(self._make(), self._as_of), "clean_loans", "vintage_year", spread=False)

    @cached_property
    def loaded(self) -> Table:
        """The loans as a table with view state: a first load, and two more up to later days."""
        path = new_table_path(self.loans.sparkSession, "loans_with_views")
        write_loans(self.loans.filter("approval_date < '2010-01-01'"), path, views=True)
        for upto in ("2014-07-01", "9999-01-01"):
            incremental_load(self.loans.sparkSession, self.loans.filter(F.col("approval_date") < upto), path)
        return loan_table(self.loans.sparkSession, path)

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.loans, self.clean))


def portfolio_of(loans: DataFrame, as_of: dt.date | None = None) -> Portfolio:
    return Portfolio(lambda: loans, as_of)


_stored: dict[tuple, Portfolio] = {}
_staged: dict[tuple, DataFrame] = {}


def _input(spark: SparkSession, sf_dir: str) -> tuple:
    """Where the tables of this application come from; changed files make another input."""
    return (
        spark.sparkContext.applicationId,
        sf_dir,
        input_state(spark, [f"{sf_dir}/{name}.parquet" for name in INPUTS]),
    )


def star_portfolio(spark: SparkSession, sf_dir: str, as_of: dt.date | None = None) -> Portfolio:
    """The portfolio of a directory of order tables; built on first use in this application."""
    key = (*_input(spark, sf_dir), as_of)
    if key not in _stored:
        _stored[key] = Portfolio(lambda: loans_from_orders(spark, sf_dir), as_of)
    return _stored[key]


def star_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text rows of a directory of order tables; stored on first use."""
    key = _input(spark, sf_dir)
    if key not in _staged:
        _staged[key] = stored(staging_from_orders(spark, sf_dir), "staging")
    return _staged[key]
