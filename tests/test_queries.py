"""Every registered query against its DuckDB check query, and properties of the results."""

import math
import os

import duckdb
import pytest
from conftest import AS_OF, SF_DIR
from plan_tools import has_window_over_rows, plan, run
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loanloom.registry import all_queries
from oracles.all import ORACLES
from loanloom.functions.metrics import known
from loanloom.plans import cohort, dashboard, kpis, quality, risk, segments
from loanloom.sources.portfolio import star_portfolio

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF_DIR}/{name}'")
    return con


@pytest.fixture(scope="module")
def clean(spark):
    return star_portfolio(spark, SF_DIR, AS_OF).clean


def in_order(rows):
    def key(row):
        return [(v is None, str(type(v)) if isinstance(v, str) else "", v) for v in row]

    return sorted(rows, key=key)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


# Duplicate checks and the numbering move every row. Interval counts of percentiles are bounded,
# but not small against these few loans. Lines of records in quotes (a third of them here) are put
# together by their first line.
MOVES_ROWS = {
    "assign_loan_id", "import_loans", "check_unique", "duplicate_ids", "potential_duplicates",
    "sample_loans", "write_loans", "incremental_load", "loan_size_by_industry", "read_quoted_csv",
}
# Distinct states and sectors per lender: a row per task, lender and state or sector. Lenders are
# as many as suppliers, so these are more than a third of the few loans here, but fewer than loans.
COUNTS_PAIRS = {"lender_summary"}
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, clean, name):
    """The result equals DuckDB's; no cross join, no Python, no window over loans; small shuffles."""
    df = QUERIES[name](spark, SF_DIR)
    text = plan(df)
    assert not [node for node in UNWANTED if node in text]
    assert not has_window_over_rows(df)
    columns = sorted(df.columns)
    rows, _, shuffled = run(spark, df)
    assert name in MOVES_ROWS or shuffled < (15_000 if name in COUNTS_PAIRS else 15_000 / 3)
    got = [tuple(r[c] for c in columns) for r in rows]
    result = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(types) == columns
    plain = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: plain[t] for c, t in df.dtypes} == types
    places = [list(types).index(c) for c in columns]
    want = [tuple(r[i] for i in places) for r in result.fetchall()]
    assert len(got) > 0
    assert len(got) == len(want)
    for a, b in zip(in_order(got), in_order(want)):
        for x, y in zip(a, b):
            same = math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) and y is not None else x == y
            assert same, (a, b)


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_lenders_are_many(spark, clean):
    """Long lender lists are cut, and what is left over is not empty."""
    lenders = clean.filter("bank_name <> 'Unknown Lender'").select("bank_name").distinct().count()
    suppliers = spark.read.parquet(f"{SF_DIR}/supplier.parquet").count()
    assert lenders == suppliers > 50
    assert kpis.lender_concentration(clean).collect()[-1][1] is not None
    assert segments.lender_ranking(clean, min_loans=1).count() == 50 < lenders


def total(df, column):
    return float(df.agg(F.sum(column)).collect()[0][0])


def test_shares_sum_to_100(clean):
    for df, column in (
        (kpis.mix_by_size(clean), "pct_of_count"), (kpis.mix_by_size(clean), "pct_of_volume"),
        (kpis.mix_by_term(clean), "pct_of_count"), (segments.state_concentration(clean), "pct_of_loans"),
        (cohort.seasoning_distribution(clean), "pct_of_defaults"), (risk.severity_distribution(clean), "pct_of_defaults"),
    ):
        assert total(df, column) == pytest.approx(100, abs=0.2)


def test_buckets_cover_all_loans(clean):
    n = known(clean).count()
    assert total(kpis.mix_by_size(clean), "loan_count") == n
    assert total(kpis.mix_by_term(clean), "loan_count") == n
    assert total(cohort.economic_periods(clean), "total_loans") == n
    per_side = dashboard.dimension_drilldown(clean).groupBy("dimension").agg(F.sum("loans").alias("n")).collect()
    assert {r.n for r in per_side} == {n} and len(per_side) == 7


def test_drilldown_equals_single_groupings(clean):
    got = {
        (r.dimension, r.dimension_value): (r.loans, r.volume, r.default_rate)
        for r in dashboard.dimension_drilldown(clean).collect()
    }
    for name, column in dashboard.DIMENSIONS.items():
        rows = (
            known(clean).groupBy(F.col(column).cast("string").alias("v"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("gross_approved").alias("vol")).collect()
        )
        for r in rows:
            assert got[(name, r.v)][:2] == (r.n, r.vol)


def test_curves_are_monotone(clean):
    survival, curve = {}, {}
    for r in cohort.survival_curve(clean).collect():
        survival.setdefault(r.vintage_year, []).append(r.survival_rate_pct)
    for r in cohort.cumulative_default_curve(clean).collect():
        curve.setdefault(r.vintage_year, []).append(r.cumulative_default_rate_pct)
    assert survival and curve
    assert all(v == sorted(v, reverse=True) for v in survival.values())
    assert all(v == sorted(v) for v in curve.values())


def test_lender_ranking_equals_plain_windows(clean):
    """Small cut-off: most lenders are outside the shown rows, the ranks still count them."""
    from pyspark.sql import Window

    plain = (
        segments.lenders_served(clean).filter("total_loans >= 100")
        .withColumn("r", F.rank().over(Window.orderBy("default_rate")))
        .withColumn("q", F.ntile(4).over(
            Window.orderBy("default_rate", F.desc("total_volume"), "bank_name", "bank_state")))
        .collect()
    )
    want = {(r.bank_name, r.bank_state): (r.r, r.q) for r in plain}
    for top_k in (3, 7):
        got = segments.lender_ranking(clean, top_k=top_k).collect()
        assert len(got) == top_k
        for r in got:
            assert (r.performance_rank, r.performance_quartile) == want[(r.bank_name, r.bank_state)]


def test_lender_concentration_others(clean):
    rows = {r.segment: r for r in kpis.lender_concentration(clean, cuts=(2, 5)).collect()}
    assert list(rows) == ["Top 2 Lenders", "Top 5 Lenders", "All Other Lenders"]
    everything = known(clean).agg(F.sum("gross_approved")).collect()[0][0]
    assert rows["Top 5 Lenders"].segment_volume + rows["All Other Lenders"].segment_volume == everything


def test_survival_without_day(make_loans):
    """A default without a charge-off day survives no year; active loans are not counted."""
    import datetime as dt

    from loanloom.operators.clean import clean as cleaned

    day = dt.date(2012, 5, 1)
    loans = make_loans(
        dict(approval_date=day, loan_status="CHGOFF"),
        dict(approval_date=day, loan_status="CHGOFF", chargeoff_date=dt.date(2014, 5, 1)),
        dict(approval_date=day, loan_status="PIF"),
        dict(approval_date=day),
    )
    rows = cohort.survival_curve(cleaned(loans), horizon=3).collect()
    assert [(r.surviving, r.total) for r in rows] == [(2, 3), (2, 3), (1, 3), (1, 3)]


def test_prior_year_counts_open_loans(make_loans):
    from loanloom.operators.clean import clean as cleaned

    loans = make_loans(
        dict(approval_fy=2010, gross_approved=100, loan_status=None),
        dict(approval_fy=2011, gross_approved=150, loan_status="PIF"),
        dict(approval_fy=2013, gross_approved=150, loan_status="PIF"),
    )
    rows = kpis.annual_originations(cleaned(loans)).collect()
    assert [(r.fiscal_year, r.yoy_growth_pct) for r in rows] == [(2013, None), (2011, 50)]


def test_empty_table(make_loans):
    from loanloom.operators.clean import clean as cleaned

    empty = cleaned(make_loans({}).filter("false"))
    assert risk.portfolio_default(empty).collect()[0].default_rate_pct is None
    summary = dashboard.executive_summary(empty).collect()[0]
    assert (summary.total_loans, summary.total_volume, summary.active_lenders) == (0, None, 0)
    assert quality.quality_scorecard(make_loans({}).filter("false")).collect()[0].total_records == 0
