"""Shape of the physical plans: pushed filters, pruned columns, no cross joins, bounded broadcasts."""

import datetime as dt
import re

import pytest
from conftest import AS_OF, SF_DIR
from plan_tools import columns_read, plan, run
from pyspark.sql import DataFrame

from loanloom.operators.clean import clean
from loanloom.plans import dashboard, kpis, quality, risk, segments
from loanloom.registry import all_queries
from loanloom.sources import portfolio, store
from loanloom.sources.portfolio import star_portfolio


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(risk.default_by_vintage(star_portfolio(spark, SF_DIR, AS_OF).clean))
    assert "PushedFilters: [In(loan_status, [CHGOFF,PIF])" in text
    assert columns_read(text) == {
        "gross_approved", "chargeoff_amount", "loan_status", "is_defaulted",
    }
    assert text.count("FileScan") == 1


def test_one_scan_reports(spark):
    """Reports that combine several groupings or totals read the loans once.

    What some of them store on the way, one row per lender, dimension value or month, is read
    again; the count of rows has some room for that.
    """
    loans, clean = star_portfolio(spark, SF_DIR, AS_OF)
    rows = clean.count()
    for report in (
        dashboard.dimension_drilldown, dashboard.comprehensive_rankings, dashboard.risk_watchlist,
        dashboard.portfolio_snapshot, dashboard.executive_summary, dashboard.ytd_comparison,
        segments.best_worst_states, segments.lender_summary, segments.summary_counts,
        segments.subsector_vs_sector, segments.lender_ranking, segments.lender_specialisation,
        kpis.top_lenders, kpis.lender_concentration, kpis.portfolio_kpi_summary, risk.risk_summary,
    ):
        read = run(spark, lambda report=report: report(clean))[1]
        assert rows <= read < 1.6 * rows, report.__name__
    for report in (quality.null_profile, quality.term_outliers):
        assert run(spark, lambda report=report: report(loans))[1] == rows
    assert run(spark, lambda: dashboard.dashboard_counts(clean))[1] < 2.2 * rows


def test_reads_of_percentiles(spark):
    loans, clean = star_portfolio(spark, SF_DIR, AS_OF)
    rows = clean.count()
    for report, table, reads in (
        (quality.amount_distribution, loans, 2), (quality.iqr_outliers, loans, 3), (kpis.loan_size_by_industry, clean, 2),
    ):
        _, read, shuffled = run(spark, lambda report=report, table=table: report(table))
        assert read < (reads + 0.1) * rows and shuffled < rows, report.__name__


def test_percentiles_shuffle_brackets_only(spark):
    """Nothing is grouped or exchanged by the single value: gaps between brackets are one row each."""
    loans = star_portfolio(spark, SF_DIR, AS_OF).loans
    text = plan(quality.amount_distribution(loans))
    assert not re.search(r"hashpartitioning\([^)]*_v#", text)
    assert not re.search(r"keys=\[[^]]*\b_v#", text)
    _, _, shuffled = run(spark, lambda: quality.amount_distribution(loans))
    assert shuffled < loans.count() / 20


YEAR_CUTS = (
    "monthly_originations", "monthly_trends", "monthly_default_trend", "quarterly_vintage",
    "cumulative_default_by_year", "cumulative_default_curve", "vintage_heatmap", "survival_curve",
    "size_by_year_business_type", "urban_rural_mix", "risk_new_vs_existing", "industry_trend",
)


@pytest.mark.parametrize("name", YEAR_CUTS)
def test_years_choose_files(spark, name):
    """Reports over a range of years open only the files of those."""
    text = plan(all_queries()[name](spark, SF_DIR))
    assert re.search(r"PartitionFilters: \[[^]]*vintage_year", text)


def test_stored_tables_are_built_when_used_and_can_be_removed(spark, make_loans, tmp_path, monkeypatch):
    made = []
    some = portfolio.Portfolio(lambda: made.append(1) or make_loans({}))
    assert not made
    assert some.loans.count() == 1 and made == [1] and "clean" not in vars(some)
    folder = tmp_path / "shared" / "loanloom"
    monkeypatch.setattr(store, "own_dir", lambda spark: str(folder))
    kept = store.stored(make_loans({}), "x")
    assert kept.count() == 1 and len(list(folder.iterdir())) == 1
    assert store.remove_stored(spark) and not folder.exists()


def test_changed_inputs_are_noticed(spark, tmp_path):
    file = tmp_path / "a.parquet"
    file.write_text("x")
    before = store.input_state(spark, [str(file)])
    assert before == store.input_state(spark, [str(file)])
    file.write_text("xy")
    assert before != store.input_state(spark, [str(file)])


def test_lookups_are_literals_and_broadcast(spark):
    text = plan(segments.geographic_summary(star_portfolio(spark, SF_DIR, AS_OF).clean))
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text
    assert "ExistingRDD" not in text


def test_stored_tables_use_the_shared_directory(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    for table in star_portfolio(spark, SF_DIR, AS_OF):
        assert all(shared in f for f in table.inputFiles())


def test_the_clean_table_is_written_without_a_shuffle_of_its_rows(spark, make_loans, monkeypatch):
    years = (2009, 2010, 2010, 2011, None)
    loans = make_loans(*[dict(approval_date=y and dt.date(y, 3, 1), loan_status="PIF") for y in years]).repartition(3)
    some = portfolio.Portfolio(lambda: loans, AS_OF)
    monkeypatch.setattr(DataFrame, "hint", lambda *_: pytest.fail("rows are shuffled by year"))
    table = some.clean
    assert "loans" not in vars(some)  # nor stored twice
    monkeypatch.undo()
    wanted = clean(loans, AS_OF)
    assert table.columns == wanted.columns
    assert sorted(map(str, table.collect())) == sorted(map(str, wanted.collect()))
    assert re.search(r"PartitionFilters: \[[^]]*vintage_year", plan(table.filter("vintage_year > 2009")))
    assert {"vintage_year=2009", "vintage_year=2011"} <= {f.split("/")[-2] for f in table.inputFiles()}
