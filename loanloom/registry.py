"""Every query by name, over a directory of order tables (see ``sources.star_mapping``)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from loanloom.functions.metrics import known
from loanloom.functions.numeric import currency
from loanloom.operators import bitmaps
from loanloom.plans import cohort, dashboard, kpis, quality, raw_variants, risk, segments, view_state
from loanloom.schemas import STAGING_COLUMNS
from loanloom.sources import ingest
from loanloom.sources.portfolio import star_portfolio, star_staging
from loanloom.sources.store import new_table_path, stored

AS_OF = dt.date(2015, 9, 1)

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for comparing engines: BIGINT, DOUBLE and text."""

    def plain(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.BooleanType)):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.concat_ws(",", c).alias(field.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


def _on_loans(fn, *args) -> Query:
    return lambda spark, d: comparable(fn(star_portfolio(spark, d, AS_OF).loans, *args))


def _on_clean(fn, *args) -> Query:
    return lambda spark, d: comparable(fn(star_portfolio(spark, d, AS_OF).clean, *args))


def _on_staging(fn) -> Query:
    return lambda spark, d: comparable(fn(star_staging(spark, d)))


def _rule(*names: str) -> Query:
    """Some columns of the import, per raw row."""
    return _on_staging(
        lambda staging: ingest.parse_loans(staging, "source_key").select("source_key", *names)
    )


def _twice(loans: DataFrame) -> DataFrame:
    """A table in which revolving low-doc loans are booked twice."""
    again = loans.filter("rev_line_of_credit = 'Y' AND low_doc = 'Y'")
    return loans.unionByName(again)


def _key() -> Column:
    return F.substring("loan_id", 5, 20).cast("bigint")


def _broken(loans: DataFrame) -> DataFrame:
    """Loans of which some violate a constraint."""
    k = _key()

    def spoiled(name: str, where: Column, value) -> Column:
        return F.when(where, value).otherwise(F.col(name)).alias(name)

    changed = {
        "loan_status": spoiled("loan_status", k % 17 == 1, F.lit("OPEN")),
        "new_business": spoiled("new_business", k % 19 == 2, F.lit(3)),
        "rev_line_of_credit": spoiled("rev_line_of_credit", k % 23 == 3, F.lit("?")),
        "gross_approved": spoiled("gross_approved", k % 29 == 4, -F.col("gross_approved")),
        "term_months": spoiled("term_months", k % 31 == 5, F.lit(0)),
    }
    return loans.select(*[changed.get(c, F.col(c)) for c in loans.columns])


def _quarantine(loans: DataFrame) -> DataFrame:
    return ingest.split_valid(_broken(loans))[1].select("loan_id", "rejected_reasons")


def _csv_folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The raw rows written as CSV files in four folders, some with too few or too many fields."""
    path = new_table_path(spark, "raw_csv")
    k = F.col("source_key")
    staging = star_staging(spark, sf_dir).withColumn("batch", k % 4)
    short, long = k % 67 == 0, k % 71 == 0
    ingest.write_raw_csv(staging.filter(~short & ~long).drop("source_key"), path, partition_by="batch")
    start = F.concat_ws(",", "asofdate", "program", k.cast("string"))
    bad = staging.filter(short | long).select(
        "batch", F.when(short, start).otherwise(F.concat(start, F.repeat(F.lit(",x"), 47))).alias("line")
    )
    header = spark.range(4).select(
        F.col("id").alias("batch"), F.lit(",".join(STAGING_COLUMNS)).alias("line")
    )
    (
        header.withColumn("place", F.lit(0))
        .union(bad.withColumn("place", F.lit(1)))
        .repartition(4, "batch")
        .sortWithinPartitions("batch", "place")
        .select("batch", "line")
        .write.mode("append")
        .partitionBy("batch")
        .text(path)
    )
    return [f"{path}/batch={i}" for i in range(4)]


def _read_raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_raw_csv(spark, _csv_folders(spark, sf_dir))


def _read_quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows whose streets have line breaks and quotes in them, from two folders.

    A folder has one file, or several where its rows are more than a task should write.
    """
    path = new_table_path(spark, "quoted_csv")
    k = F.col("source_key")
    breaks = F.when(k % 7 == 0, F.lit('\n"rear",\n\n2nd floor')).when(k % 5 == 0, F.lit("\n")).otherwise(F.lit(""))
    staging = star_staging(spark, sf_dir).withColumn("borrstreet", F.concat("borrstreet", breaks))
    rows = staging.withColumn("batch", k % 2).hint("rebalance", "batch").drop("source_key")
    ingest.write_raw_csv(rows, path, partition_by="batch")
    return ingest.read_quoted_csv(spark, [f"{path}/batch={i}" for i in range(2)])


def _rejected_raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.rejected_raw_rows(spark, _csv_folders(spark, sf_dir))
    fields = F.split(ingest.RAW_LINE, ",")
    return comparable(
        rows.select(
            "folder", "asofdate", fields[2].cast("bigint").alias("source_key"), F.size(fields).alias("fields")
        )
    )


def _count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ingest.read_raw_csv(spark, _csv_folders(spark, sf_dir))
    return comparable(ingest.count_by_source(raw, folders=True))


def _write_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of loans of which some violate a constraint."""
    loans = _broken(star_portfolio(spark, sf_dir, AS_OF).loans)
    path = new_table_path(spark, "loans_by_year")
    ingest.write_loans(loans, path)
    return comparable(ingest.read_loans(spark, path).drop("balance_gross"))


def _incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of raw rows: the ids of the later one go on, its broken rows stay out."""
    staging = star_staging(spark, sf_dir)
    path = new_table_path(spark, "loans_incremental")
    early = F.col("approvalfiscalyear") < "2013"
    ingest.write_loans(ingest.import_loans(staging.filter(early), AS_OF), path)
    first = ingest.loan_table(spark, path).last_number() + 1
    later = ingest.import_loans(staging.filter(~early), AS_OF, first)
    open_loans = F.when(_key() % 17 == 1, F.lit("OPEN")).otherwise(F.col("loan_status"))
    ingest.incremental_load(spark, later.withColumn("loan_status", open_loans), path)
    return comparable(
        ingest.read_loans(spark, path).select(
            "loan_id", "business_name", "approval_date", "approval_fy", "created_at"
        )
    )


def _load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans per version and year: a first load, a batch, and the same batch again, which adds nothing."""
    loans = star_portfolio(spark, sf_dir, AS_OF).loans
    path = new_table_path(spark, "loans_versions")
    ingest.write_loans(loans.filter("approval_date < '2010-01-01'"), path)
    for _ in range(2):
        ingest.incremental_load(spark, loans.filter("approval_date < '2014-07-01'"), path, batch="to mid 2014")
    ingest.incremental_load(spark, loans, path, batch="the rest")
    counts = [
        ingest.read_loans(spark, path, v)
        .groupBy("approval_fy")
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .select(F.lit(v).alias("version"), "approval_fy", "loan_count")
        for v in range(1, ingest.loan_table(spark, path).version + 1)
    ]
    return comparable(reduce(DataFrame.union, counts))


def _stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a batch's ids are stored: found by the ranges and filters of the files."""
    loans = star_portfolio(spark, sf_dir, AS_OF).loans
    path = new_table_path(spark, "loans_keyed")
    ingest.write_loans(loans.filter(_key() % 3 != 1), path)
    batch = loans.filter(_key() % 5 < 2)
    return comparable(ingest.loan_table(spark, path).stored_keys(batch))


def _odd_ids(loans: DataFrame) -> DataFrame:
    """A table in which some loans are booked twice and some have no id."""
    gone = F.when(_key() % 53 != 0, F.col("loan_id"))
    return _twice(loans).withColumn("loan_id", gone)


def _assigned(staging: DataFrame) -> DataFrame:
    return ingest.assign_loan_id(staging).select("loan_id", *ingest.ID_ORDER)


def _imported(staging: DataFrame) -> DataFrame:
    return ingest.import_loans(staging, AS_OF).drop("loan_id")


def ingest_queries() -> dict[str, Query]:
    return {
        "read_raw_csv": _read_raw_csv,
        "read_quoted_csv": _read_quoted_csv,
        "rejected_raw_rows": _rejected_raw_rows,
        "count_by_source": _count_by_source,
        "import_loans": _on_staging(_imported),
        "assign_loan_id": _on_staging(_assigned),
        "parse_date": _rule("approval_date", "disbursement_date", "chargeoff_date"),
        "parse_int_year": _rule("approval_fy"),
        "parse_term": _rule("term_months"),
        "parse_employees": _rule("num_employees"),
        "parse_business_age": _rule("new_business"),
        "split_jobs": _rule("jobs_created", "jobs_retained"),
        "parse_flags": _rule("rev_line_of_credit", "low_doc"),
        "parse_money": _rule("gross_approved", "sba_approved", "disbursement_gross"),
        "parse_chargeoff_amount": _rule("chargeoff_amount"),
        "map_status": _rule("loan_status"),
        "text_cleanup": _rule(
            "business_name", "city", "state", "zip", "bank_name", "bank_state", "naics",
            "franchise_code",
        ),
        "parse_failures": _on_staging(ingest.parse_failures),
        "validate_constraints": _on_loans(_quarantine),
        "check_unique": _on_loans(lambda loans: ingest.check_unique(_twice(loans))),
        "write_loans": _write_loans,
        "incremental_load": _incremental_load,
        "load_history": _load_history,
        "stored_ids": _stored_ids,
        "sample_loans": _on_loans(
            lambda loans: ingest.sample_loans(_odd_ids(loans)).select(
                "loan_id", "business_name", "approval_date", "gross_approved"
            )
        ),
        "import_report": _on_loans(ingest.import_report),
        "import_status_report": _on_loans(ingest.import_status_report),
    }


def quality_queries() -> dict[str, Query]:
    q = quality
    return {
        "null_profile": _on_loans(q.null_profile),
        "null_profile_wide": _on_loans(q.null_profile_wide),
        "amount_distribution": _on_loans(q.amount_distribution),
        "iqr_outliers": _on_loans(q.iqr_outliers),
        "term_outliers": _on_loans(q.term_outliers),
        "employee_buckets": _on_loans(q.employee_buckets),
        "invalid_states": _on_loans(q.invalid_states),
        "naics_validity": _on_loans(q.naics_validity),
        "date_checks": _on_loans(q.date_checks, AS_OF),
        "status_distribution": _on_loans(q.status_distribution),
        "duplicate_ids": _on_loans(lambda loans: q.duplicate_ids(_twice(loans))),
        "potential_duplicates": _on_loans(lambda loans: q.potential_duplicates(_twice(loans))),
        "guarantee_categories": _on_loans(q.guarantee_categories),
        "chargeoff_consistency": _on_loans(q.chargeoff_consistency),
        "clean": _on_clean(lambda loans: loans),
        "quality_scorecard": _on_loans(q.quality_scorecard, AS_OF),
        "exclusion_flags": _on_loans(q.exclusion_flags, AS_OF),
        "exclusion_summary": _on_loans(q.exclusion_summary, AS_OF),
        "helper_values": _on_loans(q.helper_values),
    }


def kpi_queries() -> dict[str, Query]:
    dated = {"monthly_originations": (kpis.monthly_originations, AS_OF)}
    plain = (
        kpis.annual_originations, kpis.quarterly_originations, kpis.loan_size_by_industry,
        kpis.loan_size_by_state, kpis.size_by_year_business_type, kpis.loan_size_trends,
        kpis.yoy_growth, kpis.segment_cagr, kpis.mix_by_size, kpis.mix_by_term,
        kpis.mix_by_business, kpis.urban_rural_mix, kpis.guarantee_distribution,
        kpis.guarantee_by_year, kpis.top_lenders, kpis.lender_concentration,
        kpis.portfolio_kpi_summary,
    )
    return {fn.__name__: _on_clean(fn) for fn in plain} | {
        name: _on_clean(*call) for name, call in dated.items()
    }


def risk_queries() -> dict[str, Query]:
    plain = (
        risk.portfolio_default, risk.default_by_vintage, risk.monthly_default_trend,
        risk.chargeoff_by_year, risk.chargeoff_by_industry, risk.chargeoff_by_size,
        risk.lgd_overall, risk.lgd_by_vintage, risk.severity_distribution, risk.risk_matrix,
        risk.geographic_risk, risk.risk_new_vs_existing, risk.risk_by_term,
        risk.sba_loss_by_vintage, risk.default_by_guarantee, risk.riskiest_sectors,
        risk.lender_risk, risk.expected_loss, risk.risk_summary,
    )
    return {fn.__name__: _on_clean(fn) for fn in plain}


def cohort_queries() -> dict[str, Query]:
    plain = (
        cohort.vintage_performance, cohort.vintage_vs_portfolio, cohort.quarterly_vintage,
        cohort.seasoning_distribution, cohort.seasoning_by_vintage, cohort.time_to_default_stats,
        cohort.ttd_by_size, cohort.ttd_by_term, cohort.cumulative_default_by_year,
        cohort.cumulative_default_curve, cohort.vintage_heatmap, cohort.vintage_outcomes,
        cohort.survival_curve, cohort.economic_periods,
    )
    return {fn.__name__: _on_clean(fn) for fn in plain} | {
        "cohort_summary": _on_clean(cohort.cohort_summary, AS_OF)
    }


def segment_queries() -> dict[str, Query]:
    s = segments
    plain = (
        s.state_ranking, s.best_worst_states, s.regional_performance, s.industry_performance,
        s.subsector_vs_sector, s.industry_concentration, s.industry_trend, s.lender_ranking,
        s.lender_ranks,
        s.lender_vs_state, s.lender_specialisation, s.state_concentration, s.geographic_hhi,
        s.cross_state_flows, s.in_out_of_state, s.state_industry_matrix,
        s.business_location_size, s.geographic_summary, s.industry_summary, s.lender_summary,
        s.summary_counts,
    )
    return {fn.__name__: _on_clean(fn) for fn in plain}


def _volume_labels(clean: DataFrame) -> DataFrame:
    """Volume per state as the reports print it."""
    volume = known(clean).groupBy("state").agg(F.sum("gross_approved").alias("v"))
    return volume.select("state", currency("v").alias("volume"))


def dashboard_queries() -> dict[str, Query]:
    d = dashboard
    dated = (d.executive_summary, d.monthly_trends, d.portfolio_snapshot, d.dashboard_counts)
    plain = (
        d.ytd_comparison, d.dimension_drilldown, d.top_rankings, d.comprehensive_rankings,
        d.risk_watchlist,
    )
    return {fn.__name__: _on_clean(fn, AS_OF) for fn in dated} | {
        fn.__name__: _on_clean(fn) for fn in plain
    } | {"volume_labels": _on_clean(_volume_labels)}


def _on_state(fn, *args) -> Query:
    """From the state of the views after three loads."""
    return lambda spark, d: comparable(
        fn(view_state.read_state(star_portfolio(spark, d, AS_OF).loaded), *args)
    )


def _distinct_counts(clean: DataFrame) -> DataFrame:
    """Distinct lenders, states and sectors in all, per state, per sector and per vintage year."""
    loans, columns = known(clean), view_state.COUNTED
    codes = stored(bitmaps.dictionary(bitmaps.value_counts(loans, columns)), "codes")
    sides = view_state.WITHIN | {"Vintage Year": "vintage_year"}
    return bitmaps.distinct_counts(bitmaps.words(loans, columns, codes, sides, total="all"), list(columns))


def state_queries() -> dict[str, Query]:
    v = view_state
    reports = {
        f"view_{name}": _on_state(fn, *([AS_OF] if name in v.DATED else []))
        for name, fn in v.REPORTS.items()
    }
    return reports | {
        "view_sums": _on_state(lambda state: state.sums),
        "lenders_reached": _on_state(v.lenders_reached),
        "distinct_counts": _on_clean(_distinct_counts),
    }


def raw_queries() -> dict[str, Query]:
    r = raw_variants
    plain = (
        r.nb_status, r.nb_kpis, r.nb_annual, r.nb_size_mix, r.nb_risk, r.nb_vintage_risk,
        r.nb_industry_risk, r.nb_size_risk, r.nb_economic_periods, r.nb_time_to_default,
        r.nb_state_performance, r.nb_state_default_map, r.nb_regions, r.nb_top_bottom_states,
        r.nb_top_lenders,
    )
    return {fn.__name__: _on_loans(fn) for fn in plain} | {
        "nb_quality": _on_loans(r.nb_quality, AS_OF)
    }


def all_queries() -> dict[str, Query]:
    families = (
        ingest_queries, quality_queries, kpi_queries, risk_queries, cohort_queries,
        segment_queries, dashboard_queries, state_queries, raw_queries,
    )
    return {name: query for family in families for name, query in family().items()}
