"""Percentiles, numbering, clean table and import."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from plan_tools import run
from pyspark.sql import functions as F

from loanloom.operators.clean import clean
from loanloom.operators.duplicates import repeated
from loanloom.operators.numbering import numbered
from loanloom.operators.percentiles import exact_percentiles
from loanloom.plans import quality
from loanloom.schemas import LOANS, STAGING_COLUMNS, schema_report
from loanloom.sources import ingest
from loanloom.sources.portfolio import star_portfolio

D = dt.date


def test_percentiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [("a", Decimal(rng.randint(0, 10**9)) / 100) for _ in range(1500)]
    rows += [("a", Decimal("777.77"))] * 800  # one hot value
    rows += [("b", Decimal(x)) for x in ("-5.25", "10.00", "99999999999.99")]
    rows += [(None, Decimal("3.00")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v decimal(15,2)")
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    got = {r.g: r for r in exact_percentiles(df, "v", probs, by=["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g in ("a", "b", None):
        vals = [float(v) for k, v in rows if k == g and v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vals, p), abs=1e-3)
    one = exact_percentiles(df, "v", probs).collect()[0]
    vals = [float(v) for _, v in rows if v is not None]
    assert one.p50 == pytest.approx(np.quantile(vals, 0.5), abs=1e-3)


def test_percentiles_of_many_groups_with_totals(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 3000).alias("g"), (F.col("id") * 7919 % 1_000_003 / 100).cast("decimal(15,2)").alias("v")
    )
    parts, totals = {"_n": F.count("v"), "_most": F.max("v")}, {"n": F.sum("_n"), "most": F.max("_most")}
    got = exact_percentiles(df, "v", {"p": 0.5, "q": 0.9}, by=["g"], parts=parts, totals=totals).collect()
    assert len(got) == 3000
    values = {}
    for i in range(30_000):
        values.setdefault(i % 3000, []).append(i * 7919 % 1_000_003 / 100)
    for r in got:
        assert r.p == pytest.approx(np.quantile(values[r.g], 0.5), abs=1e-3)
        assert r.q == pytest.approx(np.quantile(values[r.g], 0.9), abs=1e-3)
        assert (r.n, float(r.most)) == (10, pytest.approx(max(values[r.g])))


def test_percentiles_of_integers_and_nothing(spark):
    df = spark.range(1, 12).withColumn("id", F.col("id").cast("int"))
    half = exact_percentiles(df, "id", {"m": 0.5, "q": 0.25}, scale=1)
    assert tuple(half.collect()[0]) == (6.0, 3.5)
    empty = exact_percentiles(df.filter("id > 99"), "id", {"m": 0.5}, scale=1)
    assert [r.m for r in empty.collect()] == [None]


@pytest.mark.parametrize("accuracy", [20, 300, 10_000])
def test_percentiles_within_brackets(spark, accuracy):
    rng = random.Random(accuracy)
    groups = {
        "spread": [rng.randint(-(10**9), 10**9) for _ in range(8000)],
        "one value": [5] * 6000,
        "two values": [7] * 3000 + [9] * 3001,
        "hot": [rng.randint(0, 1000) for _ in range(500)] + [500] * 4000,
        "sorted": list(range(5000)),
        "few": [3, 1, 2],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.501, "f": 0.99, "g2": 1.0}
    got = exact_percentiles(df, "v", probs, by=["g"], scale=1, accuracy=accuracy)
    for r in got.collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.g], p), abs=1e-3), (r.g, name)
    every = exact_percentiles(df, "v", probs, scale=1, accuracy=accuracy).collect()[0]
    assert [every[n] for n in probs] == pytest.approx([np.quantile([x for _, x in rows], p) for p in probs.values()], abs=1e-3)


@pytest.mark.parametrize("spread", [1, 3, None])
def test_repeated_groups_with_hashes_that_collide(spark, spread):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 300), None) for _ in range(600)] + [("hot", 1, "x")] * 500
    df = spark.createDataFrame(rows, "s string, n int, t string").repartition(4)
    few = (lambda *c: F.pmod(F.xxhash64(*c), F.lit(spread))) if spread else F.xxhash64
    found = {tuple(r)[:3]: r.times for r in repeated(df, ["s", "n", "t"], "times", few).collect()}
    assert found == {k: v for k, v in Counter(rows).items() if v > 1}
    assert repeated(df.limit(0), ["s"], "times").collect() == []


def test_repeated_groups_shuffle_less(spark):
    loans = star_portfolio(spark, "/root/testdata/sf0.01", D(2015, 9, 1)).loans
    key = ["business_name", "city", "state", "approval_date", "gross_approved"]
    whole = loans.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    few = run(spark, lambda: repeated(loans, key, "n"), size=True)
    all_columns = run(spark, whole, size=True)
    assert sorted(few[0], key=str) == sorted(all_columns[0], key=str) and few[2] < 0.75 * all_columns[2]


def test_numbering_with_one_hot_key(spark):
    hot = spark.range(0, 30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, "same").alias("k"),
        "id",
    )
    out = numbered(hot, ["k"], "n")
    rows = out.orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 30_001))
    keys = [r.k for r in rows]
    assert keys == sorted([k for k in keys if k is not None]) + [None] * 10_000
    assert len({r.id for r in rows}) == 30_000


def test_clean_defaults(make_loans):
    df = clean(make_loans({}), D(2020, 1, 1))
    assert len(df.columns) == 39
    row = df.collect()[0]
    assert (row.business_name, row.bank_name, row.state, row.zip_5) == ("Unknown", "Unknown Lender", "XX", "00000")
    assert (row.naics, row.naics_sector, row.industry_sector) == ("000000", "00", "Unknown")
    assert (row.loan_size_bucket, row.term_category, row.term_months) == ("Micro (<$50K)", "Unknown", 0)
    assert (row.gross_approved, row.sba_guarantee_pct, row.loss_severity_pct) == (0, 0, 0)
    assert (row.loan_status, row.is_defaulted, row.is_paid_in_full) == ("UNKNOWN", None, None)
    assert (row.is_revolving_line, row.is_low_doc, row.vintage_year) == (False, False, None)


def test_clean_values(make_loans):
    row = clean(
        make_loans(
            dict(business_name="  ", state="ca", zip="902101234", naics="721110", approval_date=D(2009, 10, 2),
                 term_months=60, num_employees=11, new_business=2, urban_rural=2, rev_line_of_credit="Y",
                 gross_approved=300, sba_approved=100, loan_status="CHGOFF", chargeoff_amount=450)
        )
    ).collect()[0]
    assert (row.business_name, row.state, row.zip_5) == ("Unknown", "CA", "90210")
    assert row.industry_sector == "Accommodation and Food Services"
    assert (row.approval_fy, row.vintage_year, row.vintage_quarter, row.vintage_month) == (2009, 2009, 4, 10)
    assert (row.business_size, row.business_type, row.location_type) == ("Small (11-50)", "New", "Rural")
    assert (row.sba_guarantee_pct, row.loss_severity_pct) == (Decimal("33.33"), Decimal("150.00"))
    assert (row.is_defaulted, row.is_paid_in_full, row.is_revolving_line) == (True, False, True)


def test_exclusion_flags(make_loans):
    loans = make_loans(
        dict(gross_approved=1, loan_status=None, approval_date=D(2000, 1, 1), state="CA"),
        dict(gross_approved=0, loan_status="PIF", approval_date=D(2030, 1, 1), state="CAL"),
        dict(gross_approved=1, loan_status="OPEN", approval_date=D(2000, 1, 1), state=None),
    )
    rows = quality.exclusion_flags(loans, D(2020, 1, 1)).orderBy("loan_id").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0), (1, 0, 1, 1, 1), (0, 1, 0, 1, 1)]


def test_constraints_split(make_loans):
    loans = make_loans(
        dict(loan_id="ok"),
        dict(loan_id="bad", loan_status="OPEN", new_business=3, urban_rural=9, rev_line_of_credit="?",
             low_doc="?", gross_approved=-1, sba_approved=-1, term_months=0),
    )
    good, bad = ingest.split_valid(loans)
    assert [r.loan_id for r in good.collect()] == ["ok"]
    assert good.columns == loans.columns
    row = bad.collect()[0]
    assert (row.loan_id, len(row.rejected_reasons)) == ("bad", 8)
    assert row.rejected_reasons == list(ingest.constraints())


def staging_row(**given):
    return tuple(given.get(c) for c in STAGING_COLUMNS)


def test_csv_and_import(spark, tmp_path):
    header = ",".join(STAGING_COLUMNS)
    first = staging_row(
        l2locid="1", borrname='"he said ""hi"", ok"', borrstate='""', projectstate="tx", approvaldate="3/5/2020",
        approvalfiscalyear="2020", grossapproval='"$1,200.50"', loanstatus="P I F", jobssupported="7",
    )
    second = staging_row(l2locid="2", borrname='"two\nlines"', approvalfiscalyear="2019", approvaldate="x")
    blank = staging_row(l2locid="  ", borrname="skipped")
    folder = tmp_path / "in"
    folder.mkdir()
    for name, rows in (("a.csv", [first, blank]), ("b.csv", [second])):
        lines = [",".join(v or "" for v in row) for row in rows]
        (folder / name).write_text("\n".join([header, *lines]) + "\n")
    raw = ingest.read_raw_csv(spark, str(folder), multi_line=True)
    counts = [tuple(r) for r in ingest.count_by_source(raw).collect()]
    assert counts == [("a.csv", 2, 3), ("b.csv", 1, 3)]
    texts = {r.l2locid: r for r in raw.collect()}
    assert texts["1"].borrname == 'he said "hi", ok'
    assert (texts["1"].borrstate, texts["1"].borrcity) == ("", None)
    assert texts["2"].borrname == "two\nlines"

    loans = ingest.import_loans(raw, D(2026, 1, 1))
    assert [f.name for f in loans.schema] == [f.name for f in LOANS]
    rows = loans.orderBy("loan_id").collect()
    assert [r.loan_id for r in rows] == ["SBA-00000001", "SBA-00000002"]
    assert (rows[0].approval_fy, rows[0].approval_date, rows[0].business_name) == (2019, None, "two\nlines")
    one = rows[1]
    assert (one.approval_date, one.gross_approved, one.state) == (D(2020, 3, 5), Decimal("1200.50"), "")
    assert (one.jobs_created, one.jobs_retained, one.loan_status, one.urban_rural) == (3, 3, None, 0)


def csv_file(path, *lines):
    path.mkdir()
    (path / "a.csv").write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_rows_with_other_numbers_of_fields(spark, tmp_path):
    header, good = ",".join(STAGING_COLUMNS), ",".join(f"v{i}" for i in range(43))
    path = csv_file(tmp_path / "in", header, good, "x,y,z", good + ",more", '"a ""b"", c"' + "," * 42)
    raw = ingest.read_raw_csv(spark, path)
    assert raw.count() == 2
    assert {r.asofdate for r in raw.select("asofdate").collect()} == {"v0", 'a "b", c'}
    assert [tuple(r) for r in ingest.count_by_source(raw).collect()] == [("a.csv", 2, 2)]
    rejected = ingest.rejected_raw_rows(spark, path)
    assert sorted(r.raw_line for r in rejected.select("raw_line").collect()) == [good + ",more", "x,y,z"]
    assert {(r.folder, r.file, r.asofdate) for r in rejected.collect()} == {("in", "a.csv", "x"), ("in", "a.csv", "v0")}


def test_csv_with_another_header_is_refused(spark, tmp_path):
    names = list(STAGING_COLUMNS)
    i, j = names.index("grossapproval"), names.index("sbaguaranteedapproval")
    names[i], names[j] = names[j], names[i]
    path = csv_file(tmp_path / "in", ",".join(names), ",".join(str(i) for i in range(43)))
    with pytest.raises(Exception, match="FAILED_READ_FILE|CSV header does not conform"):
        ingest.read_raw_csv(spark, path).collect()


def test_large_csv_files_are_split(spark, tmp_path):
    row = ",".join(["some text"] * 43)
    path = csv_file(tmp_path / "in", ",".join(STAGING_COLUMNS), *[row] * 3000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        raw = ingest.read_raw_csv(spark, path)
        assert raw.rdd.getNumPartitions() > 3 and raw.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_beyond_eight_digits(spark):
    df = spark.sql("select explode(array(7L, 123456789L)) n")
    assert [r[0] for r in df.select(ingest.loan_id(F.col("n"))).collect()] == ["SBA-00000007", "SBA-123456789"]


def test_write_and_incremental_load(spark, make_loans, tmp_path):
    path = str(tmp_path / "loans")
    old = make_loans(
        dict(loan_id="a", approval_date=D(2010, 1, 1), approval_fy=2010),
        dict(loan_id="b", approval_date=D(2011, 1, 1), approval_fy=2011),
    )
    ingest.write_loans(old, path)
    incoming = make_loans(
        dict(loan_id="same day", approval_date=D(2011, 1, 1), approval_fy=2011),
        dict(loan_id="new", approval_date=D(2011, 1, 2), approval_fy=2011),
        dict(loan_id="broken", approval_date=D(2011, 1, 2), loan_status="OPEN"),
        dict(loan_id="no date"),
    )
    rejected = ingest.incremental_load(spark, incoming, path)
    assert [(r.loan_id, r.rejected_reasons) for r in rejected.collect()] == [("broken", ["chk_loan_status"])]
    twice = make_loans(*[dict(loan_id="twice", approval_date=D(2012, 1, 1))] * 2)
    known = make_loans(dict(loan_id="a", approval_date=D(2012, 1, 1)))
    for refused in (twice, known):
        with pytest.raises(ValueError, match="twice|already"):
            ingest.incremental_load(spark, refused, path)
    assert sorted(r.loan_id for r in ingest.read_loans(spark, path).collect()) == ["a", "b", "new"]
    assert len(list(tmp_path.glob("loans/data/load=*/rejected=false/approval_fy=2011"))) == 2
    ingest.write_loans(old.limit(1), path)  # full refresh
    assert ingest.read_loans(spark, path).count() == 1


def test_numbers_go_on(make_loans):
    def after(*ids):
        loans = make_loans(*[dict(loan_id=i) for i in ids]).filter("loan_id <> 'gone'")
        return loans.sparkSession.range(1).select(ingest.next_number(loans)).first()[0]

    assert after("SBA-00000007", "SBA-123456789", "other") == 123456790
    assert after("other") == after("gone") == 1


def test_incremental_load_into_empty_table(make_loans):
    empty = make_loans(dict(loan_id="x")).filter("false")
    incoming = make_loans(dict(loan_id="a", approval_date=D(2010, 1, 1)), dict(loan_id="b"))
    assert ingest.newer_loans(empty, incoming).count() == 2


def test_sample(spark, make_loans):
    ids = [dict(loan_id=f"L{i}") for i in range(3000)]
    loans = make_loans(*ids)
    one = [r.loan_id for r in ingest.sample_loans(loans, 300).collect()]
    again = [r.loan_id for r in ingest.sample_loans(loans.repartition(5), 300).collect()]
    other = [r.loan_id for r in ingest.sample_loans(loans, 300, seed=7).collect()]
    assert len(set(one)) == 300 and one == again and one != other
    for n in (0, 1, 2999, 3000, 3001):
        assert ingest.sample_loans(loans, n).count() == min(n, 3000)


def test_sample_of_equal_and_missing_ids(spark, make_loans):
    rows = [dict(loan_id=f"L{i}") for i in range(50)] + [dict(loan_id="same")] * 150
    loans = make_loans(*rows)
    loans = loans.unionByName(loans.limit(40).withColumn("loan_id", F.lit(None).cast("string")))
    for seed in (1, 2, 3, 42):
        for n in (1, 100, 239, 240, 500):
            assert ingest.sample_loans(loans, n, seed).count() == min(n, 240)


def test_schema_report(make_loans):
    rows = schema_report(make_loans({}), "loans").collect()
    assert [r.column_name for r in rows] == [f.name for f in LOANS]
    assert tuple(rows[0]) == ("loans", "loan_id", "string", "NO")
    assert rows[20].data_type == "decimal(15,2)"


def test_unique(make_loans):
    loans = make_loans(dict(loan_id="a"), dict(loan_id="a"), dict(loan_id="b"))
    assert [tuple(r) for r in ingest.check_unique(loans).collect()] == [("a", 2)]
