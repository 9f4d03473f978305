"""Rules on single values: parsing, bands, months and roundings."""

import datetime as dt
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loanloom.dimensions import NAICS_ROWS, SECTOR_CODES, STATE_ROWS
from loanloom.functions import buckets as B
from loanloom.functions import parsing as P
from loanloom.functions.dates import whole_months, years_seasoned
from loanloom.functions.numeric import currency, pct, ratio, rounded


def texts(spark, rule, cases):
    """Apply a rule to texts and compare with the expected values, in order."""
    rows = [(i, text) for i, (text, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = [r.v for r in df.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


D = dt.date
PARSERS = [
    (P.parse_date, [
        ("3/5/2020", D(2020, 3, 5)), ("03/05/2020", D(2020, 3, 5)), ("2020-03-05", D(2020, 3, 5)),
        ("2020-03-05T00:00", D(2020, 3, 5)), ("3/5/20", None), ("13/45/2020", None),
        ("2020-02-30", None), ("x", None), ("3/5/2020\n", None), (None, None),
    ]),
    (P.parse_year, [("2007", 2007), ("207", None), ("FY20", None), ("2007\n", None), (None, None)]),
    (P.parse_term, [
        ("84", 84), ("84.6", 85), ("84.5", 85), ("0", None), ("-3", None), ("84.6x", None),
        ("", None), ("99999999999", None), (None, None),
    ]),
    (P.parse_employees, [("7", 7), ("7.5", 8), ("20000", 9999), ("99999999999", 9999), ("-4", None)]),
    (P.split_jobs, [("7", 3), ("7.0", 4), ("8", 4), ("x", 0), (None, 0), ("-4", 0)]),
    (P.parse_business_age, [
        ("New Business or 2 years", 2), ("Existing", 1), ("1.5", 2), ("2.5", 1), ("1", 1), ("2", 2),
        ("Unanswered", None), ("3 years", None), (" startup ", 2), (None, None),
    ]),
    (P.parse_money, [
        ("1200.50", Decimal("1200.50")), ("$1,200.50", Decimal("1200.50")), ("-5", None),
        ("abc", None), ("1.2.3", None), ("$", None), ("0", Decimal("0.00")), ("12", Decimal("12.00")),
        ("1.005", Decimal("1.01")), (".", None), ("99999999999999999", None), (None, None),
    ]),
    (P.map_status, [
        ("PIF", "PIF"), ("Paid in Full", "PIF"), ("EXEMPT", "PIF"), ("CHGOFF", "CHGOFF"),
        (" charged off", "CHGOFF"), ("COMMIT", None), ("CANCLD", None), (None, None),
    ]),
    (P.parse_yes, [("Y", "Y"), (" yes ", "Y"), ("revolving", "Y"), ("N", "N"), (None, "N")]),
    (P.parse_low_doc, [("LowDoc", "Y"), ("a low doc b", "Y"), ("Preferred", "N"), (None, "N")]),
    (P.code2, [(" ca ", "CA"), ("texas", "TE"), (None, None)]),
    (B.get_naics_sector, [("721110", "72"), ("7", "Unknown"), (None, "Unknown")]),
]


@pytest.mark.parametrize("rule,cases", PARSERS, ids=[rule.__name__ for rule, _ in PARSERS])
def test_text_rules(spark, rule, cases):
    texts(spark, rule, cases)


def values(spark, sql_type, rule, cases):
    rows = [(i, None if v is None else str(v)) for i, (v, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("v", F.col("t").cast(sql_type))
    got = [r.x for r in df.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_bands(spark):
    money = "decimal(15,2)"
    edges = [
        ("49999.99", "Micro (<$50K)"), ("50000", "Small ($50K-$150K)"),
        ("149999.99", "Small ($50K-$150K)"), ("350000", "Large ($350K-$1M)"), ("1000000", "Jumbo (>$1M)"),
    ]
    values(spark, money, B.categorize_loan_size, edges + [(None, "Unknown")])
    values(spark, money, lambda c: B.loan_size(c, B.SIZE_ORDER[0]), edges + [(None, "Micro (<$50K)")])
    values(spark, money, B.numbered_loan_size, [("1", "1. Micro (<$50K)"), (None, "5. Jumbo (>$1M)")])
    values(spark, "int", B.term_category, [
        (12, "Short (<=1yr)"), (13, "Medium (1-5yr)"), (60, "Medium (1-5yr)"), (120, "Long (5-10yr)"),
        (121, "Extended (>10yr)"), (None, "Unknown"),
    ])
    values(spark, "int", B.business_size, [
        (None, "Unknown"), (0, "Unknown"), (10, "Micro (1-10)"), (250, "Medium (51-250)"), (251, "Large (250+)"),
    ])
    values(spark, "int", B.employee_range, [
        (None, "NULL"), (-1, "Negative (invalid)"), (0, "0 employees"), (500, "101-500"),
        (501, ">500 (potential issue)"),
    ])
    values(spark, money, B.guarantee_band, [
        ("90", "90-100%"), ("89.99", "80-89%"), ("75", "75-79%"), ("50", "50-74%"), ("49.99", "<50%"),
    ])
    values(spark, money, B.severity_band, [
        ("0", "No Loss (0%)"), ("24.99", "Low (1-24%)"), ("25", "Medium (25-49%)"), ("100", "Total Loss (100%)"),
    ])
    values(spark, "int", B.seasoning_band, [(0, "0-12 months"), (13, "13-24 months"), (85, "85+ months")])
    values(spark, "int", B.economic_period, [
        (2004, "Earlier Vintages"), (2006, "Pre-2008 Crisis"), (2009, "During 2008 Crisis"),
        (2019, "Post-2008 Recovery"), (2020, "COVID Year"), (2021, "Post-COVID"), (None, "Earlier Vintages"),
    ])
    values(spark, "double", currency, [(1.23e9, "$1.2B"), (5e6, "$5.0M"), (1234, "$1,234"), (None, None)])


def test_guarantee_pct(spark):
    df = spark.sql(
        "select cast(a as decimal(15,2)) a, cast(b as decimal(15,2)) b from values"
        " (75, 100), (1, 3), (2, 3), (1, 0), (1, null), (0.01, 0.02) t(a, b)"
    )
    got = [r[0] for r in df.select(B.calculate_guarantee_pct(F.col("a"), F.col("b"))).collect()]
    want = ["75.00", "33.33", "66.67", None, None, "50.00"]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_whole_months(spark):
    cases = [
        (D(2020, 1, 31), D(2020, 2, 29), 0), (D(2020, 2, 29), D(2021, 2, 28), 11),
        (D(2020, 1, 15), D(2020, 2, 15), 1), (D(2020, 1, 15), D(2020, 1, 5), 0),
        (D(2020, 3, 15), D(2020, 1, 15), -2), (D(2020, 1, 15), D(2020, 1, 15), 0),
        (None, D(2020, 1, 1), None),
    ]
    df = spark.createDataFrame([(s, e) for s, e, _ in cases], "s date, e date")
    got = [r[0] for r in df.select(whole_months(F.col("s"), F.col("e"))).collect()]
    assert got == [m for _, _, m in cases]


def test_years_seasoned(spark):
    start = D(2010, 1, 1)
    cases = [(D(2010, 1, 20), 0), (D(2010, 2, 1), 1), (D(2011, 1, 1), 1), (D(2011, 2, 1), 2)]
    df = spark.createDataFrame([(start, e) for e, _ in cases], "approval_date date, chargeoff_date date")
    assert [r[0] for r in df.select(years_seasoned()).collect()] == [y for _, y in cases]


def test_ratio_is_exact(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-10**6, 10**6), rng.randint(1, 10**4)) for _ in range(2000)]
    pairs += [(1, 8), (-1, 8), (1005, 1000), (0, 5), (7, 0), (10**18, 3)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")

    def half_up(x: Fraction) -> Decimal:
        cents = (abs(x) * 200 + 1) // 2
        return Decimal(int(cents) * (-1 if x < 0 else 1)).scaleb(-2)

    rows = df.select("i", ratio("a", "b").alias("r"), pct("a", "b").alias("p")).orderBy("i").collect()
    for (a, b), row in zip(pairs, rows):
        want = half_up(Fraction(a, b)) if b else None
        assert row.r == want
        assert row.p == (half_up(Fraction(100 * a, b)) if b else None)


def test_rounded_double(spark):
    got = spark.sql("select 1.005D x union all select 2.675D").select(rounded("x", 2)).collect()
    assert sorted(str(r[0]) for r in got) == ["1.01", "2.68"]


def test_lookup_tables_hold_what_is_expected():
    """Counts, and rows of each region and of some sectors, stated here apart from the tables."""
    assert len(NAICS_ROWS) == 24 and len(STATE_ROWS) == 54
    sectors = {r[0]: r[1] for r in NAICS_ROWS}
    assert len(sectors) == 24 and set(sectors) == set(SECTOR_CODES)
    assert sectors["72"] == "Accommodation and Food Services" and sectors["23"] == "Construction"
    assert sectors["31"] == sectors["32"] == sectors["33"] == "Manufacturing"
    states = {r[0]: r[1:] for r in STATE_ROWS}
    assert len(states) == 54
    known = {
        "CA": ("California", "West"), "TX": ("Texas", "South"), "NY": ("New York", "Northeast"),
        "OH": ("Ohio", "Midwest"), "WA": ("Washington", "West"), "FL": ("Florida", "South"),
    }
    for code, (name, region) in known.items():
        assert states[code][0] == name and states[code][1] == region
    regions = {region for _, region, _ in states.values()}
    assert {"West", "South", "Northeast", "Midwest"} <= regions
    assert all(len(code) == 2 and name and division for code, (name, _, division) in states.items())
