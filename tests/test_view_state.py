"""Distinct counts by merged bits, and state of views carried on by loads, against plain Spark."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loanloom.operators import bitmaps
from loanloom.operators.clean import clean
from loanloom.plans import dashboard, kpis, view_state
from loanloom.sources import versions
from loanloom.sources.ingest import incremental_load, loan_table, read_loans, write_loans
from loanloom.sources.store import stored
from loanloom.sources.versions import LoadConflict, Table

AS_OF = dt.date(2015, 9, 17)  # the last five years begin within a month


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table_of(spark, rows):
    return stored(spark.createDataFrame(rows, "a string, b long, g string, y int"), "bits_input")


@pytest.mark.parametrize("values", [1, 64, 65, 1000])
def test_distinct_counts_equal_plain_ones(spark, values):
    draw = random.Random(values)
    rows = [
        (
            "hot" if draw.random() < 0.4 else draw.choice([None, f"v{draw.randrange(values)}"]),
            draw.choice([None, draw.randrange(values)]),
            draw.choice(["x", "y", None]),
            draw.choice([1, 2, 3, None]),
        )
        for _ in range(3000)
    ]
    df, columns = table_of(spark, rows), {"A": "a", "B": "b"}
    codes = stored(bitmaps.dictionary(bitmaps.value_counts(df, columns)), "codes")
    listed = [r.code for r in codes.orderBy("code").collect()]
    assert listed == list(range(len(listed)))
    if values > 1:
        assert codes.filter("code = 0").first().value == "hot"
    parts = bitmaps.words(df, columns, codes, {"G": "g"}, total="all", by=["y"])
    assert parts.groupBy("y", "side", "value", "of", "word").count().filter("count > 1").isEmpty()

    def exact(by):
        per = {
            (side, r[0] if side == "G" else None, *r[1:])
            for side, keys in (("G", ["g", *by]), ("all", [F.lit(None).alias("g"), *by]))
            for r in df.groupBy(*keys).agg(F.count_distinct("a").alias("A"), F.count_distinct("b").alias("B")).collect()
        }
        return sorted((p for p in per if p[-1] or p[-2]), key=repr)

    got = bitmaps.distinct_counts(parts, ["A", "B"], ["side", "value", "y"])
    assert plain(got) == exact(["y"])
    years_merged = bitmaps.distinct_counts(bitmaps.merged(parts), ["A", "B"])
    assert plain(years_merged) == exact([])


def test_a_dictionary_goes_on(spark):
    """Old values keep their codes, new ones get the next; all 64 bits of a word are used."""
    columns = {"A": "a"}
    first = table_of(spark, [(f"v{i}", None, "x", 1) for i in range(130)])
    second = table_of(spark, [(f"v{i}", None, "x", 1) for i in range(100, 300)] + [(None, None, "x", 1)])
    codes = stored(bitmaps.dictionary(bitmaps.value_counts(first, columns)), "codes")
    more = stored(bitmaps.dictionary(bitmaps.value_counts(second, columns), codes), "codes")
    assert codes.exceptAll(more).isEmpty()
    assert [r.code for r in more.orderBy("code").collect()] == list(range(300))
    same = stored(bitmaps.dictionary(bitmaps.value_counts(first, columns), more), "codes")
    assert plain(same) == plain(more)
    parts = bitmaps.words(first, columns, more, {}, "all").unionByName(bitmaps.words(second, columns, more, {}, "all"))
    assert bitmaps.distinct_counts(bitmaps.merged(parts), ["A"]).first().A == 300
    empty = table_of(spark, [])
    none = bitmaps.dictionary(bitmaps.value_counts(empty, columns))
    assert none.isEmpty()
    assert bitmaps.words(empty, columns, none, {"G": "g"}).isEmpty()


def loans_of(make_loans, seed, days, n=150, prefix="a"):
    draw = random.Random(seed)
    first = days[0].toordinal()
    return stored(
        make_loans(
            *[
                dict(
                    loan_id=f"{prefix}{i}",
                    approval_date=dt.date.fromordinal(draw.randrange(first, days[1].toordinal())),
                    approval_fy=2010,
                    bank_name=draw.choice([f"bank {draw.randrange(90)}", "big bank", None]),
                    state=draw.choice(["CA", "TX", "NY", None]),
                    naics=draw.choice(["111110", "441110", "990000", None]),
                    gross_approved=draw.choice([None, 0, draw.randrange(10**8) / 100]),
                    sba_approved=draw.randrange(10**7) / 100,
                    chargeoff_amount=draw.choice([None, draw.randrange(10**6) / 100]),
                    term_months=draw.choice([None, 12, 84, 240]),
                    jobs_created=draw.choice([None, 3]),
                    jobs_retained=2,
                    new_business=draw.choice([1, 2, None]),
                    loan_status=draw.choice(["PIF", "CHGOFF", None]),
                )
                for i in range(n)
            ]
        ),
        "some_loans",
    )


def words_by_value(state):
    """The words with their codes spelled out, which differ between a load and a rebuild."""
    bits = state.words.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    is_set = F.expr("shiftrightunsigned(bits, bit) & 1 = 1")
    coded = bits.filter(is_set).select(*view_state.KEY, "of", (F.col("word") * 64 + F.col("bit")).alias("code"))
    return plain(coded.join(state.codes, ["of", "code"]).drop("code"))


def same_state(spark, path, tmp_path, name):
    """The state of the newest version is that of a table loaded at once, row by row."""
    write_loans(read_loans(spark, path), str(tmp_path / name), views=True)
    kept, rebuilt = (view_state.read_state(loan_table(spark, p)) for p in (path, str(tmp_path / name)))
    assert plain(kept.sums) == plain(rebuilt.sums)
    assert words_by_value(kept) == words_by_value(rebuilt)
    assert plain(view_state.lenders_reached(kept)) == plain(view_state.lenders_reached(rebuilt))
    return kept


def test_after_loads_the_state_equals_a_rebuild(spark, make_loans, tmp_path):
    path, D = str(tmp_path / "t"), dt.date
    spans = [(D(2008, 1, 1), D(2010, 9, 20)), (D(2010, 9, 20), D(2011, 1, 1)), (D(2011, 1, 1), D(2015, 9, 1))]
    write_loans(loans_of(make_loans, 0, spans[0]), path, views=True)
    for i, days in enumerate(spans[1:], 1):
        incremental_load(spark, loans_of(make_loans, i, days, prefix=f"{i}-"), path, batch=str(i))
    version = loan_table(spark, path).version
    state = same_state(spark, path, tmp_path, "rebuilt")
    incremental_load(spark, loans_of(make_loans, 9, spans[1], prefix="again"), path, batch="1")
    assert loan_table(spark, path).version == version  # a repeated batch adds nothing

    table = stored(clean(read_loans(spark, path), AS_OF), "clean")
    for name, report in view_state.REPORTS.items():
        of_loans = getattr(kpis if name == "portfolio_kpi_summary" else dashboard, name)
        for more in ((AS_OF,), (D(2013, 2, 1),)) if name in view_state.DATED else ((),):
            want, got = of_loans(table, *more), report(state, *more)
            assert got.columns == want.columns
            assert plain(got) == plain(want), name

    # a day that was never approved, and a load without known outcomes
    odd = make_loans(
        dict(loan_id="n1", approval_date=None, approval_fy=2011, loan_status="PIF", bank_name="new bank"),
        dict(loan_id="n2", approval_date=D(2016, 1, 1), approval_fy=2016, bank_name="unseen bank"),
    )
    write_loans(odd, path, "append")
    same_state(spark, path, tmp_path, "rebuilt2")


def test_state_is_published_with_its_rows(spark, make_loans, tmp_path, monkeypatch):
    path, D = str(tmp_path / "t"), dt.date
    days = (D(2010, 1, 1), D(2011, 1, 1))
    write_loans(loans_of(make_loans, 1, days, 20), path)
    with pytest.raises(ValueError, match="keeps no state"):
        view_state.read_state(loan_table(spark, path))
    # from the first load that asks for it, the state is that of all rows
    write_loans(loans_of(make_loans, 2, days, 20, "b"), path, "append", views=True)
    before = plain(view_state.read_state(loan_table(spark, path)).sums)
    assert sum(r[3] for r in before if r[1] == "all") == 40

    monkeypatch.setattr(Table, "publish", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        write_loans(loans_of(make_loans, 3, days, 20, "c"), path, "append")
    monkeypatch.undo()
    assert plain(view_state.read_state(loan_table(spark, path)).sums) == before
    old = loan_table(spark, path)
    write_loans(loans_of(make_loans, 4, days, 20, "d"), path, "append")
    with pytest.raises(LoadConflict):
        write_loans(loans_of(make_loans, 5, days, 20, "e"), path, "append", table=old)
    state = same_state(spark, path, tmp_path, "r2")
    assert state.on("all").agg(F.sum("booked")).first()[0] == 60
    versions.remove_unused(spark, path, keep=1, younger_than_s=-3600)
    assert plain(view_state.read_state(loan_table(spark, path)).sums) == plain(state.sums)
    # an overwrite begins anew, and an empty table has an empty state
    write_loans(loans_of(make_loans, 6, days, 20, "f"), path)
    assert view_state.read_state(loan_table(spark, path)).on("all").agg(F.sum("booked")).first()[0] == 20
    write_loans(read_loans(spark, path).limit(0), path)
    empty = view_state.read_state(loan_table(spark, path))
    assert empty.sums.isEmpty() and empty.codes.isEmpty() and empty.words.isEmpty()
    assert view_state.executive_summary(empty).first().total_loans == 0
    write_loans(read_loans(spark, path), path, views=False)
    assert loan_table(spark, path).views() is None


def test_a_load_reads_no_older_rows(spark, make_loans, tmp_path, monkeypatch):
    path, D = str(tmp_path / "t"), dt.date
    write_loans(loans_of(make_loans, 1, (D(2010, 1, 1), D(2011, 1, 1)), 20), path, views=True)
    monkeypatch.setattr(Table, "rows", lambda self: pytest.fail("older rows are read"))
    incremental_load(spark, loans_of(make_loans, 2, (D(2012, 1, 1), D(2013, 1, 1)), 20, "b"), path)
    monkeypatch.undo()
    assert view_state.read_state(loan_table(spark, path)).on("all").agg(F.sum("booked")).first()[0] == 40
