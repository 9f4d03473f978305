"""Loads that happen as a whole or not at all, and what is known of stored files."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from loanloom.sources import ingest, versions
from loanloom.sources.ingest import incremental_load, loan_table, read_loans, write_loans
from loanloom.sources.versions import LoadConflict, Table

D = dt.date


def ids(spark, path, version=None):
    return sorted(r.loan_id for r in read_loans(spark, path, version).select("loan_id").collect())


def batch(make_loans, year, *names, **more):
    return make_loans(*[dict(loan_id=n, approval_date=D(year, 1, 1), approval_fy=year) | more for n in names])


STEPS = ["write", "written", "describe", "publish", "_move_if_free"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stopped_load_leaves_the_old_or_the_new_table(spark, make_loans, tmp_path, monkeypatch, step, when):
    path = str(tmp_path / "t")
    write_loans(batch(make_loans, 2010, "a", "b"), path)
    owner = Table if hasattr(Table, step) else versions
    real = getattr(owner, step)

    def stopped(*args, **named):
        if when == "after":
            real(*args, **named)
        raise KeyboardInterrupt

    for load in (
        lambda: incremental_load(spark, batch(make_loans, 2011, "c"), path),
        lambda: write_loans(batch(make_loans, 2011, "c"), path),
    ):
        before = ids(spark, path)
        monkeypatch.setattr(owner, step, stopped)
        with pytest.raises(KeyboardInterrupt):
            load()
        monkeypatch.undo()
        # only a load whose version has its name is there
        published = when == "after" and step in ("publish", "_move_if_free")
        wanted = ["c"] if "c" in before else [*before, "c"]
        assert ids(spark, path) == (wanted if published else before)
    # the table goes on from whatever is there
    incremental_load(spark, batch(make_loans, 2020, "z"), path)
    assert "z" in ids(spark, path) and len(ids(spark, path)) == len(set(ids(spark, path)))
    kept = ids(spark, path)
    versions.remove_unused(spark, path, keep=1, younger_than_s=-3600)
    assert ids(spark, path) == kept
    used = {x["load"] for x in loan_table(spark, path).loads}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == {f"load={x}" for x in used}


def test_a_write_that_is_cut_off_within(spark, make_loans, tmp_path):
    path = str(tmp_path / "t")
    write_loans(batch(make_loans, 2010, "a", "b"), path)
    fails = F.udf(lambda s: 1 / 0 if s == "d" else s)
    half = batch(make_loans, 2011, "c", "d").repartition(2, "loan_id").withColumn("business_name", fails("loan_id"))
    for load in (lambda: incremental_load(spark, half, path), lambda: write_loans(half, path)):
        with pytest.raises(Exception, match="ZeroDivision"):
            load()
        assert ids(spark, path) == ["a", "b"]


def test_readers_keep_their_version(spark, make_loans, tmp_path):
    path = str(tmp_path / "t")
    assert ids(spark, path) == [] and loan_table(spark, path).latest_day() is None
    write_loans(batch(make_loans, 2010, "a"), path)
    open_before = read_loans(spark, path)
    incremental_load(spark, batch(make_loans, 2011, "b"), path)
    write_loans(batch(make_loans, 2012, "c"), path)
    assert [r.loan_id for r in open_before.collect()] == ["a"]
    assert [ids(spark, path, v) for v in (1, 2, 3)] == [["a"], ["a", "b"], ["c"]]
    assert read_loans(spark, path).schema.names == ingest.LOANS.names
    assert versions.remove_unused(spark, path, keep=1) == []  # too young
    assert len(versions.remove_unused(spark, path, keep=1, younger_than_s=-3600)) == 2
    assert ids(spark, path) == ["c"]


@pytest.mark.parametrize("full", [False, True])
def test_of_two_loads_at_once_one_is_refused(spark, make_loans, tmp_path, monkeypatch, full):
    path = str(tmp_path / "t")
    write_loans(batch(make_loans, 2010, "a"), path)
    both, publish, ends = threading.Barrier(2), Table.publish, {}
    loads = {n: batch(make_loans, 2011, n) for n in ("b", "c")}

    def together(self, *args, **named):
        both.wait(60)
        return publish(self, *args, **named)

    def load(n):
        try:
            write_loans(loads[n], path) if full and n == "b" else incremental_load(spark, loads[n], path)
            ends[n] = "loaded"
        except LoadConflict:
            ends[n] = "refused"

    monkeypatch.setattr(Table, "publish", together)
    threads = [threading.Thread(target=load, args=(n,)) for n in loads]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    monkeypatch.undo()
    assert sorted(ends.values()) == ["loaded", "refused"]
    won = next(n for n, e in ends.items() if e == "loaded")
    assert ids(spark, path) == ([won] if full and won == "b" else ["a", won])
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the refused one has left nothing
    lost = next(n for n in loads if n != won)
    if won == "c" or not full:
        loads[lost] = batch(make_loans, 2012, lost)
        incremental_load(spark, loads[lost], path)  # it can be run again
        assert lost in ids(spark, path)


def test_a_name_is_taken_once(spark, tmp_path):
    target = f"{tmp_path}/v/00000001"
    for text in ("one", "two"):
        versions._write(spark, f"{tmp_path}/v/{text}", text)
    assert versions._move_if_free(spark, f"{tmp_path}/v/one", target)
    assert not versions._move_if_free(spark, f"{tmp_path}/v/two", target)
    assert versions._read(spark, target) == "one" and not (tmp_path / "v" / "two").exists()
    with pytest.raises(Exception, match="NoSuchFile|not exist"):
        versions._move_if_free(spark, f"{tmp_path}/v/none", f"{tmp_path}/v/00000002")


def test_a_repeated_batch_adds_nothing(spark, make_loans, tmp_path):
    path = str(tmp_path / "t")
    one = batch(make_loans, 2010, "a", "b").unionByName(batch(make_loans, 2010, "bad", loan_status="OPEN"))
    assert incremental_load(spark, one, path, batch="k1").count() == 1
    again = incremental_load(spark, one, path, batch="k1")
    assert again.count() == 0 and "rejected_reasons" in again.columns
    assert (ids(spark, path), loan_table(spark, path).version) == (["a", "b"], 1)
    incremental_load(spark, batch(make_loans, 2011, "c"), path, batch="k2")
    incremental_load(spark, batch(make_loans, 2012, "d"), path, batch="k1")
    assert ids(spark, path) == ["a", "b", "c"]
    write_loans(batch(make_loans, 2010, "x"), path)  # a full refresh starts anew
    incremental_load(spark, batch(make_loans, 2011, "c"), path, batch="k1")
    assert ids(spark, path) == ["c", "x"]


def wide(spark, first, n, year=2010):
    loans = spark.range(first, first + n).select(
        F.format_string("SBA-%08d", "id").alias("loan_id"),
        F.lit(D(year, 5, 5)).alias("approval_date"),
        F.lit(year).alias("approval_fy"),
    )
    return ingest.as_loans(loans)


def test_only_files_that_can_hold_an_id_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    write_loans(wide(spark, 0, 30_000), path)
    looked_at = []
    for i in range(1, 6):
        table = loan_table(spark, path)
        batch = wide(spark, 30_000 * i, 30_000, 2010 + i)
        looked_at.append(table.may_hold(batch).count())
        incremental_load(spark, batch, path)
    assert looked_at == [0] * 5  # ids go on: none, however many files there are
    table = loan_table(spark, path)
    assert table.files().count() == 6 and table.last_number() == 179_999
    assert table.latest_day() == D(2015, 5, 5)
    assert table.may_hold(wide(spark, 75_000, 1)).count() == 1
    # within the range of files, but not stored: found by chance only
    odd = spark.range(20_000).select(F.format_string("SBA-%08d-x", "id").alias("loan_id"))
    pairs = table._known("filters", versions.FILTERS).where("block = 0").count()
    assert pairs == 6
    assert table.stored_keys(odd).count() == 0
    one_by_one = sum(
        table.may_hold(spark.createDataFrame([(f"SBA-{i:08d}-x",)], "loan_id string")).count() for i in range(0, 170_000, 8500)
    )
    assert one_by_one <= 2
    known = wide(spark, 29_990, 20).select("loan_id")
    assert table.stored_keys(known.unionByName(odd)).count() == 20
    with pytest.raises(ValueError, match="already"):
        incremental_load(spark, wide(spark, 179_999, 2, 2020), path)
    assert table.stored_keys(known.limit(0)).collect() == []


def test_filters_never_miss_a_stored_id(spark, tmp_path):
    path = str(tmp_path / "t")
    loans = wide(spark, 0, 9000).withColumn("loan_id", F.concat(F.md5("loan_id"), "loan_id"))
    write_loans(loans.withColumn("approval_fy", F.pmod(F.hash("loan_id"), F.lit(7))), path)
    table = loan_table(spark, path)
    assert table.files().agg(F.sum("rows"), F.count("file")).first()[:] == (9000, 7)
    assert table.stored_keys(loans).count() == 9000
    assert table.stored_keys(loans.limit(10).select(F.upper("loan_id").alias("loan_id"))).count() == 0


def test_a_large_batch_is_not_looked_up_in_every_file(spark, tmp_path, monkeypatch):
    """Where ids of batch and files share a range, the lookups grow with the batch and not with batch times files."""
    path, n = str(tmp_path / "t"), 40_000
    loans = wide(spark, 0, n).withColumn("approval_fy", F.pmod(F.hash("loan_id"), F.lit(20)))
    write_loans(loans.withColumn("loan_id", F.md5("loan_id")), path)
    table = loan_table(spark, path)
    assert table.files().count() == 20
    lookups, asked = [], Table._asked

    def counted(self, keys, filters):
        lookups.append(keys.count() * filters.select("file").distinct().count())
        return asked(self, keys, filters)

    monkeypatch.setattr(Table, "_asked", counted)
    new = wide(spark, n, n).withColumn("loan_id", F.md5("loan_id"))
    batch = new.unionByName(loans.limit(3000).withColumn("loan_id", F.md5("loan_id")))
    files = table.may_hold(batch)
    assert files.count() == files.distinct().count() == 20
    assert sum(lookups) <= 20 * 1.2 * versions.ASKED + n
    assert table.stored_keys(batch).count() == 3000 and table.stored_keys(new).count() == 0
    # files between which a batch lies are asked for all of it, and left out
    monkeypatch.setattr(versions, "ASKED", 10)
    apart = str(tmp_path / "apart")
    write_loans(wide(spark, 0, 1000).unionByName(wide(spark, 900_000, 1000, 2011)), apart)
    between = spark.range(100).select(F.format_string("SBA-%08d-x", F.col("id") + 500).alias("loan_id"))
    table = loan_table(spark, apart)
    assert table.may_hold(between).count() == 0
    assert table.may_hold(between.union(wide(spark, 900, 5).select("loan_id"))).count() == 1
