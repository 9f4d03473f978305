"""Line breaks in quoted fields, read in parts, against the reader that takes whole files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import registry
from loanloom.schemas import STAGING_COLUMNS
from loanloom.sources import ingest
from loanloom.sources.quoted_csv import read_quoted, records

THREE = T.StructType([T.StructField(n, T.StringType()) for n in "abc"])


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "500b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def whole_files(spark, path):
    """The rows as Spark reads them with one task per file."""
    reader = spark.read.schema(T.StructType([*THREE.fields, T.StructField("raw", T.StringType())]))
    options = {"header": True, "escape": '"', "multiLine": True, "emptyValue": "", "columnNameOfCorruptRecord": "raw"}
    return sorted(map(str, reader.options(**options).option("nullValue", None).csv(path).collect()))


def in_parts(spark, path, **more):
    return sorted(map(str, read_quoted(spark, path, THREE, "raw", **more).drop("file").collect()))


def field(draw):
    kind = draw.random()
    if kind < 0.3:
        parts = ["x", "\n", '""', ",", "yy", "\n\n", " ", "z\r\n" if draw.random() < 0.05 else "z"]
        return '"' + "".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) + '"'
    return draw.choice(["", "plain", "a b", "5", 'in"ch', "word " * draw.randint(1, 30)])


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_whole_files(spark, small_splits, tmp_path, seed):
    draw = random.Random(seed)
    for n in range(2):
        rows = [",".join(field(draw) for _ in range(3)) for _ in range(150)]
        rows[10:10] = ["short,row", "", "one,two,three,four", "  "]
        (tmp_path / f"{n}.csv").write_text("a,b,c\n" + "\n".join(rows) + "\n" * (n == 0), newline="")
    found = in_parts(spark, str(tmp_path))
    assert found == whole_files(spark, str(tmp_path)) and len(found) > 290
    assert records(spark, str(tmp_path)).select("file").distinct().count() == 2


def test_one_record_over_many_blocks(spark, small_splits, tmp_path):
    inner = "\n".join(f"line {i}, with ""quotes""".replace('"', '""') for i in range(400))
    text = f'a,b,c\n1,"{inner}",2\n' + "".join(f"{i},x,y\n" for i in range(300)) + f'3,z,"{inner}\n"\n'
    (tmp_path / "one.csv").write_text(text)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    assert in_parts(spark, str(tmp_path)) == whole_files(spark, str(tmp_path))


def test_a_quote_that_is_never_closed(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n4,"5,6\n' + "7,8,9\n" * 50)
    rows = read_quoted(spark, str(tmp_path), THREE, "raw", longest=20).collect()
    assert [tuple(r)[1:4] for r in rows if r.raw is None] == [("1", "2", "3")]
    assert sorted(r.raw for r in rows if r.raw is not None) == sorted(['4,"5,6', *["7,8,9"] * 50])


def test_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        in_parts(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("a,b,c\n")
    assert in_parts(spark, str(tmp_path)) == []


def test_raw_loan_files(spark, small_splits, tmp_path):
    good = ",".join(f"v{i}" for i in range(43))
    broken = '"two\nlines, ""quoted"""' + ",x" * 42
    (tmp_path / "a.csv").write_text("\n".join([",".join(STAGING_COLUMNS), good, broken, 'x,"y\nz"', good]) + "\n")
    found = ingest.read_quoted_csv(spark, str(tmp_path))
    whole = ingest.read_raw_csv(spark, str(tmp_path), multi_line=True)
    assert found.schema.names == whole.schema.names
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert {r.asofdate for r in found.collect()} == {"v0", 'two\nlines, "quoted"'}
    rejected = ingest.rejected_quoted_rows(spark, str(tmp_path)).collect()
    assert [(r.file, r.asofdate, r.raw_line) for r in rejected] == [("a.csv", "x", 'x,"y\nz"')]


def test_the_rows_of_a_folder_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The query's files stay as small as tasks should be, however many rows there are."""
    name, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 20_000
    texts = [F.md5(F.concat(F.lit(c), F.col("id").cast("string"))).alias(c) for c in STAGING_COLUMNS]
    spark.range(600).select(F.col("id").alias("source_key"), *texts).write.parquet(str(tmp_path / "staging"))
    monkeypatch.setattr(registry, "star_staging", lambda *_: spark.read.parquet(str(tmp_path / "staging")))
    monkeypatch.setattr(registry, "new_table_path", lambda *_: str(tmp_path / "csv"))
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        rows = registry._read_quoted_csv(spark, "").select("asofdate", "borrstreet").collect()
    finally:
        spark.conf.set(name, before)
    assert min(len(list((tmp_path / "csv" / f"batch={i}").glob("*.csv"))) for i in range(2)) > 5
    rear = '\n"rear",\n\n2nd floor'
    streets = [
        hashlib.md5(f"borrstreet{i}".encode()).hexdigest() + (rear if i % 7 == 0 else "\n" if i % 5 == 0 else "")
        for i in range(600)
    ]
    assert sorted(r.borrstreet for r in rows) == sorted(streets)
