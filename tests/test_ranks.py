"""Ranks of a table over many tasks, against Spark's own windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from loanloom.operators.ranks import ranked
from loanloom.sources.store import stored


def tables(spark):
    draw = random.Random(8)
    many = [(i, draw.choice([1, 2, 2, 2, 3, None, i % 50]), draw.choice(["a", "b", None])) for i in range(3000)]
    hot = [(i, 7 if i < 2500 else i % 9, "a") for i in range(3000)]  # one value fills several tasks
    one = [(i, 5, "a") for i in range(1000)]
    nulls = [(i, None, None) for i in range(1000)]
    few = [(1, 4, "x"), (2, 4, "x"), (3, None, None)]
    for rows in (many, hot, one, nulls, few, []):
        yield stored(spark.createDataFrame(rows, "id long, v long, s string"), "ranks_input")


@pytest.mark.parametrize("down", [False, True])
def test_ranks_equal_windows(spark, down):
    for df in tables(spark):
        v = F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last()
        ties = Window.orderBy(v, F.col("s").asc_nulls_last())
        wanted = df.select(
            "*",
            F.rank().over(ties).cast("long").alias("r"),
            F.dense_rank().over(ties).cast("long").alias("d"),
            F.ntile(7).over(Window.orderBy(v, F.col("s").asc_nulls_last(), F.desc("id"))).cast("long").alias("t"),
        )
        for partitions in (None, 1, 13):
            got = ranked(df, {"v": down, "s": False}, {"id": True}, "r", "d", ("t", 7), partitions)
            assert got.columns == wanted.columns
            assert got.orderBy("id").collect() == wanted.orderBy("id").collect()


def test_one_value_in_every_row(spark):
    hot = stored(spark.range(20_000).select("id", F.lit(1).alias("v")), "hot")
    out = ranked(hot, {"v": False}, rank="r", dense_rank="d", ntile=("t", 3), partitions=8)
    assert out.agg(F.max("r"), F.max("d"), F.count_if(F.col("t") == 1)).first()[:] == (1, 1, 6667)
