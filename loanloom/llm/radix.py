"""Ranks of a large table by a distributed radix sort, least significant digit first.

A composite key is a list of whole numbers, most significant first. Each pass sorts by one digit
and leaves rows with equal digits in the order they had (a stable counting sort):

- Rows lie in blocks of bounded size, by the places the last pass gave them.
- Rows are counted by (block, digit), summed before they are shuffled.
- Prefix sums give each (block, digit) its first place: all smaller digits, then the same digit in
  earlier blocks. One window goes over the digits (at most 2^DIGIT), one per digit over the blocks.
- A row's place is that number plus its place among the rows of its block and digit.

Digits that all rows share are skipped. Each pass is stored, so a lost executor costs the tasks
it ran. No task holds more than a block of one digit, however often a key repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.sources.store import stored

#: Bits of a digit.
DIGIT = 12
#: Rows of a block at most; with few rows blocks get smaller, so that all cores have some.
BLOCK = 1 << 20
BLOCKS_PER_PARTITION = 4
_SIGN = -(1 << 63)


def _as_stored(df: DataFrame) -> DataFrame:
    """Rows with a first place each, by task and row; runs of them make the first blocks."""
    at = F.monotonically_increasing_id()
    return stored(df.withColumn("_at", at), "radix").withColumn("_block", F.shiftright("_at", DIGIT))


def _pass(rows: DataFrame, digit: Column, per_block: int) -> DataFrame:
    rows = rows.withColumn("_digit", digit)
    counts = rows.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    smaller = (
        counts.groupBy("_digit")
        .agg(F.sum("_n").alias("_all"))
        .select("_digit", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_smaller"))
    )
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_digit", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier")
    ).join(smaller, "_digit")
    starts = starts.select("_digit", "_block", (F.col("_smaller") + F.col("_earlier")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1
    placed = rows.withColumn("_nth", nth).join(starts, ["_digit", "_block"])
    placed = placed.withColumn("_at", F.col("_start") + F.col("_nth"))
    placed = stored(placed.drop("_digit", "_block", "_nth", "_start"), "radix")
    return placed.withColumn("_block", F.floor(F.col("_at") / per_block))


def ranked(df: DataFrame, key: Sequence[str], name: str = "rank") -> DataFrame:
    """The rows with their rank, 1 for the least key; rows with equal keys keep the input's order.

    key: names of long columns without nulls. Names that begin with an underscore belong to
    the sort, and the input has none. An empty table gives an empty result.
    """
    rows = _as_stored(df)
    ends = [f(c) for c in key for f in (F.min, F.max)]
    n, *found = rows.agg(F.count(F.lit(1)), *ends).first()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(1, min(BLOCK, n // (BLOCKS_PER_PARTITION * partitions)))
    digits = []
    for c, least, most in reversed(list(zip(key, found[::2], found[1::2], strict=True))):
        if not n:
            break
        # counted from the least value, or as unsigned numbers where that would not fit
        fits = most - least < 1 << 63
        value = F.col(c) - F.lit(least) if fits else F.col(c).bitwiseXOR(F.lit(_SIGN))
        for shift in range(0, (most - least).bit_length() if fits else 64, DIGIT):
            digits.append(F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int"))
    for digit in digits or [F.lit(0)]:
        rows = _pass(rows, digit, per_block)
    return rows.withColumn(name, F.col("_at") + 1).drop("_at", "_block")
