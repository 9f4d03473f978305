"""Consecutive numbers over a large sorted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from loanloom.sources.store import stored

_PLACE_BITS = 33  # monotonically_increasing_id: task number above, row number in the task below


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, ... in the given order (NULLs last) without a one-task window.

    The table is range-partitioned and sorted, and each row notes its task and place. Rows that
    tie on all keys are told apart by their place in the input, so one repeated key does not
    end up in a single task. The sorted table is stored: the places must not be computed
    twice. The offsets are one row per task, so broadcasting them is safe. ``df`` should read files:
    then a lost task finds its rows in the same places again.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    places = (
        df.withColumn("_input", F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.col("_input"))
        .sortWithinPartitions(*keys, F.col("_input"))
        .drop("_input")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    saved = stored(places, "numbered").withColumn("_task", F.shiftright("_at", _PLACE_BITS))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        saved.groupBy("_task")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_at") - F.shiftleft("_task", _PLACE_BITS)
    return (
        saved.join(F.broadcast(offsets), "_task")
        .withColumn(name, F.col("_offset") + place + 1)
        .drop("_task", "_at", "_offset")
    )
