"""Ranks over a large sorted table, without a window over all of its rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from loanloom.sources.store import stored

_PLACE_BITS = 33  # monotonically_increasing_id: task number above, row number in the task below


def ranked(
    df: DataFrame,
    order: Mapping[str, bool],
    then: Mapping[str, bool] | None = None,
    rank: str | None = "rank",
    dense_rank: str | None = None,
    ntile: tuple[str, int] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add RANK, DENSE_RANK and NTILE by the columns of ``order`` (name: descending), NULLs last.

    ``then`` orders rows that tie, which counts for ``ntile`` (name, number of tiles) only; what
    ties on that too keeps its place in the input. Rows are range-partitioned with their place, so
    one repeated key is split over tasks. Each task counts its rows and groups of ties; from one row
    per task follow how many of both are before it, and where a group began that goes on
    from the task before. Only these rows go through one task and are broadcast. ``df`` should
    read files: then a lost task finds its rows in the same places again.
    """
    by = {**order, **(then or {})}
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by.items()]
    keys.append(F.col("_input"))
    parts = [partitions] if partitions else []
    in_task = Window.partitionBy("_task").orderBy("_place")
    so_far = in_task.rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(and_, [F.col(c).eqNullSafe(F.lag(c).over(in_task)) for c in order])
    local = stored(
        df.withColumn("_input", F.monotonically_increasing_id())
        .repartitionByRange(*parts, *keys)
        .sortWithinPartitions(*keys)
        .drop("_input")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_at", _PLACE_BITS))
        .withColumn("_place", F.col("_at") - F.shiftleft("_task", _PLACE_BITS))
        .withColumn("_begins", (F.col("_place") == 0) | ~same)
        .withColumn("_group", F.count_if("_begins").over(so_far))
        .withColumn("_start", F.max(F.when(F.col("_begins"), F.col("_place"))).over(so_far))
        .drop("_at", "_begins"),
        "ranked",
    )

    values = F.struct(*order)
    tasks = Window.orderBy("_task")
    before = tasks.rowsBetween(Window.unboundedPreceding, -1)
    upto = tasks.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("_first").eqNullSafe(F.lag("_last").over(tasks)) & F.lag(F.lit(True)).over(tasks).isNotNull()
    summary = (
        local.groupBy("_task")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max("_group").alias("_groups"),
            F.max("_start").alias("_tail"),
            F.min_by(values, "_place").alias("_first"),
            F.max_by(values, "_place").alias("_last"),
        )
        .withColumn("_goes_on", goes_on)
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy()))
        .withColumn(
            "_groups_before",
            F.coalesce(F.sum("_groups").over(before), F.lit(0)) - F.count_if("_goes_on").over(upto),
        )
        .withColumn("_opened", F.when(~F.col("_goes_on") | (F.col("_groups") > 1), F.col("_offset") + F.col("_tail")))
        .withColumn("_carried", F.last("_opened", ignorenulls=True).over(before))
        .select("_task", "_offset", "_total", "_groups_before", "_goes_on", "_carried")
    )

    first = F.when(F.col("_goes_on") & (F.col("_group") == 1), F.col("_carried")).otherwise(
        F.col("_offset") + F.col("_start")
    )
    added = {}
    if rank:
        added[rank] = first + 1
    if dense_rank:
        added[dense_rank] = F.col("_groups_before") + F.col("_group")
    if ntile:
        name, tiles = ntile
        # the first (total % tiles) tiles get one row more than the others
        place, small, larger = F.col("_offset") + F.col("_place"), F.floor(F.col("_total") / tiles), F.col("_total") % tiles
        in_larger = larger * (small + 1)
        added[name] = 1 + F.when(place < in_larger, F.floor(place / (small + 1))).otherwise(
            larger + F.floor((place - in_larger) / small)
        )
    kept = [F.col(c) for c in df.columns]
    return local.join(F.broadcast(summary), "_task").select(*kept, *[c.alias(n) for n, c in added.items()])
