"""Exact percentiles that never hold a whole group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer,
which suits months or rates but not money. Two reads are enough:

1. A mergeable rank sketch per group (``percentile_approx``, which is off by at most 1 /
   ``accuracy`` of the rows in rank) gives for each percentile a bracket of values that holds its ranks.
2. Rows are counted by value within the brackets, and all together in each gap between them, so
   the counts settle which value has a rank. A bracket may hold one value that repeats any number of times.

What is shuffled are sketches, and counts of the distinct values in the brackets: those of 6 /
``accuracy`` of a group's rows per percentile, or some hundred rows of a smaller group. That each rank lies in its bracket is checked by the counts; were it not so, the query would fail. The
first read can carry plain aggregates along, so that a report needs no read of its own for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.sources.store import stored

#: The sketch keeps some numbers per unit, and brackets hold the less values the larger it is.
ACCURACY = 10_000
#: How much wider brackets are for groups with fewer rows than that, by their number of rows.
WIDER = (1, 10, 100)
_LEAST = -(1 << 63)


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    scale: int = 100,
    digits: int = 4,
    parts: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Interpolated percentiles of ``value`` per group, one output column per entry of ``probs``.

    ``scale`` turns the value into an integer (100 for money with cents). ``parts`` are
    aggregates of the rows whose value is not NULL, taken in the first read, and ``totals``
    aggregates of those per group, which become further columns.
    """
    key = ["_g"] if by else []
    group = [F.struct(*by).alias("_g")] if by else []
    parts, totals = parts or {}, totals or {}
    wanted = sorted(set(probs.values()))
    # Exact up to 15 digits; decimal arithmetic would take several times as long.
    units = F.floor(F.col(value).cast("double") * scale + 0.5)
    rows = df.filter(F.col(value).isNotNull()).select("*", *group, units.alias("_v"))

    # three times the sketch's bound: its own error, and two ranks next to a percentile; wider
    # for fewer rows, so that a bracket always spans three ranks to each side
    edges = [e for w in WIDER for p in wanted for e in (p - 3 * w / accuracy, p + 3 * w / accuracy)]
    own = {
        "_own_n": F.count(F.lit(1)),
        "_own_least": F.min("_v"),
        "_own_most": F.max("_v"),
        "_own_edges": F.percentile_approx("_v", [min(1.0, max(0.0, e)) for e in edges], accuracy),
    }
    taken = [f.alias(n) for n, f in (parts | own).items()]
    kept = [F.first(n).alias(n) for n in own if n not in totals]
    sums = F.struct(*[F.col(n) for n in totals]) if totals else F.lit(None).cast("int")

    def edge(i: int, end: str) -> Column:
        """The i-th edge of the narrowest brackets that these rows allow, or the end of all values."""
        out = F.col(end)
        for k, wider in reversed(list(enumerate(WIDER))):
            at = k * 2 * len(wanted) + i
            if 0 < edges[at] < 1:
                out = F.when(F.col("_own_n") * wider >= accuracy, F.col("_own_edges")[at]).otherwise(out)
            else:
                out = F.when(F.col("_own_n") * wider >= accuracy, F.col(end)).otherwise(out)
        return out

    brackets = [
        F.struct(edge(2 * i, "_own_least").alias("low"), edge(2 * i + 1, "_own_most").alias("high"))
        for i in range(len(wanted))
    ]
    groups = (
        rows.groupBy(*key)
        .agg(*taken)
        .groupBy(*key)
        .agg(*kept, *[f.alias(n) for n, f in totals.items()])
        .select(*[F.col(c).alias("_of") for c in key], "_own_n", sums.alias("_totals"), F.array(*brackets).alias("_brackets"))
    )
    groups = stored(groups, "brackets")  # one row per group, so Spark knows its size

    values = rows.select(*key, "_v")
    if by:
        known = values.join(groups.select("_of", "_brackets"), F.col("_g").eqNullSafe(F.col("_of")))
    else:
        known = values.withColumn("_brackets", groups.select("_brackets").scalar())
    v, held = F.col("_v"), [F.col("_brackets")[i] for i in range(len(wanted))]
    inside = reduce(lambda a, b: a | b, [v.between(b["low"], b["high"]) for b in held])
    before = F.greatest(F.lit(_LEAST), F.lit(_LEAST), *[F.when(b["high"] < v, b["high"]) for b in held])
    # a gap comes after the last value of the bracket before it
    counts = known.groupBy(*key, F.when(inside, v).otherwise(before).alias("_at"), (~inside).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    running = Window.partitionBy(*key).orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_rows").over(running))
    if by:
        counts = counts.join(groups.select("_of", "_own_n"), F.col("_g").eqNullSafe(F.col("_of")))
    else:
        counts = counts.withColumn("_own_n", groups.select("_own_n").scalar())

    outputs, found = [], []
    for i, p in enumerate(wanted):
        rank = F.lit(p) * (F.col("_own_n") - 1)
        part = rank - F.floor(rank)
        for at, weight in ((F.floor(rank), 1 - part), (F.ceil(rank), part)):
            hit = ~F.col("_gap") & (at >= F.col("_upto") - F.col("_rows")) & (at < F.col("_upto"))
            found.append(F.count_if(hit))
            outputs.append(F.sum(F.when(hit, F.col("_at").cast("double") / scale * weight)).alias(f"_{len(outputs)}"))
    hits = reduce(lambda a, b: a + b, found)
    points = counts.groupBy(*key).agg(*outputs, hits.alias("_hits"))
    if by:
        points = points.join(groups.select("_of", "_totals"), F.col("_g").eqNullSafe(F.col("_of")))
    else:
        points = points.withColumn("_totals", groups.select("_totals").scalar())
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    whole = (F.col("_hits") == 2 * len(wanted)) | F.col("_0").isNull() & (F.col("_hits") == 0)
    return points.select(
        *[F.col(f"_g.{c}").alias(c) for c in by],
        *[
            F.when(whole, F.round(F.col(f"_{2 * i}") + F.col(f"_{2 * i + 1}"), digits)).otherwise(lost).alias(name)
            for name, i in ((n, wanted.index(p)) for n, p in probs.items())
        ],
        *[F.col(f"_totals.{n}").alias(n) for n in totals],
    )
