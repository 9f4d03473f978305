"""Mixing of sources by weights that change over the training.

A source's schedule is its weight over training time 0 to 1, straight lines between points. Its
integral is the source's weight: the sources share the words of all documents by weight, but
a source gives at most `cap` times its words, and what is above goes to the others by weight.

The demand for words of a source up to time t is its target times the part of the integral up
to t. A source is read in passes, each in the same order of hashes. A copy of a document begins
where its source's cumulative words stand then; the time at which the demand reaches that number
(the inverse of the integral, in closed form per line) is its training position. Copies that
begin before the target are taken; the one that the target falls into is cut there, so that the
words taken are those wanted, to the word. Sorting by position, in ranges, gives the order.

The plan has one row for each source. Cumulative words come from sums over runs of at most RUN
documents of the sorted table, so a source with a third of all rows is many runs; texts are read
once, for their sizes, and nothing else of them is shuffled.

Null texts have no words, null is a source of its own (the last), null ids come last in the
order of equal hashes, and empty documents are never taken. Repeated rows count each; rows that are
equal in id and size may change places. Empty tables give an empty result. The input's other
columns go. Results depend on neither the order nor the split of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.numbering import numbered
from loanloom.sources.store import stored

#: Points (time, weight) of a schedule; times go from 0 to 1.
Schedule = Sequence[tuple[float, float]]
#: Documents that are summed in one go.
RUN = 1 << 11
_BLANK = " \t\n\x0b\x0c\r"


def integrals(schedule: Schedule) -> list[float]:
    """The integral up to each point of a schedule."""
    times, weights = zip(*schedule, strict=True)
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("the times of a schedule rise from 0 to 1")
    sums = [0.0]
    for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False):
        sums.append(sums[-1] + (b - a) * (v + w) / 2)
    if min(weights) < 0 or sums[-1] <= 0:
        raise ValueError("weights are not negative, and not all zero")
    return sums


def time_of(part: Column, schedule: Schedule) -> Column:
    """When the integral reaches a part (0 to 1) of its whole."""
    sums = integrals(schedule)
    whole = part * F.lit(sums[-1])
    at = F.lit(1.0)
    for i in reversed(range(len(sums) - 1)):
        (a, v), (b, w) = schedule[i], schedule[i + 1]
        if sums[i] == sums[i + 1]:
            continue
        # v x + (w - v) x^2 / (2 (b - a)) = y, solved for x without a difference of near numbers
        y = whole - F.lit(sums[i])
        root = F.sqrt(F.lit(float(v * v)) + F.lit(2.0 * (w - v) / (b - a)) * y)
        # the start of a line that begins at weight 0
        x = F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (F.lit(float(v)) + root))
        line = F.lit(float(a)) + x
        at = F.when(whole < F.lit(sums[i + 1]), line).otherwise(at)
    return at


def words_in(text: str | Column) -> Column:
    """Number of words between ASCII white space, one character kept for each."""
    text = F.col(text) if isinstance(text, str) else text
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.length(F.ltrim(ones, F.lit(_BLANK))).cast("long")


def _sized(docs: DataFrame, seed: int, key: str, source: str, text: str) -> DataFrame:
    """Columns id, source, size, draw: all that is needed of a document."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")))
    return docs.select(
        F.col(key).cast("long").alias("id"),
        F.col(source).cast("string").alias("source"),
        words_in(text).alias("size"),
        F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long").alias("draw"),
    )


def _plan(sized: DataFrame, schedules: Sequence[Schedule], cap: int) -> DataFrame:
    """One row for each source: source, kind (its schedule), source_size, target.

    If all sources gave `cap` times their words up to this one's ratio of words to weight, and the
    others by weight at that ratio, and it were still not enough, the source gives all it can.
    """
    weights = [integrals(s)[-1] for s in schedules]
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("kind") + 1).cast("int"))
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("kind", number % len(schedules))
        .withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    )
    whole = Window.partitionBy()
    upto = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    all_words = F.sum("source_size").over(whole).cast("double")
    rest = F.sum("weight").over(whole) - F.sum("weight").over(upto)
    full = F.col("weight") * F.sum("most").over(upto) + F.col("most") * rest < all_words * F.col("weight")
    return (
        sources.withColumn("full", full)
        .withColumn("words", all_words)
        .withColumn("left", F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
        .select(
            "source",
            "kind",
            "source_size",
            F.when(F.col("full"), F.col("most"))
            .otherwise(F.least("most", F.col("left") * F.col("weight") / F.col("open")))
            .alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule],
    cap: int = 3,
    seed: int = 42,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, taken, times.

    Sources in the order of code points, null last, get the schedules in turn. taken: words that
    the mix takes of the document, each copy counted; times: training positions of its copies.
    """
    rows = stored(_sized(docs, seed, key, source, text), "sized")
    plan = stored(_plan(rows, schedules, cap), "mix_plan")
    known = rows.withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    known = known.withColumn("nothing", F.col("source").isNull())
    placed = stored(
        numbered(known, ("nothing", "source", "draw", "id", "size"), "nth").withColumn(
            "run", F.floor(F.col("nth") / RUN)
        ),
        "mix_order",
    )

    # (source, run) tells rows of a null source apart as well: it is the last, flagged one
    group = ("nothing", F.coalesce("source", F.lit("")).alias("name"), "run")
    earlier = Window.partitionBy("nothing", "name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*group)
        .agg(F.sum("size").alias("words"))
        .select(*("nothing", "name", "run"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    )
    inner = Window.partitionBy("nothing", "name", "run").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("name", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(starts, ["nothing", "name", "run"])

    demand = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(demand / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rows = rows.withColumn("before", F.col("before") + F.col("start")).withColumn("passes", passes.cast("long"))
    over = demand - F.col("passes") * F.col("source_size") - F.col("before")
    over = F.greatest(F.lit(0), F.least(F.col("size"), over)).cast("long")
    rows = rows.withColumn("over", F.when(F.col("size") > 0, over).otherwise(F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("over") > 0, 1).otherwise(0)).otherwise(0)

    def time(copy: Column) -> Column:
        part = (copy * F.col("source_size") + F.col("before")).cast("double") / F.col("target")
        at = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            at = F.when(F.col("kind") == i, time_of(part, schedule)).otherwise(at)
        return at

    listed = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), time))
    return rows.select(
        F.col("id").alias(key),
        F.col("source"),
        F.col("size"),
        F.col("source_size"),
        F.col("target"),
        (F.col("passes") * F.col("size") + F.col("over")).alias("taken"),
        F.coalesce(listed, F.array().cast("array<double>")).alias("times"),
    )


def training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each copy that ``mix`` takes, range-sorted by position.

    copy counts from 0; words: how many of the copy are taken, all but in a source's last one.
    """
    copies = mixed.select(key, "source", "size", "taken", F.posexplode("times").alias("copy", "position"))
    words = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    ties = (F.col("source").asc_nulls_last(), F.col(key).asc_nulls_last(), "copy")
    return copies.select(key, "source", "copy", words.alias("words"), "position").orderBy("position", *ties)
