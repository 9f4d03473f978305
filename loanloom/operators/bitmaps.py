"""Numbers of distinct values that can be merged: values get codes, codes are bits of words.

Plain distinct counts shuffle a row per group and value and can't be added up over years or loads.
Here a dictionary gives each value a code, and a group has one 64-bit word per 64 codes. Words of
the same place are merged by OR: over tasks before the shuffle, over years, and over loads. Spark sums up
longs in its hash aggregate; ``bitmap_construct_agg`` has a binary buffer, for which every row is sorted.
Frequent values come first in the dictionary, so that the words of most groups are well filled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from loanloom.functions.metrics import per_value
from loanloom.operators.numbering import numbered
from loanloom.sources.store import stored

WORD = 64


def dictionary(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Codes (columns of, value, code) for the values: columns of (their kind), value and n.

    Codes start at 0, with the values of the largest n. A value in ``known``, an earlier dictionary,
    keeps its code, and new ones go on from there. NULL gets no code. Each value must come once.
    """
    new, first = values.filter("value IS NOT NULL"), F.lit(0)
    if known is not None:
        new = new.join(known, ["of", "value"], "left_anti")
        first = known.agg(F.coalesce(F.max("code") + 1, F.lit(0))).scalar()
    new = stored(new.select("of", "value", (-F.col("n")).alias("_last")), "new_values")
    placed = numbered(new, ["_last", "of", "value"], "_place")
    coded = placed.select("of", "value", (F.col("_place") - 1 + first).cast("bigint").alias("code"))
    return coded if known is None else known.select("of", "value", "code").unionByName(coded)


def value_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """What ``dictionary`` takes: the values of some columns (kind: column), with their rows."""
    rows = per_value(df, dict(columns), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("side").alias("of"), "value", "n")


def words(
    df: DataFrame,
    columns: Mapping[str, str],
    codes: DataFrame,
    sides: Mapping[str, str],
    total: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The values of ``columns`` (kind: column) that occur in each group, as bits.

    Groups are the values of each column of ``sides`` on its own (and of ``by``), and all rows if
    ``total`` names them. Columns: those of ``by``, side, value, of, word, bits. One scan; the dictionary is joined
    once per column, and should be a stored table, so that Spark knows whether it is small.
    """
    coded, entries = df, []
    for i, (kind, column) in enumerate(columns.items()):
        own = codes.filter(F.col("of") == kind).select(
            F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")
        )
        coded = coded.join(own, F.col(column).cast("string") == F.col(f"_value{i}"), "left")
        entries.append(F.struct(F.lit(kind).alias("of"), F.col(f"_code{i}").alias("_code")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("_code", F.lit(WORD)).cast("int"))
    rows = (
        coded.select(*dict.fromkeys([*by, *sides.values()]), F.inline(F.array(*entries)))
        .filter("_code IS NOT NULL")
        .withColumn("word", F.floor(F.col("_code") / WORD))
        .withColumn("_bit", bit)
    )
    return per_value(rows, dict(sides), F.bit_or("_bit").alias("bits"), total=total, by=[*by, "of", "word"])


def merged(parts: DataFrame, by: Sequence[str] = ("side", "value")) -> DataFrame:
    """Words of the same group and place, from several loads or finer groups, as one."""
    return parts.groupBy(*by, "of", "word").agg(F.bit_or("bits").alias("bits"))


def distinct_counts(parts: DataFrame, kinds: Sequence[str], by: Sequence[str] = ("side", "value")) -> DataFrame:
    """Distinct values per group, a column per kind. ``parts``: words, each place once per group."""
    bits = F.bit_count("bits")
    return parts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("of") == kind, bits)), F.lit(0)).alias(kind) for kind in kinds]
    )
