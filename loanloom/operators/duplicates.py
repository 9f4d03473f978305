"""Groups of rows that agree on wide columns, without shuffling those of every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loanloom.sources.store import stored


def repeated(
    df: DataFrame, key: Sequence[str], count: str, hash_of: Callable[..., Column] = F.xxhash64
) -> DataFrame:
    """Values of the key columns that occur more than once, with their number. NULLs agree.

    The rows are counted by an 8-byte hash of the key first, which is all that is shuffled of most rows.
    Only rows whose hash occurs twice are grouped by the key itself, so keys that share a hash
    by chance cost a row of shuffle and never a wrong group. The repeated hashes are stored: Spark knows
    their size when it chooses how to join all rows with them, and sends few to all tasks.
    """
    hashed = df.select(*key, hash_of(*key).alias("_hash"))
    hashes = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    return (
        hashed.join(stored(hashes, "repeated_hashes"), "_hash", "left_semi")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias(count))
        .filter(F.col(count) > 1)
    )
