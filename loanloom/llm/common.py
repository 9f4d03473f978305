"""Helpers that several operators share: reading tables, walking Arrow batches, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once within a task; an Arrow batch is cut into pieces of about this size.
PIECE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the whole text (null: empty); further columns, whatever their names, go."""
    return df.select(
        F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text)
    )


def bucket_of(key: str | Column, n: int) -> Column:
    """crc32 of a key written as text, modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(key.cast("string").cast("binary")) % n).cast("int")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of the frame has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batch: pa.RecordBatch, text: int = 1, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about `most` bytes of the given text column."""
    sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + (size or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow over (key, text) rows.

    make() is called once in each task and gives a function from the lists of keys and texts
    to a tuple of columns (lists or Arrow arrays) in the order of the schema.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in pieces(batch):
                keys, texts = (c.to_pylist() for c in piece.columns[:2])
                columns = step(keys, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                        for c, f in zip(columns, arrow, strict=True)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    return tuple(
        np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)]).cumprod(dtype=np.uint64)
        for m in (_MULTIPLIER, _INVERSE)
    )


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of MurmurHash3; fixed values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RunHashes:
    """64-bit hashes of any runs of a list of words, from sums over its beginnings."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        power, self.inverse = _powers(n)
        sums = (hashes * power[:n]).cumsum(dtype=np.uint64)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), sums])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(_INVERSE))


#: Resolution of hash thresholds.
_GRAINS = 1 << 40


def balanced_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Keys and labels of about per_class rows of each label, chosen by a hash of the key.

    The expected number is exact and the spread that of coin tosses, so the result is bounded by
    the number of labels. Rows with a null key or label are left out.
    """
    usable = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    if not counts:
        return usable
    share = F.create_map(
        *[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_class / n) * _GRAINS))]
    )
    return usable.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_GRAINS)) < share[F.col(label)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
