"""Resampling towards a target distribution, by importance weights of hashed n-grams.

Words are lower-cased (A-Z) runs of ASCII letters, digits and all that is not ASCII; features are
runs of 1 to 3 words joined by one space, and fall into buckets by crc32. A bucket's gain is the
logarithm of how much likelier it is in the target than in the corpus, with one added to each
bucket, in thousandths. A document's weight is the sum of its features' gains; Gumbel noise drawn
from its id makes the highest scores a sample without replacement by weight.

Checksums of n-grams are put together from those of the words: the one of "a b" is the one of
"a" carried over as many zero bytes as " b" has, with the one of " b". That is linear over bits, so
four table look-ups per word do it for whole arrays, and no n-gram is ever written out. Each
text is read twice, for the counts of the corpus and for its weight; the counts of a task are an array of as many
numbers as there are buckets, which are also all that goes through the driver.

Ranks come from a radix sort over (score, id), see ``radix``.

Null texts have no words, weigh 0 and are not drawn, like any text with less than `least_words`. Null
ids draw noise as an empty id and come after all others in ties; equal rows may change places. Empty
tables, also of the target, give defined gains by the one that is added. Other columns go.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import id_and_text, map_texts, pieces
from loanloom.llm.radix import ranked
from loanloom.sources.store import stored

BUCKETS = 10_000
#: Longest word (with its space) whose zero bytes have a table of their own.
TABLED = 64
#: Bytes of words whose checksums a task keeps.
KEPT_BYTES = 32 << 20
#: Words of the longest feature.
RUN = 3

#: ASCII but digits and letters parts words; capitals become small.
_FOLD = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def _zero_tables() -> np.ndarray:
    """[n, i, b]: what byte i of a checksum with value b becomes after n zero bytes."""
    ones = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    by_byte = ones ^ ones[0]  # the classic table of one byte
    tables = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for i in range(4):
        tables[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(TABLED):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ by_byte[tables[n] & np.uint32(255)]
    return tables


_ZEROS = _zero_tables()


def _carried(checksums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after n zero bytes each, n up to TABLED."""
    parts = (_ZEROS[n, i, checksums >> np.uint32(8 * i) & np.uint32(255)] for i in range(4))
    a, b, c, d = parts
    return a ^ b ^ c ^ d


def _joined(left: np.ndarray, spaced: np.ndarray, size: np.ndarray, words: list[bytes], first: int) -> np.ndarray:
    """Checksums of runs with a space and one more word; words[first + i] is the i-th one added."""
    out = _carried(left, np.minimum(size, TABLED)) ^ spaced
    for i in np.flatnonzero(size > TABLED).tolist():
        out[i] = zlib.crc32(words[first + i], zlib.crc32(b" ", int(left[i])))
    return out


class Features:
    """Buckets of the features of texts; keeps checksums of the words it has seen."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, 3), np.uint32)
        self.held = 0

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """For each word: its checksum, that of a space and it, and the bytes of both."""
        if self.held > KEPT_BYTES:
            self._clear()
        number = self.number
        for w in set(words).difference(number):
            i = number[w] = len(number)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1
            self.held += len(w) + 100
        return self.table[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text; and for 1, 2, 3 words the buckets of all runs, with their number per text."""
        parts = [t.translate(_FOLD).split() for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        words = [w for p in parts for w in p]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        known = self._sums(words)
        spaced, size = known[:, 1], known[:, 2].astype(np.int64)
        runs, found = known[:, 0], []
        for n in range(RUN):
            if n:
                runs = _joined(runs[:-1], spaced[n:], size[n:], words, n)
            whole = owner[n:] == owner[: len(owner) - n]
            buckets = (runs[whole] % np.uint32(self.buckets)).astype(np.int64)
            found.append((buckets, np.maximum(counts - n, 0)))
        return counts, found


def _raw(df: DataFrame, key: str, text: str) -> DataFrame:
    return id_and_text(df, key, text).withColumn(text, F.col(text).cast("binary"))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: one number per bucket and task, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch):
                for found, _ in features.of(piece.column(1).to_pylist())[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    sums = _raw(df, key, text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in sums.collect():  # at most `buckets` rows
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over corpus, one added to each bucket."""
    n = len(corpus)
    s, t = float(corpus.sum() + n), float(target.sum() + n)
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in pairs], np.int64)


def noise(key: int | None, seed: int = 42) -> int:
    """Gumbel noise of an id, in thousandths."""
    name = f"{seed}:{'' if key is None else key}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, n_words, n_features, weight and score of each document."""

    def make():
        features = Features(len(gain))

        def step(keys, texts):
            words, runs = features.of(texts)
            number, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for bucket, counts in runs:
                sums, ends = np.concatenate([[0], np.cumsum(gain[bucket])]), np.cumsum(counts)
                number += counts
                weight += sums[ends] - sums[ends - counts]
            score = weight + np.array([noise(k, seed) for k in keys], np.int64)
            return keys, *map(pa.array, (words, number, weight, score))

        return step

    schema = f"{key} long, n_words long, n_features long, weight long, score long"
    return map_texts(_raw(docs, key, text), make, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    target_key: str = "item_id",
) -> DataFrame:
    """Id, n_features, weight, score and rank of each document; rank is null for those not drawn.

    Of the documents with `least_words` or more, `percent` of 100 (rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, buckets, key, text), bucket_counts(target, buckets, target_key, text))
    rows = stored(scored(docs, gain, seed, key, text).toDF("id", "n_words", "n_features", "weight", "score"), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    # least first: from the highest score down, then from the least id up
    able = (
        able.withColumn("falling", F.bitwise_not("score"))
        .withColumn("missing", F.col("id").isNull().cast("long"))
        .withColumn("known", F.coalesce("id", F.lit(0)))
    )
    able = ranked(able, ("falling", "missing", "known"))
    drawn = able.count() * percent // 100
    columns = ("id", "n_features", "weight", "score")
    chosen = able.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    short = rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return chosen.union(short).withColumnRenamed("id", key)
