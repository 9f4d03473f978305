"""Documents that hold passages of a benchmark.

Words are lower-cased and free of ASCII punctuation; shingles are runs of five words (a shorter
item is one shingle). A document leaks an item if one of its windows, as long as the item, has a
weighted Jaccard similarity of `least` or more with it, repeats of a shingle counted; a document
shorter than the item is one window.

Every place of every text is looked at, but most windows are ruled out exactly: two bags of m
and n shingles can only be that similar if they share least * (m + n) / (1 + least) of them, so
a window with fewer places whose shingle occurs in any item is none. The others get a 64-bit
SimHash. A multi-index has the items' fingerprints in 8 blocks of 8 bits: two fingerprints at a
distance of RADIUS = 23 or less differ in at most 2 bits of one block. Each item is listed under
all values within 2 bits of its own, so one look per block finds all items within the radius.
What it finds is compared shingle by shingle.
A similarity of 0.8 makes about 10 of the 64 bits differ; 23 is over four deviations from that.

The benchmark is a query set; it goes to the tasks in blocks of bounded size, one pass over the
documents for each. Null and empty texts, and items without words, match nothing. Repeated items
are all reported, repeated rows alike; null ids stay null. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import RunHashes, id_and_text, map_texts, pieces

SHINGLE = 5
RADIUS = 23
BLOCK_BYTES = 4 << 20
KEPT_WINDOWS = 50_000
_SIEVE = 1 << 22
#: ASCII punctuation, controls and spaces part words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_NEAR = [
    [v for v in range(256) if (u ^ v).bit_count() <= RADIUS // 8] for u in range(256)
]
_NEAR = np.array(_NEAR)
#: Pairs of a window and an item whose fingerprints are compared at once.
_PAIRS = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


def _shingles(words: list[bytes]) -> list[bytes]:
    k = min(SHINGLE, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    shared = sum((a & b).values())
    return shared / max(1, a.total() + b.total() - shared)


def _simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > hashes.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0]


class ItemIndex:
    """Fingerprints of items by length, in blocks."""

    def __init__(self, items: list[tuple[int | None, str]], least: float):
        self.least = least
        self.ids, self.bags, prints, self.sizes = [], [], [], []
        known: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            n, k = len(words), min(SHINGLE, len(words))
            start = np.arange(n - k + 1)
            hashes = RunHashes(words).hash(start, start + k)
            known.setdefault(k, []).append(hashes)
            self.ids.append(item)
            self.sizes.append(n)
            self.bags.append(Counter(_shingles(words)))
            prints.append(int(_simhash(hashes[None, :])[0]))
        self.prints = np.array(prints, np.uint64)
        self.lengths = sorted(set(self.sizes))
        self._index()
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.sieves = {}
        for k, hashes in self.known.items():
            self.sieves[k] = np.zeros(_SIEVE, bool)
            self.sieves[k][(hashes & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
        self.seen: dict[bytes, list[tuple[int, float]]] = {}

    def hits(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Whether each hash is that of a k-word shingle of any item."""
        found = self.sieves[k][(hashes & np.uint64(_SIEVE - 1)).astype(np.int64)]
        at = np.flatnonzero(found)
        found[at] = np.isin(hashes[at], self.known[k])
        return found

    def _index(self) -> None:
        """Lists of items by (length, block, value), each item under all values near its own."""
        place = np.searchsorted(self.lengths, self.sizes)
        values = self.prints.view(np.uint8).reshape(-1, 8)
        lists = (place[:, None] * 8 + np.arange(8)) * 256
        lists = (lists[:, :, None] + _NEAR[values]).reshape(len(values), 8 * _NEAR.shape[1])
        order = np.argsort(lists.ravel(), kind="stable")
        self.members = (order // max(1, lists.shape[1])).astype(np.int32)
        counts = np.bincount(lists.ravel(), minlength=len(self.lengths) * 2048)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window (its place in prints) and an item of n words within the radius."""
        first = self.lengths.index(n) * 2048
        lists = first + 256 * np.arange(8) + prints.view(np.uint8).reshape(-1, 8)
        counts = (self.ends - self.starts)[lists]
        each = np.cumsum(counts.sum(axis=1))
        found = []
        a = 0
        while a < len(prints):
            b = max(a + 1, int(np.searchsorted(each, (each[a - 1] if a else 0) + _PAIRS, "right")))
            some = counts[a:b].ravel()
            inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            item = self.members[np.repeat(self.starts[lists[a:b]].ravel(), some) + inner]
            window = np.repeat(np.arange(a, b), counts[a:b].sum(axis=1))
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            # a pair is found once for each block that is near
            found.append(np.unique(window[close] * len(self.ids) + item[close]))
            a = b
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def matches(self, n: int, near: list[int], words: list[bytes]) -> list[tuple[int, float]]:
        """Those of the items near a window, of n words each, that it matches, with the similarity."""
        key = b"%d " % n + b" ".join(words)
        if key not in self.seen:
            bag = Counter(_shingles(words))
            alike = [(i, similarity(self.bags[i], bag)) for i in near]
            if len(self.seen) >= KEPT_WINDOWS:
                self.seen.clear()
            self.seen[key] = [(i, s) for i, s in alike if s >= self.least]
        return self.seen[key]

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, int]]]:
        """For each text: item place -> best similarity and first word of the best window."""
        out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        parts = [words_of(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        words = [w for p in parts for w in p]
        if not words or not self.ids:
            return out
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        document = np.repeat(np.arange(len(parts)), sizes)
        runs = RunHashes(words)
        prepared = {}
        for k in self.known:
            start = np.arange(max(0, len(words) - k + 1))
            start = start[document[start] == document[start + k - 1]] if len(start) else start
            hashes = np.zeros(len(words), np.uint64)
            hashes[start] = runs.hash(start, start + k)
            hit = np.zeros(len(words), bool)
            hit[start] = self.hits(hashes[start], k)
            if hit.any():
                prepared[k] = hashes, np.concatenate([[0], np.cumsum(hit)]), np.flatnonzero(hit)
        for n in self.lengths:
            k = min(SHINGLE, n)
            if k not in prepared:
                continue
            hashes, count, places = prepared[k]
            whole = self._crowded(places, n - k + 1, len(words) - n)
            whole = whole[document[whole] == document[whole + n - 1]] if len(whole) else whole
            self._verify(n, n - k + 1, whole, n, hashes, words, document, begin, out)
            for size in np.unique(sizes[(sizes < n) & (sizes >= k)]):
                m = int(size) - k + 1
                short = begin[sizes == size]
                short = short[count[short + m] - count[short] >= self._needed(m, n - k + 1)]
                self._verify(n, m, short, int(size), hashes, words, document, begin, out)
        return out

    def _crowded(self, places: np.ndarray, m: int, last: int) -> np.ndarray:
        """Starts up to `last` of runs of m shingles with enough hits; places: the hits, in order."""
        need = math.ceil(self._needed(m, m))
        if len(places) < need or last < 0:
            return np.zeros(0, np.int64)
        # runs that hold `need` hits in a row start within a range; ranges rise, so overlaps are cut
        low = np.maximum(places[need - 1 :] - (m - 1), 0)
        high = np.minimum(places[: len(places) - need + 1], last)
        low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(np.where(low <= high, high, -1))[:-1] + 1]))
        size = np.maximum(high - low + 1, 0)
        return np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)

    def _needed(self, m: int, n: int) -> float:
        return self.least * (m + n) / (1 + self.least) - 1e-9

    def _verify(self, n, m, start, size, hashes, words, document, begin, out) -> None:
        step = max(1, 1_000_000 // m)
        for i in range(0, len(start), step):
            some = start[i : i + step]
            prints = _simhash(hashes[some[:, None] + np.arange(m)])
            window, item = self.near(n, prints)
            edges = np.flatnonzero(np.diff(window, prepend=-1, append=-1)).tolist()
            for a, b in pairwise(edges):
                s = int(some[window[a]])
                best = out[document[s]]
                for j, alike in self.matches(n, item[a:b].tolist(), words[s : s + size]):
                    if j not in best or alike > best[j][0]:
                        best[j] = alike, s - int(begin[document[s]])


def _blocks(benchmark: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """The query set in blocks of about BLOCK_BYTES of text."""
    block, held = [], 0
    for row in id_and_text(benchmark, item_key, text).toLocalIterator():
        if block and held + len(row[1]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block:
        yield block


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """One row for each document and item of which it holds a passage: key, item_id, similarity,
    start (word of the best window, the first of equals)."""
    schema = f"{key} long, hits array<struct<item:long,similarity:double,start:long>>"

    def one(block):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def make():
            index = ItemIndex(held.value, least)

            def step(keys, texts):
                found = index.search(texts)
                some = [i for i, f in enumerate(found) if f]
                hits = [
                    [{"item": index.ids[j], "similarity": s, "start": at} for j, (s, at) in sorted(found[i].items())]
                    for i in some
                ]
                return [keys[i] for i in some], hits

            return step

        return map_texts(id_and_text(docs, key, text), make, schema)

    parts = [one(block) for block in _blocks(benchmark, item_key, text)]
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], schema)]
    found = reduce(DataFrame.union, parts).select(key, F.explode("hits").alias("hit"))
    return found.select(
        key, F.col("hit.item").alias("item_id"), "hit.similarity", "hit.start"
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """The documents, all columns as they are, that hold no passage of the benchmark."""
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item_key, text):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(held.value, least)
            for batch in batches:
                for piece in pieces(batch, at):
                    found = index.search([t or "" for t in piece.column(at).to_pylist()])
                    yield piece.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
