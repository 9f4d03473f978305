"""Repeated passages found by compacting a graph of word windows.

A window of `length` consecutive words is an edge of a De Bruijn graph. Its anchor is the k-word
run in it with the least hash, the leftmost of equals. Consecutive windows with the same anchor
make a path without branches; a document is a chain of such paths, and one row stands for all
windows of a path (about one row for every eight words). Equal windows have the same anchor at
the same place in them, so whatever repeats can be found per anchor:

1. Anchors that occur once are dropped (counted before anything else is shuffled).
2. Equal paths compact to one variant with the coordinates of its first occurrence: a join of
   paths and variants marks all windows of every later occurrence.
3. Where an anchor has several variants the paths branch: the first occurrences of those are
   cut into windows again, from the text at their coordinates, and the earliest coordinate of
   each window decides.

Variants and windows are compared by a 64-bit hash of all their words together with the 64-bit
hash of the anchor. Words that a marked window covers are removed. Coordinates are
(document id, tie, place): the tie is 0, and a hash of the text if ids are not unique, so rows
that repeat an id with another text are told apart, and rows that are equal in both count as one
document and get the same result. A null id counts as the smallest. Null, empty and short texts
have no windows and lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import RunHashes, free_names, pieces
from loanloom.sources.store import stored

#: Words of an anchor.
ANCHOR = 6
#: Text whose paths are built at once; arrays over its words take some 25 times as much.
PIECE = 2 << 20
NULL_ID = -(1 << 63)


class Paths:
    """The paths of some documents, given as lists of words."""

    def __init__(self, documents: list[list[bytes]], length: int):
        self.length = length
        sizes = np.array([len(d) if len(d) >= length else 0 for d in documents], np.int64)
        words = [w for d in documents if len(d) >= length for w in d]
        n = len(words)
        self.hash = RunHashes(words).hash
        self.first_word = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        width = length - ANCHOR + 1
        if n < length:
            self.start = self.windows = self.document = np.zeros(0, np.int64)
            self.anchor = self.span = np.zeros(0, np.uint64)
            return
        places = np.arange(n - ANCHOR + 1)
        runs = self.hash(places, places + ANCHOR)
        views = np.lib.stride_tricks.sliding_window_view(runs, width)
        # in parts, since argmin copies what it looks at: 15 numbers for each word
        least = np.concatenate([views[i : i + 65536].argmin(axis=1) for i in range(0, len(views), 65536)])
        document = np.repeat(np.arange(len(documents)), sizes)
        starts = np.arange(n - length + 1)
        starts = starts[document[starts] == document[starts + length - 1]]
        at = starts + least[starts]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        self.start = starts[cut]
        self.windows = np.diff(np.append(cut, len(starts)))
        self.document = document[self.start]
        self.anchor = runs[at[cut]]
        self.span = self.hash(self.start, self.start + self.windows + length - 1)

    def places(self) -> np.ndarray:
        """Start in its document and number of windows less one, in one number."""
        return (self.start - self.first_word[self.document]) * 256 + self.windows - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(docs: DataFrame, make_batch, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2, PIECE):
                yield from make_batch(piece)

    return docs.mapInArrow(run, schema)


def _words(texts: list[str]) -> list[list[bytes]]:
    return [t.encode("utf-8", "surrogatepass").split() for t in texts]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns doc, tie, text."""
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"))
    unique = ids.groupBy("doc").count().where("count > 1").isEmpty()
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"),
        (F.lit(0).cast("long") if unique else F.xxhash64(whole)).alias("tie"),
        whole.alias("text"),
    )


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, so a shuffle of all documents is small."""

    def pack(piece):
        tool = zstandard.ZstdCompressor(level=3)
        raw = [tool.compress(t.encode("utf-8", "surrogatepass")) for t in piece.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array(raw, pa.binary())], names=["doc", "tie", "packed"]
        )

    return _rows(docs, pack, "doc long, tie long, packed binary")


def _unpacked(packed: list[bytes]) -> list[list[bytes]]:
    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(p).split() for p in packed]


def repeated_spans(keyed: DataFrame, length: int) -> DataFrame:
    """Per document (doc, tie): spans, the marked runs of words as start * 256 + words - 1."""

    def anchors(piece):
        found = Paths(_words(piece.column(2).to_pylist()), length)
        yield pa.RecordBatch.from_arrays([_signed(found.anchor)], names=["anchor"])

    def paths(piece):
        found = Paths(_words(piece.column(2).to_pylist()), length)
        pick = pa.array(found.document)
        yield pa.RecordBatch.from_arrays(
            [
                _signed(found.anchor),
                _signed(found.span),
                piece.column(0).take(pick),
                piece.column(1).take(pick),
                pa.array(found.places()),
            ],
            names=["anchor", "span", "doc", "tie", "at"],
        )

    repeated = stored(
        _rows(keyed, anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"),
        "repeated_anchors",
    )
    path = "anchor long, span long, doc long, tie long, at long"
    rows = stored(_rows(keyed, paths, path).join(repeated, "anchor", "left_semi"), "repeated_paths")

    variants = stored(
        rows.groupBy("anchor", "span").agg(
            F.min(F.struct("doc", "tie", "at")).alias("first"), F.count("*").alias("n")
        ),
        "variants",
    )
    later = (
        rows.join(variants.where("n > 1").select("anchor", "span", "first"), ["anchor", "span"])
        .where(F.struct("doc", "tie", "at") != F.col("first"))
        .select("doc", "tie", (F.col("at") + (length - 1)).alias("span"))
    )

    branching = variants.groupBy("anchor").count().where("count > 1").select("anchor")
    cut_open = (
        variants.join(branching, "anchor", "left_semi")
        .select("first.*")
        .groupBy("doc", "tie")
        .agg(F.collect_list("at").alias("paths"))
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2, PIECE // 4):
                found = Paths(_unpacked(piece.column(2).to_pylist()), length)
                chosen, base = piece.column(3), found.places()
                wanted = np.zeros(len(base), bool)
                bounds = np.searchsorted(found.document, np.arange(piece.num_rows + 1))
                for i in range(piece.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    wanted[a:b] = np.isin(base[a:b], chosen[i].values.to_numpy())
                counts = found.windows[wanted]
                which = np.repeat(np.flatnonzero(wanted), counts)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = found.start[which] + inner
                pick = pa.array(found.document[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(found.anchor[which]),
                        _signed(found.hash(start, start + length)),
                        piece.column(0).take(pick),
                        piece.column(1).take(pick),
                        pa.array(start - found.first_word[found.document[which]]),
                    ],
                    names=["anchor", "window", "doc", "tie", "start"],
                )

    cut = stored(
        _packed(keyed)
        .join(cut_open, ["doc", "tie"])
        .select("doc", "tie", "packed", "paths")
        .mapInArrow(windows, "anchor long, window long, doc long, tie long, start long"),
        "windows",
    )
    firsts = cut.groupBy("anchor", "window").agg(
        F.min(F.struct("doc", "tie", "start")).alias("first"), F.count("*").alias("n")
    )
    repeats = (
        cut.join(firsts.where("n > 1").select("anchor", "window", "first"), ["anchor", "window"])
        .where(F.struct("doc", "tie", "start") != F.col("first"))
        .select("doc", "tie", (F.col("start") * 256 + (length - 1)).alias("span"))
    )
    return stored(
        later.union(repeats).groupBy("doc", "tie").agg(F.collect_set("span").alias("spans")), "spans"
    )


OUTPUTS = {
    "n_words": "long",
    "n_removed": "long",
    "kept_sha256": "string",
    "kept": "string",
    "removed": "array<struct<start:int,end:int>>",
}


def drop_repeats(
    docs: DataFrame,
    length: int = 20,
    outputs: tuple[str, ...] = tuple(OUTPUTS),
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Remove what repeats from whole texts; one row for each input row.

    kept: the words left, joined by one space; removed: runs of removed words, by place.
    """
    if not ANCHOR < length <= 100:
        raise ValueError(f"windows have {ANCHOR + 1} to 100 words")
    keyed = _keyed(docs, key, text)
    spans = repeated_spans(keyed, length)
    kinds = {o: OUTPUTS[o] for o in outputs}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                columns: dict[str, list] = {o: [] for o in kinds}
                for words, marked in zip(_unpacked(piece.column(1).to_pylist()), piece.column(2), strict=True):
                    gone, left = np.zeros(len(words), bool), words
                    if marked.is_valid:
                        gone = _gone(len(words), marked.values.to_numpy())
                        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    joined = b" ".join(left)
                    if "n_words" in columns:
                        columns["n_words"].append(len(words))
                    if "n_removed" in columns:
                        columns["n_removed"].append(len(words) - len(left))
                    if "kept_sha256" in columns:
                        columns["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                    if "kept" in columns:
                        columns["kept"].append(joined.decode("utf-8", "surrogatepass"))
                    if "removed" in columns:
                        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                        runs = zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)
                        columns["removed"].append([{"start": int(a), "end": int(b)} for a, b in runs])
                arrays = [pa.array(v, _ARROW[o]) for o, v in columns.items()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *arrays], names=[key, *columns])

    rows = _packed(keyed).join(spans, ["doc", "tie"], "left").select("doc", "packed", "spans")
    schema = ", ".join([f"{key} long", *(f"{o} {k}" for o, k in kinds.items())])
    result = rows.mapInArrow(apply, schema)
    return result.withColumn(key, F.when(F.col(key) != NULL_ID, F.col(key)))


def without_repeats(
    docs: DataFrame,
    length: int = 20,
    key: str = "doc_id",
    text: str = "text",
    chars: str | None = "n_chars",
) -> DataFrame:
    """The rows with all their columns, repeats removed from the text.

    Texts that lose nothing stay as they are; of others the words left are joined by one space,
    which may leave an empty text. A column of the number of characters follows.
    """
    keyed = _keyed(docs, key, text)
    doc, tie, marks = free_names(docs, "doc", "tie", "spans")
    spans = repeated_spans(keyed, length).toDF(doc, tie, marks)
    unique = keyed.where("tie <> 0").isEmpty()
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "*",
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias(doc),
        (F.lit(0).cast("long") if unique else F.xxhash64(whole)).alias(tie),
    ).join(spans, [doc, tie], "left")
    at = docs.columns.index(text)
    columns = [c for c in docs.columns]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                texts = piece.column(at).to_pylist()
                for i, marked in enumerate(piece.column(len(columns))):
                    if marked.is_valid:
                        words = texts[i].encode("utf-8", "surrogatepass").split()
                        gone = _gone(len(words), marked.values.to_numpy())
                        left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                        texts[i] = left.decode("utf-8", "surrogatepass")
                arrays = [*piece.columns[: len(columns)]]
                arrays[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    result = rows.select(*columns, marks).mapInArrow(clean, docs.schema)
    if chars in columns:
        counted = F.when(F.col(chars).isNotNull(), F.length(text))
        result = result.withColumn(chars, counted.cast(docs.schema[chars].dataType))
    return result


def _gone(n: int, spans: np.ndarray) -> np.ndarray:
    """For each of n words whether a span covers it."""
    start, size = spans >> 8, (spans & 255) + 1
    delta = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return (np.cumsum(delta) > 0)[:n]


_ARROW = {
    "n_words": pa.int64(),
    "n_removed": pa.int64(),
    "kept_sha256": pa.string(),
    "kept": pa.string(),
    "removed": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}
