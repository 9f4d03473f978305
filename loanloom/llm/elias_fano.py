"""Token ids in binary files, with document boundaries in Elias-Fano coding.

Documents are sorted by id over all files; a file holds one range of them, at most FILE_DOCS
documents and about FILE_IDS ids, so neither its writer nor its reader grows with the table:

    "EFT1" | ids of all documents, 2 or 4 bytes each | boundaries | document ids | footer | size

Boundaries (and the document ids, which rise too) are Elias-Fano coded: of n rising numbers
below u, the low log2(u / n) bits are packed, and the rest is a bit vector with a one for every
number after as many zeros as its high bits say. That takes about 2 + log2(u / n) bits a
number. The place of every 256th one is kept as a 32-bit number, so select(i) looks at a few
words, and a block of boundaries is read between two selects. The footer is JSON and tells where each part lies.

Rows are sorted by id, null ids first, then by a hash of the text; repeated rows are kept, each
as a document. A null or empty text is a document with the end id alone. An empty table gives
no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.common import id_and_text, pieces
from loanloom.sources.store import new_table_path, stored

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"EFT1"
EVERY = 256
#: Words and parts of words kept per Python worker; a full table is emptied.
KEPT_WORDS = 500_000
KEPT_LENGTH = 64
#: A file is closed when it has that many documents or ids; a document is never split.
FILE_DOCS = 1 << 16
FILE_IDS = 1 << 24
#: Boundaries and ids that a reader holds at once, unless one document has more ids.
READ_DOCS = 1 << 12
READ_IDS = 4_000_000


class EliasFano:
    """Rising non-negative numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))
        if len(high) * 8 >= 1 << 32:
            raise ValueError("too many numbers for one file")
        self.sample = ones[::EVERY].astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        low = np.packbits(bits[:, :low_bits].reshape(-1), bitorder="little")
        ones = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones.astype(np.int64)] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"))

    def _place(self, i: int) -> int:
        """Where the i-th one stands in the high bits."""
        place = int(self.sample[i // EVERY])
        left, byte = i % EVERY, place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th number."""
        start = i * self.low_bits
        span = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (self._place(i) - i) << self.low_bits | (span >> (start & 7)) & ((1 << self.low_bits) - 1)

    def block(self, i: int, k: int) -> np.ndarray:
        """Numbers i to k - 1; only the bits between the two are looked at."""
        if i >= k:
            return np.zeros(0, np.uint64)
        first, last = self._place(i), self._place(k - 1)
        byte, start = first >> 3, i * self.low_bits
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (last >> 3) + 1], bitorder="little")) + byte * 8
        ones = ones[(ones >= first) & (ones <= last)].astype(np.uint64)
        bits = np.unpackbits(self.low[start >> 3 : (k * self.low_bits + 7) >> 3], bitorder="little")[start & 7 :]
        wide = np.zeros((k - i, 64), np.uint8)
        wide[:, : self.low_bits] = bits[: (k - i) * self.low_bits].reshape(k - i, self.low_bits)
        high = (ones - np.arange(i, k, dtype=np.uint64)) << np.uint64(self.low_bits)
        return high | np.packbits(wide, axis=1, bitorder="little").view(np.uint64).reshape(-1)

    def values(self) -> np.ndarray:
        """All numbers at once."""
        return self.block(0, self.n)


class WordEncoder:
    """Ids of texts by a tokenizer that never joins characters over white space.

    Words between white space are encoded by the library once and kept in a bounded table.
    """

    #: The contractions and classes by which the tokenizer splits; fixed values. They are used
    #: only for words of ASCII signs and the letters of Latin-1 and Latin Extended-A that have no
    #: parts to compose and one lower-case form, for which the classes are easy to write down.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿĀ-ſ]+|[0-9]|[^a-zß-öø-ÿĀ-ſ0-9]+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿĀ-įıĲ-ňŊ-ž]+")

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib = Tokenizer.from_str(definition)
        top = max(self.lib.get_vocab(with_added_tokens=True).values())
        self.width = 2 if top < 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.parts: dict[str, bytes] = {}
        #: The signs in which the tokenizer writes the bytes of letters beyond ASCII.
        bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {c: bytes_of(chr(c))[0][0] for c in range(0xDF, 0x180)}
        self.marked = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.splits = self._splits_as_known()
        outer = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                found = outer.encode_word(word.decode())
                if len(word) <= KEPT_LENGTH:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = found
                return found

        self.words = Words()

    def _splits_as_known(self) -> bool:
        """Whether lower case, the split above and the plain model are what the library does."""
        probe = "It's 12 o'clock, We'LL x-1!! A_b 'Tis don't Élan naïve ÇA!Œuvre STRAßE ñŽ'sı"
        known = b"".join(self._plain(w) for w in probe.split())
        return known == self._by_library(probe)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, word: str) -> bytes:
        out = []
        for part in self.PARTS.findall(word.lower()):
            known = self.parts.get(part)
            if known is None:
                if len(self.parts) >= KEPT_WORDS:
                    self.parts.clear()
                written = part if part.isascii() else part.translate(self.signs)
                ids = [t.id for t in self.lib.model.tokenize(written)]
                known = np.array(ids, self.kind).tobytes()
                if len(part) <= KEPT_LENGTH:
                    self.parts[part] = known
            out.append(known)
        return b"".join(out)

    def encode_word(self, word: str) -> bytes:
        plain = self.splits and self.PLAIN.fullmatch(word)
        if plain and not any(m in word for m in self.marked):
            return self._plain(word)
        return self._by_library(word)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def _encoder(definition: str) -> WordEncoder:
    return WordEncoder(definition)


class _NewFile:
    """One file while it is written; holds the ids and boundaries of its documents."""

    def __init__(self, folder: str, name: str, tool: WordEncoder, end_id: int):
        files, base = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{base}/{name}")
        self.out.write(MAGIC)
        self.tool, self.end = tool, np.array([end_id], tool.kind).tobytes()
        self.keys, self.ends, self.nulls, self.tokens = array("q"), array("q"), 0, 0

    def add(self, doc: int | None, text: str) -> None:
        raw = self.tool.encode(text) + self.end
        self.out.write(raw)
        self.tokens += len(raw) // self.tool.width
        self.ends.append(self.tokens)
        if doc is None:
            self.nulls += 1
        else:
            self.keys.append(doc)

    def close(self) -> None:
        keys = np.array(self.keys, np.int64)
        first = int(keys[0]) if len(keys) else 0
        width = self.tool.width
        footer = {"width": width, "docs": len(self.ends), "tokens": self.tokens}
        footer |= {"null_ids": self.nulls, "first_id": first}
        at = len(MAGIC) + self.tokens * width
        # ids may lie further apart than signed numbers reach
        offsets = keys.view(np.uint64) - np.int64(first).view(np.uint64)
        for part, values in (("ends", np.array(self.ends, np.uint64)), ("ids", offsets)):
            code = EliasFano.of(values)
            for kind, raw in (("low", code.low), ("high", code.high)):
                self.out.write(raw.tobytes())
                footer[f"{part}_{kind}"] = [at, len(raw)]
                at += len(raw)
            footer[part] = [code.n, code.low_bits]
        tail = json.dumps(footer).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little"))
        self.out.close()


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    file_docs: int = FILE_DOCS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the files and return one row per file: shard, part, path, n_docs, n_tokens.

    A shard is what one task writes, in as many parts as the limits ask for. A file's name has the
    task attempt that wrote it; the returned table, itself stored, names the files of one attempt
    per shard, so those of lost or repeated attempts are never read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        id_and_text(docs, key, text)
        .withColumn("tie", F.xxhash64(text))
        .repartitionByRange(n, F.col(key).asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col(key).asc_nulls_first(), "tie")
        .select(key, text)
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, context = _encoder(definition.value), TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        file, part = None, 0

        def closed() -> pa.RecordBatch:
            file.close()
            row = dict(zip(_LISTED.names, (shard, part, file.path, len(file.ends), file.tokens), strict=True))
            return pa.RecordBatch.from_pylist([row], schema=_LISTED)

        for batch in batches:
            for piece in pieces(batch):
                for doc, one in zip(*(c.to_pylist() for c in piece.columns[:2]), strict=True):
                    if file is None:
                        file = _NewFile(folder, f"shard-{shard:06d}-{part:06d}-{attempt}.eft", tool, end_id)
                    file.add(doc, one)
                    if len(file.ends) >= file_docs or file.tokens >= file_ids:
                        yield closed()
                        file, part = None, part + 1
        if file is not None:
            yield closed()

    rows = ordered.mapInArrow(write, "shard int, part int, path string, n_docs long, n_tokens long")
    return stored(rows, "token_files")


_LISTED = pa.schema(
    [
        ("shard", pa.int32()),
        ("part", pa.int32()),
        ("path", pa.string()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
    ]
)


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        files, inner = pa.fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        tail = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.footer = json.loads(self.file.read_at(tail, size - 8 - tail))
        self.kind = np.dtype("<u2" if self.footer["width"] == 2 else "<u4")
        self.ends, self.ids = self._code("ends"), self._code("ids")

    def _code(self, part: str) -> EliasFano:
        low, high = (
            np.frombuffer(self.file.read_at(n, at), np.uint8)
            for at, n in (self.footer[f"{part}_low"], self.footer[f"{part}_high"])
        )
        return EliasFano(*self.footer[part], low, high)

    def __len__(self) -> int:
        return self.footer["docs"]

    def doc_id(self, i: int) -> int | None:
        nulls = self.footer["null_ids"]
        return None if i < nulls else self.footer["first_id"] + self.ids.select(i - nulls)

    def doc_ids(self, i: int = 0, k: int | None = None) -> list[int | None]:
        """Ids of documents i to k - 1, or to the last."""
        k = len(self) if k is None else k
        nulls, first = self.footer["null_ids"], self.footer["first_id"]
        known = self.ids.block(max(0, i - nulls), max(0, k - nulls)).tolist()
        return [None] * (min(k, nulls) - min(i, nulls)) + [first + v for v in known]

    def boundaries(self, i: int, k: int) -> np.ndarray:
        """Start of document i, then the ends of documents i to k - 1."""
        start = self.ends.select(i - 1) if i else 0
        return np.concatenate([[start], self.ends.block(i, k).astype(np.int64)])

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids from one place of the file to another."""
        width = self.footer["width"]
        raw = self.file.read_at((end - start) * width, len(MAGIC) + start * width)
        return np.frombuffer(raw, self.kind)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.span(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def read_token_files(files: DataFrame, outputs: tuple[str, ...] = ("ids",), key: str = "doc_id") -> DataFrame:
    """Per document: its id, start (ids of all documents before it), n_tokens, and the outputs.

    files: what write_token_files returned. Outputs are ids (array) and ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). One row per shard, that is per writing task, is
    numbered in one task and broadcast; files are numbered within their shard.
    """
    kinds = {"ids": "array<int>", "ids_crc32": "long"}
    schema = f"{key} long, start long, n_tokens long" + "".join(f", {o} {kinds[o]}" for o in outputs)
    own = F.col("n_tokens")
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = shards.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - own).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("part")) - own
    listed = (
        files.withColumn("within", within)
        .join(F.broadcast(before), "shard")
        .select("shard", "part", "path", (F.col("before") + F.col("within")).alias("base"))
        .repartitionByRange(max(1, files.count()), "shard", "part")
    )

    def rows_of(file: TokenFile, before: int, i: int, k: int) -> Iterator[pa.RecordBatch]:
        ends, keys = file.boundaries(i, k), file.doc_ids(i, k)
        at = 0
        while at < k - i:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + READ_IDS, "right")) - 1)
            held = file.span(int(ends[at]), int(ends[to])).astype("<u4")
            cut = np.split(held, ends[at + 1 : to] - ends[at])
            columns = [
                pa.array(keys[at:to], pa.int64()),
                pa.array(ends[at:to] + before),
                pa.array(np.diff(ends[at : to + 1])),
            ]
            for o in outputs:
                if o == "ids":
                    columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                else:
                    columns.append(pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", *outputs])
            at = to

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                file = TokenFile(path)
                for i in range(0, len(file), READ_DOCS):
                    yield from rows_of(file, before, i, min(i + READ_DOCS, len(file)))

    return listed.mapInArrow(read, schema)


def new_folder(docs: DataFrame) -> str:
    """A folder for the files that all executors reach."""
    return new_table_path(docs.sparkSession, "token_ids")
