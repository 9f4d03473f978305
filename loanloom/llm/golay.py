"""SimHash near-duplicates, found with keys from the Golay code.

A fingerprint has 64 bits; words are lower-cased A-Z, shingles are runs of words, repeats count.
Two fingerprints that differ in at most 2 bits are linked; components of links are groups.

Keys. The fingerprint is cut into segments of 23, 23 and 18 bits. With 2 errors at most, one of
the three is free of errors (pigeonhole); it is taken as it is, and joined with a codeword index
of the next segment (18 bits are filled up with zeros). The perfect (23, 12) Golay code has one
codeword within 3 bits of every word. A segment's indices are those that its 23-bit word and all
its one-bit neighbours decode to, 1 or 6 of them. Two segments at distance 2 or less have a word
within one bit of both, so they share an index. Linked fingerprints therefore share a key.

Verification. The fingerprints at one key are compared by the number of bits in which they
differ. A key of more than CROWD fingerprints is made longer for them by an index of the third
segment, which linked ones share as well. Where more than CROWD share the longer key too, the
distance is verified through common neighbours instead: two fingerprints have a word within one
bit of both exactly if they differ in at most 2 bits, so every one is linked to the least at
each of these 65 words. No key gives more than CROWD / 2 links or 65 words a fingerprint, and no
pair is missed.

Rows without words have the fingerprint 0, as null and empty texts do. Repeated rows and equal
fingerprints are one node. A null id is kept, in the component of its fingerprint, and never is
its least id unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loanloom.llm.common import free_names, id_and_text, map_texts, pieces
from loanloom.llm.components import components
from loanloom.sources.store import stored

#: Generator polynomial of the (23, 12) Golay code; fixed value.
GENERATOR = 0b101011100011
SEED = 42
#: First bit and length of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints at one key that are compared with each other.
CROWD = 32
#: Bits of a codeword index, and the place of the segment's number in a key.
INDEX_BITS = 12
NUMBER_AT = 60


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return rest


@lru_cache(maxsize=1)
def _error_of() -> np.ndarray:
    """The error of weight 3 or less for each of the 2048 remainders."""
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.array(errors, np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_syndromes(errors)] = errors
    return table


def indices(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of 23-bit words and their one-bit neighbours."""
    near = words.astype(np.uint32)[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.uint32)
    return (near ^ _error_of()[_syndromes(near)]) >> np.uint32(11)


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    prints = prints.astype(np.uint64)
    return [(prints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]


def _distinct(rows: np.ndarray) -> list[list[int]]:
    return [np.unique(row).view(np.int64).tolist() for row in rows]


def keys(prints: np.ndarray) -> list[list[int]]:
    """Distinct join keys of each 64-bit fingerprint."""
    parts = _segments(prints)
    columns = []
    for i, exact in enumerate(parts):
        near = indices(parts[(i + 1) % 3]).astype(np.uint64)
        columns.append(np.uint64(i << NUMBER_AT) | exact[:, None] << np.uint64(INDEX_BITS) | near)
    return _distinct(np.concatenate(columns, axis=1))


def longer_keys(prints: np.ndarray, short: np.ndarray) -> list[list[int]]:
    """Each fingerprint's key, made longer by the indices of the segment that the key leaves out."""
    short = short.view(np.uint64)
    number = short >> np.uint64(NUMBER_AT)
    body = short & np.uint64((1 << NUMBER_AT) - 1)
    third = np.choose(((number + np.uint64(2)) % np.uint64(3)).astype(np.intp), _segments(prints))
    head = number << np.uint64(NUMBER_AT) | body << np.uint64(INDEX_BITS)
    return _distinct(head[:, None] | indices(third).astype(np.uint64))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash of a text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    k = min(shingle, len(words))
    ends = (starts + sizes)[k - 1 :]
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),  # noqa: B905
        np.uint64,
        len(ends),
    )
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint (as a signed long) of every whole text."""

    def make():
        def step(ids, texts):
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return ids, prints.view(np.int64)

        return step

    return map_texts(id_and_text(docs, key, text), make, f"{key} long, print long")


def _with_keys(rows: DataFrame) -> DataFrame:
    """Print and key, a row per key; rows that have a key already get longer ones."""

    def add(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            found = keys(prints) if batch.num_columns == 1 else longer_keys(prints, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["print", "keys"]
            )

    keyed = rows.mapInArrow(add, "print long, keys array<long>")
    return stored(keyed.select("print", F.explode("keys").alias("key")), "keyed")


def _compared(at_keys: DataFrame) -> DataFrame:
    """Links (a, b) between the prints of each key, all pairs of which are within 2 bits."""
    near = (
        "flatten(transform(prints, (a, i) -> transform(filter("
        f"slice(prints, i + 2, {CROWD}), b -> bit_count(a ^ b) <= 2), b -> named_struct('a', a, 'b', b))))"
    )
    listed = at_keys.groupBy("key").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    return listed.select(F.inline(F.expr(near))).distinct()


def _neighbour_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of prints to the least one that has a word within one bit in common with them."""
    points = stored(
        prints.select(
            "print",
            F.expr(
                "explode(concat(array(print), transform(sequence(0, 63), i -> print ^ shiftleft(1L, i))))"
            ).alias("point"),
        ),
        "points",
    )
    centres = points.groupBy("point").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1")
    return points.join(centres, "point").where("print <> a").select("a", F.col("print").alias("b"))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of 2 bits or fewer that connect all distinct prints that such links connect.

    prints: a stored column of distinct longs.
    """
    found, rows = None, prints.select("print")
    for _ in ("keys", "longer keys"):
        keyed = _with_keys(rows)
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        at_keys = stored(keyed.join(shared, "key"), "at_keys")
        pairs = _compared(at_keys.where(F.col("n") <= CROWD))
        found = pairs if found is None else found.union(pairs)
        rows = at_keys.where(F.col("n") > CROWD).select("print", "key")
        if rows.isEmpty():
            return found
    return found.union(_neighbour_links(rows.select("print").distinct()))


def near_groups(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, print and component_id (least key reachable over links of 2 bits or fewer) per row."""
    rows = stored(fingerprints(docs, shingle, key, text), "fingerprints")
    return rows.join(_groups(rows, key), "print").select(key, "print", "component_id")


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """Per print: component_id, and root, the least print of the group, which no other group has.

    rows: stored keys and prints.
    """
    nodes = stored(rows.groupBy("print").agg(F.min(key).alias("least")), "distinct_prints")
    roots = components(links(nodes)).select(F.col("a").alias("print"), F.col("b").alias("root"))
    members = stored(
        nodes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")),
        "members",
    )
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return members.join(least, "root").select("print", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all columns as they are: that with the least key.

    Repeated rows are in one group, so one of them stays. If the least key is null or has several
    texts in a group, that with the least fingerprint stays.
    """
    at = docs.columns.index(text)
    mark, = free_names(docs, "print")
    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
    names = schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                prints = np.array([fingerprint(t or "", shingle) for t in piece.column(at).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(prints.view(np.int64))], names=names)

    # stored with the texts, so that each is hashed once
    marked = stored(docs.mapInArrow(add, schema), "marked")
    rows = marked.select(F.col(key).cast("long").alias("key"), F.col(mark).alias("print"))
    groups = rows.join(_groups(rows, "key"), "print")
    counted = groups.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("root", "key", "print").count()
    first = counted.groupBy("root").agg(F.min(F.struct("print", "key", "count")).alias("first"))
    chosen = stored(first.select("first.*"), "chosen")
    same = marked[key].cast("long").eqNullSafe(chosen["key"]) & (marked[mark] == chosen["print"])
    kept = marked.join(chosen.select("key", "print"), same, "left_semi")
    if not chosen.where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, mark])
    return kept.drop(mark)
