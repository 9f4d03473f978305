"""Fill-in-middle by rotating blocks of a text in place.

A text is cut into units: a word with the white space before it, or the white space at its end.
Two cuts between units give prefix, middle and suffix. The parts get their sentinels in one
bytearray, as `<P>`prefix`<M>`middle`<S>`suffix, and two neighbouring blocks of it change places:

    psm: <M>middle with <S>suffix             ->  <P>prefix<S>suffix<M>middle
    spm: <P>prefix<M>middle with <S>suffix    ->  <S>suffix<P>prefix<M>middle

Blocks change places by three reversals (each by itself, then both together), so no second copy
of a text is made. The way back finds the sentinels, rotates by the other length and takes the
sentinels out. A text that holds a sentinel stays plain, and since a sentinel can't overlap
another, each is found exactly once.

The cuts and the form are drawn from sha256 of seed and id, so that they depend on neither the
order of rows nor on the task. A null id is drawn for as an empty one. Null and empty texts are
plain, with no units; repeated rows get equal results; an empty table gives an empty result.
Columns of the input other than id and text go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import id_and_text, map_texts

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that change places at once in a reversal, so that its own memory is bounded.
SWAPPED = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(raw: bytes) -> np.ndarray:
    """Where each unit ends, in bytes."""
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    inner = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.append(inner, len(raw)) if raw else inner


def draws(key: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    name = f"{seed}:{'' if key is None else key}"
    digits = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def _reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, some bytes from both ends at a time."""
    while end - start > 1:
        n = min(SWAPPED, (end - start) // 2)
        left = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """buffer[start:middle] and buffer[middle:end] change places."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, end)
    _reverse(view, start, end)


def arrange(raw: bytes, form: str, first: int, second: int) -> bytearray:
    """The text with sentinels in the order of the form; cut after `first` and `second` bytes."""
    buffer = bytearray(raw)
    if form == PLAIN:
        return buffer
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[:0] = PREFIX
    middle = len(PREFIX) + first
    suffix = middle + len(MIDDLE) + second - first
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``arrange`` was given."""
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    if form == PSM:
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    middle, suffix = buffer.index(MIDDLE), buffer.index(SUFFIX)
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return buffer


def _chars(raw: bytes) -> int:
    """Code points of UTF-8: bytes that don't go on with one."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


OUTPUTS = {
    "n": "long",
    "form": "string",
    "prefix_chars": "long",
    "middle_chars": "long",
    "output_sha256": "string",
    "restored_sha256": "string",
    "output": "string",
    "restored": "string",
}


def fill_in_middle(
    docs: DataFrame,
    outputs: tuple[str, ...] = tuple(OUTPUTS),
    changed: int = 50,
    suffix_first: int = 80,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each input row: the id and the outputs asked for.

    `changed` of 100 documents are rearranged, and of these `suffix_first` of 100 are spm, the
    others psm. restored is rebuilt from the output and its form alone.
    """

    def make():
        def one(k: int | None, raw: bytes) -> tuple:
            ends = unit_ends(raw)
            n = len(ends)
            h1, h2, h3, h4 = draws(k, seed)
            held = any(s in raw for s in (PREFIX, MIDDLE, SUFFIX))
            form = PLAIN
            if raw and not held and h3 % 100 < changed:
                form = SPM if h4 % 100 < suffix_first else PSM
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            first, second = (int(ends[i - 1]) if i else 0 for i in (first, second))
            output = bytes(arrange(raw, form, first, second))
            back = bytes(restore(output, form))
            counts = (None, None) if form == PLAIN else (_chars(raw[:first]), _chars(raw[first:second]))
            digests = (hashlib.sha256(t).hexdigest() for t in (output, back))
            return (n, form, *counts, *digests, output, back)

        def step(keys, texts):
            rows = [one(k, t) for k, t in zip(keys, texts, strict=True)]
            columns = dict(zip(OUTPUTS, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(OUTPUTS, ())
            return keys, *(
                # bytes of a Spark text go back as they came
                pa.array(columns[o], pa.binary()).cast(pa.string()) if o in ("output", "restored") else list(columns[o])
                for o in outputs
            )

        return step

    schema = ", ".join([f"{key} long", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    raw = id_and_text(docs, key, text).withColumn(text, F.col(text).cast("binary"))
    return map_texts(raw, make, schema)


def restored_texts(rows: DataFrame, key: str = "doc_id", output: str = "output", form: str = "form") -> DataFrame:
    """Id and text of stored outputs, from output and form; nulls stay null."""

    def back(batches):
        for batch in batches:
            texts = [
                None if o is None or f is None else bytes(restore(o, f))
                for o, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=[key, "text"]
            )

    narrow = rows.select(F.col(key).cast("long").alias(key), F.col(output).cast("binary"), form)
    return narrow.mapInArrow(back, f"{key} long, text string")
