"""Rotated texts, mixed sources and importance resampling against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loanloom.llm import curriculum, radix, resample, rotation
from loanloom.llm.common import table
from loanloom.llm.queries import QUERIES, SCHEDULES

from .conftest import odd_texts

SF_DIR = "/root/testdata/sf0.01"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def draws(key) -> list[int]:
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# rotation

SCRAPS = st.lists(st.sampled_from(["a", "é", " ", "\n\x0b", "<", "P", ">", "<S", "\U0001f600", "word", "\x85", "\0"]), max_size=25)


@settings(max_examples=400, deadline=None)
@given(SCRAPS.map("".join), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]), st.sampled_from([1, 2, 1 << 16]))
def test_blocks_change_places_and_go_back(text, i, j, form, swapped):
    text = re.sub("<[PSM]>", "", text)
    raw = text.encode()
    a, b = sorted((i % (len(raw) + 1), j % (len(raw) + 1)))
    p, m, s = raw[:a], raw[a:b], raw[b:]
    before, rotation.SWAPPED = rotation.SWAPPED, swapped
    try:
        out = bytes(rotation.arrange(raw, form, a, b))
        wanted = b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m
        assert out == wanted
        if not any(x in raw for x in (b"<P>", b"<S>", b"<M>")):
            assert bytes(rotation.restore(out, form)) == raw
    finally:
        rotation.SWAPPED = before


@settings(max_examples=300, deadline=None)
@given(SCRAPS.map("".join))
def test_units_are_those_of_the_pattern(text):
    ends = np.cumsum([len(u.encode()) for u in UNIT.findall(text)]).tolist()
    assert rotation.unit_ends(text.encode()).tolist() == ends


def slow_middle(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n, (h1, h2, h3, h4) = len(units), draws(key)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (key, n, "plain", None, None, sha(text), sha(text), text, text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (key, n, form, len(p), len(m), sha(out), sha(text), out, text)


def test_fill_in_middle_of_odd_texts(spark, docs, no_docs):
    extra = [(i, t, "e", *["x"] * 12, 1) for i, t in ((50, "a <P> b"), (51, "x <M>"), (55, "<S>"), (61, "c d e f " * 9))]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    found = rotation.fill_in_middle(rows)
    wanted = [slow_middle(i, t) for i, t in [*odd_texts(), *((r[0], r[1]) for r in extra)]]
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    back = rotation.restored_texts(found).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((w[0], w[8]) for w in wanted), key=str)
    assert rotation.fill_in_middle(no_docs).collect() == []
    nothing = spark.createDataFrame([(1, None, "psm"), (2, "t", None)], "doc_id long, output string, form string")
    assert {r.text for r in rotation.restored_texts(nothing).collect()} == {None}


# mixing


def targets(sizes: dict, weights: dict, cap: int) -> dict:
    """Shares by weight; what is above a cap is shared again, until nothing is."""
    out, left, words = {}, dict(sizes), Fraction(sum(sizes.values()))
    while left:
        whole = sum(weights[s] for s in left)
        share = {s: words * weights[s] / whole for s in left}
        full = [s for s in left if share[s] > cap * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            words -= out[s]
            del left[s]
    return out


def slow_mix(rows, schedules=SCHEDULES, cap=3):
    """Per row: id, source, size, source_size, target, taken."""
    rows = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: Fraction(curriculum.integrals(schedules[n % len(schedules)])[-1]) for n, s in enumerate(sources)}
    sizes = {s: sum(n for _, o, n in rows if o == s) for s in sources}
    wanted = targets(sizes, weights, cap)
    out = []
    for s in sources:
        order = sorted(
            ((int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:15], 16), i is None, i or 0, n, i) for i, o, n in rows if o == s)
        )
        demand, copy, at = math.floor(wanted[s]), [0] * len(order), 0
        while at < demand:
            for k, (*_, n, _) in enumerate(order):
                copy[k] += max(0, min(n, demand - at))
                at += n
        out += [(i, s, n, sizes[s], float(wanted[s]), c) for (*_, n, i), c in zip(order, copy, strict=True)]
    return out


MIXED = StructType([StructField("doc_id", LongType()), StructField("source", StringType()), StructField("text", StringType()), StructField("size", StringType()), StructField("target", StringType())])


def test_mix_of_odd_texts(spark):
    names = [None, "", "b", "Z", "é", "hot"]
    rows = [(i, names[n % 6], t) for n, (i, t) in enumerate(odd_texts())]
    rows += [(i, "hot", "w " * (i % 40)) for i in range(400)] + [(7, None, "x y")] * 3 + [(None, "hot", "a b c")] * 200
    df = spark.createDataFrame([(*r, "s", "t") for r in rows], MIXED).repartition(5)
    mixed = curriculum.mix(df, SCHEDULES)
    found = [tuple(r)[:6] for r in mixed.collect()]
    wanted = slow_mix(rows)
    key = str
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert all(t <= 3 * n for *_, n, _, _, t in found) and any(t > n for *_, n, _, _, t in found)
    order = curriculum.training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert all(0 <= r.position < 1 and r.words > 0 for r in order)
    taken = Counter()
    for r in order:
        taken[r.doc_id] += r.words
    assert taken == {k: v for k, v in sum_by_id(wanted).items() if v}
    empty = curriculum.mix(df.limit(0), SCHEDULES)
    assert empty.collect() == [] and curriculum.training_order(empty).collect() == []
    blank = curriculum.mix(df.select("doc_id", "source", F.lit(" ").alias("text")), SCHEDULES)
    assert {(r["size"], r.source_size, r.target, r.taken, tuple(r.times)) for r in blank.collect()} == {(0, 0, 0.0, 0, ())}


def sum_by_id(rows) -> dict:
    out = Counter()
    for i, *_, taken in rows:
        out[i] += taken
    return out


def test_long_runs_are_summed_over_their_borders(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "RUN", 7)
    rows = [(i, f"s{i % 2}", "w " * (1 + i * 37 % 11)) for i in range(300)]
    df = spark.createDataFrame([(*r, "s", "t") for r in rows], MIXED).repartition(3)
    found = [tuple(r)[:6] for r in curriculum.mix(df, SCHEDULES).collect()]
    assert sorted(found) == sorted(slow_mix(rows))


@pytest.mark.parametrize("schedule", [*SCHEDULES, ((0, 0), (0.25, 4), (0.5, 0), (0.75, 0), (1, 1)), ((0, 1), (1, 0))])
def test_times_invert_the_integral(spark, schedule):
    times, weights = zip(*schedule, strict=True)
    parts = [i / 500 for i in range(500)]
    df = spark.createDataFrame([(p,) for p in parts], "part double")
    found = {r.part: r.t for r in df.select("part", curriculum.time_of(F.col("part"), schedule).alias("t")).collect()}
    grid = np.linspace(0, 1, 400_001)
    height = np.interp(grid, times, weights)
    upto = np.concatenate([[0], np.cumsum((height[1:] + height[:-1]) / 2 * np.diff(grid))])
    for p in parts:
        assert abs(np.interp(found[p], grid, upto) / upto[-1] - p) < 1e-6
    assert [found[p] for p in parts] == sorted(found[p] for p in parts)


def test_schedules_are_checked():
    for wrong in [((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3)), ((0, 1), (0.5, 1), (0.5, 2), (1, 1))]:
        with pytest.raises(ValueError):
            curriculum.integrals(wrong)
    assert [curriculum.integrals(s)[-1] for s in SCHEDULES] == [5, 2, 1]


def test_mix_comes_near_its_targets(spark):
    found = QUERIES["op12_mixture"](spark, SF_DIR)
    by_source = found.join(table(spark, SF_DIR, "documents").select("doc_id", "source"), "doc_id")
    sums = by_source.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert len(sums) > 1 and all(0 <= r.t - r.n < 1 for r in sums)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, QUERIES["op12_mixture"](spark, SF_DIR).collect()), key=str)


# resampling

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow_buckets(text) -> list[int]:
    words = LETTERS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % 10_000 for r in runs]


def slow_resampled(rows, target):
    corpus = Counter(b for _, t in rows for b in slow_buckets(t))
    wanted = Counter(b for t in target for b in slow_buckets(t))
    s, t = corpus.total() + 10_000, wanted.total() + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s / ((corpus[b] + 1) * t))) for b in range(10_000)}
    out, able = [], []
    for i, text in rows:
        found = slow_buckets(text)
        weight = sum(gain[b] for b in found)
        h = draws(i)[0]
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(LETTERS.findall((text or "").translate(LOWER))) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return [tuple(r) for r in out]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A", "b", "é", "0", " ", "-", "\U0001f600", "İ", "long" * 30, "\0"]), max_size=12).map("".join), max_size=4))
def test_buckets_are_checksums_of_the_runs(texts):
    features = resample.Features()
    for _ in range(2):
        words, runs = features.of([t.encode() for t in texts])
        assert words.tolist() == [len(LETTERS.findall(t.translate(LOWER))) for t in texts]
        for k, t in enumerate(texts):
            got = [b for bucket, n in runs for b in bucket[n[:k].sum() : n[: k + 1].sum()].tolist()]
            assert got == slow_buckets(t)


def test_resampling_of_odd_texts(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(resample, "KEPT_BYTES", 2000)
    draw = random.Random(5)
    more = [(None if i % 50 == 0 else 100 + i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(15, 60)))) for i in range(600)]
    more += [(200, "a " * 30)] * 30
    rows = [*odd_texts(), *more]
    df = docs.union(spark.createDataFrame([(i, t, "e", *["x"] * 12, 1) for i, t in more], docs.schema))
    target = ["a b c d", None, "", "A-b w1 w2 w3 w5"]
    items = spark.createDataFrame([(None, t) for t in target], "item_id long, text string")
    found = resample.resampled(df, items)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(slow_resampled(rows, target), key=str)
    assert resample.resampled(no_docs, items).collect() == []
    none = resample.resampled(df, items.limit(0)).collect()
    assert sorted(map(tuple, none), key=str) == sorted(slow_resampled(rows, []), key=str)


def test_resampling_of_the_documents(spark):
    rows = [tuple(r) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    found = sorted(map(tuple, QUERIES["op13_resampling"](spark, SF_DIR).collect()))
    assert found == sorted(slow_resampled(rows, target)) and sum(r[4] is not None for r in found) > 10


@pytest.mark.parametrize("kind", ["wide", "narrow", "one", "ties"])
def test_radix_ranks(spark, monkeypatch, kind):
    monkeypatch.setattr(radix, "BLOCK", 50)
    draw = random.Random(kind)
    low, high = {"wide": (-(1 << 63), (1 << 63) - 1), "narrow": (-5000, 900_000), "one": (7, 7), "ties": (-1, 1)}[kind]
    rows = [(draw.randint(low, high), draw.randint(low // 2, high), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, n long").repartition(3)
    found = radix.ranked(df, ("a", "b")).collect()
    assert sorted(r.rank for r in found) == list(range(1, 1001))
    found.sort(key=lambda r: r.rank)
    assert [(r.a, r.b) for r in found] == sorted((a, b) for a, b, _ in rows)
    assert radix.ranked(df.limit(0), ("a", "b")).collect() == []
    assert [r.rank for r in radix.ranked(df.where("n = 3"), ("a", "b")).collect()] == [1]
