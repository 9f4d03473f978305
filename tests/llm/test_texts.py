"""Operators on documents, against brute-force versions over odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loanloom.llm import debruijn, decontam, elias_fano, golay, piece_codec
from loanloom.llm.queries import PIECE_MODEL, WORD_TOKENIZER

from .conftest import odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_tokenizer_files_are_named_by_path():
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECE_MODEL


# merge codec


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(PIECE_MODEL, "rb") as f:
        return piece_codec.PieceCodec(f.read())


SCRAPS = st.lists(
    st.sampled_from(
        "▁| |  |    |a|t|h|e|the| the|ing|\n|\t|é|ß|中|文|1|.|==|!!|́|\U0001f600|\0|<s>|</s>|<0x41>|​|,".split("|")
    ),
    max_size=30,
)


@settings(max_examples=400, deadline=None)
@given(SCRAPS.map("".join) | st.text(max_size=40))
def test_encoding_and_decoding_equal_the_library(codec, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text).tolist() == ids
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
def test_any_ids_decode_as_in_the_library(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids)


def test_round_trip_of_odd_texts(docs, no_docs, library):
    found = sorted(map(tuple, piece_codec.round_trip(docs, PIECE_MODEL).collect()), key=str)
    wanted = []
    for i, t in odd_texts():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        back = library.decode(ids)
        raw = np.array(ids, "<u4").tobytes()
        wanted.append((i, ids, len(ids), hashlib.sha256(raw).hexdigest(), back, hashlib.sha256(back.encode()).hexdigest()))
    assert found == sorted(wanted, key=str)
    assert piece_codec.round_trip(no_docs, PIECE_MODEL).collect() == []


# token files


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 50) | st.integers(0, 40), max_size=700).map(sorted))
def test_elias_fano_gives_every_number(values):
    code = elias_fano.EliasFano.of(np.array(values, np.uint64))
    assert code.values().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values


def test_token_files_end_at_their_limits(spark):
    """Of many small documents no writer and no reader holds more than a file, and a file is bounded."""
    docs = spark.range(20_000).selectExpr(
        "if(id % 500 = 0, null, id * 1000003 - 7e9) as doc_id", "repeat('ab ', cast(id % 5 as int)) as text"
    )
    whole = elias_fano.write_token_files(docs, WORD_TOKENIZER, 2, elias_fano.new_folder(docs))
    small = elias_fano.write_token_files(
        docs, WORD_TOKENIZER, 2, elias_fano.new_folder(docs), file_docs=700, file_ids=1500
    )
    assert whole.count() <= 8 and small.agg({"n_docs": "max"}).first()[0] <= 700
    assert small.agg({"n_tokens": "max"}).first()[0] < 1500 + 20
    assert small.agg({"n_docs": "sum"}).first()[0] == 20_000
    one, two = (
        elias_fano.read_token_files(f, ("ids", "ids_crc32")).orderBy("start").collect() for f in (whole, small)
    )
    assert one == two and len(one) == 20_000 and sum(r.doc_id is None for r in one) == 40
    last = elias_fano.TokenFile(small.orderBy("shard", "part").collect()[-1].path)
    n = len(last)
    assert [last.doc_id(i) for i in range(n)] == last.doc_ids(0, n)
    assert last.doc_ids(n // 3, n) == last.doc_ids(0, n)[n // 3 :] == [r.doc_id for r in two[-n:]][n // 3 :]


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=900).map(sorted), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano_reads_any_block(values, data):
    code = elias_fano.EliasFano.of(np.array(values, np.uint64))
    i = data.draw(st.integers(0, len(values)))
    k = data.draw(st.integers(i, len(values)))
    assert code.block(i, k).tolist() == values[i:k]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000)).astype(np.uint64)
    code = elias_fano.EliasFano.of(values)
    assert (code.low.nbytes + code.high.nbytes + code.sample.nbytes) * 8 < len(values) * (2.2 + np.log2(values[-1] / len(values)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBc1 's\n\té<|end>oftxr \x1cİΣ.!", max_size=40))
def test_words_encode_as_the_library(text):
    lib = tokenizers.Tokenizer.from_file(WORD_TOKENIZER)
    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        tool = elias_fano._encoder(f.read())
    got = np.frombuffer(tool.encode(text), tool.kind).tolist()
    assert got == lib.encode(text, add_special_tokens=False).ids


def test_token_files_of_odd_texts(docs, no_docs, spark):
    lib = tokenizers.Tokenizer.from_file(WORD_TOKENIZER)
    files = elias_fano.write_token_files(docs, WORD_TOKENIZER, 2, elias_fano.new_folder(docs))
    found = elias_fano.read_token_files(files, ("ids", "ids_crc32")).orderBy("start").collect()
    texts = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [i for i, _ in texts]
    start = 0
    wanted = {}
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.setdefault(i, []).append(ids)
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) and list(r.ids) in wanted[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert start == sum(len(x) for v in wanted.values() for x in v)
    one = elias_fano.TokenFile(files.orderBy("shard", "part").first().path)
    assert one.doc_id(0) is None and [one.doc_id(i) for i in range(len(one))] == one.doc_ids()
    assert list(one.tokens(0)) in wanted[None]
    empty = elias_fano.write_token_files(no_docs, WORD_TOKENIZER, 2, elias_fano.new_folder(no_docs))
    assert elias_fano.read_token_files(empty).collect() == []


# repeated passages


def slow_repeats(texts, length):
    """(id, tie, words, removed) by looking at every window."""
    counts = Counter(i for i, _ in texts)
    unique = max(counts.values()) == 1
    order = {}
    for i, t in texts:
        low = -(1 << 63) if i is None else i
        order[low, 0 if unique else xxhash.xxh64_intdigest((t or "").encode(), 42) - ((1 << 64) if xxhash.xxh64_intdigest((t or "").encode(), 42) >= 1 << 63 else 0)] = (i, t)
    seen, out = {}, []
    for place in sorted(order):
        i, t = order[place]
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - length + 1):
            said = tuple(words[s : s + length])
            if said in seen:
                gone.update(range(s, s + length))
            seen.setdefault(said, place)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out += [(i, len(words), len(gone), kept)] * sum(1 for r in texts if r == (i, t))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [7, 20])
def test_repeats_of_odd_texts(docs, no_docs, length):
    found = debruijn.drop_repeats(docs, length, ("n_words", "n_removed", "kept")).collect()
    assert sorted(map(tuple, found), key=str) == slow_repeats(odd_texts(), length)
    assert debruijn.drop_repeats(no_docs, length).collect() == []


def test_repeats_of_random_small_alphabets(spark):
    draw = random.Random(8)
    texts = [(i, " ".join(draw.choice("ab" if i % 3 else "abc") for _ in range(draw.randrange(0, 120)))) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = debruijn.drop_repeats(frame, 8, ("n_words", "n_removed", "kept")).collect()
    assert sorted(map(tuple, found), key=str) == slow_repeats(texts, 8)


def test_removed_runs_and_rows_with_all_columns(docs):
    rows = debruijn.drop_repeats(docs, 20, ("n_removed", "removed")).collect()
    assert all(r.n_removed == sum(x.end - x.start for x in r.removed) for r in rows)
    clean = debruijn.without_repeats(docs, 20)
    assert clean.schema.names == docs.schema.names
    kept = Counter((r.doc_id, r.text) for r in clean.collect())
    texts = odd_texts()
    slow = {(i, k): n for i, _, n, k in slow_repeats(texts, 20)}
    for i, t in kept:
        words = " ".join(WORD.findall(t or ""))
        assert (i, words) in slow
        if slow[i, words] == 0:
            assert (i, t) in texts


# near copies


def slow_print(text, shingle):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lower)
    k = min(shingle, len(words))
    votes, n = [0] * 64, 0
    for s in range(len(words) - k + 1 if words else 0):
        n += 1
        h = xxhash.xxh64_intdigest(" ".join(words[s : s + k]).encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def slow_groups(prints):
    """Least id by union of all pairs at 2 bits or fewer; prints: (id, print)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, p, least.get(root(a))) for a, (i, p) in enumerate(prints)]


def test_near_copies_of_odd_texts(docs, no_docs):
    found = golay.near_groups(docs, 3).collect()
    prints = [(i, slow_print(t or "", 3)) for i, t in odd_texts()]
    got = sorted(((r[0], r[1] % (1 << 64), r[2]) for r in found), key=str)
    assert got == sorted(slow_groups(prints), key=str)
    assert golay.near_groups(no_docs, 3).collect() == []
    kept = golay.representatives(docs, 3)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    wanted = {c for _, _, c in slow_groups(prints)}
    assert sorted(ids, key=str) == sorted(wanted, key=str)
    assert golay.representatives(no_docs, 3).collect() == []


def test_golay_keys_meet_at_two_bits():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for flips in (0, 1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << draw.integers(0, 64, len(a)).astype(np.uint64)
        assert all(set(x) & set(y) for x, y in zip(golay.keys(a), golay.keys(b), strict=True))


def test_golay_decodes_every_word_within_three_bits():
    words = np.random.default_rng(4).integers(0, 1 << 23, 5000).astype(np.uint32)
    errors = golay._error_of()[golay._syndromes(words)]
    assert not golay._syndromes(words ^ errors).any()
    assert max(int(e).bit_count() for e in errors) <= 3


def test_chains_of_links_are_one_group(spark):
    prints = [0]
    for i in range(40):
        prints.append(prints[-1] ^ (3 << (i % 31 * 2)))
    frame = spark.createDataFrame([(f"x{i}",) for i in range(3)], "text string")
    assert frame.count() == 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500)], "a long, b long")
    from loanloom.llm.components import components

    roots = dict(map(tuple, components(edges).collect()))
    assert {roots[i] for i in range(1, 301)} == {0} and roots[2000] == roots[1500] == 1000


def test_links_are_those_of_all_pairs_also_at_crowded_keys(spark):
    draw = np.random.default_rng(11)
    found = set(draw.integers(0, 1 << 64, 40, dtype=np.uint64).tolist())
    for base in list(found)[:12]:  # copies at 0 to 3 bits
        for flips in (1, 2, 3):
            at = draw.choice(64, flips, replace=False)
            found.add(base ^ sum(1 << int(b) for b in at))
    base = int(draw.integers(0, 1 << 63))
    # one key for many that are far apart, and many within a few bits of one
    found |= {base ^ (int(far) << 46) for far in draw.choice(1 << 18, 150, replace=False)}
    found |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i)}
    # a chain of two bits, and one at three bits that has no link
    chain = int(draw.integers(0, 1 << 63))
    found |= {chain, chain ^ 3, chain ^ 15, chain ^ (7 << 40) ^ 15}
    prints = sorted(found)
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    for n, p in enumerate(prints):
        for q in prints[:n]:
            if (p ^ q).bit_count() <= 2:
                a, b = sorted((top(p), top(q)), key=signed.get)
                root[b] = a
    rows = spark.createDataFrame([(v,) for v in signed.values()], "print long")
    edges = [(r.a, r.b) for r in golay.links(rows).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)
    from loanloom.llm.components import components

    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {signed[p]: signed[top(p)] for p in prints if top(p) != p}


def test_longer_keys_meet_at_two_bits():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << draw.integers(0, 64, len(a)).astype(np.uint64))
    b ^= np.uint64(1) << draw.integers(0, 64, len(a)).astype(np.uint64)
    for p, q, x, y in zip(a, b, golay.keys(a), golay.keys(b), strict=True):
        both = np.array(sorted(set(x) & set(y)), np.int64)
        one, two = (golay.longer_keys(np.full(len(both), v), both) for v in (p, q))
        assert any(set(m) & set(n) for m, n in zip(one, two, strict=True))


# benchmark passages


def slow_leaks(texts, items, least):
    out = {}
    for i, t in texts:
        words = decontam.words_of(t or "")
        for item, said in items:
            wanted = decontam.words_of(said or "")
            if not wanted:
                continue
            n, k = len(wanted), min(5, len(wanted))
            bag = Counter(tuple(wanted[s : s + k]) for s in range(n - k + 1))
            spans = [(s, s + n) for s in range(len(words) - n + 1)] or ([(0, len(words))] if len(words) >= k else [])
            for a, b in spans:
                own = Counter(tuple(words[s : s + k]) for s in range(a, b - k + 1))
                shared = sum((own & bag).values())
                alike = shared / (sum(own.values()) + sum(bag.values()) - shared)
                if alike >= least and alike > out.get((i, item), (0,))[0]:
                    out[i, item] = (alike, a)
    return sorted(((i, j, s, a) for (i, j), (s, a) in out.items()), key=str)


def test_benchmark_passages(spark, docs, no_docs):
    draw = random.Random(5)
    words = [f"q{i}" for i in range(300)]
    items = [(k, " ".join(draw.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 12, 30, 30, 44, 70])]
    items += [(50, None), (51, "... !"), (52, items[5][1]), (None, items[7][1])]
    texts = [(-1, None), (-2, "")]
    for i in range(120):
        item = (items[i % len(items)][1] or "").split()
        for _ in range(i // 13 % 5):
            if item:
                item[draw.randrange(len(item))] = "zz"
        body = [draw.choice(words) for _ in range(40)]
        if i % 4:
            body[20:20] = item
        if i % 10 == 1:
            body = item[: int(len(item) * 0.95)]
        text = " ".join(body)
        texts.append((i, text.upper() if i % 5 == 0 else text.replace(" ", ", ")))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, decontam.leaks(frame, bench).collect()), key=str)
    wanted = slow_leaks(texts, items, 0.8)
    assert [f[:2] + f[3:] for f in found] == [w[:2] + w[3:] for w in wanted]
    assert np.allclose([f[2] for f in found], [w[2] for w in wanted])
    clean = {r.doc_id for r in decontam.without_leaks(frame, bench).collect()}
    assert clean == {i for i, _ in texts} - {w[0] for w in wanted}
    assert decontam.without_leaks(docs, bench).schema.names == docs.schema.names
    assert decontam.without_leaks(docs, bench).count() == docs.count()
    assert decontam.leaks(no_docs, bench).collect() == []
    assert decontam.leaks(frame, bench.limit(0)).collect() == []
