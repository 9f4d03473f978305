"""The pipeline against brute-force versions of its stages, and its stages on odd input."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from loanloom.llm import golay, noisy_or
from loanloom.llm.common import table
from loanloom.llm.queries import PIECE_MODEL, TOXIC, training_labels

from .conftest import SF_DIR
from .test_texts import WORD, slow_groups, slow_leaks, slow_print, slow_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_as_agreed():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    model = noisy_or.fit(docs, training_labels(spark, SF_DIR))
    left = {r.doc_id: r.text for r in docs.collect() if model.score(r.text or "") < TOXIC}
    assert 0 < len(left) < docs.count()

    groups = slow_groups([(i, slow_print(t, 3)) for i, t in sorted(left.items())])
    left = {i: left[i] for i, _, least in groups if i == least}

    cut = slow_repeats(sorted(left.items()), 20)
    assert any(removed for _, _, removed, _ in cut)
    left = {i: kept if removed else left[i] for i, _, removed, kept in cut}

    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    leaks = {i for i, *_ in slow_leaks(sorted(left.items()), items, 0.8)}
    left = {i: t for i, t in left.items() if i not in leaks}

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    wanted = {}
    for i, t in left.items():
        ids = library.encode(t, add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        wanted[i] = (ids, hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: (r.ids, r.ids_sha256, r.decoded_sha256) for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_stages_keep_the_columns_and_take_odd_rows(spark, docs, no_docs):
    documents = table(spark, SF_DIR, "documents").columns
    assert documents == COLUMNS
    for rows in (docs, no_docs):
        before = rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, rows, SF_DIR)
            assert after.schema.names == rows.schema.names, name
            assert after.count() <= before, name
        tokens = corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR)
        assert tokens.count() == before
    clean = corpus_pipeline.substring_dedup(spark, docs, SF_DIR)
    changed = clean.where(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).count()
    assert changed == 0
    assert WORD.findall("a b") == ["a", "b"]


def test_one_row_of_a_group_whose_least_id_is_null_or_repeated(spark):
    words = [f"w{i}" for i in range(400)]
    first = " ".join(words)
    near = (" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(400))
    near = next(t for t in near if 1 <= (golay.fingerprint(first, 3) ^ golay.fingerprint(t, 3)).bit_count() <= 2)
    alone = "another text of its own"
    for ids in ((None, None), (1, 1), (None, 1), (1, 2)):
        rows = [(ids[0], first), (ids[1], near), (ids[0], first), (ids[0], alone)]
        kept = golay.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.text == alone for r in kept) == [False, True], ids
        assert all(r.doc_id == min((i for i in ids if i is not None), default=None) for r in kept if r.text != alone)
