"""Operators that learn: held-out accuracy, gradients, and odd input."""

import duckdb
import numpy as np
import pytest

from loanloom.llm import additive, byte_gru, noisy_or
from loanloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def results(spark, name, column):
    """Held-out rows of a query with the label: (label, prediction)."""
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    source = "documents" if column == "lang" else "labels"
    truth = duckdb.sql(f"SELECT doc_id, {column} AS label FROM '{SF_DIR}/{source}.parquet'").df()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{SF_DIR}/documents.parquet'").fetchall()[0][0]
    assert rows.score.between(0, 1).all()
    return rows.merge(truth.dropna(), on="doc_id").query("held_out")


def test_language_of_held_out_documents(spark):
    rows = results(spark, "op3_language", "lang")
    assert len(rows) > 100 and (rows.lang_pred == rows.label).mean() > 0.97


def test_toxicity_of_held_out_documents(spark):
    rows = results(spark, "op6_toxicity", "toxic")
    toxic = rows[rows.label == 1]
    assert (toxic.predicted == 1).mean() > 0.6  # a few dozen toxic documents to learn from
    assert (rows[rows.label == 0].predicted == 0).mean() > 0.95
    assert set(rows.predicted) <= {0, 1} and (rows.predicted == (rows.score >= 0.3)).all()


def test_quality_of_held_out_documents(spark):
    rows = results(spark, "op8_quality", "quality")
    assert (rows.predicted == rows.label).mean() > 0.95


def test_odd_texts_get_scores(docs, no_docs, spark):
    model = noisy_or.NoisyOr({"<w5>": 9.0, "<w6>": 9.0}, -6.0)
    rows = noisy_or.score(docs, model, spans=True).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].score == by_id[2].score == pytest.approx(1 / (1 + np.exp(6)))
    assert by_id[11].score > 0.9 and by_id[11].offending[0].score > 0.5
    assert noisy_or.without_toxic(docs, model, 0.3).schema.names == docs.schema.names
    assert noisy_or.score(no_docs, model).collect() == []

    rows = additive.score(docs, additive.train(np.zeros((0, 15)), np.zeros(0), np.zeros(0))).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.5}

    net = byte_gru.ByteGru.new(["aa", "bb"])
    by_id = {r.doc_id: r for r in byte_gru.predict(docs, net).collect()}
    assert (by_id[1].lang_pred, by_id[1].score) == ("und", 0.0)
    assert by_id[2].lang_pred == by_id[3].lang_pred == "und"
    assert by_id[14].lang_pred in ("aa", "bb") and 0.4 < by_id[11].score <= 1
    assert byte_gru.predict(no_docs, net).collect() == []


def test_nothing_to_learn_from(docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, toxic int, quality int")
    model = noisy_or.fit(docs, labels)
    assert {r.score for r in noisy_or.score(docs, model).collect()} == {0.0}
    assert {round(r.score) for r in additive.score(docs, additive.fit(docs, labels)).collect()} == {1}
    assert {r.lang_pred for r in byte_gru.predict(docs, byte_gru.fit(no_docs)).collect()} == {"und"}


def test_gradients_of_the_network():
    draw = np.random.default_rng(0)
    net = byte_gru.ByteGru.new(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, lengths = byte_gru.as_matrix([b"abc", b"d", "é".encode()])
    label = np.array([0, 1, 2])
    _, grads = net.gradients(data, lengths, label)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(draw.integers(0, s)) for s in g.shape)
            if name == "embed":
                at = (int(draw.choice(data[0])), at[1])
            step, keep = 1e-3, net.weights[name][at]
            losses = []
            for d in (step, -step):
                net.weights[name][at] = keep + d
                losses.append(net.gradients(data, lengths, label)[0])
            net.weights[name][at] = keep
            assert g[at] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=2e-3)


def test_noisy_or_finds_the_telling_sentence():
    draw = np.random.default_rng(1)
    bags, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        bag = [sorted(draw.choice(range(1, 30), 3, replace=False).tolist()) for _ in range(5)]
        if toxic:
            bag[2] = [0, *bag[2]]
        bags.append(bag)
        y.append(float(toxic))
    weights, bias = noisy_or.train(np.array(y), np.zeros(400), bags, 30)
    assert weights[0] > 4 > np.abs(weights[1:]).max() and bias < -3


def test_additive_model_needs_its_pairs():
    draw = np.random.default_rng(2)
    x = draw.random((4000, 15))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = additive.train(x, y, np.ones(len(y)))
    assert model.pairs[0][:2] == (3, 7)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_toxic_capitals_beside_a_letter_whose_lower_case_is_longer():
    model = noisy_or.NoisyOr({"<bad>": 9.0}, -5.0)
    text = "İİ. BADΣ! Bad words.\nEnd"
    assert model.score("İ. BAD") == model.score("x. bad") > 0.9
    found = model.sentences(text)
    assert [text[a:b] for a, b, _ in found] == ["İİ", " BADΣ", " Bad words", "End"]
    assert [z for _, _, z in found] == [-5.0, -5.0, 4.0, -5.0]
