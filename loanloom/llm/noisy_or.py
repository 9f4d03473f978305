"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence is a run of text without a full stop, exclamation mark, question mark or line break.
Its score is a logistic function of the weights of its words; a word's weight is the sum of
those of the word and of its five-letter pieces. A document is toxic if any sentence is:

    P(document) = 1 - product over sentences of (1 - P(sentence))

The weights are trained by gradients of the document labels through that product, on about
`per_class` labelled documents of each label. Which words and pieces get a weight is settled by
counting, over those documents, in how many of each label they occur. Scoring looks at all of
every text and names the offending sentences.

Null and empty texts have one empty sentence. Repeated rows score alike. Without labels of both
kinds nothing is learnt and every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import balanced_sample, id_and_text, map_texts, pieces, sigmoid

PIECE = 5
PER_CLASS = 2500
#: A feature gets a weight if its share among toxic documents is this many deviations above.
DEVIATIONS = 5.0
MOST_FEATURES = 5000
ROUNDS = 1500
KEPT_WORDS = 300_000
_STOPS = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> set[str]:
    """The word itself and its pieces, with marks where it begins and ends."""
    marked = f"<{word}>"
    return {marked, *(marked[i : i + PIECE] for i in range(len(marked) - PIECE + 1))}


@dataclass
class NoisyOr:
    """Weights by feature and the score of a sentence without any."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        known = self.words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return known

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence."""
        out, start = [], 0
        ends = [(m.start(), m.end()) for m in _STOPS.finditer(text)] + [(len(text), len(text))]
        # lower case may have another length, but has the same stops
        for (end, after), sentence in zip(ends, _STOPS.split(text.lower()), strict=True):
            z = self.bias
            for w in set(_WORD.findall(sentence)):
                found = self.words.get(w)
                z += self.word(w) if found is None else found
            out.append((start, end, z))
            start = after
        return out

    def score(self, text: str) -> float:
        z = np.array([s[2] for s in self.sentences(text)])
        return float(-np.expm1(-np.logaddexp(0.0, z).sum()))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
) -> NoisyOr:
    """Train on about per_class documents of each label; texts never leave the tasks."""
    known = labels.where(F.col(label).isNotNull()).groupBy((F.col(label) != 0).cast("int").alias("y")).count()
    totals = {r[0]: r[1] for r in known.collect()}
    chosen = balanced_sample(labels, label, key, per_class)
    sample = (
        id_and_text(docs, key, text)
        .join(F.broadcast(chosen), key)
        .select(F.col(label).cast("long").alias("y"), text)
    )

    def count(ys, texts):
        seen = {0: Counter(), 1: Counter()}
        for y, t in zip(ys, texts, strict=True):
            seen[1 if y else 0].update(set().union(*map(features, set(_WORD.findall(t.lower())))))
        names = sorted(seen[0].keys() | seen[1].keys())
        return names, [seen[0][n] for n in names], [seen[1][n] for n in names]

    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("y") != 0).cast("int").alias("y")).count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return NoisyOr({}, -np.inf)
    counted = (
        map_texts(sample, lambda: count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    p0, p1 = F.col("clean") / n0, F.col("toxic") / n1
    mean = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    spread = F.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1))
    telling = (
        counted.where("toxic >= 5 and clean + toxic < " + str(n0 + n1))
        .withColumn("z", (p1 - p0) / spread)
        .where(F.col("z") >= DEVIATIONS)
        .orderBy(F.desc("z"), "feature")
        .limit(MOST_FEATURES)
    )
    names = [r.feature for r in telling.collect()]
    at = {n: i for i, n in enumerate(names)}
    held = docs.sparkSession.sparkContext.broadcast(at)

    def bags(ys, texts):
        empty, found = [], []
        for t in texts:
            sentences = [
                sorted({held.value[f] for w in set(_WORD.findall(s)) for f in features(w) if f in held.value})
                for s in _STOPS.split(t.lower())
            ]
            empty.append(sum(not s for s in sentences))
            found.append([s for s in sentences if s])
        return ys, empty, found

    rows = map_texts(sample, lambda: bags, "y long, empty long, sentences array<array<int>>").collect()
    rows.sort(key=lambda r: (r.y, r.empty, r.sentences))
    weights, bias = train(
        np.array([r.y != 0 for r in rows], float),
        np.array([r.empty for r in rows], float),
        [r.sentences for r in rows],
        len(names),
        totals[1] / (totals[0] + totals[1]),
    )
    return NoisyOr({n: float(w) for n, w in zip(names, weights, strict=True)}, bias)


def train(
    y: np.ndarray,
    empty: np.ndarray,
    bags: list[list[list[int]]],
    n: int,
    share: float = 0.5,
    rounds: int = ROUNDS,
    decay: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradients with steps scaled per weight.

    empty: sentences of a document without features; bags: the features of the others. Toxic
    documents count for `share` of the whole, however many of each label there are here.
    """
    document = np.repeat(np.arange(len(y)), [len(b) for b in bags])
    sizes = np.array([len(s) for b in bags for s in b], np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.array([f for b in bags for s in b for f in s], np.int64)
    worth = np.where(y > 0, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum()))
    w, bias = np.zeros(n), -4.0
    squares, bias_square = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(sentence, w[feature], len(sizes))
        clean = np.bincount(document, np.logaddexp(0.0, z), len(y)) + empty * np.logaddexp(0.0, bias)
        p = np.maximum(-np.expm1(-clean), 1e-12)
        # d loss / d z of a sentence is p_sentence times this factor of its document
        factor = worth * np.where(y > 0, -(1.0 - p) / p, 1.0)
        pull = sigmoid(z) * factor[document]
        slope = np.bincount(feature, pull[sentence], n) + decay * w / len(y)
        bias_slope = pull.sum() + (factor * empty).sum() * sigmoid(np.array(bias))
        squares += slope**2
        bias_square += bias_slope**2
        w -= 0.4 * slope / np.sqrt(squares)
        bias -= 0.5 * float(bias_slope) / np.sqrt(float(bias_square))
    return w, float(bias)


def score(docs: DataFrame, model: NoisyOr, spans: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every whole text; with spans, also its sentences of probability 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    schema = f"{key} long, score double" + ", offending array<struct<start:int,end:int,score:double>>" * spans

    def make():
        tool = NoisyOr(*held.value)

        def step(keys, texts):
            if not spans:
                return keys, [tool.score(t) for t in texts]
            parts = [tool.sentences(t) for t in texts]
            marked = [
                [{"start": a, "end": b, "score": float(sigmoid(np.array(z)))} for a, b, z in p if z >= 0]
                for p in parts
            ]
            return keys, [tool.score(t) for t in texts], marked

        return step

    return map_texts(id_and_text(docs, key, text), make, schema)


def without_toxic(docs: DataFrame, model: NoisyOr, least: float, text: str = "text") -> DataFrame:
    """The documents, all columns as they are, that score below `least`."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = NoisyOr(*held.value)
        for batch in batches:
            for piece in pieces(batch, at):
                scores = [tool.score(t or "") for t in piece.column(at).to_pylist()]
                yield piece.filter(pa.array([s < least for s in scores], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
