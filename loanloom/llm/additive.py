"""Quality by a generalised additive model with pairwise interactions.

Every text is described by the numbers in FEATURES. Each number falls into one of at most 64
bins, and the log-odds of good quality are a sum of table entries: one table per feature, then
one per chosen pair of features. The tables are learnt by cyclic boosting: in turn each feature
gets a tree of at most three leaves, fitted to the gradients of its bins alone, times a small
rate. Pairs are ranked by how much a tree of one cut on each axis gains on what the single
features leave, and the best get tables in the same way. Scoring adds up bins, for a whole batch
at once.

It is trained on about `per_class` labelled documents of each label, weighted back to the share
that labels have. Null and empty texts have 0 for every feature. Repeated rows score alike.
Without labels of both kinds every score is the share of the one there is, or 0.5. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import balanced_sample, id_and_text, map_texts, sigmoid

PER_CLASS = 5000
BINS, PAIR_BINS = 64, 12
PAIRS = 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = (
    "log_words", "word_length", "longest_word", "distinct_share", "top_word_share",
    "adjacent_equal", "symbol_share", "bar_share", "digit_share", "upper_share", "beyond_ascii",
    "words_per_stop", "line_words", "repeated_lines", "stop_share",
)

_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STOPS, _MARKS = b".!?", b".,!?;:'\"-()"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def describe(text: str) -> list[float]:
    """The numbers of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stops = _count(raw, _STOPS)
    ascii_only = len(raw.translate(None, bytes(range(128, 256))))
    return [
        float(np.log1p(n)),
        letters / n,
        float(min(1000, max(map(len, words)))),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        _count(raw, _SYMBOLS) / letters,
        raw.count(b"|") / n,
        _count(raw, _DIGITS) / letters,
        _count(raw, _UPPER) / letters,
        1.0 - ascii_only / len(raw),
        n / (1 + stops),
        n / max(1, len(lines)),
        1.0 - len(set(lines)) / max(1, len(lines)),
        stops / letters,
    ]


@dataclass
class Additive:
    """Cut points and tables."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cut, x[:, j], "right")]
        for j, k, values in self.pairs:
            a = np.searchsorted(self.pair_cuts[j], x[:, j], "right")
            b = np.searchsorted(self.pair_cuts[k], x[:, k], "right")
            z += values[a, b]
        return sigmoid(z)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A tree of at most three leaves over ordered bins: the value of each bin."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    spans = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in spans:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (a, b), a + i + 1)
        if best[1] is None:
            break
        (a, b), cut = best[1], best[2]
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
        for lo, hi in ((a, cut), (cut, b)):
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis: its gain and the value of each cell."""
    cg, ch = (np.cumsum(np.cumsum(t, 0), 1) for t in (g, h))
    best, cell = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, cell
    i, j = np.meshgrid(np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1), indexing="ij")

    def corner(t):
        a, top, left, all_ = t[i, j], t[i, -1], t[-1, j], t[-1, -1]
        return np.stack([a, top - a, left - a, all_ - top - left + a])

    qg, qh = corner(cg), corner(ch)
    gain = (qg**2 / (qh + ridge)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = qg[:, a, b] / (qh[:, a, b] + ridge)
    cell[: a + 1, : b + 1], cell[: a + 1, b + 1 :] = values[0], values[1]
    cell[a + 1 :, : b + 1], cell[a + 1 :, b + 1 :] = values[2], values[3]
    return float(gain[a, b]), cell


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
    """Learn the tables from features, labels and weights of rows."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if len(set(y)) < 2:
        return Additive(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    model = Additive(float(np.log(share / (1 - share))))
    z = np.full(len(y), model.base)
    width = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(width)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    for _ in range(ROUNDS):
        for j in range(width):
            p = sigmoid(z)
            size = len(model.tables[j])
            g = np.bincount(bins[j], weight * (y - p), size)
            h = np.bincount(bins[j], weight * p * (1 - p), size)
            step = RATE * _leaves(g, h)
            model.tables[j] += step
            z += step[bins[j]]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]

    def grid(j, k, values):
        shape = len(model.pair_cuts[j]) + 1, len(model.pair_cuts[k]) + 1
        return np.bincount(bins[j] * shape[1] + bins[k], values, shape[0] * shape[1]).reshape(shape)

    p = sigmoid(z)

    def quarters(j, k, p):
        return _quarters(grid(j, k, weight * (y - p)), grid(j, k, weight * p * (1 - p)))

    ranked = sorted((-quarters(j, k, p)[0], j, k) for j, k in combinations(range(width), 2))
    chosen = [(j, k) for _, j, k in ranked[:PAIRS]]
    tables = {c: np.zeros_like(grid(*c, weight)) for c in chosen}
    for _ in range(PAIR_ROUNDS):
        for j, k in chosen:
            step = RATE * quarters(j, k, sigmoid(z))[1]
            tables[j, k] += step
            z += step[bins[j], bins[k]]
    model.pairs = [(j, k, tables[j, k]) for j, k in chosen]
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
) -> Additive:
    """Train on about per_class documents of each label; only their features reach the driver."""
    known = labels.where(F.col(label).isNotNull()).groupBy((F.col(label) != 0).cast("int").alias("y"))
    totals = {r[0]: r[1] for r in known.count().collect()}
    chosen = balanced_sample(labels, label, key, per_class)
    sample = (
        id_and_text(docs, key, text)
        .join(F.broadcast(chosen), key)
        .select((F.col(label) != 0).cast("long").alias("y"), text)
    )

    def make():
        return lambda ys, texts: (ys, [describe(t) for t in texts])

    rows = map_texts(sample, make, "y long, x array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    y = np.array([r.y for r in rows], float)
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    weight = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            weight[y == k] = totals[k] / (y == k).sum()
    if len(y):
        weight *= len(y) / weight.sum()
    return train(x, y, weight)


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        tool = held.value

        def step(keys, texts):
            x = np.array([describe(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            return keys, tool.score(x)

        return step

    return map_texts(id_and_text(docs, key, text), make, f"{key} long, score double")
