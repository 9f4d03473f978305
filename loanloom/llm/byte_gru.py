"""Language of a text by a bidirectional gated recurrent network over bytes.

A text is lower-cased and read word by word; a word is a run of letters as UTF-8 bytes, with a
space before and after it. Two recurrent layers, one in each direction, give a state for every
byte, and a softmax labels every position. The probability of a language in a document is the
mean over its positions. States start anew at each word, so equal words are labelled once and
kept in a bounded table; words longer than WORD_BYTES are read in parts of that length.

Training is backpropagation through time in numpy, with Adam, on words of about `per_class`
documents of each language; a document gives at most SAMPLE_WORDS words, spread over all of it.

Null texts and texts without a letter are `und` with score 0. Repeated rows are labelled alike.
If nothing can be learnt, every text is `und`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import balanced_sample, id_and_text, map_texts

PER_CLASS = 400
SAMPLE_WORDS = 120
WORD_BYTES = 24
UNITS, EMBEDDING = 24, 12
STEPS, BATCH = 900, 256
KEPT_WORDS = 300_000
UNKNOWN = "und"
#: Everything in ASCII that is no letter parts words.
_PARTS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[bytes]:
    raw = text.lower().encode("utf-8", "replace").translate(_PARTS).split()
    if max(map(len, raw), default=0) <= WORD_BYTES:
        return raw
    return [w[i : i + WORD_BYTES] for w in raw for i in range(0, len(w), WORD_BYTES)]


def as_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, a space before and after, filled up with zeros; and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    width = int(lengths.max()) if len(words) else 0
    flat = b"".join((b" " + w + b" ").ljust(width, b"\0") for w in words)
    return np.frombuffer(flat, np.uint8).reshape(len(words), width), lengths


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class ByteGru:
    """Weights: an embedding, then for each direction input, recurrent and bias, then the labels."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> ByteGru:
        draw = np.random.default_rng(seed)

        def w(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        weights = {
            "embed": w(256, EMBEDDING) * 4,
            "out": w(2 * UNITS, len(languages)),
            "out_b": np.zeros(len(languages), np.float32),
        }
        for d in "fb":
            weights |= {
                f"{d}_x": w(EMBEDDING, 3 * UNITS),
                f"{d}_h": w(UNITS, 3 * UNITS),
                f"{d}_b": np.zeros(3 * UNITS, np.float32),
            }
        return cls(languages, weights)

    def _direction(self, d: str, steps: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction; steps: (time, rows, 3 units) of input, mask: (time, rows, 1)."""
        recurrent = self.weights[f"{d}_h"]
        time, rows, _ = steps.shape
        h = np.zeros((rows, UNITS), np.float32)
        states, tape = np.empty((time, rows, UNITS), np.float32), []
        order = range(time) if d == "f" else range(time - 1, -1, -1)
        u = UNITS
        for t in order:
            rec = h @ recurrent
            gates = _logistic(steps[t, :, : 2 * u] + rec[:, : 2 * u])
            z, r = gates[:, :u], gates[:, u:]
            c = np.tanh(steps[t, :, 2 * u :] + r * rec[:, 2 * u :])
            new = h + mask[t] * (1 - z) * (c - h)
            if keep:
                tape.append((t, h, z, r, c, rec[:, 2 * u :]))
            states[t] = h = new
        return states, tape

    def _inputs(self, d: str) -> np.ndarray:
        """What each byte adds to the gates."""
        return self.weights["embed"] @ self.weights[f"{d}_x"] + self.weights[f"{d}_b"]

    def forward(self, data: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probabilities (time, rows, languages) and the mask of real positions."""
        mask = (np.arange(data.shape[1])[:, None] < lengths[None, :]).astype(np.float32)[:, :, None]
        seen, tapes = [], {}
        for d in "fb":
            states, tapes[d] = self._direction(d, self._inputs(d)[data.T], mask, keep)
            seen.append(states)
        both = np.concatenate(seen, axis=2)
        logits = both @ self.weights["out"] + self.weights["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, mask, both, tapes

    def gradients(
        self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray
    ) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        p, mask, both, tapes = self.forward(data, lengths, True)
        count = mask.sum()
        chosen = p[:, np.arange(len(label)), label]
        loss = float(-(np.log(chosen + 1e-12) * mask[:, :, 0]).sum() / count)
        slope = p.copy()
        slope[:, np.arange(len(label)), label] -= 1
        slope *= mask / count
        grads = {"out": np.tensordot(both, slope, ((0, 1), (0, 1))), "out_b": slope.sum((0, 1))}
        back = slope @ self.weights["out"].T
        grads["embed"] = np.zeros_like(self.weights["embed"])
        u = UNITS
        for i, d in enumerate("fb"):
            w = self.weights
            g_h, g_in = np.zeros_like(w[f"{d}_h"]), np.zeros((256, 3 * u), np.float32)
            carry = np.zeros((len(label), u), np.float32)
            for t, h, z, r, c, rec in reversed(tapes[d]):
                dh = carry + back[t, :, i * u : (i + 1) * u]
                step = dh * mask[t]
                dc = step * (1 - z) * (1 - c * c)
                dz = -step * (c - h) * z * (1 - z)
                dr = dc * rec * r * (1 - r)
                gates = np.concatenate([dz, dr, dc * r], axis=1)
                g_h += h.T @ gates
                np.add.at(g_in, data[:, t], np.concatenate([dz, dr, dc], axis=1))
                carry = dh - step * (1 - z) + gates @ w[f"{d}_h"].T
            grads[f"{d}_h"] = g_h
            grads[f"{d}_x"] = w["embed"].T @ g_in
            grads[f"{d}_b"] = g_in.sum(0)
            grads["embed"] += g_in @ w[f"{d}_x"].T
        return loss, grads

    def train(
        self, words: list[bytes], label: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 3
    ) -> None:
        """Adam over batches of words of about equal length."""
        data, lengths = as_matrix(words)
        by_length = np.argsort(lengths, kind="stable")
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for n in range(1, steps + 1):
            at = int(draw.integers(0, max(1, len(words) - 4 * BATCH)))
            rows = draw.choice(by_length[at : at + 4 * BATCH], BATCH)
            rows = np.concatenate([rows[: BATCH // 2], draw.integers(0, len(words), BATCH // 2)])
            width = int(lengths[rows].max())
            _, grads = self.gradients(data[rows, :width], lengths[rows], label[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2.0 * (1 - n / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                grown = np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8
                self.weights[k] = (self.weights[k] - now * first[k] / (1 - 0.9**n) / grown).astype(np.float32)

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Sum over the positions of each word of the probabilities."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), 2048):
            some = order[i : i + 2048]
            p, mask, _, _ = self.forward(*as_matrix([words[j] for j in some]))
            out[some] = (p * mask).sum(0)
        return out


class Labeller:
    """Labels texts with a network; word results are kept."""

    def __init__(self, net: ByteGru):
        self.net = net
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(net.languages)), np.float32)

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        parts = [words_of(t) for t in texts]
        if not self.net.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.place) > KEPT_WORDS:
            self.place, self.sums = {}, self.sums[:0]
        place = self.place
        new = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in place]
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.net.word_sums(new)])
        names, scores = [], []
        for text, words in zip(texts, parts, strict=True):
            if not words or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            total = self.sums[at].sum(0, dtype=np.float64)
            best = int(np.argmax(total))
            names.append(self.net.languages[best])
            scores.append(float(min(1.0, total[best] / total.sum())))
        return names, scores


def fit(
    labelled: DataFrame,
    label: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    per_class: int = PER_CLASS,
) -> ByteGru:
    """Train on the rows given, of which about per_class of each language are used."""
    chosen = balanced_sample(labelled.where(F.col(text).isNotNull()), label, key, per_class)
    chosen = chosen.withColumnRenamed(label, "language")
    sample = id_and_text(labelled, key, text).join(F.broadcast(chosen), key).select("language", text)

    def make():
        def step(names, texts):
            some = []
            for t in texts:
                words = words_of(t)
                some.append(words[:: -(-len(words) // SAMPLE_WORDS) or 1])
            return names, some

        return step

    rows = map_texts(sample, make, "language string, words array<binary>").collect()
    pairs = sorted((r.language, bytes(w)) for r in rows for w in r.words)
    languages = sorted({p[0] for p in pairs})
    net = ByteGru.new(languages)
    if languages:
        at = {name: i for i, name in enumerate(languages)}
        net.train([p[1] for p in pairs], np.array([at[p[0]] for p in pairs]))
    return net


def predict(docs: DataFrame, net: ByteGru, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Label and score of every whole text: columns lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda keys, texts, tool=Labeller(held.value): (keys, *tool.label(texts))

    return map_texts(id_and_text(docs, key, text), make, f"{key} long, lang_pred string, score double")
