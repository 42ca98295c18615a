"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every passage of `PASSAGE` words is encoded from its content (its words and byte trigrams, counted by hash) and its surface
(characters by class, word lengths, repetition within the passage and the document) by two learned layers. Gated attention, a tanh and a sigmoid branch multiplied, gives each
passage a weight; the document is the weighted mean of its passage encodings, and one unit scores it. Encoder, attention
and output are trained together from document labels alone, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, texts_of
from .labelled import held_out, sample, shares

#: At most so many labelled documents of either class are learned from.
PER_CLASS = 2000
PASSAGE = 64
UNITS, GATE = 16, 8
EPOCHS, BATCH, RATE = 40, 64, 0.01

#: Classes of bytes: lower, upper, digit, white, stop mark, symbol, bar, exclamation, other ASCII, start and rest of other characters.
CLASS = np.full(256, 8, np.uint8)
for number, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\f\r", ".,;:?'\"()-", "#*$%&<>", "|", "!")):
    CLASS[np.frombuffer(members.encode(), np.uint8)] = number
CLASS[0xC0:] = 9
CLASS[0x80:0xC0] = 10
CLASSES = 11
#: Numbers that words and byte trigrams are hashed to.
HASHED = 256
SURFACE = CLASSES - 1 + 9
FEATURES = SURFACE + 2 * HASHED


def passages(text: str) -> np.ndarray:
    """One row of features for each passage of the text; an empty text is one passage of zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = len(words)
    count = -(-n // PASSAGE)
    of_word = np.arange(n) // PASSAGE
    kind = CLASS[np.frombuffer(raw, np.uint8)]
    white = kind == 3
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    of_byte = np.repeat(np.arange(count), np.diff([0, *starts[PASSAGE::PASSAGE].tolist(), len(raw)]))
    chars = np.bincount(of_byte * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES)[:, : CLASSES - 1].astype(np.float64)
    size = np.maximum(chars.sum(1, keepdims=True), 1)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    length = np.fromiter(map(len, words), np.float64, n)
    per = np.bincount(of_word)
    share = lambda flag: np.bincount(of_word, flag, count) / per
    order = np.lexsort((h, of_word))
    fresh = np.ones(n)
    fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (of_word[order[1:]] != of_word[order[:-1]])
    first = np.zeros(n)
    first[np.unique(h, return_index=True)[1]] = 1
    same = np.concatenate([[0.0], h[1:] == h[:-1]])
    pair = mix64(h ^ mix64(np.concatenate([h[1:], h[:1]])))
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    again = (times[inverse] > 1).astype(float)
    head = kind[starts]
    some_words = np.bincount(of_word * HASHED + (h >> np.uint64(56)).astype(np.int64), minlength=count * HASHED)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    tri = ((b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    some_grams = np.bincount(of_byte[: len(tri)] * HASHED + tri, minlength=count * HASHED)
    return np.concatenate(
        [
            np.log1p(some_words.reshape(count, HASHED)),
            np.log1p(some_grams.reshape(count, HASHED)),
            chars / size,
            np.stack([share(fresh), share(first), share(same), share(again), share(length <= 3), share(length >= 14), share(head == 1), share(length) / 10, np.full(count, np.log1p(n) / 10)], axis=1),
        ],
        axis=1,
    ).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The network; `mean` and `spread` standardise the features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.spread = mean, spread
        self.p = {"w1": f(FEATURES, UNITS), "b1": np.zeros(UNITS), "w2": f(UNITS, UNITS), "b2": np.zeros(UNITS), "v": f(UNITS, GATE), "u": f(UNITS, GATE), "a": f(GATE), "out": f(UNITS), "base": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray):
        """Rows of passages, where each document's begin, the document of each -> logits, and what backward() needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h1 = np.tanh(x @ p["w1"] + p["b1"])
        h = np.tanh(h1 @ p["w2"] + p["b2"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        w = np.exp(e - np.maximum.reduceat(e, starts)[of])
        w /= np.add.reduceat(w, starts)[of]
        z = np.add.reduceat(w[:, None] * h, starts)
        return z @ p["out"] + p["base"], (x, h1, h, t, s, w, z)

    def backward(self, slope: np.ndarray, memory, starts: np.ndarray, of: np.ndarray) -> dict:
        p, (x, h1, h, t, s, w, z) = self.p, memory
        g = {"out": z.T @ slope, "base": np.array([slope.sum()])}
        dz = (slope[:, None] * p["out"])[of]
        dw = (dz * h).sum(1)
        de = w * (dw - np.add.reduceat(w * dw, starts)[of])
        g["a"] = (t * s).T @ de
        dts = de[:, None] * p["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (w[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        g["w2"], g["b2"] = h1.T @ dh, dh.sum(0)
        d1 = (dh @ p["w2"].T) * (1 - h1**2)
        g["w1"], g["b1"] = x.T @ d1, d1.sum(0)
        return g


def bags(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes[:-1])]), np.repeat(np.arange(len(rows)), sizes)


class Quality:
    def __init__(self, network: Attention | None, share: float):
        self.network, self.share = network, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return sigmoid(self.network.forward(*bags([passages(t) for t in texts]))[0]) if texts else np.empty(0)


def train(labelled: list[tuple[str, int]], share: dict[int, float]) -> Quality:
    """Learn from (text, label) pairs whose classes are weighted to `share`; of one class or none, every text scores that."""
    y = np.array([label for _, label in labelled], float)
    if len(set(y.tolist())) < 2:
        return Quality(None, share.get(1, 0.0))
    rows = [passages(t) for t, _ in labelled]
    every = np.concatenate(rows)
    network = Attention(every.mean(0), every.std(0) + 0.02)
    weight = np.where(y > 0, share[1] / y.mean(), share[0] / (1 - y.mean()))
    rng = np.random.default_rng(3)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            x, starts, of = bags([rows[i] for i in at])
            logit, memory = network.forward(x, starts, of)
            g = network.backward((sigmoid(logit) - y[at]) * weight[at] / len(at), memory, starts, of)
            step += 1
            for k, v in g.items():  # Adam, with a little weight decay
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                network.p[k] -= RATE / (1 + epoch / 10) * ((m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) + 1e-3 * network.p[k])
    return Quality(network, share[1])


def score(docs: DataFrame, model: Quality, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. A null text is the empty text, which has a score too.

    Rows are independent: repeated rows score alike, a null doc_id stays null (and counts as held out), an empty table
    gives an empty one. Other columns of docs are left behind, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    @lean
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            out, at = [], 0
            while at < len(texts):  # about a megabyte of text at a time
                to, size = at, 0
                while to < len(texts) and size < 1_000_000:
                    size += len(texts[to])
                    to += 1
                out.append(sent.value.scores(texts[at:to]))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """`score` with a model learned from at most `per_class` labelled documents of either class, never from held-out ones.

    Labels that are null, or that mark one document both ways, aren't learned from; without labels of both classes every
    text scores the share of the one that is there (0 without any). Empty tables of either kind are allowed.
    """
    return score(docs, train(sample(docs, labels, label, per_class), shares(labels, label)))
