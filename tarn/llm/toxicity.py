"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the sum of two inputs: an embedding of its hash, and the mean of embeddings of its character n-grams and
prefixes. A token of over `LONGEST` bytes enters as several such words, so that all of it is read. The network reads windows of `WINDOW` words in both directions, attention pools the states and one unit scores
the window. Windows overlap by half and cover the whole text; a document's score is calibrated from its highest windows.

Labels are of documents, so training alternates: the network scores all windows of the training documents, the highest of
a toxic document and the highest of a clean one become examples (in the first round, the windows with the most telling
words by log-odds), and it is trained on these.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts_of
from .labelled import held_out, sample

#: At most so many labelled documents of either class are learned from.
PER_CLASS = 1500
WINDOW, STEP = 24, 12
HIDDEN, WIDTH = 8, 12
WORDS, GRAMS = 1 << 13, 1 << 13
LONGEST = 20
ROUNDS, EPOCHS, BATCH, RATE = 4, 4, 128, 0.02
CACHE_WORDS = 250_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¡¿"
RUNS = re.compile(f"[{re.escape(EDGES)}]+|[^{re.escape(EDGES)}]+")


def cut(token: str) -> list[bytes]:
    """A long token in pieces of at most LONGEST bytes: its runs with and without punctuation, long ones overlapping by about half."""
    out = []
    for run in RUNS.findall(token):
        raw, at = run.encode("utf-8", "surrogatepass"), 0
        while True:
            to = at + LONGEST
            while to < len(raw) and raw[to] & 0xC0 == 0x80:  # pieces are of whole characters
                to -= 1
            out.append(raw[at:to])
            if to >= len(raw):
                break
            at += LONGEST // 2
            while raw[at] & 0xC0 == 0x80:
                at -= 1
    return out


def words_of(text: str) -> list[str | bytes]:
    """Lowered words of a text; tokens of over LONGEST bytes (less punctuation at their ends) are there as their pieces."""
    words = text.lower().split()
    sure = LONGEST if text.isascii() else LONGEST // 4  # so many characters are never too long
    if max(map(len, words), default=0) <= sure:
        return words
    out = []
    for w in words:
        if len(w) > sure and len((bare := w.strip(EDGES)).encode("utf-8", "surrogatepass")) > LONGEST:
            out += cut(bare)
        else:
            out.append(w)
    return out


def word_inputs(words: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed inputs of `words_of` texts: the word's number, and numbers of its byte trigrams and prefixes (-1 where there is none)."""
    raw = [w if isinstance(w, bytes) else w.strip(EDGES).encode("utf-8", "surrogatepass") for w in words]
    n = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(r.ljust(LONGEST, b"\0") for r in raw), np.uint8).reshape(len(raw), LONGEST).astype(np.uint64)
    prime, mixed = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    prefix = np.empty_like(b)
    state = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for i in range(LONGEST):
        state = (state ^ b[:, i]) * prime
        prefix[:, i] = state
    scatter = lambda x, size: ((x * mixed) >> np.uint64(40)).astype(np.int64) % size
    whole = scatter(prefix[np.arange(len(raw)), np.maximum(n - 1, 0)], WORDS)
    whole[n == 0] = 0
    tri = scatter((b[:, :-2] * np.uint64(65599) + b[:, 1:-1]) * np.uint64(65599) + b[:, 2:] + np.uint64(1), GRAMS)
    tri[np.arange(LONGEST - 2) + 3 > n[:, None]] = -1
    heads = scatter(prefix[:, 2:9], GRAMS)
    heads[np.arange(3, 10) > n[:, None]] = -1
    return whole, np.concatenate([tri, heads], axis=1).astype(np.int32)


def summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of `values` added up by their number `at`."""
    return np.stack([np.bincount(at, v, size) for v in values.T], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        h = HIDDEN
        self.p = {
            "word": f(WORDS, WIDTH, scale=0.1),
            "gram": f(GRAMS, WIDTH, scale=0.3),
            "in": f(WIDTH, 6 * h),  # both directions: update, reset and new gates
            "bias": np.zeros(6 * h, np.float32),
            "rec": f(2, h, 3 * h),
            "att": f(2 * h, h),
            "see": f(h),
            "out": f(2 * h),
            "base": np.zeros(1, np.float32),
        }

    def embed(self, whole: np.ndarray, grams: np.ndarray) -> np.ndarray:
        there = grams >= 0
        mean = (self.p["gram"][np.maximum(grams, 0)] * there[:, :, None]).sum(1) / np.maximum(there.sum(1), 1)[:, None]
        return self.p["word"][whole] + mean

    def gates(self, whole: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Gate inputs of words, so many at a time that their n-grams' embeddings take little room."""
        out = np.empty((len(whole), 6 * HIDDEN), np.float32)
        for at in range(0, len(whole), 5_000):
            out[at : at + 5_000] = self.embed(whole[at : at + 5_000], grams[at : at + 5_000]) @ self.p["in"] + self.p["bias"]
        return out

    def read(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Windows of rows of `table` (the words' gate inputs) -> logits, and what backward() needs."""
        n, steps, h = len(index), index.shape[1], HIDDEN
        states, kept = np.empty((steps, n, 2 * h), np.float32), []
        for d in (0, 1):
            rec, state = self.p["rec"][d], np.zeros((n, h), np.float32)
            trail = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = table[index[:, t], 3 * h * d : 3 * h * (d + 1)]
                g = state @ rec
                zr = sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                m = mask[:, t, None]
                after = state + m * (1 - z) * (new - state)
                if keep:
                    trail.append((t, state, g, z, r, new, m))
                state = after
                states[t, :, h * d : h * (d + 1)] = state
            kept.append(trail)
        seen = np.tanh(states @ self.p["att"])
        e = seen @ self.p["see"]
        e = np.where(mask.T > 0, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["base"]
        return (logit, (states, seen, a, pooled, kept)) if keep else logit

    def backward(self, slope: np.ndarray, memory) -> tuple[dict, np.ndarray]:
        """Gradients from the slope at the logits: of the parameters, and (steps, n, 6h) of the gate inputs."""
        states, seen, a, pooled, kept = memory
        h, p = HIDDEN, self.p
        g = {"out": pooled.T @ slope, "base": np.array([slope.sum()], np.float32)}
        dpool = slope[:, None] * p["out"]
        dstates = a[:, :, None] * dpool
        da = (states * dpool).sum(2)
        de = a * (da - (a * da).sum(0))
        g["see"] = np.einsum("tn,tnh->h", de, seen)
        dpre = de[:, :, None] * p["see"] * (1 - seen**2)
        g["att"] = np.einsum("tni,tnj->ij", states, dpre)
        dstates = dstates + dpre @ p["att"].T
        dgates = np.zeros((*states.shape[:2], 6 * h), np.float32)
        g["rec"] = np.zeros_like(p["rec"])
        for d in (0, 1):
            carry = np.zeros((states.shape[1], h), np.float32)
            for t, state, gg, z, r, new, m in reversed(kept[d]):
                ds = dstates[t, :, h * d : h * (d + 1)] + carry
                dnew, dz = ds * m * (1 - z) * (1 - new**2), -ds * m * (new - state) * z * (1 - z)
                dr = dnew * gg[:, 2 * h :] * r * (1 - r)
                dgates[t, :, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dz, dr, dnew], 1)
                dg = np.concatenate([dz, dr, dnew * r], 1)
                g["rec"][d] += state.T @ dg
                carry = ds * (1 - m * (1 - z)) + dg @ p["rec"][d].T
        return g, dgates


def windows(n: int) -> list[int]:
    """Starts of the windows over n words: half a window apart, the last one ending with the text."""
    return [*range(0, max(n - WINDOW, 0), STEP), max(n - WINDOW, 0)]


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of texts -> (windows by WINDOW) numbers, mask, and each window's text."""
    index, mask, of = [], [], []
    for i, t in enumerate(texts):
        starts = np.array(windows(len(t)))
        at = starts[:, None] + np.arange(WINDOW)
        ok = at < len(t)
        index.append(t[np.minimum(at, max(len(t) - 1, 0))] if len(t) else np.zeros(at.shape, np.int64))
        mask.append(ok)
        of.append(np.full(len(starts), i))
    return np.concatenate(index), np.concatenate(mask).astype(np.float32), np.concatenate(of)


def summary(logit: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per text: a constant, its highest window, the mean of its three highest, the log of its number of windows."""
    order = np.lexsort((-logit, of))
    first = np.searchsorted(of[order], np.arange(n))
    count = np.bincount(of, minlength=n)
    ranked = logit[order]
    top = ranked[first]
    three = sum(ranked[first + np.minimum(k, count - 1)] for k in range(3)) / 3
    return np.stack([np.ones(n), top, three, np.log(count)], axis=1)


class Toxicity:
    """A trained network with its calibration; scores texts."""

    def __init__(self, network: Network, weights: np.ndarray):
        self.network, self.weights = network, weights

    def scores(self, texts: list[str], words: dict, table: np.ndarray) -> np.ndarray:
        """Scores of texts. words and table are a cache: gate inputs of words seen before."""
        split = [words_of(t) for t in texts]
        distinct = set().union(*split)
        new = [*(distinct - words.keys())]
        if len(words) + len(new) > len(table):
            raise BufferError(len(distinct))
        for some in range(0, len(new), 20_000):
            part = new[some : some + 20_000]
            table[len(words) : len(words) + len(part)] = self.network.gates(*word_inputs(part))
            words.update(zip(part, range(len(words), len(words) + len(part))))
        out = []
        numbered = [np.fromiter(map(words.__getitem__, s), np.int64, len(s)) for s in split]
        index, mask, of = laid_out(numbered)
        logit = np.concatenate([self.network.read(table, index[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(index), 4096)])
        out = sigmoid(summary(logit, of, len(texts)) @ self.weights)
        return out


def train(labelled: list[tuple[str, int]]) -> Toxicity:
    """Learn from (text, label) pairs; with no pair, or of one class only, every text scores that class's share (0 if none)."""
    network = Network()
    y = np.array([label for _, label in labelled])
    if len(set(y.tolist())) < 2:
        share = np.array([-4.0 if not len(y) or not y[0] else 4.0, 0, 0, 0])
        return Toxicity(network, share)
    words: dict[str, int] = {}
    texts = [np.array([words.setdefault(w, len(words)) for w in words_of(t)], np.int64) for t, _ in labelled]
    listed = [*words] or [""]
    parts = [word_inputs(listed[at : at + 20_000]) for at in range(0, len(listed), 20_000)]
    whole, grams = (np.concatenate(p) for p in zip(*parts))
    index, mask, of = laid_out(texts)
    # the first choice of windows: by the log-odds of words and prefixes over documents
    n1, n0 = y.sum(), (1 - y).sum()
    odds = np.zeros(len(whole))
    for feature in (whole, *(grams[:, -k] for k in (1, 2, 3, 4, 5))):
        seen = [np.unique(feature[t]) for t in texts]
        size = max(WORDS, GRAMS) + 1
        c1 = sum((np.bincount(s + 1, minlength=size) for s, label in zip(seen, y) if label), np.zeros(size))
        c0 = sum((np.bincount(s + 1, minlength=size) for s, label in zip(seen, y) if not label), np.zeros(size))
        score = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
        score[0] = 0
        odds = np.maximum(odds, score[feature + 1])
    rank = (np.maximum(odds[index] - 1, 0) * mask).sum(1)
    rng = np.random.default_rng(11)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step = 0
    for turn in range(ROUNDS):
        if turn:
            table = network.gates(whole, grams)
            rank = np.concatenate([network.read(table, index[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(index), 4096)])
        order = np.lexsort((-rank, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        label = y[of[order]]
        count = np.bincount(of)[of[order]]
        chosen = order[(label == 1) & (place < np.where(count > 6, 2, 1)) | (label == 0) & ((place < 2) | (rng.random(len(order)) < 0.05))]
        target = y[of[chosen]].astype(np.float32)
        weight = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)).astype(np.float32) * len(chosen)
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
                pick = chosen[at]
                used, inverse = np.unique(index[pick], return_inverse=True)
                local = inverse.reshape(len(pick), WINDOW)
                x = network.embed(whole[used], grams[used])
                logit, memory = network.read(x @ network.p["in"] + network.p["bias"], local, mask[pick], keep=True)
                slope = ((sigmoid(logit) - target[at]) * weight[at] / len(at)).astype(np.float32)
                g, dgates = network.backward(slope, memory)
                flat = summed(local.T.ravel(), dgates.reshape(-1, 6 * HIDDEN), len(used))
                g["in"], g["bias"] = x.T @ flat, flat.sum(0)
                dx = flat @ network.p["in"].T
                there = grams[used] >= 0
                share = dx / np.maximum(there.sum(1), 1)[:, None]
                rows, cols = np.nonzero(there)
                g["word"], g["gram"] = summed(whole[used], dx, WORDS), summed(grams[used][rows, cols], share[rows], GRAMS)
                step += 1
                for k, v in g.items():  # Adam
                    m, s = moment[k]
                    m *= 0.9
                    m += 0.1 * v
                    s *= 0.99
                    s += 0.01 * v * v
                    network.p[k] -= (RATE / (1 + turn)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    table = network.gates(whole, grams)
    logit = np.concatenate([network.read(table, index[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(index), 4096)])
    x, w = summary(logit, of, len(texts)), np.zeros(4)
    for _ in range(50):  # calibration: ridge logistic regression by Newton steps
        p = sigmoid(x @ w)
        change = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(4), x.T @ (p - y) + 0.5 * w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return Toxicity(network, w)


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. A null text is the empty text, which has a score too.

    Rows are independent: repeated rows score alike, a null doc_id stays null (and counts as held out), an empty table
    gives an empty one. Other columns of docs are left behind, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # under two megabytes

    @lean
    def run(batches):
        words: dict[str, int] = {}
        table = np.empty((CACHE_WORDS, 6 * HIDDEN), np.float32)
        for batch in batches:
            out, texts = [], texts_of(batch)
            at = 0
            while at < len(texts):  # about a megabyte of text at a time
                to, size = at, 0
                while to < len(texts) and size < 1_000_000:
                    size += len(texts[to])
                    to += 1
                try:
                    out.append(sent.value.scores(texts[at:to], words, table))
                except BufferError as full:  # the cache is full: start it afresh, larger if these texts alone need it
                    words.clear()
                    if full.args[0] > len(table):
                        table = np.empty((full.args[0], 6 * HIDDEN), np.float32)
                    out.append(sent.value.scores(texts[at:to], words, table))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """`score` with a model learned from at most `per_class` labelled documents of either class, never from held-out ones.

    Labels that are null, or that mark one document both ways, aren't learned from; without labels of both classes every
    text scores near the one that is there (near 0 without any). Empty tables of either kind are allowed.
    """
    return score(docs, train(sample(docs, labels, label, per_class)))
