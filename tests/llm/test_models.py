"""Personal data, quality and toxicity: spans by the plain patterns, and accuracy on documents held out of training."""

import hashlib
import random
import re
import zlib

import pytest

from tarn.llm import labelled, pii, quality, toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_truth(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card" and 14 <= len(digits) <= 19:
                ok = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return sorted(out)


def test_base_spans():
    rnd = random.Random(11)
    bits = ["a@b.c", "x.y+z@host-1.example.org", "@", "a@b", "a@b.c@d.e", "..@x.y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+49 (30) 123-4567", "+1.415.555.0100", "+12", "00000000000000", "12-", " ", " ", "é", "日", "1", "2.", "-", "+", "(", ")"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        found, _ = pii.base_spans(text)
        assert [(a, k, b) for a, b, k in found] == [(a, k, b) for a, _, b, k in base_truth(text)], text


def test_find(spark, make_docs, odd):
    rows = odd + [(20, "write to ann.lee@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, +49 30 1234567 é ann@x.de"), (21, "api_key = \"sk-a8f3kQ92mZx71LpWvT0bNc45\" Dr. Anna Schmidt tel: (415) 555-2671"), (None, "a@b.cc")]
    got = pii.find(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        spans = base_truth(t or "")
        want.append((d, *(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [kinds.count(k) for k in PATTERNS] == [r[f"n_{k}"] for k in PATTERNS]
        starts = [int(s.split(":")[1]) for s in r["spans"].split(",") if s]
        assert starts == sorted(starts)
    assert pii.find(make_docs()).count() == 0


PLANTED = [
    ("person", "Dr. {}", ["Anna Schmidt", "Maria Lopez-Garcia", "Paul O'Neil", "Sarah A" + "b" * 60, "Claire " + "Dupont-" * 12 + "Petit"]),
    ("secret", 'api_key = "{}"', ["sk-a8f3kQ92mZx71LpWvT0bNc45", "ghp_9xKw2LmZ81QpTa6RvBn3Yc7Us4Df", "Zx81LpQ9wT0bNc45a8f3kQ92mVr7"]),
    ("local_phone", "call me, phone {}", ["(415) 555-2671", "212-555-0188", "(030) 555-7781"]),
    ("spelled_email", "contact {}", ["ann [at] example [dot] com", "jo.smith (at) mail (dot) host (dot) org", "x" * 70 + " [at] example [dot] net", "a [at] b" + " [dot] c" * 7 + " [dot] com"]),
]


def test_added_spans(spark, make_docs):
    """Planted personal data of every added kind is found whole, whatever its length, and clean look-alikes mostly aren't."""
    rnd = random.Random(5)
    rows, want = [], {}
    for i in range(400):
        kind, frame, values = PLANTED[i % 4]
        head, tail = frame.split("{}")
        before = " ".join(rnd.choice(["we", "met", "them", "there"]) for _ in range(5)) + " " + head
        value = rnd.choice(values)
        start = len(before) - (len("Dr. ") if kind == "person" else 0)
        rows.append((i, before + value + tail + " and went on"))
        want[i] = (kind, start, len(before) + len(value))
    clean = [f"the ratio was {i} of 415.{i % 900 + 100}.2671 for thelongestwordsofall{i} in section {i}" for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(clean)] + [(2000, "room 1234 phone 415-555-2671 now")]
    got = {r["doc_id"]: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in pii.find(make_docs(*rows)).collect()}
    for kind, *_ in PLANTED:
        of = [i for i, w in want.items() if w[0] == kind]
        assert sum(want[i] in got[i] for i in of) >= 0.9 * len(of), kind
    assert sum(bool(got[1000 + i]) for i in range(200)) <= 10
    assert got[2000] == [("local_phone", 16, 28)]  # though it stands in a run of digits that no card number is


def test_patterns_read_runs_once():
    """Long runs that match in part are read in linear time."""
    import time

    start = time.perf_counter()
    for text in ("a-" * 200_000 + " [at", "a." * 200_000, "Dr. " + "Ab-" * 200_000, "x [at] y" + " [dot] z" * 100_000, "a [at] b " * 100_000):
        pii.candidates(text, *pii.base_spans(text))
    assert time.perf_counter() - start < 20


def test_mask_of_any_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc", "p", 2), (1, "mail a@b.cc", "p", 2), (None, None, None, None)], "doc_id bigint, text string, `a.b` string, row int")
    assert sorted(map(tuple, pii.mask(docs).collect()), key=repr) == sorted([(1, "mail <EMAIL>", "p", 2)] * 2 + [(None, None, None, None)], key=repr)
    assert pii.mask(docs.where("false")).count() == 0


def test_mask(spark, make_docs):
    docs = make_docs((1, "mail a@b.cc now"), (2, None), (3, ""), (4, "clean text"))
    got = pii.mask(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "mail <EMAIL> now", 2: None, 3: "", 4: "clean text"}


def test_expectation_maximisation():
    """Reliabilities come out of votes alone: three labelers of known accuracy, one of them useless."""
    import numpy as np

    rnd = np.random.default_rng(1)
    truth = rnd.random(20_000) < 0.4
    said = np.stack([np.where(rnd.random(len(truth)) < p, truth, ~truth) * 2 - 1 for p in (0.9, 0.85, 0.8, 0.5)] + [np.zeros(len(truth), int)], axis=1)
    pattern, inverse, n = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    p = pii.reliabilities(pattern, np.zeros(len(pattern), int), n.astype(float))
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > 0.9


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def measured(spark, tables, run, label):
    docs, labels = tables
    got = {r["doc_id"]: r for r in run(docs, labels).collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [(got[d]["score"], got[d]["predicted"], y) for d, y in truth.items() if d in got and got[d]["held_out"]]
    order = sorted(held)
    n1 = sum(y for *_, y in held)
    auc = (sum(i + 1 for i, h in enumerate(order) if h[2]) - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1))
    return auc, sum(p == y for _, p, y in held) / len(held)


def test_quality_held_out(spark, tables):
    auc, accuracy = measured(spark, tables, quality.quality, "quality")
    assert auc > 0.9 and accuracy > 0.85


def test_toxicity_held_out(spark, tables):
    auc, accuracy = measured(spark, tables, toxicity.toxicity, "toxic")
    assert auc > 0.95 and accuracy > 0.95


def plain_quality(network, text):
    """The score of one text by loops over passages, units and gates."""
    import math

    p, rows = network.p, quality.passages(text)
    coded, weights = [], []
    for row in rows:
        x = [min(max((float(v) - float(m)) / float(s), -6), 6) for v, m, s in zip(row, network.mean, network.spread)]
        h1 = [math.tanh(sum(x[i] * p["w1"][i, j] for i in range(len(x))) + p["b1"][j]) for j in range(quality.UNITS)]
        h = [math.tanh(sum(h1[i] * p["w2"][i, j] for i in range(quality.UNITS)) + p["b2"][j]) for j in range(quality.UNITS)]
        e = 0.0
        for g in range(quality.GATE):
            t = math.tanh(sum(h[i] * p["v"][i, g] for i in range(quality.UNITS)))
            e += p["a"][g] * t / (1 + math.exp(-sum(h[i] * p["u"][i, g] for i in range(quality.UNITS))))
        coded.append(h)
        weights.append(math.exp(e))
    z = [sum(w * h[j] for w, h in zip(weights, coded)) / sum(weights) for j in range(quality.UNITS)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["out"])) + p["base"][0])))


def plain_toxicity(network, text):
    """The logit of each window of one text by loops over words and units."""
    import numpy as np

    p, h = network.p, toxicity.HIDDEN
    words = toxicity.words_of(text)
    inputs = []
    for w in words:
        whole, grams = toxicity.word_inputs([w])
        some = [p["gram"][g] for g in grams[0] if g >= 0]
        inputs.append((p["word"][whole[0]] + (sum(some) / len(some) if some else 0)) @ p["in"] + p["bias"])
    squash = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for start in toxicity.windows(len(words)):
        here = inputs[start : start + toxicity.WINDOW]
        both = np.zeros((len(here), 2 * h))
        for d in (0, 1):
            state = np.zeros(h)
            for t in range(len(here)) if d == 0 else reversed(range(len(here))):
                x, g = here[t][3 * h * d : 3 * h * (d + 1)], state @ p["rec"][d]
                z, r = squash(x[:h] + g[:h]), squash(x[h : 2 * h] + g[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
                both[t, h * d : h * (d + 1)] = state
        e = [np.tanh(s @ p["att"]) @ p["see"] for s in both]
        a = np.exp(e) / np.exp(e).sum()
        out.append(float((a @ both) @ p["out"] + p["base"][0]))
    return out


def test_quality_scores_by_brute_force(tables):
    docs, labels = tables
    some = labelled.sample(docs, labels, "quality", 150)
    model = quality.train(some, {0: 0.5, 1: 0.5})
    texts = ["", "one", *(t for t, _ in some[:12]), "long " * 1000]
    for text, score in zip(texts, model.scores(texts)):
        assert abs(score - plain_quality(model.network, text)) < 1e-5


def test_toxicity_scores_by_brute_force(tables):
    import numpy as np

    docs, labels = tables
    model = toxicity.train(labelled.sample(docs, labels, "toxic", 60))
    texts = ["one", "two words", *(t for t, _ in labelled.sample(docs, labels, "toxic", 4)), "many more words " * 40]
    for text, score in zip(texts, model.scores(texts, {}, np.empty((50_000, 6 * toxicity.HIDDEN), np.float32))):
        logits = sorted(plain_toxicity(model.network, text), reverse=True)
        three = sum(logits[min(k, len(logits) - 1)] for k in range(3)) / 3
        assert abs(score - toxicity.sigmoid(np.array([1, logits[0], three, np.log(len(logits))]) @ model.weights)) < 1e-3


def test_quality_gradients():
    """backward() against finite differences of the loss, for some numbers of every parameter."""
    import numpy as np

    rnd = np.random.default_rng(2)
    rows = [rnd.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    network = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, starts, of = quality.bags(rows)
    target = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.log1p(np.exp(-(2 * target - 1) * network.forward(x, starts, of)[0])).sum())
    logit, memory = network.forward(x, starts, of)
    check_gradients(network.p, network.backward(quality.sigmoid(logit) - target, memory, starts, of), loss, rnd, 1e-5, 1e-4)


def test_toxicity_gradients():
    import numpy as np

    rnd = np.random.default_rng(4)
    network = toxicity.Network()
    n, steps, h = 5, toxicity.WINDOW, toxicity.HIDDEN
    table = rnd.normal(0, 0.5, (9, 6 * h))
    index, mask = rnd.integers(0, 9, (n, steps)), np.ones((n, steps), np.float32)
    mask[1, 7:] = mask[2, 1:] = 0
    target = rnd.integers(0, 2, n).astype(float)
    values = {**network.p, "table": table}
    loss = lambda: float(np.log1p(np.exp(-(2 * target - 1) * network.read(values["table"], index, mask))).sum())
    logit, memory = network.read(table, index, mask, keep=True)
    g, dgates = network.backward(toxicity.sigmoid(logit) - target, memory)
    g["table"] = np.zeros_like(table)
    np.add.at(g["table"], index.T, dgates)
    check_gradients(values, g, loss, rnd, 1e-2, 2e-2)


def check_gradients(values, gradients, loss, rnd, by, tolerance):
    import numpy as np

    for name, g in gradients.items():
        v, g, seen = values[name], np.asarray(g), []
        for _ in range(8):
            at = tuple(rnd.integers(0, n) for n in v.shape)
            kept = v[at]
            v[at] = kept + by
            up = loss()
            v[at] = kept - by
            seen.append(((up - loss()) / (2 * by), g[at]))
            v[at] = kept
        assert max(abs(a - b) for a, b in seen) < tolerance * (1 + np.abs(g).max()), name


@pytest.mark.parametrize("model, label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_rows(spark, make_docs, odd, model, label):
    labels = spark.createDataFrame([(i, i % 2, 7) for i in range(4)] + [(4, None, 7), (None, 1, 7), (6, 0, 7), (6, 1, 7)], f"doc_id bigint, {label} int, text int")
    docs = make_docs(*odd)
    got = model(docs, labels).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    for none in (labels.where("false"), labels.where(f"{label} = 1")):
        some = model(docs, none).collect()
        assert len(some) == len(odd) and all(0 <= r["score"] <= 1 for r in some)
    assert model(docs.where("false"), labels).count() == 0
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1  # equal texts score alike


def test_toxicity_reads_all_of_long_tokens(spark, make_docs):
    """Texts that differ only behind the twentieth byte of a token: joined words, no spaces at all, one enormous word."""
    rnd = random.Random(8)
    plain, vile = ["garden", "window", "letter", "summer", "bridge", "coffee"], ["moronic", "scumbag"]
    signs, bad = "今天我们一起去公园看花然后回家吃饭休息", "滚蛋废物"
    texts = []
    for i in range(600):
        y, kind = i % 2, i // 2 % 3
        if kind == 2:
            text = "和平的城市里有很多人" + "".join(rnd.choices(signs, k=20)) + (bad if y else "春天花园") + "".join(rnd.choices(signs, k=5))
        else:
            mark = "_/"[kind]
            text = mark.join(["thesamebeginningofall", *rnd.choices(plain, k=4), rnd.choice(vile if y else plain), *rnd.choices(plain, k=2)])
        texts.append((text, y))
    model = toxicity.train(texts[:540])
    held = texts[540:] + [("a" * 300_000 + "_" + "_".join(vile * 3), 1), ("a" * 300_000 + "_" + "_".join(plain), 0)]
    got = {r["doc_id"]: r for r in toxicity.score(make_docs(*(t for t, _ in held)), model).collect()}
    assert sum(got[i]["predicted"] == y for i, (_, y) in enumerate(held[:60])) >= 57
    assert got[60]["score"] > got[61]["score"]


def test_toxicity_pieces():
    token = "".join(chr(c) for low in (0x5D0, 0x4E00, 0x20000) for c in range(low, low + 25)) + "-abcdefghijklmnopqrstuvwxyz/0123"
    raw, at = token.encode(), 0
    for p in toxicity.words_of(f"one {token}, two")[1:-1]:
        start = raw.index(p)  # no character is there twice
        assert start <= at < start + len(p) and len(p) <= toxicity.LONGEST and p.decode()
        at = start + len(p)
    assert at == len(raw)
    same = toxicity.words_of("word " * 9 + '"' * 30 + "Quoted" + "!" * 30)
    assert same == ["word"] * 9 + ['"' * 30 + "quoted" + "!" * 30]  # what isn't long is one word, as before
    assert toxicity.words_of("x" * 20 + "a") != toxicity.words_of("x" * 20 + "b")


def test_held_out_labels_are_never_learned(spark, make_docs):
    ids = [i for i in range(50)]
    docs = make_docs(*((i, f"text {i}") for i in ids))
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, quality int")
    seen = {t for t, _ in labelled.sample(docs, labels, "quality", 100)}
    assert seen == {f"text {i}" for i in ids if zlib.crc32(str(i).encode()) % 5}
