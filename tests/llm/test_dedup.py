"""Near-duplicates, repeated passages, lines and vectors against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tarn.llm import components, embeddings, lines, minhash, rules, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_truth(rows, k, percent):
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingles(t, k))
    flat = [(d, s) for d, ss in sets.items() for s in ss if s]
    links = [(a, b) for i, (a, s) in enumerate(flat) for b, t in flat[:i] if 100 * len(s & t) >= percent * len(s | t)]
    component = least_reachable(sets, links)
    return sorted((d, len(shingles(t, k)), component[d], d == component[d]) for d, t in rows)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    rnd = random.Random(1)
    rows = []
    for _ in range(12):
        base = [f"v{rnd.randrange(4000)}" for _ in range(rnd.randrange(30, 150))]
        rows += [edited(rnd, base, rnd.randrange(0, 12)) for _ in range(rnd.randrange(1, 14))]
    rows += [f"alone {i} with some words {i * 7}" for i in range(30)] + rows[:9]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, make_docs, families, k):
    got = minhash.near_duplicates(make_docs(*families), k, 80).collect()
    assert sorted(map(tuple, got)) == near_truth(families, k, 80)


def test_minhash_one_large_group(spark, make_docs):
    """Most of a bucket's members hang together, some only through others, some not at all."""
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    rows = list(enumerate(edited(rnd, base, n) for n in rnd.choices(range(9), k=250)))
    assert sorted(map(tuple, minhash.near_duplicates(make_docs(*rows), 2, 80).collect())) == near_truth(rows, 2, 80)


def test_minhash_odd_rows(spark, make_docs, odd):
    rows = [((-1, d) if d is None else (0, d), t) for d, t in odd]
    got = minhash.near_duplicates(make_docs(*odd), 2, 80).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[6] == [(1, 6, True)] * 2 and by[7] == [(1, 6, False)]
    assert by[None] == [(2, None, True)] * 2 and rows
    assert minhash.near_duplicates(make_docs()).count() == 0
    kept = minhash.keep_first(make_docs(*odd), 2, 80)
    assert kept.columns == make_docs().columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:8]) for r in kept.collect()), key=repr) == sorted([(None, "one two "), (1, ""), (2, ""), (3, " \t\n\x0b "), (4, "w0 x0 w1"), (5, "zzzzzzzz"), (6, "one two"), (8, "other wo"), (8, "solo")], key=repr)


def test_minhash_shared_ids(spark, make_docs):
    """Different texts with one id, or none, are judged each by its own text."""
    rnd = random.Random(6)
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = {x: edited(rnd, words, 1) for x, words in zip("abc", (a, b, c))}
    rows = [(1, " ".join(a)), (None, near["a"]), (None, "quite clean words here"), (None, " ".join(b)), (None, near["b"]), (None, "None at all"), (None, "none at all"), (None, "")]
    rows += [(7, " ".join(c)), (7, "seven is clean too"), (9, near["c"]), (9, "nine is clean too"), (9, "nine is clean too")]
    got = minhash.near_duplicates(make_docs(*rows), 2, 80).collect()
    assert len(got) == len(rows)
    stays = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_first(make_docs(*rows), 2, 80).collect()), key=repr)
    one_of = [{(None, " ".join(b)), (None, near["b"])}, {(None, "None at all"), (None, "none at all")}]
    clean = {(1, " ".join(a)), (None, "quite clean words here"), (None, ""), (7, " ".join(c)), (7, "seven is clean too"), (9, "nine is clean too")}
    assert len(stays) == len(clean) + 2 and clean < set(stays) and all(len(x & set(stays)) == 1 for x in one_of)
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(1, 1, True), (None, 1, False), (7, 7, True), (7, 7, True), (9, 7, False), (9, 9, True), (9, 9, True)] + [(None, None, True)] * 5 + [(None, None, False)], key=repr)


def test_circulant_signatures():
    rnd = np.random.default_rng(0)
    a = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:700], rnd.integers(0, 2**63, 200).astype(np.uint64)]))
    s = minhash.signatures([a, b])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert (minhash.intersections([a, b], [b, a]) == [[700, len(a)], [len(b), 700]]).all()


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(5, 5)] + [(i, i + 1) for i in range(1000, 1300)] + [(7, i) for i in range(500, 700)]
    want = least_reachable({x for l in links for x in l}, links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    loops = {x for x in want if x not in got}
    assert all(want[x] == x for x in loops) and got == {x: c for x, c in want.items() if x in got}


def removal_truth(rows, window):
    seen, out = {}, []
    docs = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0))
    for _, (d, t) in docs:
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), (d, i))
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring(spark, make_docs, odd):
    rnd = random.Random(4)
    passages = [" ".join(f"p{rnd.randrange(300)}" for _ in range(rnd.randrange(15, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"u{rnd.randrange(50)}" for _ in range(rnd.randrange(0, 60)))]
        parts += rnd.sample(passages, rnd.randrange(0, 4)) + ["same " * rnd.randrange(0, 45)]
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(99, None), (100, "x"), (101, "")] + [(None, rows[3][1])]
    assert sorted(map(tuple, substring.substring_dedup(make_docs(*rows)).collect()), key=repr) == removal_truth(rows, 20)
    assert sorted(map(tuple, substring.substring_dedup(make_docs(*odd)).collect()), key=repr) == removal_truth(odd, 20)
    assert substring.substring_dedup(make_docs()).count() == 0


def test_sketch(spark, monkeypatch):
    """Merged from many partitions and flushes, estimates never fall below true counts, and few keys are let through by chance."""
    monkeypatch.setattr(substring, "HELD", 500)
    rnd = np.random.default_rng(5)
    once, often = rnd.integers(-(2**63), 2**63, 30_000), rnd.integers(-(2**63), 2**63, 300)
    keys = np.concatenate([once, np.repeat(often, rnd.integers(2, 40, 300)), np.full(2000, 77)])
    rnd.shuffle(keys)
    rows = spark.createDataFrame([([int(k) for k in some],) for some in np.array_split(keys, 400)], "keys array<bigint>").repartition(7)
    sketch = substring.Sketch(len(keys))
    merged = sketch.merged(sketch.partial(rows)).collect()
    counters = {(r["row"], r["chunk"]): np.frombuffer(r["counters"], np.uint8) for r in merged}
    assert len(counters) == len(merged)
    distinct, counts = np.unique(keys, return_counts=True)
    each = [sketch.cells(distinct, r) for r in range(substring.ROWS)]
    read = lambda r, c: counters[r, int(c) >> sketch.chunk_bits][int(c) & ((1 << sketch.chunk_bits) - 1)]
    estimates = np.array([[read(r, c) for c in cells] for r, cells in enumerate(each)]).min(axis=0)
    assert (estimates >= np.minimum(counts, 255)).all()
    assert (estimates[counts == 1] > 1).mean() <= substring.ODDS
    twice = {(r["row"], r["cell"]) for r in sketch.repeated(sketch.merged(sketch.partial(rows))).collect()}
    assert {k for k, e in zip(distinct.tolist(), estimates) if e > 1} == {k for i, k in enumerate(distinct.tolist()) if all((r, int(each[r][i])) in twice for r in range(substring.ROWS))}
    cell = spark.createDataFrame([(int(k),) for k in distinct[:50]], "key bigint").select(*(sketch.cell("key", r) for r in range(substring.ROWS))).collect()
    assert [tuple(r) for r in cell] == [tuple(int(e[i]) for e in each) for i in range(50)]
    assert substring.Sketch(10**12).bits > 40 and substring.Sketch(0).bits == substring.LEAST_BITS


def lines_truth(rows, sites):
    where, first = defaultdict(set), {}
    for d, t, _, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            bare = line.strip(" \t\n\x0b\f\r")
            if bare:
                where[bare].add(s)
                first.setdefault(bare, (d, i))
    out = []
    for d, t, _, s in rows:
        kept, n = [], 0
        for i, line in enumerate((t or "").split("\n")):
            bare = line.strip(" \t\n\x0b\f\r")
            if bare and len(where[bare]) >= sites and first[bare] != (d, i):
                n += 1
            else:
                kept.append(line)
        out.append((d, len((t or "").split("\n")) if t else 0, n, "\n".join(kept) if n else t))
    return sorted(out, key=repr)


def test_lines_shared_ids(spark, make_docs):
    """Lines go only from the text they were found in, whatever other texts share its id or have none."""
    sites = [(i, f"own {i}\nBOILER", "en", f"site{i}") for i in range(9)]
    rows = [(None, "a\nb\nBOILER"), (None, "x\ny\nz"), (None, "BOILER\nq"), (7, "p\nclean seven"), (-5, "first\nBOILER\nBOILER"), (-5, "BOILER\nfirst again")]
    want = [(None, "a\nb"), (None, "x\ny\nz"), (None, "q"), (7, "p\nclean seven"), (-5, "first"), (-5, "BOILER\nfirst again")] + [(i, f"own {i}") for i in range(9)]
    got = [(r["doc_id"], r["text"]) for r in lines.drop_boilerplate(make_docs(*rows, *sites)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines(spark, make_docs, odd):
    rnd = random.Random(5)
    pool = [f"line number {i}" for i in range(12)] + ["", "  ", " padded ", "padded"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.6 else f"own {rnd.random()}" for _ in range(rnd.randrange(0, 9))), "en", rnd.choice([None, *"abcdefghijkl"])) for i in range(90)]
    rows += [(200 + i, "spread by few", "en", c) for i, c in enumerate("abcdefg" * 3)] + [(300 + i, "spread by many", "en", str(i)) for i in range(40)] + [(None, "spread by many", "en", "z"), (400, None, "en", "a")]
    got = lines.drop_boilerplate(make_docs(*rows))
    assert got.columns == make_docs().columns + ["n_lines", "n_removed"]
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr) == lines_truth(rows, lines.MIN_SITES)
    few = lines.drop_boilerplate(make_docs(*odd)).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, few), key=repr) == lines_truth([(d, t, "en", "s") for d, t in odd], lines.MIN_SITES)
    assert lines.drop_boilerplate(make_docs()).count() == 0


def test_lines_keep_columns_of_any_name(spark):
    """Names that the operator uses itself, a dot in a name, and a text of very many removed lines."""
    many = "\n".join(["BOILER", "own"] * 30_000)
    rows = [(i, f"own {i}\nBOILER", f"site{i}", "x", "y", "z", 1.5) for i in range(9)] + [(50, many, "site1", "x", None, "z", 2.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _id string, _gone string, `a.b` string, _row double")
    out = lines.drop_boilerplate(docs, counts=False)
    assert out.columns == docs.columns
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert all(got[r[0]][2:] == r[2:] for r in rows)
    assert got[0][1] == "own 0\nBOILER" and got[3][1] == "own 3" and got[50][1] == "\n".join(["own"] * 30_000)


def test_lines_by_shuffled_join(spark, make_docs, monkeypatch):
    rows = [(i, f"own {i}\nBOILER", "en", f"site{i}") for i in range(30)]
    want = sorted(map(tuple, lines.drop_boilerplate(make_docs(*rows)).collect()))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, lines.drop_boilerplate(make_docs(*rows)).collect())) == want and sum(r[-1] for r in want) == 29


def vectors_truth(rows, least):
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], defaultdict(int)
    for x, (a, v) in enumerate(good):
        for b, w in good[:x]:
            if len(v) == len(w) and v @ w >= least:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    component = least_reachable({i for i, _ in rows}, links)
    return sorted((i, n[i], component[i], component[i] == i) for i, _ in rows)


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = rnd.normal(size=64)
        rows += [base + rnd.normal(size=64) * rnd.choice([0.1, 0.3, 0.45]) for _ in range(rnd.integers(1, 9))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, [0.0] * 64), (903, None), (904, []), (905, [float("nan")] * 64), (906, [float("inf")] + [1.0] * 63), (907, [None] + [1.0] * 63), (908, [1.0, 2.0]), (909, [1.0, 2.1]), (910, [1e300, 1e300]), (911, [3.0]), (912, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 label", "'x' digest", "2 rep")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    truth = dict((r[0], r) for r in vectors_truth([r for r in rows if r[0] != 910], 0.9))
    truth[910] = (910, 2, 908, False)
    truth[908], truth[909] = (908, 2, 908, True), (909, 2, 908, False)
    assert got == sorted(truth.values())
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.01]), (4, None)], "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(odd).collect()), key=repr)[-2:] == [(None, 2, 4, False)] * 2


def test_embeddings_one_large_group(spark):
    """More copies and neighbours than a block holds."""
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=16)
    rows = [(i, [float(x) for x in base + rnd.normal(size=16) * 0.2]) for i in range(1500)]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()))
    truth = vectors_truth(rows, 0.9)
    assert [r[2] for r in got] == [r[2] for r in truth]
    missed = sum(t[1] - g[1] for g, t in zip(got, truth))
    assert 0 <= missed <= 0.01 * sum(t[1] for t in truth)


def test_blocks_compared_together():
    """Small and large blocks side by side give the pairs that a look at each pair gives."""
    rnd = np.random.default_rng(5)
    sizes = [1, 2, 0, 7, 300, 129, 128, 3]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n = int(edges[-1])
    x = rnd.normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, dims, rep = rnd.random(n) < 0.4, rnd.choice([3, 4], n), rnd.integers(0, n, n)
    a, b = embeddings.near_in_group(x, dims, edges, home, lambda a, b: rep[a] != rep[b], 0.9)
    got = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())]
    truth = {(i, j) for low, high in zip(edges, edges[1:]) for i in range(low, high) for j in range(i + 1, high) if (home[i] or home[j]) and dims[i] == dims[j] and rep[i] != rep[j] and x[i] @ x[j] >= 0.9}
    assert len(got) == len(truth) and set(got) == truth


@pytest.mark.parametrize("d", [16, 64, 160])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_pairs_meet(d, k):
    """Of pairs of cosine 0.9, drawn anew, at most a few in a thousand meet in no table, whatever the width."""
    rnd = np.random.default_rng(d + k)
    scheme = embeddings.CrossPolytope(k, embeddings.tables_for([d], k, 0.9))
    a, b = rnd.normal(size=(2, 500, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    p, q = scheme.buckets(a), scheme.buckets(b)
    met = ((q == p[:, :, :1]).any(2) | (p == q[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.994


def rule_counts(text):
    t = text or ""
    words = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {p + k for ps in windows.values() if len(ps) > 1 for p in ps for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark, make_docs, odd):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice(["the", "of", "and", "word", "été", "#", "a|b", "X9", "word\nword", "\n"]) for _ in range(rnd.randrange(0, 120))) for _ in range(80)]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts)), (None, None)]
    got = rules.judge(make_docs(*rows)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got), key=repr) == sorted(((d, *rule_counts(t)) for d, t in rows), key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert rules.judge(make_docs()).count() == 0


def test_rules_by_divergence(spark, make_docs, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 600")
    symbols = make_docs((10**6, " ".join(f"{i}$%{i * i}" for i in range(400))), (10**6 + 1, None, None)).select(*docs.columns)
    judged = {r["doc_id"]: r for r in rules.judge(docs.unionByName(symbols)).collect()}
    far = judged.pop(10**6)
    assert not far["base_failed"] and not far["kept"] and judged.pop(10**6 + 1)["kept"] is False
    assert rules.keep_good(docs.unionByName(symbols)).columns == docs.columns


def test_divergence(spark):
    from pyspark.sql import functions as F

    a = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    got = spark.range(1).select(rules.js_distance(a(1, 0), a(0, 5)).alias("far"), rules.js_distance(a(1, 3), a(2, 6)).alias("same"), rules.js_distance(a(0, 0), a(1, 1)).alias("none")).first()
    assert abs(got["far"] - 1) < 1e-12 and got["same"] < 1e-6 and got["none"] is None
