"""Encoding against the tokenizers library; packing: every id once, gapless, within capacity, few sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarn.llm import bpe, packing, registry

TRICKY = ["", "A b  C", "don't STOP", "İstanbul ΣΑΣ ςσ", "é é", "日本語 テスト", "👩‍👩‍👧 ok", "a\x1cb\x1fc\x85d e f", "<|endoftext|> x <|startoftext|>y", "x" * 500, "aaaa " * 50, "1234567890 3.14", "\x00\x01", "naïve—café…", "<|endoftext", "ß ẞ ﬁ ǅ"]


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(registry.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_like_the_library(oracle):
    rnd = random.Random(3)
    alphabet = "abcdefgh ABC,.'\"!?-0123456789éüßñ\n\t日本Σσς<|>endoftx"
    texts = TRICKY + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(400)]
    encoder = bpe.load(registry.vocabulary())
    for text, ids in zip(texts, encoder.encode_many(texts)):
        expected = oracle.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert encoder.decode(ids) == oracle.decode(expected, skip_special_tokens=False)


def test_every_code_point(oracle):
    """Between letters, as a word of its own, and behind a letter in a chunk: all of Unicode but surrogates."""
    encoder = bpe.load(registry.vocabulary())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"ab{c}Cd {c} x{c}" for c in points[at : at + 50_000]]
        expected = oracle.encode_batch(texts, add_special_tokens=False)
        for text, ids, want in zip(texts, encoder.encode_many(texts), expected):
            assert ids == packed(want.ids), ascii(text)


def test_rows_and_heap_merge_alike():
    encoder = bpe.load(registry.vocabulary())
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in range(1, bpe.LONG_WORD + 1)]
    for word, ids in zip(words, encoder.merge_words(words)):
        start = encoder.inner[np.frombuffer(word.encode(), np.uint8)]
        start[-1] = encoder.final[word.encode()[-1]]
        assert packed(encoder.merge_long(start.tolist())) == ids


def test_query_rows(spark, make_docs, odd, oracle):
    rows = odd + [(100 + i, t) for i, t in enumerate(TRICKY)]
    got = bpe.digests(make_docs(*rows), registry.vocabulary()).collect()
    expected = []
    for d, t in rows:
        ids = oracle.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(oracle.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    full = bpe.encode_decode(make_docs((1, "Hello, World"), (2, None)), registry.vocabulary(), keep=("doc_id", "kept")).orderBy("doc_id").collect()
    assert full[0]["ids"] == oracle.encode("Hello, World", add_special_tokens=False).ids and full[1]["ids"] == [] and full[1]["decoded"] == "" and full[0]["kept"] == "k"
    assert bpe.digests(make_docs(), registry.vocabulary()).count() == 0


def check_packing(rows, expected_ids, capacity):
    """rows of pieces; expected_ids: a list of (doc_id, ids) -> number of sequences."""
    want = []
    for d, ids in expected_ids:
        want += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(packed(ids[at : at + capacity]))) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_places(spark, make_docs, odd, oracle):
    rnd = random.Random(8)
    rows = odd + [(100 + i, " ".join(rnd.choice(["word", "token", "pack", "fit"]) for _ in range(int(rnd.expovariate(1 / 300))))) for i in range(300)]
    got = packing.pack_documents(make_docs(*rows), registry.vocabulary()).collect()
    ids = [(d, oracle.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    used = check_packing(got, ids, 2048)
    assert used <= 1.01 * sum(len(x) for _, x in ids) / 2048 + 1
    assert packing.pack_documents(make_docs(), registry.vocabulary()).count() == 0


def test_plan_beats_no_bound():
    """Against the least possible number of sequences, and every availability count kept."""
    rnd = np.random.default_rng(2)
    for draw in (lambda: rnd.integers(1, 65, 500), lambda: rnd.geometric(0.1, 500).clip(1, 64), lambda: np.full(100, 64), lambda: np.full(99, 33), lambda: np.array([], int)):
        lengths = draw()
        counts = np.bincount(lengths, minlength=65)
        recipes = packing.plan(counts)
        used = np.zeros(65, int)
        for recipe, times in recipes:
            assert sum(recipe) <= 64
            np.add.at(used, list(recipe), times)
        assert (used == counts).all()
        total = sum(times for _, times in recipes)
        least = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))
        assert total <= least * 1.03 + 1


def test_exact_complements():
    left = np.bincount([10, 20, 30, 40, 15, 15], minlength=101)
    sums = packing.Sums(left)
    assert sums.exact(40, left) == (40,) and sum(sums.exact(60, left)) == 60 and sum(sums.pair(30, left)) == 30
    triple = sums.triple(60, left)
    assert len(triple) == 3 and sum(triple) == 60 and sums.exact(99, left) == ()


def test_every_triple_is_tried():
    """Single counts: a hundred first lengths would need their second twice; what brute force finds behind them is found."""
    counts, gap = np.zeros(2049, int), 2000
    for x in range(1000, 1400, 2):  # x + 2 * y = gap, with one y each
        counts[[x, (gap - x) // 2]] = 1
    counts[[700, 660, 640]] += 1
    lengths = np.flatnonzero(counts).tolist()
    there = {x for a in lengths for b in lengths if a > b and (x := gap - a - b) > 0 and counts[x] > (x == a) + (x == b)}
    assert there
    for longest in range(1400, 700, -50):
        left = np.where(np.arange(2049) <= longest, counts, 0)
        some = [x for x in lengths if x <= longest]
        any_ = any((x := gap - a - b) > 0 and left[x] > (x == a) + (x == b) for a in some for b in some if a > b)
        got = packing.Sums(left).triple(gap, left.copy())
        assert bool(got) == any_ and (not got or sum(got) == gap and (np.bincount(got, minlength=2049) <= left).all())


def test_hot_length_is_dealt_out(spark, monkeypatch):
    """A length that most rows have is numbered by many tasks, each number once."""
    monkeypatch.setattr(packing, "SALT_ROWS", 20)
    rows = spark.range(1000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 9 = 0, id % 7 + 1, 64) length", "id ids_crc32")
    got = packing.pack(rows, 64).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(places) == len(got) == 1000 and len({r["doc_id"] for r in got}) == 1000


def test_words_are_merged_once(oracle, monkeypatch):
    """What a chunk's words have in common with chunks before isn't merged again; equal chunks are looked up once."""
    made = bpe.WordBpe(open(registry.vocabulary(), encoding="utf-8").read())
    merged = []
    monkeypatch.setattr(made, "merge_words", lambda words, run=made.merge_words: merged.append(sorted(words)) or run(words))
    for text in ("abcde xyzzy", "abcde, (xyzzy) abcde. Abcde,", "<|ENDOFTEXT|> abcde<|endoftext|>'s ͸a"):
        assert made.encode(text) == packed(oracle.encode(text, add_special_tokens=False).ids)
    assert merged[:2] == [["abcde", "xyzzy"], ["(", ")", ",", "."]]
