"""Byte-pair encoding and decoding with a public vocabulary file.

Short words are encoded on contiguous rank arrays: the parts of a word and the merge ranks of its adjacent pairs lie
side by side in a row; the smallest rank is found by a scan, the boundary inside that pair is deleted and the two
neighbouring ranks are refreshed, until no pair can merge. Words of like length are the rows of one matrix, so numpy
takes a step of many words at once. Words over `LONG_WORD` bytes take the same merges in the same order from a heap,
so a text that is one enormous word stays near-linear.

Words repeat: each worker keeps a bounded two-generation cache from white-space-separated chunks to ids. A few megabytes of
text at a time, chunks are numbered by Arrow's dictionary encoding, so only different ones are looked up, and the ids of
all are gathered by number in numpy.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import lean

ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 60
LONG_WORD = 128
CACHE_ENTRIES = 250_000
SPACE = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class WordBpe:
    """The word-end BPE of a tokenizer file: normalise, split into words, merge; ids as little-endian uint32 bytes."""

    def __init__(self, vocab_json: str):
        spec = json.loads(vocab_json)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # pair of ids (packed) -> rank and merged id (packed): comparing values compares ranks
        self.merge = {vocab[a] << ID_BITS | vocab[b]: rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        # the same pairs in an open-addressing table, for lookups by the array
        size = 1 << (4 * len(self.merge)).bit_length()
        self.slot_mask, self.slot_key, self.slot_rank = size - 1, np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64)
        for key, at in zip(self.merge, self.slot(np.fromiter(self.merge, np.int64)).tolist()):
            while self.slot_key[at] >= 0:
                at = (at + 1) & self.slot_mask
            self.slot_key[at], self.slot_rank[at] = key, self.merge[key]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.rule_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.rule_split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_start = {s[:2] for s in self.special}
        # as chunks, special tokens stand after a space, which no chunk of text holds
        self.special_ids = {f" {s}": i.to_bytes(4, "little") for s, i in self.special.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank and merged id of each pair of ids, NO_RANK where a pair can't merge."""
        keys = (left.astype(np.int64) << ID_BITS | right).ravel()
        slot = self.slot(keys)
        found = np.where(self.slot_key[slot] == keys, self.slot_rank[slot], NO_RANK)
        open_ = np.flatnonzero((found == NO_RANK) & (self.slot_key[slot] >= 0))
        while open_.size:  # another pair has this slot: look in the next
            slot[open_] = (slot[open_] + 1) & self.slot_mask
            at = self.slot_key[slot[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[(at >= 0) & ~hit]
        return found.reshape(left.shape)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.slot_mask

    def merge_rows(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of part ids, n of them used in each -> the same after all merges."""
        out, length, ids, rows = ids.copy(), n.copy(), ids.copy(), np.arange(len(ids))
        column = np.arange(ids.shape[1] - 1)
        ranks = np.where(column + 1 < n[:, None], self.rank_of(ids[:, :-1], ids[:, 1:]), NO_RANK)
        while rows.size:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            live = least < NO_RANK
            if not live.all():  # rows that have come to their end are laid aside
                done = ~live
                out[rows[done], : ids.shape[1]], length[rows[done]] = ids[done], n[done]
                rows, ids, n, ranks, at, least = rows[live], ids[live], n[live], ranks[live], at[live], least[live]
                if not rows.size:
                    break
            each = np.arange(len(at))
            ids[each, at] = least & ID_MASK
            # the boundary after part `at` goes: what follows moves up by one place
            ids[:, :-1] = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(column[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            n = n - 1
            ranks[each, np.maximum(n - 1, 0)] = NO_RANK
            right, left = np.flatnonzero(at < n - 1), np.flatnonzero(at > 0)
            ranks[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])
            ranks[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])
        return out, length

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        _, offsets, data = pa.array(words, pa.large_string()).buffers()
        at = np.frombuffer(offsets, np.int64)[: len(words) + 1]
        raw = np.frombuffer(data or b"", np.uint8)
        sizes = np.diff(at)
        found: list[bytes] = [b""] * len(words)
        edges = [1, 6, 9, 12, 16, 24, 48, LONG_WORD + 1]
        for low, high in zip(edges, edges[1:]):
            of = np.flatnonzero((sizes >= low) & (sizes < high))
            for some in np.array_split(of, len(of) // 20_000 + 1):
                if not some.size:
                    continue
                n, width = sizes[some], max(high - 1, 2)
                place = at[some][:, None] + np.arange(width)  # what lies beyond a word's end isn't looked at
                ids = self.inner[raw[np.minimum(place, len(raw) - 1)]]
                ids[np.arange(len(some)), n - 1] = self.final[raw[at[some] + n - 1]]
                ids, n = self.merge_rows(ids, n)
                packed = np.ascontiguousarray(ids, dtype="<u4").tobytes()
                first = np.arange(0, len(packed), 4 * width)
                for i, j, k in zip(some.tolist(), first.tolist(), (first + 4 * n).tolist()):
                    found[i] = packed[j:k]
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            word = raw[at[i] : at[i + 1]]
            ids = self.inner[word]
            ids[-1] = self.final[word[-1]]
            found[i] = np.array(self.merge_long(ids.tolist()), "<u4").tobytes()
        return found

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order (least rank, then leftmost) from a heap over linked parts."""
        rank_of, n = self.merge.get, len(ids)
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << ID_BITS | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or rank_of(ids[i] << ID_BITS | ids[j]) != rank:
                continue  # a part of this pair has merged meanwhile
            ids[i], alive[j], after[i] = rank & ID_MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := rank_of(ids[left] << ID_BITS | ids[right])):
                    heapq.heappush(heap, (r, left))
        return [x for x, live in zip(ids, alive) if live]

    def learn(self, chunks: list[str]) -> None:
        """Bring chunks into the cache's younger generation: from the older one, or encoded now."""
        young = self.young
        for kept in (self.special_ids, self.old):
            again = [c for c in chunks if c in kept]
            young.update(zip(again, map(kept.__getitem__, again)))
            chunks = [c for c in chunks if c not in kept] if again else chunks
        split = {c: ws for c in chunks if (ws := self.split_words(c)) != [c]}
        # letters alone are the same as a word and as a chunk
        words = [*{c for c in chunks if c not in split}.union(w for w in set().union(*split.values()) if not (w in young and w.isalpha()))]
        ids_of = dict(zip(words, self.merge_words(words)))
        young.update((c, ids) for c, ids in ids_of.items() if c.isalpha())
        for c in chunks:
            if c not in young:
                young[c] = b"".join([ids_of[w] if w in ids_of else young[w] for w in split[c]]) if c in split else ids_of[c]

    def normal(self, text: str) -> str:
        if not text.isascii():
            # each character is lowered on its own, so a sigma at a word's end gets no final form
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split_words(self, chunk: str) -> list[str]:
        """The words of a normalised chunk without white space."""
        if chunk.isalpha():  # all of it letters: one word
            return [chunk]
        if not chunk.isascii() and "Cn" in map(unicodedata.category, chunk):
            # code points that this Python's tables don't know: the file's own normaliser and pattern say what they are
            return [w for w, _ in self.rule_split.pre_tokenize_str(self.rule_normal.normalize_str(chunk))]
        return self.words(chunk)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        out, some, size = [], [], 0
        for text in texts:  # a few megabytes at a time
            some.append(text)
            size += len(text)
            if size > 4_000_000:
                out += self.encode_some(some)
                some, size = [], 0
        return out + self.encode_some(some)

    def encode_some(self, texts: list[str]) -> list[bytes]:
        chunks: list[str] = []
        ends = []  # per text, how many chunks there are up to its end
        for text in texts:
            if any(s in text for s in self.special_start):
                for i, p in enumerate(self.specials.split(text)):
                    chunks += [f" {p}"] if i % 2 else self.split(self.normal(p))
            else:
                chunks += self.split(self.normal(text))
            ends.append(len(chunks))
        if len(self.young) > CACHE_ENTRIES:  # the older generation goes
            self.old, self.young = self.young, {}
        numbered = pa.array(chunks, pa.large_string()).dictionary_encode()
        chunks.clear()
        different, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        if new := [c for c in different if c not in self.young]:
            self.learn(new)
        ids_of = [*map(self.young.__getitem__, different)]
        n = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        first, count = (np.cumsum(n) - n)[number], n[number]
        end = np.cumsum(count)
        at = np.repeat(first - end + count, count)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(ids_of), "<u4")[at].tobytes()
        cuts = (4 * np.concatenate([[0], end])[[0, *ends]]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    def split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split(), but not to the vocabulary's pattern
            return SPACE.split(text)
        return text.split()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids joined by one space: the file names no decoder that would undo the byte symbols."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One encoder per worker and vocabulary file."""
    with open(path, encoding="utf-8") as f:
        return WordBpe(f.read())


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode every text: the `keep` columns, n_tokens, ids (array of int) and decoded text.

    A null text is the empty text: no ids and an empty decoding. Other columns are left behind, whatever their names.
    Rows are independent, so repeated rows give repeated results and nothing is shuffled.
    """

    @lean
    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            ids = bpe.encode_many(texts_of_batch(batch, text))
            arrays = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(x) // 4 for x in ids], pa.int64()), arrays, pa.array(map(bpe.decode, ids), pa.string())], [*keep, "n_tokens", "ids", "decoded"])

    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.select(*keep, text).mapInArrow(run, T.StructType(fields))


def texts_of_batch(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of its ids (little-endian uint32) and of its decoded text (UTF-8).

    A null or empty text has no ids and decodes to the empty text. Rows are independent, so repeated rows give repeated
    results and nothing is shuffled; a null doc_id stays null; an empty table gives an empty one. Other columns are left
    behind, whatever their names.
    """

    @lean
    def run(batches):
        bpe = load(vocab_path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids in bpe.encode_many(texts_of_batch(batch, "text")):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
