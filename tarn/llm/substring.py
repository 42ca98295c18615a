"""Exact substring dedup over word windows behind a count-min prefilter.

First pass: every partition sketches its windows. A window is counted under its minimizer (the least hash of its word
n-grams), so equal windows always have one key and neighbouring windows mostly share theirs: a text updates the sketch
once for every eight words or so. The sketch has `ROWS` rows of counters, each addressed by other bits of the key and cut
into chunks. A partition adds its updates up and sends, for each chunk it touches, the counters it has raised; one task per
chunk adds these to the chunk's array. No array is longer than a chunk, and a key that a third of all documents share is
one counter per partition. A key's estimate is its least counter over the rows. It never falls below the number of the
key's windows, as every occurrence of a window holds its own occurrence of the minimizer; counters stop at 255, far above
the 2 that is asked for.

The width follows from the number of updates, which is counted beforehand: a key that is there once is let through with
odds `ODDS` at most, whatever the corpus's size.

Second pass: the counters of two or more are read from each chunk, and a document's keys are held against them row by row.
Only windows that are estimated to be repeated are grouped, by 128 bits of their hash, and the least (document, start) of
each group is its first occurrence. Every other candidate is a repeat; the words that repeats cover are removed. Documents
with equal words are settled beforehand: a copy is covered whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_or_last, id_or_null, lean, mix64, small

WINDOW, GRAM = 20, 5
#: Rows of the sketch, and the greatest odds that a key without a repeat is estimated to be repeated.
ROWS, ODDS = 2, 0.02
#: Bits that address a counter within a chunk: so that there are some thousand chunks, within these bounds.
LEAST_BITS, MOST_BITS = 18, 26
#: Updates that a task adds up before it sends them.
HELD = 1_000_000
#: Documents that are worked on at a time.
SOME = 200
_POWER = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least (base is odd)."""
    kept = _POWER.get(base)
    if kept is None or len(kept[0]) <= n:
        size = max(1 << 12, 1 << (n + 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = _POWER[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:  # an enormous text's table isn't kept
            del _POWER[base]
    return kept


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every run of `width` word hashes: polynomials modulo 2**64, scattered."""
    up, down = powers(base, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: len(h) - width + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def minimizers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the key (its minimizer's hash) and the minimizer's place (the leftmost of equals)."""
    value = rolling(h, gram, 0x9E3779B97F4A7C15)
    place, have, want = np.arange(len(value)), 1, window - gram + 1
    while have < want:  # least of twice as many n-grams, at last of all in a window
        by = min(have, want - have)
        right = value[by:] < value[:-by]
        place = np.where(right, place[by:], place[:-by])
        value = np.where(right, value[by:], value[:-by])
        have += by
    return mix64(value).view(np.int64), place  # a least hash is small: mixed again, its bits are all alike


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def first_pass(docs: DataFrame, window: int) -> DataFrame:
    """Per row: id, n, digest of its words (null if it has no window), hash of its words as kept whole, sketch updates."""

    @lean
    def run(batches):
        for batch in batches:
            n, digest, whole, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                joined = b" ".join(words)
                n.append(len(words))
                whole.append(hashlib.sha256(joined).hexdigest())
                if len(words) < window:
                    digest.append(None)
                    keys.append(None)
                    continue
                digest.append(hashlib.blake2b(joined, digest_size=16).digest())
                key, place = minimizers(word_hashes(words), window)
                keys.append(key[np.flatnonzero(np.diff(place, prepend=-1))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(whole, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "digest", "whole", "keys"])

    return docs.mapInArrow(run, "id bigint, n bigint, digest binary, whole string, keys array<bigint>")


class Sketch:
    """The sizes of a count-min sketch for a number of updates: 2**bits counters a row, 2**chunk_bits a chunk."""

    def __init__(self, updates: int):
        # a counter is some other update's too with odds 1 - exp(-updates / width); all rows' are with that to the power of ROWS
        width = max(1, updates) / -math.log1p(-(ODDS ** (1 / ROWS)))
        self.bits = min(62, max(LEAST_BITS, math.ceil(math.log2(width))))
        self.chunk_bits = min(MOST_BITS, max(LEAST_BITS, self.bits - 12))

    def shift(self, row: int) -> int:
        """Where the bits of a key that address its counter in a row begin."""
        return (64 - self.bits) * row // max(1, ROWS - 1)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(self.shift(row))) & np.uint64((1 << self.bits) - 1)

    def cell(self, key: str, row: int):
        """The same as a column."""
        return F.shiftrightunsigned(key, self.shift(row)).bitwiseAND((1 << self.bits) - 1)

    def partial(self, rows: DataFrame) -> DataFrame:
        """Each partition's sketch of rows' keys, as far as it isn't zero: row, chunk, places within it, counts."""

        def pieces(held: list[np.ndarray]):
            keys, low = np.concatenate(held), np.uint64(self.chunk_bits)
            for row in range(ROWS):
                cells, counts = np.unique(self.cells(keys, row), return_counts=True)
                chunk, places = (cells >> low).astype(np.int64), (cells & np.uint64((1 << self.chunk_bits) - 1)).astype("<u4")
                counts = np.minimum(counts, 255).astype(np.uint8)
                edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
                for at in range(0, len(edges) - 1, 1000):
                    some = [*zip(edges[at : at + 1000], edges[at + 1 : at + 1001])]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int32()), pa.array([chunk[a] for a, _ in some], pa.int64()), pa.array([places[a:b].tobytes() for a, b in some], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())], ["row", "chunk", "places", "counts"])

        @lean
        def run(batches):
            held, n = [], 0
            for batch in batches:
                keys = batch.column("keys").flatten().to_numpy()
                held.append(keys)
                n += len(keys)
                if n >= HELD:
                    yield from pieces(held)
                    held, n = [], 0
            if n:
                yield from pieces(held)

        return rows.select("keys").mapInArrow(run, "row int, chunk bigint, places binary, counts binary")

    def merged(self, partial: DataFrame) -> DataFrame:
        """The partitions' sketches added up, chunk by chunk: row, chunk, counters (one byte each)."""

        @lean
        def run(batches):
            at, total = None, None
            for batch in batches:
                out = []
                for row, chunk, places, counts in zip(*(batch.column(c) for c in ("row", "chunk", "places", "counts"))):
                    if (row.as_py(), chunk.as_py()) != at:
                        if at:
                            out.append((*at, total.tobytes()))
                        at, total = (row.as_py(), chunk.as_py()), np.zeros(1 << self.chunk_bits, np.uint8)
                    where, more = np.frombuffer(places.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), np.uint8)  # no place comes twice in a piece
                    total[where] = np.minimum(total[where].astype(np.uint16) + more, 255)
                yield from (self.counters(*x) for x in out)
            if at:
                yield self.counters(*at, total.tobytes())

        dealt = partial.repartition("row", "chunk").sortWithinPartitions("row", "chunk")
        return dealt.mapInArrow(run, "row int, chunk bigint, counters binary")

    @staticmethod
    def counters(row: int, chunk: int, counters: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([chunk], pa.int64()), pa.array([counters], pa.binary())], ["row", "chunk", "counters"])

    def repeated(self, merged: DataFrame) -> DataFrame:
        """row, cell of every counter of two or more."""

        @lean
        def run(batches):
            for batch in batches:
                for row, chunk, counters in zip(*(batch.column(c) for c in ("row", "chunk", "counters"))):
                    found = np.flatnonzero(np.frombuffer(counters.as_buffer(), np.uint8) >= 2) + (chunk.as_py() << self.chunk_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row.as_py(), np.int32)), pa.array(found)], ["row", "cell"])

        return merged.mapInArrow(run, "row int, cell bigint")


def suspects(words: list[bytes], hot: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes, and which windows have a key that is estimated to be there more than once."""
    h = word_hashes(words)
    key, _ = minimizers(h, window)
    return h, np.isin(key, np.array(hot, np.int64))


def candidate_windows(hot: DataFrame, window: int) -> DataFrame:
    """h1, h2, id, pos of every window estimated to be repeated."""

    @lean
    def run(batches):
        for batch in batches:
            for some in (batch.slice(i, SOME) for i in range(0, batch.num_rows, SOME)):
                parts = []
                for doc, text, keys in zip(*(some.column(c).to_pylist() for c in ("id", "text", "keys"))):
                    words = words_of(text)
                    if len(words) < window:
                        continue
                    h, suspect = suspects(words, keys, window)
                    at = np.flatnonzero(suspect)
                    parts.append((rolling(h, window, 0xD1342543DE82EF95)[at].view(np.int64), rolling(h, window, 0xAF251AF3B0F025B5)[at].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["h1", "h2", "id", "pos"])

    return hot.select("id", "text", "keys").mapInArrow(run, "h1 bigint, h2 bigint, id bigint, pos int")


def removal(hot: DataFrame, window: int) -> DataFrame:
    """hot with firsts (starts of first occurrences) -> id, digest, removed words, hash of the kept words, and the kept text."""

    @lean
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, keys, firsts in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "keys", "firsts"))):
                words = words_of(text)
                if len(words) < window:
                    continue
                _, repeat = suspects(words, keys, window)
                repeat[[x for x in firsts or () if x < len(repeat)]] = False
                edges = np.zeros(len(words) + 1, np.int64)
                edges[: len(repeat)] += repeat
                edges[window : window + len(repeat)] -= repeat
                covered = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist()) if not c)
                rows.append((doc, hashlib.blake2b(b" ".join(words), digest_size=16).digest(), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()))], ["id", "digest", "removed", "kept_hash", "kept"])

    return hot.select("id", "text", "keys", "firsts").mapInArrow(run, "id bigint, digest binary, removed bigint, kept_hash string, kept string")


def repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, settled): every row of docs as in `first_pass` with copy (it has the words of an earlier document), and the
    documents that may hold repeated windows with what is left of them."""
    body = docs.select(id_or_last(doc_id).alias("id"), F.col(text).alias("text"))
    rows = durable(first_pass(body, window), "windows")
    owners = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("rows")).where("rows > 1").select("digest", "owner")
    owners = durable(owners, "owners")
    n = owners.count()
    rows = rows.join(small(owners, n), "digest", "left").withColumn("copy", F.coalesce(F.col("id") != F.col("owner"), F.lit(False))).drop("owner")
    windows = rows.where("digest is not null and not copy")
    sketch = Sketch(windows.agg(F.sum(F.size("keys"))).first()[0] or 0)
    # written, so that a join with it can split the updates of a key that very many documents share
    twice = durable(sketch.repeated(sketch.merged(sketch.partial(windows))), "sketch")
    updates = windows.select("id", F.explode("keys").alias("key"))
    for row in range(ROWS):
        found = twice.where(F.col("row") == row).select("cell")
        updates = updates.withColumn("cell", sketch.cell("key", row)).join(found, "cell", "left_semi").drop("cell")
    marked = durable(updates.groupBy("id").agg(F.collect_set("key").alias("keys")), "marked")
    texts = body.join(small(marked.select("id")), "id", "left_semi")
    hot = durable(texts.join(marked, "id"), "suspects")
    found = candidate_windows(hot, window).groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"))
    firsts = found.groupBy(F.col("first.id").alias("id")).agg(F.collect_list("first.pos").alias("firsts"))
    return rows, removal(hot.join(firsts, "id", "left"), window)


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `window` words over it has its words also at an earlier start: a smaller doc_id, or before
    in the same document. All windows are those of the input. A null text has no words. A null id comes after all others;
    rows that share an id count as one document, so none of them is earlier than another at the same start. An empty table
    gives an empty one. Other columns of docs are left behind, whatever their names.
    """
    rows, settled = repeats(docs, window, doc_id, text)
    settled = settled.select("id", "digest", "removed", "kept_hash").distinct()
    out = rows.drop("keys").join(settled, ["id", "digest"], "left")
    return out.select(
        id_or_null(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_hash", "whole")).alias("kept_sha256"),
    )
