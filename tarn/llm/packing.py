"""Best-fit packing of tokenised documents into sequences of fixed capacity by exact-complement hashing.

Only lengths matter for packing, and a piece has at most `capacity` tokens, so the corpus is packed as a histogram of
at most `capacity` rows, whatever its size. On that histogram the planner indexes which lengths exist, which sums two of
them make and, through these, which sums three make. It opens a sequence with the longest piece left and looks for a
single, a pair or a triple that fills the gap exactly, as far as the availability counts allow; where none does, the
longest piece that fits goes in (best fit) and the search goes on with the gap that is left. Every recipe found is used
as often as its counts allow, which uses up a length or nearly so: a plan has a few recipes per length.

Pieces meet their places in Spark: pieces of one length are numbered without gathering them (a count per salt and
length, running sums over the salts, numbers within a salt), and piece number k of its length takes the place that the
plan holds for it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load, texts_of_batch
from .common import durable, id_or_last, lean

CAPACITY = 2048
#: Pieces of one length that a task numbers.
SALT_ROWS = 200_000


def pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then `end_id`; only one of over `capacity` ids is cut. A null or empty text is the
    `end_id` alone. A null doc_id stays null. Repeated rows are packed as often as they come.
    """

    @lean
    def run(batches):
        bpe, end = load(vocab_path), end_id.to_bytes(4, "little")
        for batch in batches:
            of = batch.column("doc_id").to_pylist()
            rows = []
            for doc, ids in zip(of, bpe.encode_many(texts_of_batch(batch, "text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Sums:
    """Which lengths are left, and how many pairs of present lengths make each sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.present = counts > 0
        self.pairs = np.zeros(2 * len(counts), np.int64)
        for a in np.flatnonzero(self.present):
            self.pairs[a : a + len(counts)] += self.present & (np.arange(len(counts)) >= a)

    def gone(self, length: int) -> None:
        """No piece of this length is left."""
        if self.present[length]:
            self.pairs[length : length + len(self.counts)] -= self.present
            self.present[length] = False

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.present[gap] else ()

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        """The pair (longest first) that sums to gap, from the availability counts `left`."""
        if gap < 2 or not self.pairs[gap]:
            return ()
        a = np.arange((gap + 1) // 2, gap)
        fits = a[(left[a] > 0) & (left[gap - a] > (a == gap - a))]
        return (int(fits[-1]), gap - int(fits[-1])) if fits.size else ()

    def triple(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        """A triple that sums to gap, of all that there are the one with the longest first length; each is tried until one has its counts."""
        a = np.arange((gap + 2) // 3, gap - 1)
        for x in a[(left[a] > 0) & (self.pairs[gap - a] > 0)][::-1].tolist():
            left[x] -= 1
            rest = self.pair(gap - x, left)
            left[x] += 1
            if rest:
                return (x, *rest)
        return ()

    def exact(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        return (self.single(gap) if left[gap] > 0 else ()) or self.pair(gap, left) or self.triple(gap, left)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """counts[n] pieces of length n -> recipes (lengths in order) and how many sequences each makes.

    Every piece is used once; a recipe's lengths sum to len(counts) - 1 at most.
    """
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    sums, recipes = Sums(left), []
    longest = capacity
    while True:
        while longest and left[longest] == 0:
            longest -= 1
        if not longest:
            return recipes
        recipe, gap = [longest], capacity - longest
        left[longest] -= 1
        while gap:
            part = sums.exact(gap, left)
            if not part:  # best fit: the longest piece that fits
                fits = np.flatnonzero(left[1 : gap + 1])
                if not fits.size:
                    break
                part = (int(fits[-1]) + 1,)
            for x in part:
                left[x] -= 1
                gap -= x
            recipe += part
        uses = np.bincount(recipe, minlength=len(left))
        used = np.flatnonzero(uses)
        times = 1 + int((left[used] // uses[used]).min())
        left[used] -= (times - 1) * uses[used]
        for x in used[left[used] == 0].tolist():
            sums.gone(x)
        recipes.append((tuple(recipe), times))


def places(recipes: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first piece number, first sequence and offset of every run of places, by piece number."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for recipe, times in recipes:
        offset = 0
        for x in recipe:
            out.setdefault(x, []).append((taken.get(x, 0), first, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs)) for x, runs in out.items()}


def numbered(df: DataFrame, counts: np.ndarray, salts: int) -> DataFrame:
    """df with number: 0, 1, 2, ... within each length; a length is dealt to `salts` tasks at least, and to one for every SALT_ROWS of its rows."""
    rows = [(int(x), max(salts, -(-int(counts[x]) // SALT_ROWS))) for x in np.flatnonzero(counts)]  # at most `capacity` rows
    of = F.broadcast(df.sparkSession.createDataFrame(rows, "length bigint, salts bigint"))
    salted = df.join(of, "length").withColumn("salt", F.pmod(F.xxhash64(id_or_last(), "piece", "start", "ids_crc32"), "salts")).drop("salts")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    within = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_or_last(), "piece")) - 1)
    return within.join(before, ["length", "salt"]).withColumn("number", F.col("base") + F.col("within")).drop("salt", "base", "within")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (from `pieces`, read twice: pass a durable table) with sequence_id and offset.

    Every piece gets one place, equal rows one each; pieces of one length are interchangeable, so which of them takes which
    place is decided by hash, id and piece and says nothing. A null doc_id is a document like others. No pieces, no rows.
    """
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    found = spark.sparkContext.broadcast(places(plan(counts)))  # a few runs per length: bounded by the capacity

    @lean
    def place(batches):
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for x in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == x)
                start, first, off = found.value[x]
                run = np.searchsorted(start, numbers[at], side="right") - 1
                sequence[at], offset[at] = first[run] + numbers[at] - start[run], off[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return numbered(cut, counts, salts).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents; an empty table gives no rows."""
    return pack(durable(pieces(docs, vocab_path, capacity), "pieces"), capacity)
