"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

Every signature coordinate comes from the same two permutations of the 32-bit shingle space: the first scatters the
shingles, the second ranks them, circularly shifted by another amount for each coordinate (no coordinate has a
permutation of its own). Coordinates are grouped into bands; documents that agree on a band are candidates.

Texts with equal shingle sets form a class with a number of its own, and one member stands for it from there on, so copies
cost nothing; ids only order and name what is found. In a
bucket every member is first verified against the bucket's least member only; the links so confirmed join most of a
bucket. In a second round the members outside the bucket's main component meet the rest of it, in blocks of bounded
size that compare whole shingle sets and return links alone: no bucket is gathered and pairs are never written out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_or_last, id_or_null, lean, mix32, mix64, small, texts_of
from .components import components

ROWS, BANDS = 6, 42
SHIFT = 0x9E3779B1
#: Shingles that are ranked at a time.
BLOCK = 1 << 16
#: Members of one bucket that a block of the second round holds on either side.
CHUNK = 512


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """The text's set of k-word shingles (A-Z lowered) as sorted distinct 64-bit hashes; with fewer words, the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    x = mix64(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        x = mix64(x ^ (h[i : len(h) - k + 1 + i] + np.uint64(i)))
    return np.unique(x)


def signatures(sets: list[np.ndarray], rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Circulant MinHash: one row of rows * bands coordinates for each (non-empty) set."""
    out = np.empty((len(sets), rows * bands), np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):  # a block of whole sets at a time, so that it stays in the cache
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), BLOCK, side="right")))
        x = np.concatenate(sets[first:last])
        scattered = mix32((x ^ (x >> np.uint64(32))).astype(np.uint32))
        starts = np.concatenate([[0], np.cumsum(sizes[first : last - 1])])
        for i in range(rows * bands):
            out[first:last, i] = np.minimum.reduceat(mix32(scattered + np.uint32(i * SHIFT & 0xFFFFFFFF)), starts)
        first = last
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per row and band."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2])
    for i in range(rows):
        key = mix64(key ^ s[:, :, i])
    return key.view(np.int64)


def text_hash(text: str):
    """128 bits that tell texts apart; no bytes for null."""
    return F.coalesce(F.unhex(F.md5(F.col(text))), F.lit(b""))


def shingled(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id (nulls last), hash (of the text), n (set size), digest (of the set; null if empty), bands (keys)."""

    @lean
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t, k) for t in texts_of(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for i, row in zip(full, band_keys(signatures([sets[i] for i in full]))):
                keys[i] = row
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "hash", "n", "digest", "bands"])

    return docs.select(id_or_last(doc_id).alias("id"), text_hash(text).alias("hash"), F.col(text).alias("text")).mapInArrow(run, "id bigint, hash binary, n bigint, digest binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) with the exact size of the intersection and both set sizes: a, b, both, na, nb."""

    @lean
    def run(batches):
        last, kept = None, None
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                if ta != last:
                    last, kept = ta, shingle_hashes(ta or "", k)
                other = shingle_hashes(tb or "", k)
                rows.append((a, b, len(np.intersect1d(kept, other, assume_unique=True)), len(kept), len(other)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "both", "na", "nb"])

    met = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, both bigint, na bigint, nb bigint")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """id, text -> rep, hashes (the sorted shingle set)."""

    @lean
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t, k).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "hashes"])

    return texts.mapInArrow(run, "rep bigint, hashes array<bigint>")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, a row per left set."""
    words = np.unique(np.concatenate(left))
    every, owner = np.concatenate(right), np.repeat(np.arange(len(right)), [len(r) for r in right])
    at = np.minimum(np.searchsorted(words, every), len(words) - 1)
    known = words[at] == every
    at, owner = at[known], owner[known]
    out, mark = np.empty((len(left), len(right)), np.int64), np.zeros(len(words), bool)
    for i, x in enumerate(left):
        mark[:] = False
        mark[np.searchsorted(words, x)] = True
        out[i] = np.bincount(owner[mark[at]], minlength=len(right))
    return out


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Members of buckets with c, main, size, others and hashes -> links (a, b) between members of different components.

    Members outside the bucket's main component meet all others of the bucket, in blocks of at most CHUNK of the former and
    about CHUNK of the latter; a large bucket is many blocks. Per member and component that it meets, one link is returned.
    """
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    of = lambda n: F.pmod(F.xxhash64("rep"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    kept = ["rep", "c", "hashes"]
    left = rows.where("c <> main").select("bucket", of("others").alias("i"), every("size").alias("j"), F.lit(0).alias("side"), *kept)
    right = rows.select("bucket", every("others").alias("i"), of("size").alias("j"), F.lit(1).alias("side"), *kept)
    blocks = left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def block(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        side, rep, c = (t.column(n).to_numpy() for n in ("side", "rep", "c"))
        lists = t.column("hashes").chunk(0)
        values, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [values[x:y] for x, y in zip(edges[:-1], edges[1:])]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        both, n = intersections([sets[i] for i in left], [sets[i] for i in right]), np.diff(edges)
        close = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (c[left][:, None] != c[right][None, :])
        x, y = np.nonzero(close)
        if not len(x):
            return None
        _, one = np.unique(np.stack([rep[left[x]], c[right[y]]]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(rep[left[x[one]]]), pa.array(rep[right[y[one]]])], ["a", "b"])

    @lean
    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("bucket", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                this = tuple(keys[low].tolist())
                if this != key and held:
                    if out := block(held):
                        yield out
                    held = []
                key = this
                held.append(batch.slice(low, high - low))
        if held and (out := block(held)):
            yield out

    return blocks.mapInArrow(run, "a bigint, b bigint")


def judged(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Per row of docs: id (nulls last), hash, n, digest as in `shingled`, component (least id of its component), kept."""
    rows = durable(shingled(docs, k, doc_id, text), "shingled")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = durable(classes.select("digest", "first.id", "first.hash", "n", "bands", F.monotonically_increasing_id().alias("rep")), "classes")
    keyed = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("center")).where("size > 1")
    members = durable(keyed.join(shared, "bucket").select("bucket", "rep", "n", F.col("center.rep").alias("center"), F.col("center.n").alias("center_n")), "members")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else the sizes alone rule a link out

    ids = durable(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("id", "hash", "rep"), "candidates")
    n = ids.count()
    body = docs.select(id_or_last(doc_id).alias("id"), text_hash(text).alias("hash"), F.col(text).alias("text"))
    texts = durable(body.join(small(ids, n), ["id", "hash"]).select(F.col("rep").alias("id"), "text"), "texts")
    if texts.count() > n:  # rows are there more than once, id and text
        texts = durable(texts.dropDuplicates(["id"]), "texts")

    stars = members.where(F.col("rep") != F.col("center")).where(fits(F.col("n"), F.col("center_n"))).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    label = components(verified(stars, texts, k).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))

    parted = members.where("rep <> center").join(label.toDF("rep", "c"), "rep", "left").select("bucket", "rep", F.coalesce("c", "rep").alias("c"))
    lead = parted.groupBy("bucket", "c").agg(F.count("*").alias("m")).groupBy("bucket")
    lead = lead.agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("size"), (F.sum("m") - F.max("m")).alias("others")).where("others > 0")
    parted = durable(parted.join(lead, "bucket"), "parted")
    sets = durable(shingle_sets(texts.join(small(parted.select(F.col("rep").alias("id")).distinct()), "id", "left_semi"), k), "sets")
    second = durable(block_links(parted.join(sets, "rep"), percent).distinct(), "verified")
    # links of the second round join components of the first
    whole = components(label.toDF("a", "b").union(second))
    linked = whole.toDF("rep", "root").join(classes.select("rep", "id", "digest"), "rep")
    heads = linked.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("head"))
    linked = linked.join(heads, "root").select("rep", "head")
    known = classes.select("rep", "digest", "id").join(linked, "rep", "left")
    known = known.select("digest", F.coalesce("head.id", "id").alias("component"), F.coalesce(F.col("head.digest") == F.col("digest"), F.lit(True)).alias("leads"))
    out = rows.select("id", "hash", "n", "digest").join(known, "digest", "left").withColumn("component", F.coalesce("component", "id"))
    return out.withColumn("kept", F.coalesce("leads", F.lit(True)) & (F.col("id") == F.col("component"))).drop("leads")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of k-word shingles have 100 * intersection >= percent * union; component_id is the
    least id reachable over links, itself included; kept marks the row that has that id. A null or wordless text has an
    empty set and no links. A null id comes after all others and stays null in the result. Rows that share an id are each
    judged by their own text; where several of a component have its least id, those of one set are kept. An empty table
    gives an empty one. Other columns of docs are left behind, whatever their names.
    """
    out = judged(docs, k, percent, doc_id, text)
    return out.select(id_or_null(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_or_null(F.col("component")).alias("component_id"), "kept")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all columns of docs, whatever their names.

    The one with the least id stays, of several with that id one; other rows go or stay by their own texts, not by their
    ids. Texts without words all stay, but of rows with the same id and text one.
    """
    kept = judged(docs, k, percent, doc_id, text).where("kept").groupBy("id", F.coalesce("digest", "hash").alias("set")).agg(F.min("hash").alias("_hash"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), id_or_last(doc_id).alias("_id"), text_hash(text).alias("_hash"))
    return whole.join(kept.select(F.col("id").alias("_id"), "_hash"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
