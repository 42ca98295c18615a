"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

A table's hash of a unit vector: random signs and a fast Hadamard transform, three times over, then the axis with the
largest coordinate and its sign (the nearest vertex of the cross-polytope); `k` such rotations make a bucket. Every
vector lives in the bucket of its nearest vertices and also visits those next to it. In a bucket all pairs with a
resident are verified by their cosine in double precision. Large buckets are cut into chunks that meet pair by pair in
separate tasks, so no bucket is gathered and none is cut short.

A pair that meets in several buckets counts in the least of them only. Tasks return, for some blocks at a time, each vector's links and
a spanning forest of its blocks, not the pairs: what is shuffled grows with the vectors. Equal vectors are one class with
a count.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_or_last, id_or_null, lean, mix64, small
from .components import components

#: Rotations of a table: with more of them buckets are smaller, and a pair meets in fewer tables.
MOST_ROTATIONS = 4
#: Odds that a pair of the least cosine meets in no table.
MISSED = 1e-4
NEXT = 2
CHUNK = 1024
#: Rows of small blocks that are compared together, the members of a block that is compared by a product of its own, and the
#: numbers that are held at a time when pairs are compared.
GROUP, DENSE, PRODUCTS = 8192, 128, 1 << 20
SEED = 20240229


class CrossPolytope:
    """`tables` hashes of `k` rotations each, alike on every worker."""

    def __init__(self, k: int, tables: int):
        self.k, self.tables = k, tables

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Unit rows -> (rows, tables, 1 + NEXT * k) bucket numbers; the first of a table is the row's own."""
        n, d = x.shape
        size = max(2, 1 << max(0, d - 1).bit_length())
        rng = np.random.default_rng([SEED, d])
        padded = np.zeros((n, size))
        padded[:, :d] = x
        out = np.empty((n, self.tables, 1 + NEXT * self.k), np.uint64)
        for t in range(self.tables):
            near = []
            for _ in range(self.k):
                y = padded
                for _ in range(3):
                    y = hadamard(y * rng.choice((-1.0, 1.0), size))
                near.append(nearest_vertices(np.concatenate([y, -y], axis=1)))
            code = lambda places, t=t: self.number(t, d, places)
            own = [v[:, 0] for v in near]
            out[:, t, 0] = code(own)
            for i in range(self.k):
                for j in range(NEXT):
                    out[:, t, 1 + NEXT * i + j] = code([near[i][:, 1 + j] if m == i else own[m] for m in range(self.k)])
        return out.view(np.int64)

    def number(self, t: int, d: int, places: list[np.ndarray]) -> np.ndarray:
        x = np.full(len(places[0]), (t + 1) << 32 | d, np.uint64)
        for p in places:
            x = mix64(x) ^ p
        return mix64(x)


def nearest_vertices(y: np.ndarray) -> np.ndarray:
    """Places of the 1 + NEXT largest numbers of each row, the largest first, the least place first among equals. Overwrites y."""
    out = np.empty((len(y), 1 + NEXT), np.uint64)
    rows = np.arange(len(y))
    for i in range(1 + NEXT):
        out[:, i] = at = y.argmax(axis=1)
        y[rows, at] = -np.inf
    return out


@functools.lru_cache(maxsize=64)
def odds(d: int, k: int, cosine: float, tables: int = 8) -> float:
    """How likely a pair of this cosine in d dimensions meets in one table of k rotations: measured on random pairs."""
    n = max(100, min(1500, (1 << 18) // d))
    rng = np.random.default_rng([SEED, d, k])
    a, b = rng.normal(size=(2, n, d))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b -= (a * b).sum(1, keepdims=True) * a
    size = np.sqrt((b * b).sum(1, keepdims=True))
    b = cosine * a + np.sqrt(1 - cosine * cosine) * (b / size if d > 1 else 0)
    p, q = (CrossPolytope(k, tables).buckets(x) for x in (a, b))
    met = (q == p[:, :, :1]).any(2) | (p == q[:, :, :1]).any(2)
    return max(float(met.mean()) - 2 / math.sqrt(n * tables), 0.01)  # less two standard errors at most


def tables_for(dimensions: list[int], k: int, cosine: float) -> int:
    """So many tables that a pair of this cosine meets in none of them with odds MISSED, in whichever of the dimensions."""
    least = min((odds(d, k, cosine) for d in dimensions), default=1.0)
    return math.ceil(math.log(MISSED) / math.log(1 - min(least, 0.999)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep norms."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def unit(vector) -> np.ndarray | None:
    """The vector scaled to norm 1 in double precision; None if it is null, empty or zero or holds what isn't a finite number."""
    if vector is None or not len(vector) or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    if not most:
        return None
    x = x / most  # no overflow in the squares
    return x / math.sqrt(x @ x)


def matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors as rows scaled to norm 1 in double precision, short ones padded with zeros; and their dimensions."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    edges = lists.offsets.to_numpy()
    d = np.diff(edges)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[edges[0] : edges[-1]]
    x = np.zeros((len(d), d.max(initial=0)))
    x[np.arange(x.shape[1]) < d[:, None]] = values
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), d


def hashed(vectors: DataFrame, scheme: CrossPolytope) -> DataFrame:
    """Per distinct vector rep, count, vec -> with buckets (flat, tables by 1 + NEXT * k)."""

    @lean
    def run(batches):
        for batch in batches:
            x, dims = matrix(batch.column("vec"))
            keys: list = [None] * len(x)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for i, row in zip(at.tolist(), scheme.buckets(x[at, :d]).reshape(len(at), -1)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("count"), batch.column("vec"), pa.array(keys, pa.list_(pa.int64()))], ["rep", "count", "vec", "buckets"])

    return vectors.select("rep", "count", "vec").mapInArrow(run, f"rep bigint, count bigint, vec {vectors.schema['vec'].dataType.simpleString()}, buckets array<bigint>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place reachable from each of n places over the links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_in_group(x: np.ndarray, dims: np.ndarray, edges: np.ndarray, home: np.ndarray, fits, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of one block, one of them at home in it, that `fits` lets through and whose cosine is high enough.

    Blocks are the rows between edges. Small ones are compared together, their pairs side by side; large ones by a product each.
    """
    sizes = np.diff(edges)
    dense = sizes > DENSE
    rows = np.flatnonzero(home & ~np.repeat(dense, sizes))
    start, size = (np.repeat(v, sizes)[rows] for v in (edges[:-1], sizes))
    ends = np.cumsum(size)
    a = np.repeat(rows, size)
    b = np.arange(len(a)) - np.repeat(ends - size, size) + np.repeat(start, size)
    once = (a != b) & ~(home[b] & (a > b))
    a, b = a[once], b[once]
    at_once = max(1, PRODUCTS // max(1, x.shape[1]))
    close = [np.einsum("ij,ij->i", x[a[i : i + at_once]], x[b[i : i + at_once]]) >= least_cosine for i in range(0, len(a), at_once)]
    close = np.concatenate(close) if close else np.empty(0, bool)
    found = [(a[close], b[close])]
    for i in np.flatnonzero(dense).tolist():
        low, high = edges[i], edges[i + 1]
        own = low + np.flatnonzero(home[low:high])
        p, q = np.nonzero(x[own] @ x[low:high].T >= least_cosine)
        p, q = own[p], low + q
        once = (p != q) & ~(home[q] & (p > q))
        found.append((p[once], q[once]))
    a, b = (np.concatenate(v) for v in zip(*found))
    ok = fits(a, b) & (dims[a] == dims[b])
    return a[ok], b[ok]


def least_meeting(scheme: CrossPolytope, x: np.ndarray, dims: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the least bucket that it meets in, one of the two being at home there."""
    involved, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = np.empty((len(involved), scheme.tables, 1 + NEXT * scheme.k), np.int64)
    for d in np.unique(dims[involved]).tolist():
        at = np.flatnonzero(dims[involved] == d)
        keys[at] = scheme.buckets(x[involved[at], :d])
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    out, none = np.empty(len(a), np.int64), np.iinfo(np.int64).max
    at_once = max(1, PRODUCTS // keys[:1].size) if len(keys) else 1
    for i in range(0, len(a), at_once):
        p, q = keys[ia[i : i + at_once]], keys[ib[i : i + at_once]]
        meet = np.minimum(np.where((q == p[:, :, :1]).any(2), p[:, :, 0], none), np.where((p == q[:, :, :1]).any(2), q[:, :, 0], none))
        out[i : i + at_once] = meet.min(axis=1)
    return out


def linked(members: DataFrame, scheme: CrossPolytope, least_cosine: float) -> DataFrame:
    """Rows sorted by block -> per run of blocks and linked vector: rep, n (vectors it is linked to), root (least rep it reaches there)."""

    def blocks(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        rep, count, home, chunk, ci, cj, bucket = (t.column(c).to_numpy() for c in ("rep", "count", "home", "chunk", "ci", "cj", "bucket"))
        x, dims = matrix(t.column("vec"))
        new = (bucket[1:] != bucket[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(rep)]])
        # pairs within a chunk belong to the block of that chunk alone
        fits = lambda a, b: (rep[a] != rep[b]) & ((ci[a] == cj[a]) | (chunk[a] != chunk[b]))
        a, b = near_in_group(x, dims, edges, home, fits, least_cosine)
        if len(a):
            here = least_meeting(scheme, x, dims, a, b) == bucket[a]
            a, b = a[here], b[here]
        if not len(a):
            return None
        reps, place = np.unique(rep, return_inverse=True)  # places in order of rep, so that the least place is the least rep
        a, b, ca, cb = place[a], place[b], count[a], count[b]
        n = np.bincount(a, cb, len(reps)) + np.bincount(b, ca, len(reps))
        root = reps[forest(len(reps), a, b)]
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(n[at].astype(np.int64)), pa.array(root[at])], ["rep", "n", "root"])

    @lean
    def run(batches):
        held, n, last = [], 0, None
        for whole in batches:
            for first in range(0, whole.num_rows, GROUP):
                batch = whole.slice(first, GROUP)
                keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "ci", "cj")], axis=1)
                before = keys[:1] if last is None else last
                starts = np.flatnonzero((keys != np.concatenate([before, keys[:-1]])).any(axis=1))
                last = keys[-1:]
                if len(starts) and n + (cut := int(starts[-1])) >= GROUP:  # whole blocks only
                    if (out := blocks([*held, batch.slice(0, cut)])) is not None:
                        yield out
                    held, n, batch = [], 0, batch.slice(cut)
                held.append(batch)
                n += batch.num_rows
        if held and (out := blocks(held)) is not None:
            yield out

    return members.mapInArrow(run, "rep bigint, n bigint, root bigint")


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of like dimension are linked if their cosine in double precision is least_cosine or more and they meet in a
    bucket (about one pair in 1 / MISSED of just that cosine doesn't, whatever its dimension; fewer of closer ones). A vector that is null, empty or
    zero, or holds a null or non-finite component, has no links. Equal vectors are linked. component_id is the least id
    reachable, itself included. A null id comes after all others and stays null; rows that share an id are each returned
    and count as vectors of their own. An empty table gives an empty one. Other columns are left behind.
    """

    @lean
    def digest(batches):
        for batch in batches:
            units = [unit(v) for v in batch.column("vec").to_pylist()]
            marks = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.binary()), batch.column("vec")], ["id", "digest", "vec"])

    # vectors of floats are sent about as floats; all that is computed from them is in double precision
    kind = "float" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(id_or_last(vec_id).alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("vec")).mapInArrow(digest, f"id bigint, digest binary, vec array<{kind}>")
    rows = durable(rows, "vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("count"), F.first("vec").alias("vec"))
    classes = durable(classes, "distinct")
    n = classes.count()
    # the widest vectors of each padded width: a dozen numbers or so
    widths = [r["d"] for r in classes.groupBy(F.ceil(F.log2(F.size("vec")))).agg(F.max(F.size("vec")).alias("d")).collect()]
    width = max(widths, default=1)
    # so many rotations that buckets stay small as the vectors grow in number, so many tables that few pairs are missed
    k = min(MOST_ROTATIONS, max(1, math.ceil(math.log(max(n / 32, 1)) / math.log(2 * max(2, width)))))
    scheme = CrossPolytope(k, tables_for(widths, k, least_cosine))
    keyed = durable(hashed(classes, scheme), "hashed")
    each = 1 + NEXT * k
    large = durable(keyed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK), "large")
    members = keyed.select("rep", "count", "vec", F.posexplode("buckets").alias("at", "bucket")).withColumn("home", F.col("at") % each == 0)
    members = members.join(small(large), "bucket", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / CHUNK), F.lit(1)).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select("bucket", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "home", "rep", "count", "vec")
    members = members.repartition("bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj")
    met = durable(linked(members, scheme, least_cosine), "met")
    joined = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("rep").agg(F.sum("n").alias("others"))
    known = classes.join(links, "rep", "left").join(joined.toDF("rep", "component"), "rep", "left")
    known = known.select("digest", (F.col("count") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "digest").join(known, "digest", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(id_or_null(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_or_null(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
