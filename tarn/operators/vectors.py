"""Vector search: exact top-k by cosine for one query or a table of them, an approximate index with exact re-ranking, and
search followed by graph expansion.

vectors(node_id, field, vec). Scores are dot products of normalised vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import normalized, similarity
from .graph import OUT, Graph, traverse

#: Queries whose matrix is sent to every task at a time; more are searched block by block.
QUERY_BLOCK = 2048
#: Queries and vectors whose scores are held at a time.
SCORE_BLOCK = (256, 4096)
#: Vectors of an index for each slice of its buckets: a bucket that held them all would still be one task's.
SLICE_ROWS = 200_000


def nearest(vectors: DataFrame, query: list[float], k: int, field: str | None = None) -> DataFrame:
    """The k vectors nearest to one query: node_id, score; each task keeps k rows, so nothing is sorted whole."""
    if field is not None:
        vectors = vectors.where(F.col("field") == field)
    scored = vectors.where(F.size("vec") == len(query)).select("node_id", similarity(F.col("vec"), query).alias("score"))
    return scored.orderBy(F.desc("score"), "node_id").limit(k)


def unit_rows(lists: list) -> np.ndarray:
    x = np.array(lists, np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x.copy(), where=size > 0)


def matrix_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of rows of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(len(column), -1))


def kept_nearest(row: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k entries of greatest score of each row, ties by node."""
    order = np.lexsort((node, np.where(np.isnan(score), np.inf, -score), row))
    row, node, score = row[order], node[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], node[kept], score[kept]


def nearest_rows(asked: np.ndarray, unit: np.ndarray, node: np.ndarray, k: int, so_far: tuple | None = None) -> tuple:
    """(row, node, score): for each row of asked the k nearest of unit, and of those found so far. Scores are held for
    SCORE_BLOCK rows and vectors at a time, whatever the sizes."""
    found = [so_far] if so_far else []
    for at in range(0, len(asked), SCORE_BLOCK[0]):
        for first in range(0, len(unit), SCORE_BLOCK[1]):
            scores = asked[at : at + SCORE_BLOCK[0]] @ unit[first : first + SCORE_BLOCK[1]].T
            least = np.where(np.isnan(scores), -np.inf, scores)
            n = scores.shape[1]
            if n > k:
                row, column = np.nonzero(least >= np.partition(least, n - k, axis=1)[:, n - k, None])
            else:
                row, column = (x.ravel() for x in np.indices(scores.shape))
            found.append(kept_nearest(row + at, node[first + column], scores[row, column], k))
    return kept_nearest(*(np.concatenate(x) for x in zip(*found)), k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries (query, vec) -> (query, node_id, score, rank) of the k nearest of each, ties by id; all of one dimension.

    A block of at most QUERY_BLOCK queries is a matrix that every task multiplies with its vectors, a small block of scores at
    a time; of each task only k rows a query go on, so what is held and shuffled grows with queries, not with vectors.
    """
    wanted = queries.select("query", "vec").orderBy("query")
    blocks, out = -(-wanted.count() // QUERY_BLOCK), None
    for block in range(blocks):
        rows = wanted.offset(block * QUERY_BLOCK).limit(QUERY_BLOCK).collect()
        ids, matrix = np.array([r["query"] for r in rows]), unit_rows([r["vec"] for r in rows])

        def run(batches, ids=ids, matrix=matrix):
            best = None
            for batch in batches:
                batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("vec")), matrix.shape[1]), False))
                if batch.num_rows:
                    best = nearest_rows(matrix, matrix_of(batch.column("vec")), batch.column("node_id").to_numpy(), k, best)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "node_id", "score"])

        some = vectors.select("node_id", "vec").mapInArrow(run, "query bigint, node_id bigint, score double")
        out = some if out is None else out.unionByName(some)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, node_id bigint, score double, rank int")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def approximate_index(vectors: DataFrame, dimension: int, tables: int = 12, bucket: float = 0.6, seed: int = 42):
    """Random-projection hashing over normalised vectors (model and hashed table) for `approximate_nearest`."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    ready = vectors.where(F.size("vec") == dimension).select("node_id", array_to_vector(normalized(F.col("vec"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(ready)
    return model, model.transform(ready)


def save_index(index, folder: str) -> None:
    """Write an approximate index: the model, and the table with its hashes, which is not fitted or hashed again."""
    model, table = index
    model.write().overwrite().save(f"{folder}/model")
    table.write.mode("overwrite").parquet(f"{folder}/table")


def load_index(spark: SparkSession, folder: str):
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    return BucketedRandomProjectionLSHModel.load(f"{folder}/model"), spark.read.parquet(f"{folder}/table")


def approximate_nearest_many(index, queries: DataFrame, k: int, together: int = 4) -> DataFrame:
    """queries (query, vec) -> (query, node_id, score, rank) of about the k nearest of each, in one plan.

    Queries are hashed like the vectors; `together` hashes make a bucket, and both meet in the buckets, the vectors of a
    large index dealt to several slices of each. A slice's queries and vectors are multiplied as matrices and k rows a query
    go on, so no pair of them is shuffled or joined. A pair that meets in several buckets counts once; the score is exact.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model, table = index
    asked = model.transform(queries.select("query", array_to_vector(normalized(F.col("vec"))).alias("features")))
    buckets = F.array(*(F.xxhash64(F.lit(i), *(vector_to_array(F.col("hashes")[i + j])[0] for j in range(together))) for i in range(0, model.getNumHashTables() - together + 1, together)))
    slices = -(-table.count() // SLICE_ROWS) or 1
    vectors = table.select("node_id", vector_to_array("features").alias("vec"), F.pmod(F.xxhash64("node_id"), F.lit(slices)).alias("slice"), F.explode(buckets).alias("bucket"))
    asked = asked.select("query", vector_to_array("features").alias("vec"), F.explode(buckets).alias("bucket")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("slice", F.col("slice").cast("long"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], "int64"), "node_id": pa.array([], "int64"), "score": pa.array([], "float64")})
        row, node, score = nearest_rows(*(matrix_of(t.column("vec").combine_chunks()) for t in (left, right)), right.column("node_id").to_numpy(), k)
        return pa.table({"query": left.column("query").to_numpy()[row], "node_id": node, "score": score})

    pairs = asked.groupBy("bucket", "slice").cogroup(vectors.groupBy("bucket", "slice")).applyInArrow(met, "query bigint, node_id bigint, score double")
    scored = pairs.groupBy("query", "node_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def approximate_nearest(index, query: list[float], k: int) -> DataFrame:
    """About the k nearest by cosine: candidates share a hash with the query; the score is exact."""
    from pyspark.ml.linalg import Vectors

    model, table = index
    unit = unit_rows([query])[0]
    found = model.approxNearestNeighbors(table, Vectors.dense(unit), k, "distance")
    # for unit vectors distance and cosine are one another's function
    return found.select("node_id", (1 - F.col("distance") * F.col("distance") / 2).alias("score")).orderBy(F.desc("score"), "node_id")


def retrieve(graph: Graph, vectors: DataFrame, query: list[float], k: int, depth: int = 1, direction: str = OUT, edge_types: list[str] | None = None, node_type: str | None = None, field: str | None = None) -> DataFrame:
    """The k nearest live nodes with what surrounds them: id, key, score, props, neighbors (keys within depth, sorted).

    All hits are the seeds of one traversal.
    """
    alive = vectors.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    hits = nearest(alive, query, k, field).select(F.col("node_id").alias("id"), "score")
    around = graph.typed(traverse(graph, hits.select(F.col("id").alias("seed"), "id"), depth, direction, edge_types, node_type).where("depth > 0 and id <> seed"))
    around = around.groupBy(F.col("seed").alias("id")).agg(F.sort_array(F.collect_set("key")).alias("neighbors"))
    out = hits.join(graph.nodes.select("id", "key", "props"), "id").join(around, "id", "left")
    return out.select("id", "key", "score", "props", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))


def retrieved_subgraph(graph: Graph, vectors: DataFrame, query: list[float], k: int, depth: int = 1, direction: str = OUT, edge_types: list[str] | None = None, node_type: str | None = None, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, key, node_type, score, which is -1 for those that the expansion of the k nearest adds; edges among them)."""
    alive = vectors.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    hits = nearest(alive, query, k, field).select(F.col("node_id").alias("id"), "score")
    reached = traverse(graph, hits.select(F.col("id").alias("seed"), "id"), depth, direction, edge_types, node_type).select("id").distinct()
    nodes = graph.typed(reached.join(hits, "id", "left")).select("id", "key", "node_type", F.coalesce("score", F.lit(-1.0)).alias("score"))
    return nodes, subgraph(graph, nodes.select("id"))


def subgraph(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges among the nodes of ids (id)."""
    wanted = ids.select("id").distinct()
    return graph.edges.join(wanted.toDF("src"), "src", "left_semi").join(wanted.toDF("dst"), "dst", "left_semi").select("src", "dst", "edge_type", "weight")
