"""Property graphs as two tables, and reads on them: neighbours, traversal, grouped impact.

nodes(id, key, node_type, props) and edges(id, src, dst, edge_type, weight, props); directed, parallel edges allowed. Every
read takes a table of seeds (seed, id), so that many traversals are one plan: a level is one join of the frontier with the
edges. A frontier that was counted and is small is broadcast, and the edges aren't shuffled; a large one meets them in a
shuffled join whose skewed keys Spark splits. Each level is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import dealt, durable, hinted

OUT, IN, BOTH = "OUT", "IN", "BOTH"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def arcs(self, direction: str = OUT, edge_types: list[str] | None = None) -> DataFrame:
        """src, dst, edge_type, weight as they are walked in a direction, of the given types (none: all)."""
        edges = self.edges.select("src", "dst", "edge_type", "weight")
        if edge_types:
            edges = edges.where(F.col("edge_type").isin(*edge_types))
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight")
        if direction == OUT:
            return edges
        if direction == IN:
            return back
        if direction == BOTH:
            return edges.unionByName(back)
        raise ValueError(f"direction must be OUT, IN or BOTH, not {direction!r}")

    def seeds(self, *keys: str) -> DataFrame:
        """(seed, id) of the nodes with these keys."""
        return self.nodes.where(F.col("key").isin(*keys)).select(F.col("id").alias("seed"), "id")

    def typed(self, rows: DataFrame) -> DataFrame:
        """rows with id -> with key and node_type of the node."""
        return rows.join(self.nodes.select("id", "key", "node_type"), "id")


def node(graph: Graph, *keys: str) -> DataFrame:
    """key, node_type and properties of the nodes with these keys."""
    return graph.nodes.where(F.col("key").isin(*keys)).select("id", "key", "node_type", "props", F.coalesce(F.size("props"), F.lit(0)).alias("n_props"))


def list_by_type(graph: Graph, node_type: str, limit: int | None = None) -> DataFrame:
    found = graph.nodes.where(F.col("node_type") == node_type).select("id", "key", "node_type")
    return found if limit is None else found.orderBy("id").limit(limit)


def stats(graph: Graph) -> DataFrame:
    """Live nodes, and live edges (whose ends are both live)."""
    ids = graph.nodes.select("id")
    edges = graph.edges.select("src", "dst")
    n = edges.count()
    whole = dealt(dealt(edges, ["src"], n).join(ids.toDF("src"), "src", "left_semi"), ["dst"], n).join(ids.toDF("dst"), "dst", "left_semi")
    return ids.agg(F.count("*").alias("nodes")).crossJoin(whole.agg(F.count("*").alias("edges")))  # one row each


def neighbors(graph: Graph, seeds: DataFrame, direction: str = OUT, edge_types: list[str] | None = None) -> DataFrame:
    """(seed, id, key, node_type) one step away, each once; a loop makes a node its own neighbour."""
    n = seeds.count()
    near = graph.arcs(direction, edge_types).join(hinted(seeds.withColumnRenamed("id", "src"), n), "src").select("seed", F.col("dst").alias("id")).distinct()
    return graph.typed(near).select("seed", "id", "key", "node_type")


def degrees(graph: Graph, direction: str = OUT) -> DataFrame:
    """Edges per node, parallel ones counted; nodes without any count 0."""
    counts = graph.arcs(direction).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return graph.nodes.select("id", "key").join(counts, "id", "left").select("id", "key", F.coalesce("n", F.lit(0)).alias("degree"))


def common_neighbors(graph: Graph, pairs: DataFrame, direction: str = OUT) -> DataFrame:
    """pairs (pair, a, b) -> (pair, id, key, node_type) of the nodes one step away from both."""
    left = neighbors(graph, pairs.select(F.col("pair").alias("seed"), F.col("a").alias("id")), direction)
    right = neighbors(graph, pairs.select(F.col("pair").alias("seed"), F.col("b").alias("id")), direction).select("seed", "id")
    return left.join(right, ["seed", "id"], "left_semi").withColumnRenamed("seed", "pair")


def traverse(graph: Graph, seeds: DataFrame, depth: int = 10, direction: str = OUT, edge_types: list[str] | None = None, node_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Breadth-first from many seeds: (seed, id, depth), the seed at depth 0, each node at its least depth.

    edge_types are alternatives; types that no edge has leave only the seeds. node_type prunes: nodes of other types are
    neither returned nor walked through (a type that no node has filters nothing). With a limit the walk of a seed ends
    once its nodes, the seed included, are as many; the nearest stay, of equal depth those with the least id.
    """
    arcs = graph.arcs(direction, edge_types).select("src", "dst")
    if node_type is not None and not graph.nodes.where(F.col("node_type") == node_type).isEmpty():
        arcs = arcs.join(graph.nodes.where(F.col("node_type") == node_type).select(F.col("id").alias("dst")), "dst", "left_semi")
    if depth > 1:
        arcs = durable(arcs, "arcs")  # read at every level
    edges = arcs.count() if depth else 0
    frontier = durable(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)), "level")
    visited, level = frontier, 0
    while level < depth:
        n = frontier.count()
        if not n:
            break
        level += 1
        step = arcs.join(hinted(frontier.select("seed", F.col("id").alias("src")), n), "src").select("seed", F.col("dst").alias("id"))
        step = dealt(step, ["seed", "id"], max(n, min(edges, n * n))).distinct()  # about as many steps as edges
        frontier = durable(step.join(visited.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)), "level")
        visited = visited.unionByName(frontier)
        if limit is not None:
            full = visited.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("seed")
            frontier = frontier.join(full, "seed", "left_anti")
    if limit is not None:
        nearest = Window.partitionBy("seed").orderBy("depth", "id")
        visited = visited.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= limit).drop("_n")
    return visited


def impact(graph: Graph, seeds: DataFrame, depth: int = 10, edge_types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
    """Per seed how many nodes are reachable over outgoing edges, by type, and as 'total'; the seed isn't counted.

    node_types limits what is counted, not what is walked through. A seed that reaches nothing has a total of 0.
    """
    reached = graph.typed(traverse(graph, seeds, depth, OUT, edge_types).where("depth > 0")).where(F.col("id") != F.col("seed"))
    if node_types:
        reached = reached.where(F.col("node_type").isin(*node_types))
    by_type = reached.groupBy("seed", F.col("node_type").alias("type_name")).agg(F.count("*").alias("n"))
    total = by_type.groupBy("seed").agg(F.sum("n").alias("n"))
    total = seeds.select("seed").distinct().join(total, "seed", "left").select("seed", F.lit("total").alias("type_name"), F.coalesce("n", F.lit(0)).alias("n"))
    return by_type.unionByName(total)


def match(graph: Graph, *pattern) -> DataFrame:
    """Nodes along a chain of types: match(g, "part", ("supplied_by", OUT), "supplier", ("in", OUT), "nation") -> n0, n1, n2 (ids).

    A type or edge type of None is any. Each chain of nodes is returned once, whatever the number of parallel edges.
    """
    of_type = lambda t, name: (graph.nodes if t is None else graph.nodes.where(F.col("node_type") == t)).select(F.col("id").alias(name))
    found = of_type(pattern[0], "n0")
    for i in range(1, len(pattern), 2):
        edge_type, direction = pattern[i]
        n, before = f"n{(i + 1) // 2}", f"n{(i - 1) // 2}"
        arcs = graph.arcs(direction, None if edge_type is None else [edge_type]).select(F.col("src").alias(before), F.col("dst").alias(n)).distinct()
        found = found.join(arcs, before).join(of_type(pattern[i + 1], n), n)
    return found.select(*(f"n{i}" for i in range((len(pattern) + 1) // 2)))


def compacted(graph: Graph, table: str, buckets: int = 64) -> Graph:
    """The graph with its edges in a table bucketed and sorted by source: later shuffled joins on src leave the edges where they are."""
    graph.edges.write.bucketBy(buckets, "src").sortBy("src").mode("overwrite").saveAsTable(table)
    return Graph(graph.nodes, graph.edges.sparkSession.table(table))
