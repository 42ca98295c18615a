"""Changes to a graph as tables folded into it. Ids are given by the caller or by hashing keys, never by a global counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalized
from ..plans.durable import dealt
from .graph import Graph

EDGE = ["src", "dst", "edge_type"]


def node_id(key):
    """Id of a node that comes by key alone."""
    return F.xxhash64(key)


def upsert_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """graph with rows (seq, key, node_type, props): a known key keeps its id and type, properties are written over one by one."""
    new = rows.groupBy("key").agg(F.min_by("node_type", "seq").alias("_type"))
    pairs = rows.select("key", "seq", F.explode("props").alias("k", "v")).groupBy("key", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = pairs.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_props"))
    new = new.join(maps, "key", "left")
    both = graph.nodes.join(new, "key", "full")
    empty = F.create_map().cast("map<string,string>")
    old, added = F.coalesce("props", empty), F.coalesce("_props", empty)
    props = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(added, k)), added)
    return Graph(both.select(F.coalesce("id", node_id("key")).alias("id"), "key", F.coalesce("node_type", "_type").alias("node_type"), props.alias("props")), graph.edges)


def add_nodes(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph with the rows (seq, key, node_type, props) whose key is new; the others, as seq, key and error).

    Of several rows with one new key the first is added.
    """
    fresh = rows.join(graph.nodes.select("key"), "key", "left_anti")
    first = fresh.groupBy("key").agg(F.min_by(F.struct("node_type", "props"), "seq").alias("_n"), F.min("seq").alias("_seq"))
    added = first.select(node_id("key").alias("id"), "key", F.col("_n.node_type").alias("node_type"), F.coalesce("_n.props", F.create_map().cast("map<string,string>")).alias("props"))
    refused = rows.join(first.select("key", "_seq"), "key", "left").where("_seq is null or seq <> _seq").select("seq", "key", F.lit("ERR node already exists").alias("error"))
    return Graph(graph.nodes.select(*added.columns).unionByName(added), graph.edges), refused


def add_edges(graph: Graph, rows: DataFrame) -> Graph:
    """graph with rows (id, from_key, to_key, edge_type, weight): parallel edges stay apart; an edge needs both nodes; a missing weight is 1."""
    ids = graph.nodes.select("id", "key")
    ends = rows.withColumnRenamed("id", "edge").join(ids.toDF("src", "from_key"), "from_key").join(ids.toDF("dst", "to_key"), "to_key")
    new = ends.select(F.col("edge").alias("id"), "src", "dst", "edge_type", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), F.lit(None).cast("map<string,string>").alias("props"))
    return Graph(graph.nodes, graph.edges.select(*new.columns).unionByName(new))


def upsert_edges(graph: Graph, rows: DataFrame) -> Graph:
    """graph with rows (seq, from_key, to_key, edge_type, props): one edge for each (from, to, type), of weight 1; missing ends
    become nodes of type 'unknown'."""
    ends = rows.select("seq", F.explode(F.array("from_key", "to_key")).alias("key"))
    missing = ends.join(graph.nodes.select("key"), "key", "left_anti").groupBy("key").agg(F.min("seq").alias("seq"))
    empty = F.create_map().cast("map<string,string>")
    graph = upsert_nodes(graph, missing.select("seq", "key", F.lit("unknown").alias("node_type"), empty.alias("props")))
    ids = graph.nodes.select("id", "key")
    new = rows.join(ids.toDF("src", "from_key"), "from_key").join(ids.toDF("dst", "to_key"), "to_key")
    pairs = new.select(*EDGE, "seq", F.explode("props").alias("k", "v")).groupBy(*EDGE, "k").agg(F.max_by("v", "seq").alias("v"))
    maps = pairs.groupBy(*EDGE).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_props"))
    fresh = new.select(*EDGE).distinct().join(graph.edges.select(*EDGE), EDGE, "left_anti")
    fresh = fresh.join(maps, EDGE, "left").select(F.xxhash64(*EDGE).alias("id"), *EDGE, F.lit(1.0).alias("weight"), F.coalesce("_props", empty).alias("props"))
    known = graph.edges.join(maps, EDGE, "left")
    old, added = F.coalesce("props", empty), F.coalesce("_props", empty)
    props = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(added, k)), added)
    known = known.select("id", *EDGE, "weight", props.alias("props"))
    return Graph(graph.nodes, known.unionByName(fresh))


def delete_nodes(graph: Graph, keys: DataFrame) -> Graph:
    """graph without the nodes of keys (key) and all edges at them."""
    gone = graph.nodes.join(keys.select("key").distinct(), "key", "left_semi").select("id")
    edges = graph.edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(*graph.edges.columns))


def delete_vectors(graph: Graph, vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """vectors without those of the nodes of keys (key): what goes with `delete_nodes`."""
    gone = graph.nodes.join(keys.select("key").distinct(), "key", "left_semi").select(F.col("id").alias("node_id"))
    return vectors.join(gone, "node_id", "left_anti").select(*vectors.columns)


def set_edge_properties(graph: Graph, rows: DataFrame) -> Graph:
    """graph with rows (seq, id, k, v) written to edges that are there."""
    last = rows.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_props"))
    old, added = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("props", "_props"))
    props = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(added, k)), added)
    known = graph.edges.join(maps, "id", "left").withColumn("props", F.when(F.col("_props").isNull(), F.col("props")).otherwise(props))
    return Graph(graph.nodes, known.select(*graph.edges.columns))


def delete_edges(graph: Graph, ids: DataFrame) -> Graph:
    edges = dealt(graph.edges, ["id"], graph.edges.count())
    return Graph(graph.nodes, edges.join(ids.select("id"), "id", "left_anti"))


def set_properties(graph: Graph, rows: DataFrame) -> Graph:
    """graph with rows (seq, key, k, v) written to nodes that are there."""
    known = rows.join(graph.nodes.select("key"), "key", "left_semi")
    return upsert_nodes(graph, known.select("seq", "key", F.lit(None).cast("string").alias("node_type"), F.create_map("k", "v").alias("props")))


def get_vectors(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, node_id, field) -> with vec, null where there is none."""
    return wanted.join(vectors, ["node_id", "field"], "left").select("pos", "node_id", "field", "vec")


def count_vectors(vectors: DataFrame) -> DataFrame:
    """Per field how many vectors there are, and their dimension."""
    return vectors.groupBy("field").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dimension"))


def set_vectors(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """vectors (node_id, field, vec) with rows (seq, node_id, field, vec), normalised: the last write wins.

    A field's dimension is that of its vectors so far, else of its first new one; rows of another dimension are left out.
    """
    new = rows.groupBy("node_id", "field").agg(F.max_by("vec", "seq").alias("vec"))
    first = rows.groupBy("field").agg(F.min_by(F.size("vec"), "seq").alias("_first"))
    held = vectors.groupBy("field").agg(F.min(F.size("vec")).alias("_held"))
    dims = first.join(held, "field", "left").select("field", F.coalesce("_held", "_first").alias("_dim"))
    new = new.join(dims, "field").where(F.size("vec") == F.col("_dim")).select("node_id", "field", normalized(F.col("vec")).alias("vec"))
    return vectors.join(new.select("node_id", "field"), ["node_id", "field"], "left_anti").select("node_id", "field", F.col("vec").cast("array<double>").alias("vec")).unionByName(new)
