"""Bulk graph documents in JSON: {"nodes": [...], "edges": [...]}, with either spelling of each field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.graph_writes import upsert_edges, upsert_nodes

DOCUMENT = """struct<nodes: array<struct<id: string, node_type: string, type: string, metadata: string>>,
edges: array<struct<from_id: string, `from`: string, to_id: string, `to`: string, edge_type: string, type: string, metadata: string>>>"""


def string_values(json: str):
    """The entries of a JSON object whose values are strings, as a map; others are dropped."""
    raw = F.from_json(F.col(json), "map<string,string>", {"allowUnquotedFieldNames": "false"})
    # a string value stands in the text as "key": "..."; to_json of the parsed variant tells its type
    typed = F.expr(f"from_json({json}, 'map<string,variant>')")
    strings = F.map_filter(typed, lambda _, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.map_filter(raw, lambda k, _: F.map_contains_key(strings, k)), F.create_map().cast("map<string,string>"))


def parse(documents: DataFrame, json: str = "json", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """documents (seq, json) -> node rows (seq, key, node_type, props) and edge rows (seq, from_key, to_key, edge_type, props).

    Items without an id, an end or a type, and documents that don't parse, are left out. seq orders all items: by
    document, then place.
    """
    parsed = documents.select(F.col(seq).alias("_doc"), F.from_json(json, DOCUMENT).alias("d"))
    at = (F.col("_doc") * F.lit(1 << 32) + F.col("_pos")).alias("seq")
    nodes = parsed.select("_doc", F.posexplode("d.nodes").alias("_pos", "x")).withColumn("_meta", F.col("x.metadata"))
    nodes = nodes.select(at, F.col("x.id").alias("key"), F.coalesce("x.node_type", "x.type").alias("node_type"), string_values("_meta").alias("props"))
    edges = parsed.select("_doc", F.posexplode("d.edges").alias("_pos", "x")).withColumn("_meta", F.col("x.metadata"))
    edges = edges.select(at, F.coalesce("x.from_id", "x.from").alias("from_key"), F.coalesce("x.to_id", "x.to").alias("to_key"), F.coalesce("x.edge_type", "x.type").alias("edge_type"), string_values("_meta").alias("props"))
    return nodes.where("key is not null and node_type is not null"), edges.where("from_key is not null and to_key is not null and edge_type is not null")


def ingest(graph: Graph, documents: DataFrame, json: str = "json", seq: str = "seq") -> Graph:
    """graph with all nodes, then all edges, of the documents; missing ends become nodes of type 'unknown'."""
    nodes, edges = parse(documents, json, seq)
    return upsert_edges(upsert_nodes(graph, nodes), edges)


def empty_graph(spark) -> Graph:
    return Graph(
        spark.createDataFrame([], "id bigint, key string, node_type string, props map<string,string>"),
        spark.createDataFrame([], "id bigint, src bigint, dst bigint, edge_type string, weight double, props map<string,string>"),
    )
