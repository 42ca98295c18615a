"""Keyed tables, a property graph and vectors derived from relational tables: what the registered queries run on.

Every derivation stands here twice, as DataFrames and as SQL over the same columns, so results can be compared engine by engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.durable import dealt

#: The moment at which expiry is judged: 20 days after the first event.
NOW_MS = 1_705_795_200_000
DAY_MS = 86_400_000
#: Kinds of nodes; a node's id is its kind's number times 2**40 plus its key.
KINDS = ("region", "nation", "customer", "supplier", "part", "order")
SHIFT = 1 << 40

OPS = {"view": "SET", "purchase": "SET", "click": "INCRBY", "signup": "SETNX", "error": "DEL"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, ops: dict[str, str] = OPS) -> DataFrame:
    """Events as mutations of one key per user; events of types that `ops` doesn't name are none. Purchases expire."""
    op = F.lit(None).cast("string")
    for event, name in ops.items():
        op = F.when(F.col("event_type") == event, name).otherwise(op)
    cents = F.floor(F.col("value") * 100 + 0.5)
    ts_ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    ttl = F.when((F.col("event_type") == "purchase") & (op == "SET") | (op == "EXPIRE"), (F.col("event_id") % 7 + 1) * DAY_MS)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ts_ms.alias("ts_ms"), (F.col("user_id") % 4).cast("int").alias("db"), F.concat(F.lit("u:"), "user_id").alias("key"), op.alias("op"), cents.cast("string").alias("value"), cents.alias("delta"), ttl.alias("ttl_ms"))
    return rows.where("op is not null")


def log_sql(ops: dict[str, str] = OPS) -> str:
    op = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{o}'" for e, o in ops.items()) + " END"
    expires = " OR ".join(f"event_type = '{e}'" for e, o in ops.items() if o == "EXPIRE" or e == "purchase" and o == "SET") or "FALSE"
    return f"""log AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id % 4 AS INTEGER) AS db, 'u:' || user_id AS key, {op} AS op,
    CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR) AS value, CAST(floor(value * 100 + 0.5) AS BIGINT) AS delta,
    CASE WHEN {expires} THEN (event_id % 7 + 1) * {DAY_MS} END AS ttl_ms FROM events WHERE {op} IS NOT NULL)"""


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key asked for per customer: pos, db, key."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 4).cast("int").alias("db"), F.concat(F.lit("u:"), "c_custkey").alias("key"))


WANTED_SQL = "wanted AS (SELECT c_custkey AS pos, CAST(c_custkey % 4 AS INTEGER) AS db, 'u:' || c_custkey AS key FROM customer)"


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events pushed to their user's list, even ones to the left: db, key, pos, value."""
    from ..operators.lists import pushed

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 4).cast("int").alias("db"), F.concat(F.lit("u:"), "user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("side"), F.col("event_type").alias("value"))
    return pushed(rows)


LIST_SQL = """items AS (SELECT CAST(user_id % 4 AS INTEGER) AS db, 'u:' || user_id AS key, CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END AS pos, event_type AS value FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY pos) - 1 AS index, count(*) OVER (PARTITION BY db, key) AS size FROM items)"""


def hash_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of a field per event type: seq, db, key, field, value."""
    return log(spark, sf_dir, {e: e for e in OPS}).select("seq", "db", "key", F.col("op").alias("field"), "value", "delta")


HASH_SQL = f"""{log_sql({e: e for e in OPS})}, fields AS (SELECT db, key, op AS field, max_by(value, seq) AS value FROM log GROUP BY ALL)"""


def set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of every order: db, key, member."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = dealt(rows, rows.columns, rows.count()).distinct()  # of numbers, before they are keys
    return rows.select(F.lit(0).alias("db"), F.concat(F.lit("o:"), "l_orderkey").alias("key"), F.col("l_suppkey").alias("member"))


SET_SQL = "members AS (SELECT DISTINCT 0 AS db, 'o:' || l_orderkey AS key, l_suppkey AS member FROM lineitem)"


def set_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first and last order: request, nth, db, key."""
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return ends.select(F.col("o_custkey").alias("request"), F.posexplode(F.array("a", "b")).alias("nth", "o"), F.lit(0).alias("db")).select("request", "nth", "db", F.concat(F.lit("o:"), "o").alias("key"))


REQUEST_SQL = """ends AS (SELECT o_custkey AS request, 'o:' || min(o_orderkey) AS a, 'o:' || max(o_orderkey) AS b FROM orders GROUP BY ALL)"""


def zset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance, one sorted set per market segment."""
    return table(spark, sf_dir, "customer").select(F.lit(0).alias("db"), F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


ZSET_SQL = "zset AS (SELECT 0 AS db, c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"

_NODES = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", "o_orderstatus"))
#: table, kind and key of the source, kind and key of the target, type, weight
_EDGES = (
    ("nation", "nation", "n_nationkey", "region", "n_regionkey", "in", "1.0"),
    ("customer", "customer", "c_custkey", "nation", "c_nationkey", "in", "1.0"),
    ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in", "1.0"),
    ("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by", "1.0"),
    ("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains", "l_quantity"),
    ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supplied_by", "l_quantity"),
)


def number(kind: str, key: str) -> str:
    return f"CAST({KINDS.index(kind) * SHIFT} AS BIGINT) + {key}"


def graph(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = KINDS) -> Graph:
    """The tables' rows as nodes and their foreign keys as edges, among the given kinds."""
    nodes = edges = None
    for kind, name, key, label in _NODES:
        if kind in kinds:
            some = table(spark, sf_dir, name).selectExpr(f"{number(kind, key)} id", f"concat('{kind}:', {key}) key", f"'{kind}' node_type", f"map('name', {label}) props")
            nodes = some if nodes is None else nodes.unionByName(some)
    for name, a, ka, b, kb, edge_type, weight in _EDGES:
        if a in kinds and b in kinds:
            some = table(spark, sf_dir, name).selectExpr(f"{number(a, ka)} src", f"{number(b, kb)} dst", f"'{edge_type}' edge_type", f"cast({weight} as double) weight")
            edges = some if edges is None else edges.unionByName(some)
    edges = edges.select(F.xxhash64("src", "dst", "edge_type").alias("id"), "src", "dst", "edge_type", "weight", F.lit(None).cast("map<string,string>").alias("props"))
    return Graph(nodes, edges)


def graph_sql(kinds: tuple[str, ...] = KINDS) -> str:
    nodes = " UNION ALL ".join(f"SELECT {number(k, key)} AS id, '{k}:' || {key} AS key, '{k}' AS node_type, {label} AS name FROM {name}" for k, name, key, label in _NODES if k in kinds)
    edges = " UNION ALL ".join(f"SELECT {number(a, ka)} AS src, {number(b, kb)} AS dst, '{t}' AS edge_type, CAST({w} AS DOUBLE) AS weight FROM {name}" for name, a, ka, b, kb, t, w in _EDGES if a in kinds and b in kinds)
    return f"nodes AS ({nodes}), edges AS ({edges})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit("emb").alias("field"), F.col("embedding").alias("vec"))


def labelled_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Vectors and their labels as nodes: vec -has_label-> label."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    vec = table(spark, sf_dir, "embeddings").selectExpr("vec_id id", "concat('vec:', vec_id) key", "'vec' node_type", "map('label', cast(label as string)) props")
    label = e.select("label").distinct().selectExpr(f"cast({SHIFT} as bigint) + label id", "concat('label:', label) key", "'label' node_type", "map('label', cast(label as string)) props")
    edges = e.selectExpr("vec_id id", "vec_id src", f"cast({SHIFT} as bigint) + label dst", "'has_label' edge_type", "1.0d weight", "cast(null as map<string,string>) props")
    return Graph(vec.unionByName(label), edges)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the least id: a query."""
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])
