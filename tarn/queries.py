"""Registered queries: every operator over whole tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import extensions, graph, graph_writes, hashes, kv, lists, paths, sets, streams, transactions, vectors, zsets
from .plans.durable import shared_dir
from .sources import domain as D
from .sources import ingest, store
from .streaming import expiry, pubsub

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

WRITES = {"view": "SET", "purchase": "SET", "error": "DEL"}
APPENDS = {"view": "SET", "click": "APPEND", "signup": "APPEND", "error": "DEL"}
REPLIES = {"view": "SET", "purchase": "GETSET", "click": "INCRBY", "signup": "SETNX", "error": "DEL"}
BUDGET = 4_000

KV_SQL = f"""{D.log_sql(WRITES)}, last AS (SELECT db, key, max_by(op, seq) AS op, max_by(value, seq) AS value, max_by(ts_ms, seq) AS ts_ms, arg_max_null(ttl_ms, seq) AS ttl_ms FROM log GROUP BY db, key),
kv AS (SELECT db, key, value, ts_ms + ttl_ms AS expires_at FROM last WHERE op <> 'DEL'), live AS (SELECT * FROM kv WHERE expires_at IS NULL OR expires_at >= {D.NOW_MS})"""

REPLAY_SQL = """r AS (SELECT *, lag(op) OVER w AS prev FROM log WINDOW w AS (PARTITION BY db, key ORDER BY seq)),
e AS (SELECT *, CASE WHEN op = 'SETNX' AND (prev IS NULL OR prev = 'DEL') THEN 'SET' ELSE op END AS eff FROM r),
s AS (SELECT *, max(CASE WHEN eff IN ('SET', 'GETSET', 'DEL') THEN seq END) OVER (PARTITION BY db, key ORDER BY seq) AS start FROM e),
c AS (SELECT *, sum(CASE WHEN eff IN ('SET', 'GETSET', 'INCRBY') THEN delta ELSE 0 END) OVER (PARTITION BY db, key, coalesce(start, -1) ORDER BY seq) AS cur FROM s)"""

REACH_SQL = """WITH RECURSIVE {graph}, walk(seed, id, depth) AS (SELECT id, id, 0 FROM nodes WHERE {seed} UNION SELECT w.seed, n.id, w.depth + 1 FROM walk w JOIN edges e ON {step} JOIN nodes n ON n.id = {to} WHERE w.depth < {depth}{more}),
hit AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY seed, id)"""


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.last_write(D.log(spark, sf_dir, WRITES))


# keyed values


@query(f"WITH {KV_SQL} SELECT db, key, value, expires_at FROM kv")
def kv_last_write(spark, sf_dir):
    return state(spark, sf_dir)


@query(f"WITH {D.log_sql({'signup': 'SETNX'})} SELECT db, key, min_by(value, seq) AS value FROM log GROUP BY db, key")
def kv_first_write(spark, sf_dir):
    return kv.first_write(D.log(spark, sf_dir, {"signup": "SETNX"})).select("db", "key", "value")


@query(f"""WITH {D.log_sql()}, {REPLAY_SQL}, l AS (SELECT db, key, max(seq) FILTER (op <> 'SETNX' OR eff = 'SET') AS last, max_by(start, seq) AS start, max_by(cur, seq) AS cur FROM c GROUP BY db, key)
SELECT l.db, l.key, CAST(CAST(l.cur AS BIGINT) AS VARCHAR) AS value, CASE WHEN l.last = l.start THEN b.ts_ms + b.ttl_ms END AS expires_at FROM l LEFT JOIN e b ON b.seq = l.start WHERE b.eff IS DISTINCT FROM 'DEL' OR l.last <> l.start""")
def kv_fold(spark, sf_dir):
    return kv.fold(D.log(spark, sf_dir))


@query(f"""WITH {D.log_sql(APPENDS)}, s AS (SELECT *, max(CASE WHEN op IN ('SET', 'DEL') THEN seq END) OVER (PARTITION BY db, key) AS start FROM log)
SELECT db, key, string_agg(value, '' ORDER BY seq) AS value FROM s WHERE (start IS NULL OR seq >= start) AND op <> 'DEL' GROUP BY db, key""")
def kv_append(spark, sf_dir):
    return kv.fold(D.log(spark, sf_dir, APPENDS)).select("db", "key", "value")


@query(f"WITH {D.log_sql({e: 'INCRBY' for e in D.OPS})} SELECT db, key, CAST(CAST(sum(delta) AS BIGINT) AS VARCHAR) AS value FROM log GROUP BY db, key")
def kv_counters(spark, sf_dir):
    return kv.counters(D.log(spark, sf_dir, {e: "INCRBY" for e in D.OPS})).select("db", "key", "value")


@query(f"""WITH {D.log_sql(REPLIES)}, {REPLAY_SQL} SELECT db, key, seq, CASE op WHEN 'SET' THEN '1' WHEN 'SETNX' THEN CASE WHEN eff = 'SET' THEN '1' ELSE '0' END WHEN 'INCRBY' THEN CAST(CAST(cur AS BIGINT) AS VARCHAR)
WHEN 'DEL' THEN CASE WHEN prev IS NULL OR prev = 'DEL' THEN '0' ELSE '1' END ELSE CASE WHEN prev <> 'DEL' THEN CAST(CAST(lag(cur) OVER (PARTITION BY db, key ORDER BY seq) AS BIGINT) AS VARCHAR) END END AS reply FROM c""")
def kv_replay(spark, sf_dir):
    return kv.replay(D.log(spark, sf_dir, REPLIES)).select("db", "key", "seq", "reply")


@query(f"WITH {KV_SQL}, {D.WANTED_SQL} SELECT w.pos, w.db, w.key, l.value FROM wanted w LEFT JOIN live l USING (db, key)")
def kv_mget(spark, sf_dir):
    return kv.multi_get(state(spark, sf_dir), D.wanted(spark, sf_dir), D.NOW_MS)


@query(f"WITH {KV_SQL}, {D.WANTED_SQL} SELECT count(*) AS n FROM wanted w JOIN live l USING (db, key)")
def kv_exists(spark, sf_dir):
    return kv.exists(state(spark, sf_dir), D.wanted(spark, sf_dir), D.NOW_MS)


@query(f"""WITH {KV_SQL}, {D.WANTED_SQL} SELECT w.pos, w.db, w.key, CASE WHEN l.key IS NULL THEN -2 WHEN expires_at IS NULL THEN -1 ELSE (expires_at - {D.NOW_MS}) // 1000 END AS ttl,
CASE WHEN l.key IS NULL THEN -2 WHEN expires_at IS NULL THEN -1 ELSE expires_at - {D.NOW_MS} END AS pttl FROM wanted w LEFT JOIN live l USING (db, key)""")
def kv_ttl(spark, sf_dir):
    return kv.time_to_live(state(spark, sf_dir), D.wanted(spark, sf_dir), D.NOW_MS)


@query(f"WITH {KV_SQL} SELECT db, key, CAST(strlen(value) AS BIGINT) AS strlen, CAST(strlen(value) + strlen(key) + 56 AS BIGINT) AS memory_usage, 'int' AS encoding FROM live")
def kv_described(spark, sf_dir):
    return kv.described(state(spark, sf_dir), D.NOW_MS)


@query(f"WITH {KV_SQL} SELECT db, count(*) AS n FROM live GROUP BY db")
def kv_dbsize(spark, sf_dir):
    return kv.db_sizes(state(spark, sf_dir), D.NOW_MS)


@query(f"""WITH {KV_SQL}, {D.WANTED_SQL}, t AS (SELECT DISTINCT db, key, 'string' AS type FROM kv UNION SELECT CAST(user_id % 4 AS INTEGER), 'u:' || user_id, 'list' FROM events)
SELECT w.pos, w.db, w.key, coalesce(string_agg(t.type, ',' ORDER BY t.type), 'none') AS type FROM wanted w LEFT JOIN t USING (db, key) GROUP BY ALL""")
def kv_type(spark, sf_dir):
    return kv.key_types({"string": state(spark, sf_dir), "list": D.list_items(spark, sf_dir)}, D.wanted(spark, sf_dir))


@query("SELECT 0 AS db, url AS key FROM pages WHERE url GLOB 'http*://*/en/*'")
def kv_keys(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select(F.lit(0).alias("db"), F.col("url").alias("key"), F.lit(None).cast("long").alias("expires_at"))
    return kv.keys_like(pages, "http*://*/en/*", D.NOW_MS)


@query(f"WITH {KV_SQL} SELECT db, key, value FROM live WHERE (key, db) > ('u:12', 3) ORDER BY key, db LIMIT 20")
def kv_scan(spark, sf_dir):
    return kv.scan_page(state(spark, sf_dir), ("u:12", 3), 20, D.NOW_MS)


@query(f"WITH {KV_SQL} SELECT db, key, value FROM live WHERE key LIKE 'u:1%' ORDER BY key, db LIMIT 15")
def kv_scan_values(spark, sf_dir):
    return kv.scan_values(state(spark, sf_dir), "u:1", 15, D.NOW_MS)


@query(f"""WITH {D.log_sql(WRITES)}, v AS (SELECT db, key, max(seq) AS version FROM log GROUP BY ALL), w AS (SELECT o_orderkey AS txn, CAST(o_custkey % 4 AS INTEGER) AS db, 'u:' || o_custkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS version FROM orders)
SELECT txn FROM w LEFT JOIN v USING (db, key) WHERE w.version IS NOT DISTINCT FROM v.version""")
def transactions_admitted(spark, sf_dir):
    """Orders as transactions that watch their customer's key: admitted if it still has the version they saw."""
    return transactions.admitted(D.log(spark, sf_dir, WRITES), watches(spark, sf_dir))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), (F.col("o_custkey") % 4).cast("int").alias("db"), F.concat(F.lit("u:"), "o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("version"))


@query(f"""WITH {KV_SQL}, a AS (SELECT k.*, l.last_access FROM kv k JOIN (SELECT db, key, max(ts_ms) AS last_access FROM log GROUP BY ALL) l USING (db, key)),
b AS (SELECT *, sum(strlen(value) + strlen(key) + 56) OVER (ORDER BY last_access DESC, key DESC, db DESC) AS run FROM a) SELECT db, key, last_access FROM b WHERE run <= {BUDGET}""")
def kv_evict(spark, sf_dir):
    rows = D.log(spark, sf_dir, WRITES)
    seen = rows.groupBy("db", "key").agg(F.max("ts_ms").alias("last_access"))
    return kv.evicted(kv.last_write(rows).join(seen, ["db", "key"]), BUDGET).select("db", "key", "last_access")


#: A second name for every key, which up to four keys of a database share and which other keys may have already.
_TO_SQL = f"{KV_SQL}, m AS (SELECT *, CAST(substr(key, 3) AS BIGINT) AS uid, 'u:' || CAST(substr(key, 3) AS BIGINT) // 16 AS name FROM kv WHERE expires_at IS NOT NULL)"


def renames(now: DataFrame) -> DataFrame:
    """Keys that expire, to be renamed in order of their numbers: seq, db, key, to."""
    return now.where("expires_at is not null").select(F.expr("cast(substr(key, 3) as bigint)").alias("seq"), "db", "key", F.concat(F.lit("u:"), F.expr("cast(substr(key, 3) as bigint) div 16")).alias("to"))


@query(f"""WITH {_TO_SQL}, w AS (SELECT db, name, arg_max(value, uid) AS value FROM m GROUP BY db, name)
SELECT db, name AS key, value, NULL::BIGINT AS expires_at FROM w UNION ALL SELECT db, key, value, NULL FROM kv WHERE expires_at IS NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.db = kv.db AND w.name = kv.key)""")
def kv_rename(spark, sf_dir):
    now = state(spark, sf_dir)
    return kv.renamed(now, renames(now))


@query(f"""WITH {_TO_SQL}, f AS (SELECT m.*, row_number() OVER (PARTITION BY m.db, m.name ORDER BY uid) AS nth FROM m WHERE NOT EXISTS (SELECT 1 FROM kv WHERE kv.db = m.db AND kv.key = m.name))
SELECT kv.db, coalesce(f.name, kv.key) AS key, kv.value, CASE WHEN f.name IS NULL THEN kv.expires_at END AS expires_at FROM kv LEFT JOIN f ON f.db = kv.db AND f.key = kv.key AND f.nth = 1""")
def kv_renamenx(spark, sf_dir):
    now = state(spark, sf_dir)
    return kv.renamed(now, renames(now), if_absent=True)


@query(f"""WITH {_TO_SQL}, w AS (SELECT db, name, first(value ORDER BY uid) AS value FROM m GROUP BY db, name)
SELECT db, key, value, expires_at FROM kv UNION ALL SELECT w.db, w.name, w.value, NULL FROM w WHERE (w.db, w.name) NOT IN (SELECT (db, key) FROM kv)""")
def kv_copy(spark, sf_dir):
    now = state(spark, sf_dir)
    return kv.copied(now, renames(now))


@query(f"""WITH {_TO_SQL}, w AS (SELECT db, name, last(value ORDER BY uid) AS value FROM m GROUP BY db, name), t AS (SELECT db, key, value, expires_at, 1 AS p FROM kv UNION ALL SELECT db, name, value, NULL, 2 FROM w)
SELECT db, key, arg_max(value, p) AS value, CASE WHEN max(p) = 1 THEN max(expires_at) END AS expires_at FROM t GROUP BY db, key""")
def kv_copy_replace(spark, sf_dir):
    now = state(spark, sf_dir)
    return kv.copied(now, renames(now), replace=True)


@query(f"""WITH {KV_SQL}, k AS (SELECT db, 'k:' || CAST(substr(key, 3) AS BIGINT) // 4 AS key, value, expires_at FROM kv)
SELECT CASE WHEN db IN (1, 2) AND key NOT IN (SELECT key FROM k WHERE db = 3) AND NOT (db = 2 AND key IN (SELECT key FROM k WHERE db = 1)) THEN 3 ELSE db END AS db, key, value, expires_at FROM k""")
def kv_move(spark, sf_dir):
    """Keys of two databases that share their names, to a third that has some of them."""
    now = state(spark, sf_dir).withColumn("key", F.concat(F.lit("k:"), F.expr("cast(substr(key, 3) as bigint) div 4")))
    return kv.moved(now, now.where("db in (1, 2)").select("db", "key"), 3)


@query(f"""WITH {KV_SQL}, b AS (SELECT o_orderkey AS batch, [CAST(o_custkey % 4 AS VARCHAR) || '/u:' || o_custkey, '0/d:' || o_orderdate::DATE] AS keys, o_orderpriority AS value FROM orders),
one AS (SELECT list_reduce(list({{'batch': batch, 'keys': keys, 'held': []::VARCHAR[], 'done': []::BIGINT[]}} ORDER BY batch), lambda s, x: CASE WHEN list_has_any(s.held, x.keys) THEN s ELSE {{'batch': x.batch, 'keys': x.keys, 'held': s.held || x.keys, 'done': list_append(s.done, x.batch)}} END,
  {{'batch': 0::BIGINT, 'keys': []::VARCHAR[], 'held': (SELECT list(db || '/' || key) FROM kv), 'done': []::BIGINT[]}}) AS s FROM b),
n AS (SELECT unnest(keys) AS name, value FROM b WHERE batch IN (SELECT unnest(s.done) FROM one))
SELECT db, key, value FROM kv UNION ALL SELECT CAST(split_part(name, '/', 1) AS INTEGER), substr(name, 3), value FROM n""")
def kv_msetnx(spark, sf_dir):
    """Every order writes its customer's key and its day's, if neither is there; the SQL takes the orders one after the other."""
    orders = D.table(spark, sf_dir, "orders")
    customer = F.struct((F.col("o_custkey") % 4).cast("int").alias("db"), F.concat(F.lit("u:"), "o_custkey").alias("key"))
    day = F.struct(F.lit(0).alias("db"), F.concat(F.lit("d:"), F.to_date("o_orderdate")).alias("key"))
    batches = orders.select(F.col("o_orderkey").alias("batch"), F.explode(F.array(customer, day)).alias("k"), F.col("o_orderpriority").alias("value")).select("batch", "k.db", "k.key", "value")
    return kv.set_if_none(state(spark, sf_dir), batches).select("db", "key", "value")


EXPIRIES = {"view": "SET", "purchase": "SET", "click": "EXPIRE", "signup": "PERSIST", "error": "DEL"}


@query(f"""WITH {D.log_sql(EXPIRIES)}, w AS (SELECT db, key, max(seq) AS at FROM log WHERE op IN ('SET', 'DEL') GROUP BY db, key), e AS (SELECT db, key, max(seq) AS at FROM log WHERE op IN ('EXPIRE', 'PERSIST') GROUP BY db, key)
SELECT s.db, s.key, s.value, CASE WHEN x.seq IS NULL THEN s.ts_ms + s.ttl_ms WHEN x.op = 'EXPIRE' THEN x.ts_ms + x.ttl_ms END AS expires_at FROM w JOIN log s ON s.seq = w.at LEFT JOIN e ON e.db = w.db AND e.key = w.key AND e.at > w.at LEFT JOIN log x ON x.seq = e.at WHERE s.op = 'SET'""")
def kv_expire(spark, sf_dir):
    """EXPIRE and PERSIST rows after the last write of a key set or lift its expiry."""
    return kv.fold(D.log(spark, sf_dir, EXPIRIES))


TAKES = {"view": "SET", "purchase": "GETDEL", "click": "GETEX", "signup": "SETXX", "error": "DEL"}


@query(f"""WITH {D.log_sql(TAKES)}, a AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('SET', 'DEL', 'GETDEL') THEN op END IGNORE NULLS) OVER (PARTITION BY db, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'SET' AS there FROM log),
b AS (SELECT *, last_value(CASE WHEN op = 'SET' OR op = 'SETXX' AND there THEN value END IGNORE NULLS) OVER (PARTITION BY db, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM a)
SELECT db, key, seq, CASE op WHEN 'SET' THEN '1' WHEN 'SETXX' THEN CASE WHEN there THEN '1' ELSE '0' END WHEN 'DEL' THEN CASE WHEN there THEN '1' ELSE '0' END ELSE CASE WHEN there THEN held END END AS reply FROM b""")
def kv_getdel_getex(spark, sf_dir):
    """Replies of GETDEL, GETEX and SETXX among writes and deletes."""
    return kv.replay(D.log(spark, sf_dir, TAKES)).select("db", "key", "seq", "reply")


TOUCHES = {"view": "SETNX", "click": "EXPIRE", "signup": "PERSIST", "error": "EXPIRE"}


@query(f"""WITH {D.log_sql(TOUCHES)}, f AS (SELECT *, min(CASE WHEN op = 'SETNX' THEN seq END) OVER (PARTITION BY db, key) AS born FROM log) SELECT db, key, seq, CASE WHEN born IS NULL OR seq < born THEN '0' ELSE '1' END AS reply FROM f WHERE op = 'PERSIST' AND (born IS NULL OR seq < born)
UNION ALL SELECT db, key, seq, '0' FROM f WHERE op = 'EXPIRE' AND (born IS NULL OR seq < born)""")
def kv_touch_missing(spark, sf_dir):
    """EXPIRE and PERSIST of keys that aren't there yet."""
    rows = D.log(spark, sf_dir, TOUCHES)
    born = rows.where("op = 'SETNX'").groupBy("db", "key").agg(F.min("seq").alias("born"))
    replies = kv.replay(rows).join(rows.select("db", "key", "seq", "op"), ["db", "key", "seq"])
    return replies.join(born, ["db", "key"], "left").where("op <> 'SETNX' and (born is null or seq < born)").select("db", "key", "seq", "reply")


@query(f"WITH {KV_SQL} SELECT db, key, value, expires_at FROM kv WHERE db <> 1")
def kv_flushdb(spark, sf_dir):
    return kv.flushed(state(spark, sf_dir), 1)


@query(f"WITH {KV_SQL} SELECT db, key, value FROM live ORDER BY md5('7:' || db || ':' || key) LIMIT 1")
def kv_random(spark, sf_dir):
    return kv.any_key(state(spark, sf_dir), D.NOW_MS, 7)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {KV_SQL} SELECT 'kv' AS name, db, key, value, expires_at FROM kv UNION ALL SELECT 'list', CAST(user_id % 4 AS INTEGER), 'u:' || user_id, event_type, CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END FROM events")
def store_snapshot(spark, sf_dir):
    """Two tables saved, saved again and loaded: the later snapshot is the one that is read."""
    folder, now = scratch(spark, "snapshots"), state(spark, sf_dir)
    store.save({"kv": now.limit(0), "list": D.list_items(spark, sf_dir).limit(0)}, folder, 1)
    store.save({"kv": now, "list": D.list_items(spark, sf_dir)}, folder, 2)
    found = store.load(spark, folder)
    both = found["kv"].select(F.lit("kv").alias("name"), "db", "key", "value", "expires_at")
    return both.unionByName(found["list"].select(F.lit("list").alias("name"), "db", "key", "value", F.col("pos").alias("expires_at")))


@query("SELECT 2 AS at_ms, 'kv,list' AS tables")
def store_last_save(spark, sf_dir):
    folder = scratch(spark, "snapshots")
    tables = {"kv": state(spark, sf_dir), "list": D.list_items(spark, sf_dir)}
    store.save(tables, folder, 1)
    store.save(tables, folder, 2)
    last = store.last_save(spark, folder)
    return spark.createDataFrame([(last["at_ms"], ",".join(last["tables"]))], "at_ms bigint, tables string")


@query(f"WITH {D.log_sql(REPLIES)} SELECT seq, db, key, op, value FROM log")
def store_log(spark, sf_dir):
    """A log appended in two parts and read back."""
    folder, rows = scratch(spark, "log"), D.log(spark, sf_dir, REPLIES)
    store.append(rows.where("seq % 2 = 0"), folder)
    store.append(rows.where("seq % 2 = 1"), folder)
    return spark.read.parquet(folder).select("seq", "db", "key", "op", "value")


@query(f"WITH {D.log_sql(REPLIES)}, {REPLAY_SQL}, l AS (SELECT db, key, max_by(start, seq) AS start, max_by(cur, seq) AS cur, max_by(eff, seq) FILTER (op <> 'SETNX' OR eff = 'SET') AS op FROM c GROUP BY db, key) SELECT db, key, 'SET' AS op, CAST(CAST(cur AS BIGINT) AS VARCHAR) AS value FROM l WHERE op <> 'DEL'")
def store_compact(spark, sf_dir):
    """The log rewritten as one SET per key that is there at its end."""
    return store.compact(D.log(spark, sf_dir, REPLIES), 10**9).select("db", "key", "op", "value")


@query("SELECT vec_id AS node_id, 'emb' AS field, len(embedding) AS dimension, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def store_vectors(spark, sf_dir):
    """Vectors saved and loaded."""
    folder = scratch(spark, "vectors")
    store.save({"vectors": D.vectors(spark, sf_dir)}, folder, 1)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.load(spark, folder)["vectors"].select("node_id", "field", F.size("vec").cast("long").alias("dimension"), F.round(total, 4).alias("total"))


_TXN_SQL = f"""{D.log_sql(WRITES)}, v AS (SELECT db, key, max(seq) AS version FROM log GROUP BY ALL), w AS (SELECT o_orderkey AS txn, CAST(o_custkey % 4 AS INTEGER) AS db, 'u:' || o_custkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS version FROM orders),
ok AS (SELECT txn FROM w LEFT JOIN v USING (db, key) WHERE w.version IS NOT DISTINCT FROM v.version)"""


@query(f"""WITH {_TXN_SQL}, q AS (SELECT l_orderkey AS txn, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS nth, 'p:' || l_partkey AS key, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem) SELECT row_number() OVER (ORDER BY txn, nth) + 1000000 AS seq, txn, key, 'SET' AS op, value FROM q WHERE txn IN (SELECT txn FROM ok) OR txn NOT IN (SELECT txn FROM w)""")
def transactions_committed(spark, sf_dir):
    """Line items as the queued writes of their order's transaction: those that may go, numbered without gaps."""
    queued = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), F.expr("l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey % 1000").alias("nth"), F.concat(F.lit("p:"), "l_partkey").alias("key"), F.lit("SET").alias("op"), F.col("l_suppkey").cast("string").alias("value"))
    return transactions.committed(D.log(spark, sf_dir, WRITES), queued, watches(spark, sf_dir), 10**6).select("seq", "txn", "key", "op", "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select(F.col("event_id").alias("message"), F.concat(F.lit("ch:"), F.col("user_id") % 25).alias("channel"))


@query("SELECT e.event_id AS message, 'ch:' || (e.user_id % 25) AS channel, s.s_suppkey AS client FROM events e JOIN supplier s ON s.s_nationkey = e.user_id % 25")
def pubsub_deliveries(spark, sf_dir):
    """Every event to the suppliers that subscribe to its channel, their nation's."""
    subscriptions = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("client"), F.concat(F.lit("ch:"), "s_nationkey").alias("channel"))
    return pubsub.deliveries(messages(spark, sf_dir), subscriptions)


@query("""WITH m AS (SELECT event_id AS message, 'ch:' || (user_id % 25) AS channel FROM events), p(pattern, client) AS (VALUES ('ch:1*', 'a'), ('ch:1*', 'b'), ('ch:?', 'a'), ('*', 'c'))
SELECT message, channel, client, pattern FROM m JOIN p ON m.channel GLOB p.pattern""")
def pubsub_pattern_deliveries(spark, sf_dir):
    return pubsub.pattern_deliveries(messages(spark, sf_dir), {"ch:1*": ["a", "b"], "ch:?": ["a"], "*": ["c"]})


@query("SELECT event_id AS message, 'ch:' || (user_id % 25) AS channel, 'n' || (user_id % 25) AS client FROM events")
def pubsub_publish(spark, sf_dir):
    """The same as a stream: messages written as files are read, delivered and appended batch by batch."""
    folder, out = scratch(spark, "messages"), scratch(spark, "deliveries")
    messages(spark, sf_dir).repartition(3, "message").write.parquet(folder)
    subscriptions = spark.range(25).select(F.concat(F.lit("n"), "id").alias("client"), F.concat(F.lit("ch:"), "id").alias("channel"))
    stream = pubsub.message_stream(spark, folder, "message bigint, channel string", files_per_batch=2)
    pubsub.publish(stream, subscriptions, scratch(spark, "offsets"), lambda rows, n: rows.write.mode("append").parquet(out)).awaitTermination()
    return spark.read.parquet(out).select("message", "channel", "client")


@query(f"""WITH {D.log_sql({"view": "SET", "click": "PERSIST", "purchase": "EXPIRE", "error": "DEL"})}, e AS (SELECT db, key, ts_ms, CASE WHEN op IN ('SET', 'EXPIRE') THEN ts_ms + 3600000 * (1 + seq % 5) END AS until, lead(ts_ms) OVER (PARTITION BY db, key ORDER BY seq) AS after FROM log)
SELECT db, key, until AS expired_at FROM e WHERE after > until OR after IS NULL AND until < (SELECT max(ts_ms) FROM log)""")
def stream_expiry(spark, sf_dir):
    """Keys that live some hours, written, kept and deleted, as a stream: every time that one expires before it is written again."""
    rows = D.log(spark, sf_dir, {"view": "SET", "click": "PERSIST", "purchase": "EXPIRE", "error": "DEL"})
    rows = rows.select("seq", "ts_ms", "db", "key", "op", F.when(F.col("op").isin("SET", "EXPIRE"), 3_600_000 * (1 + F.col("seq") % 5)).cast("long").alias("ttl_ms"))
    folder, out = scratch(spark, "mutations"), scratch(spark, "expired")
    rows.repartition(4).write.parquet(folder)
    stream = pubsub.message_stream(spark, folder, "seq bigint, ts_ms bigint, db int, key string, op string, ttl_ms bigint")
    expiry.expired(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("db int, key string, expired_at bigint").parquet(out)


@query(f"""WITH {KV_SQL} SELECT db, count(*) AS keys, count(expires_at) AS expires, coalesce(CAST(floor(avg(expires_at - {D.NOW_MS})) AS BIGINT), 0) AS avg_ttl,
CAST(sum(strlen(value) + strlen(key) + 56) AS BIGINT) AS bytes FROM live GROUP BY db""")
def kv_info(spark, sf_dir):
    return kv.summary(state(spark, sf_dir), D.NOW_MS)


# lists


@query(f"WITH {D.LIST_SQL} SELECT db, key, count(*) AS n FROM items GROUP BY db, key")
def list_len(spark, sf_dir):
    return lists.lengths(D.list_items(spark, sf_dir))


@query(f"WITH {D.LIST_SQL} SELECT db, key, index, value FROM placed WHERE index BETWEEN 2 AND 6")
def list_range(spark, sf_dir):
    return lists.in_range(D.list_items(spark, sf_dir), 2, 6)


@query(f"WITH {D.LIST_SQL} SELECT db, key, index, value FROM placed WHERE index >= size - 3")
def list_range_tail(spark, sf_dir):
    return lists.in_range(D.list_items(spark, sf_dir), -3, -1)


@query(f"WITH {D.LIST_SQL} SELECT db, key, value FROM placed WHERE index = size - 2")
def list_index(spark, sf_dir):
    return lists.at_index(D.list_items(spark, sf_dir), -2)


@query(f"WITH {D.LIST_SQL} SELECT db, key, index AS nth, value FROM placed WHERE index < 3")
def list_pop(spark, sf_dir):
    return lists.popped(D.list_items(spark, sf_dir), 3)[0].select("db", "key", "nth", "value")


@query(f"WITH {D.LIST_SQL} SELECT db, key, pos, CASE WHEN index = size - 1 THEN 'last' ELSE value END AS value FROM placed")
def list_set(spark, sf_dir):
    items = D.list_items(spark, sf_dir)
    return lists.replaced(items, items.select("db", "key").distinct().select("db", "key", F.lit(-1).alias("at"), F.lit("last").alias("new")))


@query(f"""WITH {D.LIST_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY db, key, value ORDER BY pos DESC) AS nth FROM items) SELECT db, key, pos, value FROM m WHERE value <> 'click' OR nth > 2""")
def list_rem(spark, sf_dir):
    return lists.removed(D.list_items(spark, sf_dir), "click", -2)


@query(f"WITH {D.LIST_SQL}, a AS (SELECT db, key, list(value ORDER BY pos) AS x FROM items GROUP BY ALL) SELECT db, key, array_to_string(x[2:4], ',') AS part, x[-1] AS last FROM a")
def list_arrays(spark, sf_dir):
    whole = lists.as_arrays(D.list_items(spark, sf_dir))
    return whole.select("db", "key", F.array_join(C.list_range(F.col("items"), 1, 3), ",").alias("part"), C.list_index(F.col("items"), -1).alias("last"))


@query(f"""WITH {D.LIST_SQL} SELECT db, key, 5 AS at, 'ERR index out of range' AS error FROM items GROUP BY db, key HAVING count(*) <= 5 UNION ALL SELECT 9, 'none', 0, 'ERR no such key'""")
def list_set_errors(spark, sf_dir):
    items = D.list_items(spark, sf_dir)
    changes = items.select("db", "key").distinct().select("db", "key", F.lit(5).alias("at"), F.lit("x").alias("new"))
    return lists.out_of_range(items, changes.unionByName(spark.createDataFrame([(9, "none", 0, "x")], "db int, key string, at int, new string")))


# streams

STREAM_SQL = f"""{D.log_sql()}, entries AS (SELECT db, key, ts_ms AS ms, row_number() OVER (PARTITION BY db, key, ts_ms ORDER BY seq) - 1 AS nth, value AS fields FROM log)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.appended(D.log(spark, sf_dir).withColumn("fields", F.col("value")))


@query(f"WITH {STREAM_SQL} SELECT db, key, ms, nth, fields FROM entries WHERE ms BETWEEN {D.NOW_MS - D.DAY_MS} AND {D.NOW_MS}")
def stream_range(spark, sf_dir):
    return streams.between(entries(spark, sf_dir), D.NOW_MS - D.DAY_MS, D.NOW_MS)


@query(f"WITH {STREAM_SQL} SELECT db, key, count(*) AS n FROM entries GROUP BY db, key")
def stream_len(spark, sf_dir):
    return streams.lengths(entries(spark, sf_dir))


@query(f"""WITH {STREAM_SQL}, {D.WANTED_SQL}, r AS (SELECT e.*, row_number() OVER (PARTITION BY db, key ORDER BY ms, nth) AS place FROM entries e JOIN wanted w USING (db, key) WHERE ms > {D.NOW_MS})
SELECT db, key, ms, nth, fields, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def stream_read(spark, sf_dir):
    positions = D.wanted(spark, sf_dir).select("db", "key", F.lit(D.NOW_MS).alias("after_ms"), F.lit(10**6).alias("after_nth"))
    return streams.read_after(entries(spark, sf_dir), positions, 3)


# hashes


@query(f"""WITH {D.HASH_SQL} SELECT db, key, count(*) AS n FROM (SELECT DISTINCT db, key, op AS field FROM log) w WHERE field IN ('click', 'view') GROUP BY db, key""")
def hash_new_fields(spark, sf_dir):
    log = D.hash_log(spark, sf_dir)
    return hashes.new_fields(hashes.written(log.where("field not in ('click', 'view')")), log)


@query(f"WITH {D.HASH_SQL} SELECT db, key, field, value FROM fields")
def hash_set(spark, sf_dir):
    return hashes.written(D.hash_log(spark, sf_dir))


@query(f"""WITH {D.HASH_SQL}, {D.WANTED_SQL}, f AS (SELECT unnest(['view', 'none', 'click']) AS field) SELECT w.pos, w.db, w.key, f.field, x.value FROM wanted w CROSS JOIN f LEFT JOIN fields x ON x.db = w.db AND x.key = w.key AND x.field = f.field""")
def hash_mget(spark, sf_dir):
    wanted = D.wanted(spark, sf_dir).withColumn("field", F.explode(F.array(*map(F.lit, ("view", "none", "click")))))
    return hashes.get(hashes.written(D.hash_log(spark, sf_dir)), wanted)


@query(f"WITH {D.HASH_SQL} SELECT db, key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM fields GROUP BY db, key")
def hash_getall(spark, sf_dir):
    maps = hashes.as_maps(hashes.written(D.hash_log(spark, sf_dir)))
    return maps.select("db", "key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("fields"))


@query(f"WITH {D.HASH_SQL} SELECT db, key, field, value FROM fields WHERE field <> 'error'")
def hash_del(spark, sf_dir):
    fields = hashes.written(D.hash_log(spark, sf_dir))
    return hashes.deleted(fields, fields.where("field = 'error'"))


@query(f"WITH {D.HASH_SQL} SELECT db, key, count(*) AS n FROM fields GROUP BY db, key")
def hash_len(spark, sf_dir):
    return hashes.sizes(hashes.written(D.hash_log(spark, sf_dir)))


@query(f"""WITH {D.HASH_SQL}, d AS (SELECT db, key, op AS field, sum(delta) AS d FROM log GROUP BY ALL) SELECT db, key, field, CAST(CAST(CAST(value AS BIGINT) + d AS BIGINT) AS VARCHAR) AS value FROM fields JOIN d USING (db, key, field)""")
def hash_incrby(spark, sf_dir):
    log = D.hash_log(spark, sf_dir)
    return hashes.incremented(hashes.written(log), log)


@query(f"""WITH {D.HASH_SQL}, {D.WANTED_SQL}, f AS (SELECT unnest(['view', 'none']) AS field) SELECT w.pos, w.db, w.key, f.field, x.field IS NOT NULL AS found FROM wanted w CROSS JOIN f LEFT JOIN fields x ON x.db = w.db AND x.key = w.key AND x.field = f.field""")
def hash_exists(spark, sf_dir):
    wanted = D.wanted(spark, sf_dir).withColumn("field", F.explode(F.array(*map(F.lit, ("view", "none")))))
    return hashes.exists(hashes.written(D.hash_log(spark, sf_dir)), wanted)


@query(f"WITH {D.HASH_SQL}, {D.WANTED_SQL} SELECT db, key, field FROM fields JOIN wanted USING (db, key)")
def hash_keys(spark, sf_dir):
    return hashes.field_names(hashes.written(D.hash_log(spark, sf_dir)), D.wanted(spark, sf_dir))


@query(f"WITH {D.HASH_SQL}, {D.WANTED_SQL} SELECT db, key, value FROM fields JOIN wanted USING (db, key)")
def hash_vals(spark, sf_dir):
    return hashes.field_values(hashes.written(D.hash_log(spark, sf_dir)), D.wanted(spark, sf_dir))


@query(f"""WITH {D.HASH_SQL}, s AS (SELECT db, key, field, CASE WHEN field = 'view' THEN 'x' || value ELSE value END AS value FROM fields), d AS (SELECT db, key, op AS field, delta FROM log)
SELECT db, key, field, delta, 'ERR hash value is not an integer' AS error FROM s JOIN d USING (db, key, field) WHERE field = 'view'""")
def hash_incrby_errors(spark, sf_dir):
    log = D.hash_log(spark, sf_dir)
    fields = hashes.written(log).withColumn("value", F.when(F.col("field") == "view", F.concat(F.lit("x"), "value")).otherwise(F.col("value")))
    return hashes.not_integers(fields, log)


# sets


@query(f"WITH {D.SET_SQL} SELECT db, key, member FROM members UNION SELECT 0, 'o:' || o_orderkey, o_custkey FROM orders")
def set_add(spark, sf_dir):
    rows = sum(D.table(spark, sf_dir, t).count() for t in ("lineitem", "orders"))
    return sets.added(D.set_members(spark, sf_dir), customers_of_orders(spark, sf_dir), rows)


@query(f"WITH {D.SET_SQL} SELECT db, key, member FROM members EXCEPT SELECT 0, 'o:' || o_orderkey, o_custkey FROM orders")
def set_rem(spark, sf_dir):
    return sets.without(D.set_members(spark, sf_dir), customers_of_orders(spark, sf_dir))


def customers_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select(F.lit(0).alias("db"), F.concat(F.lit("o:"), "o_orderkey").alias("key"), F.col("o_custkey").alias("member"))


@query(f"WITH {D.SET_SQL} SELECT db, key, member FROM members WHERE key IN (SELECT 'o:' || max(o_orderkey) FROM orders GROUP BY o_custkey)")
def set_members(spark, sf_dir):
    """Members of every customer's last order."""
    keys = D.set_requests(spark, sf_dir).where("nth = 1").select("db", "key")
    return sets.of(D.set_members(spark, sf_dir), keys)


@query(f"WITH {D.SET_SQL} SELECT db, key, count(*) AS n FROM members GROUP BY db, key")
def set_card(spark, sf_dir):
    return sets.cardinalities(D.set_members(spark, sf_dir))


@query(f"WITH {D.SET_SQL}, w AS (SELECT o_orderkey AS pos, 0 AS db, 'o:' || o_orderkey AS key, o_custkey % 100 AS member FROM orders) SELECT pos, db, key, member, m.member IS NOT NULL AS found FROM w LEFT JOIN members m USING (db, key, member)")
def set_ismember(spark, sf_dir):
    wanted = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.lit(0).alias("db"), F.concat(F.lit("o:"), "o_orderkey").alias("key"), (F.col("o_custkey") % 100).alias("member"))
    return sets.is_member(D.set_members(spark, sf_dir), wanted)


_A, _B = (f"SELECT e.request, m.member FROM ends e JOIN members m ON m.key = e.{c}" for c in "ab")


@query(f"WITH {D.SET_SQL}, {D.REQUEST_SQL} {_A} UNION {_B}")
def set_union(spark, sf_dir):
    return sets.combined(D.set_members(spark, sf_dir), D.set_requests(spark, sf_dir), "union")


@query(f"WITH {D.SET_SQL}, {D.REQUEST_SQL} {_A} INTERSECT {_B}")
def set_inter(spark, sf_dir):
    return sets.combined(D.set_members(spark, sf_dir), D.set_requests(spark, sf_dir), "inter")


@query(f"WITH {D.SET_SQL}, {D.REQUEST_SQL} {_A} EXCEPT {_B}")
def set_diff(spark, sf_dir):
    return sets.combined(D.set_members(spark, sf_dir), D.set_requests(spark, sf_dir), "diff")


# sorted sets


@query(f"WITH {D.ZSET_SQL} SELECT db, key, member, score, row_number() OVER (PARTITION BY db, key ORDER BY score, member) - 1 AS rank FROM zset")
def zset_rank(spark, sf_dir):
    return zsets.ranked(D.zset(spark, sf_dir))


@query(f"WITH {D.ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY db, key) AS n FROM zset) SELECT db, key, member, score, rank FROM r WHERE rank >= n - 5")
def zset_range(spark, sf_dir):
    return zsets.in_range(D.zset(spark, sf_dir), -5, -1)


@query(f"WITH {D.ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY score DESC, member DESC) - 1 AS rank FROM zset) SELECT db, key, member, score, rank FROM r WHERE rank < 10")
def zset_top(spark, sf_dir):
    return zsets.top(D.zset(spark, sf_dir), 10)


@query(f"WITH {D.ZSET_SQL} SELECT db, key, count(*) FILTER (score BETWEEN 0 AND 5000) AS n FROM zset GROUP BY db, key")
def zset_count(spark, sf_dir):
    return zsets.count_between(D.zset(spark, sf_dir), 0, 5000)


@query(f"""WITH {D.ZSET_SQL}, d AS (SELECT c_mktsegment AS key, c_name AS member, sum(floor(o_totalprice)) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT z.db, z.key, z.member, round(z.score + coalesce(d.d, 0), 2) AS score FROM zset z LEFT JOIN d USING (key, member)""")
def zset_incrby(spark, sf_dir):
    customer = D.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"))
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").alias("delta"))
    deltas = orders.join(customer, "c_custkey").select(F.lit(0).alias("db"), "key", "member", F.col("delta").cast("double").alias("delta"))
    return zsets.incremented(D.zset(spark, sf_dir), deltas).withColumn("score", F.round("score", 2))


@query("""WITH l AS (SELECT 'c:' || event_type AS key, 'u:' || user_id AS member, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value::DOUBLE END AS score, event_id AS seq FROM events), w AS (SELECT key, member, max(seq) AS seq FROM l GROUP BY ALL)
SELECT 0 AS db, key, member, score FROM w JOIN l USING (key, member, seq) WHERE score IS NOT NULL""")
def zset_written(spark, sf_dir):
    """Adds and (every eleventh) removals in one log: the last of a member counts."""
    return zset_log(spark, sf_dir)


def zset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double"))
    return zsets.written(D.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit(0).alias("db"), F.concat(F.lit("c:"), "event_type").alias("key"), F.concat(F.lit("u:"), "user_id").alias("member"), score.alias("score")))


@query(f"""WITH {D.ZSET_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY db, key ORDER BY score, member) - 1 AS rank FROM zset), w AS (SELECT o_orderkey AS pos, 0 AS db, 'BUILDING' AS key, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS member FROM orders)
SELECT pos, w.db, w.key, w.member, r.rank, r.score FROM w LEFT JOIN r USING (db, key, member)""")
def zset_score(spark, sf_dir):
    """Score and rank, in one segment, of each order's customer, who may not be in it."""
    wanted = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.lit(0).alias("db"), F.lit("BUILDING").alias("key"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("member"))
    return zsets.rank_of(D.zset(spark, sf_dir), wanted)


@query(f"WITH {D.ZSET_SQL} SELECT db, key, count(*) AS n FROM zset GROUP BY db, key")
def zset_card(spark, sf_dir):
    return zsets.cardinalities(D.zset(spark, sf_dir))


# graphs


@query(REACH_SQL.format(graph=D.graph_sql(), seed="key = 'region:0'", step="e.dst = w.id", to="e.src", depth=3, more="") + " SELECT n.key, n.node_type, h.depth FROM hit h JOIN nodes n USING (id)")
def graph_traverse(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return g.typed(graph.traverse(g, g.seeds("region:0"), 3, graph.IN)).select("key", "node_type", "depth")


@query(REACH_SQL.format(graph=D.graph_sql(), seed="node_type = 'nation'", step="e.edge_type IN ('in', 'placed_by') AND e.dst = w.id", to="e.src", depth=3, more="") + " SELECT seed, id, depth FROM hit")
def graph_traverse_many(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    seeds = graph.list_by_type(g, "nation").select(F.col("id").alias("seed"), "id")
    return graph.traverse(g, seeds, 3, graph.IN, ["in", "placed_by"])


@query(REACH_SQL.format(graph=D.graph_sql(), seed="key = 'nation:1'", step="e.dst = w.id", to="e.src", depth=4, more=" AND n.node_type = 'customer'") + " SELECT id, depth FROM hit")
def graph_traverse_pruned(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph.traverse(g, g.seeds("nation:1"), 4, graph.IN, node_type="customer").select("id", "depth")


@query(REACH_SQL.format(graph=D.graph_sql(), seed="key = 'region:1'", step="e.dst = w.id", to="e.src", depth=3, more="") + " SELECT id, depth FROM hit ORDER BY depth, id LIMIT 50")
def graph_traverse_limit(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph.traverse(g, g.seeds("region:1"), 3, graph.IN, limit=50).select("id", "depth")


@query(f"WITH {D.graph_sql()} SELECT id, key, node_type, name FROM nodes WHERE key IN ('nation:3', 'part:5', 'region:9')")
def graph_getnode(spark, sf_dir):
    return graph.node(D.graph(spark, sf_dir), "nation:3", "part:5", "region:9").select("id", "key", "node_type", F.col("props")["name"].alias("name"))


@query(f"WITH {D.graph_sql()} SELECT id, key, node_type FROM nodes WHERE node_type = 'supplier'")
def graph_list_by_type(spark, sf_dir):
    return graph.list_by_type(D.graph(spark, sf_dir), "supplier")


@query(f"WITH {D.graph_sql()} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)) AS edges")
def graph_stats(spark, sf_dir):
    return graph.stats(D.graph(spark, sf_dir))


@query(f"WITH {D.graph_sql()}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) SELECT s.id AS seed, n.id, n.key, n.node_type FROM nodes s JOIN b ON b.src = s.id JOIN nodes n ON n.id = b.dst WHERE s.node_type = 'supplier'")
def graph_neighbors(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph.neighbors(g, graph.list_by_type(g, "supplier").select(F.col("id").alias("seed"), "id"), graph.BOTH)


@query(f"WITH {D.graph_sql()}, c AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) SELECT n.id, n.key, coalesce(c.n, 0) AS degree FROM nodes n LEFT JOIN c USING (id)")
def graph_degree(spark, sf_dir):
    return graph.degrees(D.graph(spark, sf_dir), graph.IN)


@query(f"""WITH {D.graph_sql()}, p AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'supplied_by'), s AS (SELECT id FROM nodes WHERE node_type = 'supplier')
SELECT s.id AS pair, n.id, n.key, n.node_type FROM s JOIN p x ON x.dst = s.id JOIN p y ON y.src = x.src AND y.dst = s.id + 1 JOIN nodes n ON n.id = x.src""")
def graph_common(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    pairs = graph.list_by_type(g, "supplier").select(F.col("id").alias("pair"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return graph.common_neighbors(g, pairs, graph.IN)


@query(f"""WITH {D.graph_sql()} SELECT DISTINCT p.id AS n0, s.id AS n1, n.id AS n2 FROM nodes p JOIN edges a ON a.src = p.id AND a.edge_type = 'supplied_by' JOIN nodes s ON s.id = a.dst AND s.node_type = 'supplier'
JOIN edges b ON b.src = s.id JOIN nodes n ON n.id = b.dst AND n.node_type = 'nation' WHERE p.node_type = 'part'""")
def graph_match(spark, sf_dir):
    return graph.match(D.graph(spark, sf_dir), "part", ("supplied_by", graph.OUT), "supplier", (None, graph.OUT), "nation")


@query(f"""WITH {D.graph_sql()}, hit AS (SELECT id FROM nodes WHERE node_type IN ('nation', 'region')) SELECT src, dst, edge_type, weight FROM edges WHERE src IN (SELECT id FROM hit) AND dst IN (SELECT id FROM hit)""")
def graph_subgraph(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return vectors.subgraph(g, g.nodes.where("node_type in ('nation', 'region')").select("id"))


@query(f"""WITH {D.graph_sql()} SELECT src, dst, edge_type, weight FROM edges UNION ALL SELECT a.id, b.id, 'likes', CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1.0 END FROM supplier JOIN nodes a ON a.key = 'supplier:' || s_suppkey JOIN nodes b ON b.key = 'customer:' || s_suppkey""")
def graph_addedge(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    new = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("from_key"), F.concat(F.lit("customer:"), "s_suppkey").alias("to_key"), F.lit("likes").alias("edge_type"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("weight"))
    return graph_writes.add_edges(g, new).edges.select("src", "dst", "edge_type", "weight")


@query(REACH_SQL.format(graph=D.graph_sql(), seed="node_type = 'part'", step="e.src = w.id", to="e.dst", depth=10, more="") + """, t AS (SELECT h.seed, n.node_type AS type_name, count(*) AS n FROM hit h JOIN nodes n USING (id) WHERE h.depth > 0 GROUP BY ALL)
SELECT seed, type_name, n FROM t UNION ALL SELECT p.id, 'total', CAST(coalesce(sum(t.n), 0) AS BIGINT) FROM (SELECT id FROM nodes WHERE node_type = 'part') p LEFT JOIN t ON t.seed = p.id GROUP BY p.id""")
def graph_impact(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph.impact(g, graph.list_by_type(g, "part").select(F.col("id").alias("seed"), "id"))


@query(f"""WITH {D.graph_sql()}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p AS (SELECT id AS a, id + 1 AS b FROM nodes WHERE node_type = 'supplier' AND id + 1 IN (SELECT id FROM nodes))
SELECT p.a AS pair, 2 AS hops, p.a || '>' || min(x.dst) || '>' || p.b AS path FROM p JOIN b x ON x.src = p.a JOIN b y ON y.src = x.dst AND y.dst = p.b GROUP BY p.a, p.b""")
def graph_path(spark, sf_dir):
    """From each supplier to the next: never one hop, as no edge joins suppliers; two over what they share, as in the SQL, and
    four where they share nothing, which is the more common the more suppliers there are."""
    g = D.graph(spark, sf_dir)
    pairs = graph.list_by_type(g, "supplier").select(F.col("id").alias("pair"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return paths.shortest(g, pairs, 4).select("pair", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {D.graph_sql()}, q AS (SELECT p.id AS pair, a.weight + b.weight + c.weight AS weight, p.id || '>' || a.dst || '>' || b.dst || '>' || c.dst AS path, row_number() OVER (PARTITION BY p.id ORDER BY a.weight + b.weight + c.weight, a.dst, b.dst, c.dst) AS nth
FROM nodes p JOIN edges a ON a.src = p.id JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE p.node_type = 'part' AND c.dst = (p.id - {4 * D.SHIFT}) % 5) SELECT pair, weight, path FROM q WHERE nth = 1""")
def graph_wpath(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    pairs = graph.list_by_type(g, "part").select(F.col("id").alias("pair"), F.col("id").alias("a"), ((F.col("id") - 4 * D.SHIFT) % 5).alias("b"))
    return paths.lightest(g, pairs).select("pair", "weight", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {D.graph_sql()}, q AS (SELECT p.id AS seed, 3 AS hops, p.id || '>' || a.dst || '>' || b.dst || '>' || c.dst AS path, row_number() OVER (PARTITION BY p.id ORDER BY a.dst, b.dst, c.dst) AS nth
FROM nodes p JOIN edges a ON a.src = p.id JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE p.node_type = 'part') SELECT seed, hops, path FROM q WHERE nth <= 10""")
def graph_paths(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    found = paths.to_type(g, graph.list_by_type(g, "part").select(F.col("id").alias("seed"), "id"), "region", 5, limit=10)
    return found.select("seed", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {D.graph_sql()} SELECT n.key, n.node_type FROM nodes n WHERE n.node_type <> 'nation'")
def graph_delnode(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph_writes.delete_nodes(g, graph.list_by_type(g, "nation")).nodes.select("key", "node_type")


@query(f"WITH {D.graph_sql()} SELECT src, dst, edge_type, weight FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE node_type = 'nation') AND src NOT IN (SELECT id FROM nodes WHERE node_type = 'nation')")
def graph_delnode_edges(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph_writes.delete_nodes(g, graph.list_by_type(g, "nation")).edges.select("src", "dst", "edge_type", "weight")


@query(f"WITH {D.graph_sql()} SELECT key, node_type, name, 'x' AS tag FROM nodes UNION ALL SELECT 'new:' || r_regionkey, 'new', NULL, 'x' FROM region")
def graph_upsert(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    old = g.nodes.select("key").union(D.table(spark, sf_dir, "region").select(F.concat(F.lit("new:"), "r_regionkey")))
    rows = old.select(F.lit(1).alias("seq"), "key", F.lit("new").alias("node_type"), F.create_map(F.lit("tag"), F.lit("x")).alias("props"))
    return graph_writes.upsert_nodes(g, rows).nodes.select("key", "node_type", F.col("props")["name"].alias("name"), F.col("props")["tag"].alias("tag"))


@query("""WITH d AS (SELECT DISTINCT 'user:' || user_id AS a, 'type:' || event_type AS b FROM events) SELECT a AS from_key, 'user' AS from_type, b AS to_key, 'unknown' AS to_type, 'did' AS edge_type FROM d""")
def graph_ingest(spark, sf_dir):
    """Events as JSON documents, read back into a graph: a node per user, its event types known only as ends of edges."""
    text = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("user:"), "user_id").alias("id"), F.lit("user").alias("type"))).alias("nodes"), F.array(F.struct(F.concat(F.lit("user:"), "user_id").alias("from"), F.concat(F.lit("type:"), "event_type").alias("to_id"), F.lit("did").alias("edge_type"))).alias("edges")))
    g = ingest.ingest(ingest.empty_graph(spark), D.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.alias("json")))
    ends = g.nodes.select("id", "key", "node_type")
    return g.edges.join(ends.toDF("src", "from_key", "from_type"), "src").join(ends.toDF("dst", "to_key", "to_type"), "dst").select("from_key", "from_type", "to_key", "to_type", "edge_type")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS value, l_partkey AS id FROM lineitem), s AS (SELECT value FROM m GROUP BY value HAVING count(*) BETWEEN 2 AND 50)
SELECT x.id AS a, y.id AS b, CAST(count(*) AS DOUBLE) AS weight FROM m x JOIN m y ON x.value = y.value AND x.id < y.id WHERE x.value IN (SELECT value FROM s) GROUP BY x.id, y.id""")
def graph_cooccur(spark, sf_dir):
    return extensions.cooccurrence(D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("value")))


@query(f"""WITH RECURSIVE {D.graph_sql()}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), one(id) AS (SELECT min(id) FROM nodes UNION SELECT w.dst FROM one JOIN both_ways w ON w.src = one.id),
rest(root, id) AS (SELECT id, id FROM nodes WHERE id NOT IN (SELECT id FROM one) UNION SELECT r.root, w.dst FROM rest r JOIN both_ways w ON w.src = r.id)
SELECT id, (SELECT min(id) FROM nodes) AS component FROM one UNION ALL SELECT root, min(id) FROM rest GROUP BY root""")
def graph_components(spark, sf_dir):
    return extensions.graph_components(D.graph(spark, sf_dir))


def _pagerank_sql(rounds: int = 10) -> str:
    parts = [D.graph_sql(), "n AS (SELECT count(*) AS n FROM nodes)", "o AS MATERIALIZED (SELECT src, count(*) AS out FROM edges GROUP BY src)", "r0 AS (SELECT id, 1.0::DOUBLE / n.n AS rank FROM nodes, n)"]
    for i in range(rounds):
        parts += [f"f{i} AS (SELECT e.dst AS id, sum(r.rank / o.out) AS flow FROM edges e JOIN r{i} r ON r.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst)", f"l{i} AS (SELECT sum(rank) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM o))", f"r{i + 1} AS MATERIALIZED (SELECT m.id, 0.15 / n.n + 0.85 * (coalesce(f.flow, 0) + l.lost / n.n) AS rank FROM nodes m CROSS JOIN n CROSS JOIN l{i} l LEFT JOIN f{i} f ON f.id = m.id)"]
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql())
def graph_pagerank(spark, sf_dir):
    return extensions.pagerank(D.graph(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


# vectors

_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))"
_ONE = f"q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), scored AS (SELECT vec_id, label, {_COS.format(a='embedding', b='q')} AS score FROM embeddings, q)"


@query(f"WITH {_ONE} SELECT vec_id AS node_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 10")
def vector_search(spark, sf_dir):
    return vectors.nearest(D.vectors(spark, sf_dir), D.first_vector(spark, sf_dir), 10, "emb").select("node_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS node_id, {_COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) AS rank FROM s) SELECT query, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_search_many(spark, sf_dir):
    every = D.vectors(spark, sf_dir)
    queries = every.where("node_id % 50 = 0").select(F.col("node_id").alias("query"), "vec")
    return vectors.nearest_many(every, queries, 10).select("query", "rank", F.round("score", 6).alias("score"))


@query("""SELECT vec_id AS node_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS one,
round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings""")
def vector_normalize(spark, sf_dir):
    unit = C.normalized(F.col("vec"))
    return D.vectors(spark, sf_dir).select("node_id", F.round(C.dot(unit, unit), 6).alias("one"), F.round(unit[0], 6).alias("first"))


@query(f"""WITH {_ONE}, hit AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 5) SELECT 'vec:' || h.vec_id AS key, round(h.score, 6) AS score, CAST(h.label AS VARCHAR) AS label, string_agg(x.key, ',' ORDER BY x.key) AS neighbors
FROM hit h JOIN (SELECT 'label:' || label AS key, label, -1 AS vec_id FROM embeddings GROUP BY label UNION ALL SELECT 'vec:' || vec_id, label, vec_id FROM embeddings) x ON x.label = h.label AND x.vec_id <> h.vec_id GROUP BY ALL""")
def vector_rag(spark, sf_dir):
    found = vectors.retrieve(D.labelled_graph(spark, sf_dir), D.vectors(spark, sf_dir), D.first_vector(spark, sf_dir), 5, 2, graph.BOTH)
    return found.select("key", F.round("score", 6).alias("score"), F.col("props")["label"].alias("label"), F.array_join("neighbors", ",").alias("neighbors"))


@query(f"WITH {_ONE} SELECT vec_id AS entry, 'a' || label AS answer, round(score, 6) AS score FROM scored WHERE vec_id % 2 = 1 AND score >= 0.1 ORDER BY scored.score DESC, vec_id LIMIT 1")
def semantic_cache(spark, sf_dir):
    cache = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vec"), F.concat(F.lit("a"), "label").alias("answer"), F.lit("t").alias("tag"), F.when(F.col("vec_id") % 2 == 0, F.lit(0)).cast("long").alias("expires_at"))
    return extensions.cache_lookup(cache, D.first_vector(spark, sf_dir), D.NOW_MS, 0.1, "t").select("entry", "answer", F.round("score", 6).alias("score"))


@query(f"""WITH {_ONE} SELECT vec_id AS memory, round(score * pow(0.5, (vec_id * 3600.0) / 86400) * ((label + 1) / 10.0) * least(1.0, log2(vec_id % 50 + 1) / 10), 6) AS score FROM scored
ORDER BY score * pow(0.5, (vec_id * 3600.0) / 86400) * ((label + 1) / 10.0) * least(1.0, log2(vec_id % 50 + 1) / 10) DESC, vec_id LIMIT 10""".replace("ORDER BY score *", "ORDER BY scored.score *"))
def memory_recall(spark, sf_dir):
    memories = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory"), F.col("embedding").alias("vec"), ((F.col("label") + 1) / 10).alias("importance"), (F.col("vec_id") % 50).alias("uses"), (F.lit(D.NOW_MS) - F.col("vec_id") * 3_600_000).alias("at_ms"))
    return extensions.recall(memories, D.first_vector(spark, sf_dir), D.NOW_MS, 10, 86_400_000.0).select("memory", F.round("score", 6).alias("score"))


@query()
def vector_search_approximate(spark, sf_dir):
    """About the ten nearest of every fiftieth vector, from an index that is built, written and read again."""
    rows, folder = D.vectors(spark, sf_dir), scratch(spark, "index")
    dimension = rows.agg(F.max(F.size("vec"))).first()[0]
    vectors.save_index(vectors.approximate_index(rows, dimension, tables=96), folder)
    queries_ = rows.where("node_id % 50 = 0").select(F.col("node_id").alias("query"), "vec")
    return vectors.approximate_nearest_many(vectors.load_index(spark, folder), queries_, 10)


# further writes


@query(f"WITH {D.graph_sql()} SELECT 'node' AS what, key FROM nodes UNION ALL SELECT 'node', 'new:' || r_regionkey FROM region UNION ALL SELECT 'ERR node already exists', key FROM nodes WHERE node_type = 'nation' UNION ALL SELECT 'ERR node already exists', 'new:' || r_regionkey FROM region")
def graph_addnode(spark, sf_dir):
    """Nations that are there, and new nodes, each twice: what is added, and what is refused."""
    g = D.graph(spark, sf_dir)
    new = D.table(spark, sf_dir, "region").select(F.concat(F.lit("new:"), "r_regionkey").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    rows = graph.list_by_type(g, "nation").select("key", F.lit(0).alias("seq")).unionByName(new)
    more, refused = graph_writes.add_nodes(g, rows.select("seq", "key", F.lit("new").alias("node_type"), F.create_map(F.lit("a"), F.lit("b")).alias("props")))
    return more.nodes.select(F.lit("node").alias("what"), "key").unionByName(refused.select(F.col("error").alias("what"), "key"))


@query(f"WITH {D.graph_sql()} SELECT key, name, CASE WHEN node_type = 'customer' THEN 'gold' END AS tier FROM nodes")
def graph_setprop(spark, sf_dir):
    """A property of all customers, written twice, and of keys that no node has."""
    g = D.graph(spark, sf_dir)
    keys_ = graph.list_by_type(g, "customer").select("key").unionByName(spark.range(3).select(F.concat(F.lit("none:"), "id").alias("key")))
    rows = keys_.select("key", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("iron").alias("v")), F.struct(F.lit(2).alias("seq"), F.lit("gold").alias("v")))).alias("w")).select("w.seq", "key", F.lit("tier").alias("k"), "w.v")
    return graph_writes.set_properties(g, rows).nodes.select("key", F.col("props")["name"].alias("name"), F.col("props")["tier"].alias("tier"))


@query(f"WITH {D.graph_sql()} SELECT src, dst, edge_type, weight FROM edges WHERE edge_type <> 'supplied_by'")
def graph_deledge(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return graph_writes.delete_edges(g, g.edges.where("edge_type = 'supplied_by'").select("id")).edges.select("src", "dst", "edge_type", "weight")


@query(f"WITH {D.graph_sql()} SELECT src, dst, edge_type, CASE WHEN edge_type = 'in' THEN 'checked' END AS state FROM edges")
def graph_edge_property(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    rows = g.edges.where("edge_type = 'in'").select(F.lit(1).alias("seq"), "id", F.lit("state").alias("k"), F.lit("checked").alias("v"))
    return graph_writes.set_edge_properties(g, rows).edges.select("src", "dst", "edge_type", F.col("props")["state"].alias("state"))


@query(f"WITH {D.graph_sql()} SELECT edge_type, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY edge_type")
def graph_compact(spark, sf_dir):
    """Edges moved to a bucketed table and read from there."""
    table = f"compacted_{uuid.uuid4().hex}"
    kept = graph.compacted(D.graph(spark, sf_dir), table, 8).edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()  # a row per edge type
    spark.sql(f"DROP TABLE {table}")
    return spark.createDataFrame(kept, "edge_type string, n bigint, weight double")


_UNIT = "round({v}[1]::DOUBLE / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])), 6)"


@query(f"SELECT vec_id AS node_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, {_UNIT.format(v='list_reverse(embedding)')} FROM embeddings WHERE vec_id % 3 = 0")
def graph_setvec(spark, sf_dir):
    """Every third vector written again, reversed, after a write that it replaces, with one of the wrong dimension that is refused."""
    every = D.vectors(spark, sf_dir)
    third = every.where("node_id % 3 = 0")
    rows = third.select(F.lit(1).alias("seq"), "node_id", "field", F.col("vec")).unionByName(third.select(F.lit(2), "node_id", "field", F.reverse("vec")).toDF("seq", "node_id", "field", "vec"))
    rows = rows.unionByName(every.where("node_id % 3 = 1").select(F.lit(3).alias("seq"), "node_id", "field", F.slice("vec", 1, 5).alias("vec")))
    return graph_writes.set_vectors(every, rows).select("node_id", F.round(F.col("vec")[0], 6).alias("first"))


@query("SELECT w.id AS pos, w.id AS node_id, round(e.embedding[1]::DOUBLE, 6) AS first FROM (SELECT vec_id * 2 AS id FROM embeddings) w LEFT JOIN embeddings e ON e.vec_id = w.id")
def graph_getvec(spark, sf_dir):
    every = D.vectors(spark, sf_dir)
    wanted = every.select((F.col("node_id") * 2).alias("pos"), (F.col("node_id") * 2).alias("node_id"), "field")
    return graph_writes.get_vectors(every, wanted).select("pos", "node_id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("SELECT 'emb' AS field, count(*) AS n, max(len(embedding)) AS dimension FROM embeddings")
def vector_count(spark, sf_dir):
    return graph_writes.count_vectors(D.vectors(spark, sf_dir)).withColumn("dimension", F.col("dimension").cast("long"))


@query("SELECT vec_id AS node_id FROM embeddings WHERE vec_id % 2 = 1")
def graph_delnode_vectors(spark, sf_dir):
    g = D.labelled_graph(spark, sf_dir)
    return graph_writes.delete_vectors(g, D.vectors(spark, sf_dir), g.nodes.where("node_type = 'vec' and id % 2 = 0").select("key")).select("node_id")


@query(f"""WITH {_ONE}, hit AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 5) SELECT 'vec:' || vec_id AS key, round(score, 6) AS score, 'label:' || label AS neighbors FROM hit""")
def vector_rag_options(spark, sf_dir):
    """Retrieval whose expansion follows one edge type outwards and keeps one node type."""
    found = vectors.retrieve(D.labelled_graph(spark, sf_dir), D.vectors(spark, sf_dir), D.first_vector(spark, sf_dir), 5, 3, graph.OUT, ["has_label"], "label", "emb")
    return found.select("key", F.round("score", 6).alias("score"), F.array_join("neighbors", ",").alias("neighbors"))


_HITS = f"WITH {_ONE}, hit AS (SELECT vec_id, label, score FROM scored ORDER BY score DESC, vec_id LIMIT 5), every AS (SELECT vec_id AS id, 'vec:' || vec_id AS key, label FROM embeddings WHERE label IN (SELECT label FROM hit) UNION ALL SELECT DISTINCT {D.SHIFT} + label, 'label:' || label, label FROM hit)"


@query(f"{_HITS} SELECT e.key, round(coalesce(h.score, -1), 6) AS score FROM every e LEFT JOIN hit h ON h.vec_id = e.id")
def vector_rag_nodes(spark, sf_dir):
    """Retrieval as a subgraph: the nearest with their scores, what the expansion adds with -1."""
    nodes, _ = rag_subgraph(spark, sf_dir)
    return nodes.select("key", F.round("score", 6).alias("score"))


@query(f"{_HITS} SELECT id AS src, {D.SHIFT} + label AS dst, 'has_label' AS edge_type FROM every WHERE key LIKE 'vec:%'")
def vector_rag_edges(spark, sf_dir):
    _, edges = rag_subgraph(spark, sf_dir)
    return edges.select("src", "dst", "edge_type")


def rag_subgraph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors.retrieved_subgraph(D.labelled_graph(spark, sf_dir), D.vectors(spark, sf_dir), D.first_vector(spark, sf_dir), 5, 2, graph.BOTH)


@query("""WITH m AS (SELECT s_suppkey AS id, s_nationkey AS value FROM supplier), k AS (SELECT value FROM m GROUP BY value HAVING count(*) BETWEEN 2 AND 50)
SELECT x.id AS a, y.id AS b, 2.5::DOUBLE + CASE WHEN y.id = x.id + 1 THEN 1 ELSE 0 END AS weight FROM m x JOIN m y ON x.value = y.value AND x.id < y.id WHERE x.value IN (SELECT value FROM k)
UNION ALL SELECT x.id, x.id + 1, 1 FROM m x JOIN m y ON y.id = x.id + 1 WHERE x.value <> y.value OR x.value NOT IN (SELECT value FROM k)""")
def graph_cooccur_edges(spark, sf_dir):
    """Suppliers of one nation linked with a weight, on top of edges that neighbours by number have already."""
    rows = D.table(spark, sf_dir, "supplier")
    supplier = rows.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s:"), "s_suppkey").alias("key"), F.lit("supplier").alias("node_type"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("props"))
    other = supplier.select((F.col("id") + D.SHIFT).alias("id"), "key", F.lit("other").alias("node_type"), "props")
    ids = supplier.select("id")
    edges = ids.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(ids.toDF("dst"), "dst", "left_semi")
    edges = edges.select(F.col("src").alias("id"), "src", "dst", F.lit("COOCCUR").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("map<string,string>").alias("props"))
    found = extensions.linked_by_property(graph.Graph(supplier.unionByName(other), edges), "nation", "supplier", weight=2.5)
    return found.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cached answers under two tags; every fifth has expired, and every seventh is stored a second time."""
    e = D.table(spark, sf_dir, "embeddings")
    row = lambda df, seq, answer: df.select(F.lit(seq).alias("seq"), F.col("vec_id").alias("entry"), F.col("embedding").alias("vec"), answer.alias("answer"), F.concat(F.lit("t"), F.col("vec_id") % 2).alias("tag"), F.when(F.col("vec_id") % 5 == 4, F.lit(0)).cast("long").alias("expires_at"))
    none = row(e.limit(0), 0, F.lit("")).drop("seq")
    return extensions.cache_stored(none, row(e, 1, F.concat(F.lit("a"), "label")).unionByName(row(e.where("vec_id % 7 = 0"), 2, F.lit("again"))))


@query("SELECT 't' || (vec_id % 2) AS tag, count(*) AS entries, count(*) FILTER (vec_id % 5 <> 4) AS live, CAST(sum(strlen(CASE WHEN vec_id % 7 = 0 THEN 'again' ELSE 'a' || label END)) AS BIGINT) AS bytes FROM embeddings GROUP BY 1")
def semantic_cache_stats(spark, sf_dir):
    return extensions.cache_stats(cached(spark, sf_dir), D.NOW_MS)


@query("SELECT vec_id AS entry, CASE WHEN vec_id % 7 = 0 THEN 'again' ELSE 'a' || label END AS answer FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 14 <> 0")
def semantic_cache_invalidated(spark, sf_dir):
    cache = cached(spark, sf_dir)
    kept = extensions.cache_invalidated(cache, tag="t1")
    return extensions.cache_invalidated(kept, entries=cache.where("answer = 'again'").select("entry")).select("entry", "answer")


@query(f"WITH {_ONE} SELECT vec_id AS entry, round(score, 6) AS score FROM scored WHERE vec_id % 5 <> 4 AND score >= 0.95 ORDER BY scored.score DESC, vec_id LIMIT 1")
def semantic_cache_strict(spark, sf_dir):
    """A lookup at the usual threshold; where nothing that lives is so near, nothing is found."""
    return extensions.cache_lookup(cached(spark, sf_dir), D.first_vector(spark, sf_dir), D.NOW_MS).select("entry", F.round("score", 6).alias("score"))


@query(f"""WITH {_ONE}, top AS (SELECT vec_id AS memory, score FROM scored ORDER BY score DESC, vec_id LIMIT 5), r AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings UNION ALL SELECT vec_id + 1, vec_id FROM embeddings)
SELECT memory, round(score, 6) AS score, NULL::BIGINT AS via FROM top UNION ALL SELECT b, NULL, min(a) FROM r WHERE a IN (SELECT memory FROM top) AND b NOT IN (SELECT memory FROM top) GROUP BY b""")
def memory_context(spark, sf_dir):
    """The memories nearest to a query and those related to them, over relations that were written twice."""
    e = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.lit("next").alias("kind"))
    none = e.limit(0).withColumn("weight", F.lit(0.0))
    relations = extensions.memories_related(none, e.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "a", "b", "kind").withColumn("weight", F.col("seq") / 2))
    found = vectors.nearest(D.vectors(spark, sf_dir), D.first_vector(spark, sf_dir), 5, "emb").withColumnRenamed("node_id", "memory")
    return extensions.memory_context(found, relations.where("weight = 1")).select("memory", F.round("score", 6).alias("score"), "via")


@query(f"SELECT vec_id AS memory, {D.NOW_MS} - vec_id * 3600000 AS at_ms FROM embeddings WHERE (label + 1) / 10.0 >= 0.3 ORDER BY vec_id LIMIT 20")
def memory_list(spark, sf_dir):
    memories = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory"), ((F.col("label") + 1) / 10).alias("importance"), (F.col("vec_id") % 50).alias("uses"), (F.lit(D.NOW_MS) - F.col("vec_id") * 3_600_000).alias("at_ms"))
    return extensions.memories_listed(memories, 20, 0.3).select("memory", "at_ms")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
