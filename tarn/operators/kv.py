"""Keyed values: lookups, scans, and the folds that turn an append-only log of mutations into current state.

A state is a table kv(db, key, value, expires_at); a log is (seq, ts_ms, db, key, op, value, delta, ttl_ms). Expiry is
judged against a `now_ms` that the caller names. Keys asked for are a table too, so a thousand lookups are one join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import glob_regex, live, ttl_ms, ttl_seconds
from ..plans.durable import carried, durable, running

KEY = ["db", "key"]
#: What a key and its entry take besides their bytes.
ENTRY_BYTES = 56
EMBEDDED_BYTES = 44


def live_keys(kv: DataFrame, now_ms: int) -> DataFrame:
    return kv.where(live(F.col("expires_at"), now_ms))


# reads


def multi_get(kv: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """wanted (pos, db, key; repeats allowed) -> pos, db, key, value: null where there is no live key."""
    found = live_keys(kv, now_ms).select(*KEY, "value")
    return wanted.join(found, KEY, "left").select("pos", *KEY, "value")


def exists(kv: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """How many of the wanted keys exist, repeats counted."""
    return wanted.join(live_keys(kv, now_ms).select(*KEY), KEY, "left_semi").agg(F.count("*").alias("n"))


def time_to_live(kv: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """Per wanted key ttl (seconds, truncated) and pttl (milliseconds): -1 without expiry, -2 without key."""
    found = live_keys(kv, now_ms).select(*KEY, ttl_seconds(F.col("expires_at"), now_ms).alias("ttl"), ttl_ms(F.col("expires_at"), now_ms).alias("pttl"))
    missing = lambda c: F.coalesce(c, F.lit(-2)).cast("long").alias(c)
    return wanted.join(found, KEY, "left").select("pos", *KEY, missing("ttl"), missing("pttl"))


def described(kv: DataFrame, now_ms: int) -> DataFrame:
    """Per live key: length in bytes, memory it takes, encoding, and whether the value is an integer."""
    size = F.octet_length("value")
    return live_keys(kv, now_ms).select(
        *KEY,
        size.cast("long").alias("strlen"),
        (size + F.octet_length("key") + ENTRY_BYTES).cast("long").alias("memory_usage"),
        F.when(F.expr("try_cast(value as bigint)").isNotNull(), "int").when(size <= EMBEDDED_BYTES, "embstr").otherwise("raw").alias("encoding"),
    )


def db_sizes(kv: DataFrame, now_ms: int) -> DataFrame:
    return live_keys(kv, now_ms).groupBy("db").agg(F.count("*").alias("n"))


def key_types(tables: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """Per wanted key the names of the tables that have it, comma-joined in order; 'none' if none has."""
    where = None
    for name, df in sorted(tables.items()):
        some = df.select(*KEY).distinct().withColumn("type", F.lit(name))
        where = some if where is None else where.unionByName(some)
    found = where.join(wanted.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("type"))
    return wanted.join(found, KEY, "left").select("pos", *KEY, F.coalesce("type", F.lit("none")).alias("type"))


def keys_like(kv: DataFrame, pattern: str, now_ms: int) -> DataFrame:
    """Live keys that match a glob. A fixed beginning goes to the scan as a range."""
    head = pattern.split("*")[0].split("?")[0]
    found = live_keys(kv, now_ms).where(F.col("key").rlike(glob_regex(pattern)))
    return (found.where(F.col("key").startswith(head)) if head else found).select(*KEY)


def scan_page(kv: DataFrame, after: tuple[str, int] | None, count: int, now_ms: int, pattern: str = "*") -> DataFrame:
    """A page of a scan: the next `count` live keys of the pattern after the cursor, with values, in order of key, db.

    The cursor is key and db of the last row of the page before rather than an offset, so a page is a top-k and never a full sort.
    """
    found = live_keys(kv, now_ms).where(F.col("key").rlike(glob_regex(pattern)))
    if after is not None:
        key, db = after
        found = found.where((F.col("key") > key) | (F.col("key") == key) & (F.col("db") > db))
    return found.orderBy("key", "db").limit(count).select(*KEY, "value")


def scan_values(kv: DataFrame, prefix: str, count: int, now_ms: int) -> DataFrame:
    """The first `count` live keys with a prefix, with values; the prefix reaches the scan."""
    return live_keys(kv, now_ms).where(F.col("key").startswith(prefix)).orderBy("key", "db").limit(count).select(*KEY, "value")


def any_key(kv: DataFrame, now_ms: int, seed: int = 0) -> DataFrame:
    """One live key, drawn by a seeded hash of its name."""
    return live_keys(kv, now_ms).orderBy(F.md5(F.concat_ws(":", F.lit(seed), *KEY)), *KEY).limit(1).select(*KEY, "value")


def evicted(kv: DataFrame, budget: int, buckets: int = 1000) -> DataFrame:
    """What stays within `budget` bytes when the keys least recently accessed go first (kv with last_access).

    Bytes are summed per slice of access time, `buckets` of them; running sums over these are few rows, and only the slice in
    which the budget ends is ordered by key, range by range, so a bulk load of one moment is many tasks too. Every key that
    fits in order of (last_access, key, db), latest first, stays.
    """
    sized = kv.withColumn("_bytes", (F.octet_length("value") + F.octet_length("key") + ENTRY_BYTES).cast("long"))
    low, high = kv.agg(F.min("last_access"), F.max("last_access")).first()
    if low is None:
        return kv
    width = (high - low) // buckets + 1
    sized = sized.withColumn("_bucket", F.floor((F.col("last_access") - low) / width))
    sums = sized.groupBy("_bucket").agg(F.sum("_bytes").alias("_sum"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(later), F.lit(0))).where(F.col("_base") < budget)
    sized = sized.join(F.broadcast(base), "_bucket")  # `buckets` rows at most
    whole = F.col("_base") + F.col("_sum") <= budget
    edge = running(sized.where(~whole), [F.desc("last_access"), F.desc("key"), F.desc("db")], F.col("_bytes"), "_run")
    return sized.where(whole).select(*kv.columns).unionByName(edge.where(F.col("_run") + F.col("_base") <= budget).select(*kv.columns))


# folds


def last_write(log: DataFrame) -> DataFrame:
    """State after a log of SET (with or without ttl_ms) and DEL rows: the last row of a key wins."""
    last = log.groupBy(*KEY).agg(F.max_by(F.struct("op", "value", "ts_ms", "ttl_ms"), "seq").alias("w"))
    return last.where("w.op <> 'DEL'").select(*KEY, F.col("w.value").alias("value"), (F.col("w.ts_ms") + F.col("w.ttl_ms")).alias("expires_at"))


def first_write(log: DataFrame) -> DataFrame:
    """State after a log of SETNX rows alone: the first row of a key wins."""
    first = log.groupBy(*KEY).agg(F.min_by(F.struct("value", "ts_ms", "ttl_ms"), "seq").alias("w"))
    return first.select(*KEY, F.col("w.value").alias("value"), (F.col("w.ts_ms") + F.col("w.ttl_ms")).alias("expires_at"))


def resolved(log: DataFrame) -> DataFrame:
    """Rows that write, each SETNX that found no key as SET and the others left out."""
    made = F.when(F.col("op") == "DEL", F.lit(0)).otherwise(F.lit(1))
    log = carried(log.where("op in ('SET', 'SETNX', 'DEL', 'INCRBY', 'APPEND')"), KEY, "seq", made, "_was", include_self=False)
    fresh = (F.col("op") == "SETNX") & (F.coalesce("_was", F.lit(0)) == 0)
    return log.withColumn("op", F.when(fresh, "SET").otherwise(F.col("op"))).where("op <> 'SETNX'").drop("_was")


def fold(log: DataFrame) -> DataFrame:
    """State (db, key, value, expires_at) after a log of SET, SETNX, DEL, INCRBY, APPEND, EXPIRE and PERSIST rows.

    A key's rows after its last whole write are summed (INCRBY) or joined in order (APPEND); all of it is partial
    aggregation. Counters and appended values have no expiry, as a rewrite drops it. Expiry counts when the state is read; a
    log in which keys expire between writes, or which mixes INCRBY and APPEND on one value, is for `replay`.
    """
    rows = resolved(log)
    last = rows.groupBy(*KEY).agg(F.max(F.when(F.col("op").isin("SET", "DEL"), F.col("seq"))).alias("last"), F.max("seq").alias("write"))
    tail = rows.join(last, KEY).where(F.coalesce(F.col("seq") >= F.col("last"), F.lit(True)))
    state = tail.groupBy(*KEY).agg(
        F.max("write").alias("write"),
        F.max(F.when(F.col("op").isin("SET", "DEL"), F.struct("op", "value", "ts_ms", "ttl_ms"))).alias("w"),
        F.sum(F.when(F.col("op") == "INCRBY", F.col("delta"))).alias("added"),
        F.sort_array(F.collect_list(F.when(F.col("op") == "APPEND", F.struct("seq", "value")))).alias("tail"),
    )
    mixed = F.col("added").isNotNull() & (F.size("tail") > 0)
    base = F.when(F.col("w.op") == "SET", F.col("w.value"))
    number = F.expr("try_cast(coalesce(case when w.op = 'SET' then w.value end, '0') as bigint)")
    joined = F.concat(F.coalesce(base, F.lit("")), F.array_join(F.transform("tail", lambda x: x.value), ""))
    value = (
        F.when(mixed, F.raise_error(F.lit("INCRBY and APPEND meet on one value: use replay")).cast("string"))
        .when(F.col("added").isNotNull(), F.coalesce(F.try_add(number, F.col("added")).cast("string"), base))
        .when(F.size("tail") > 0, joined)
        .otherwise(base)
    )
    plain = F.col("added").isNull() & (F.size("tail") == 0)
    state = state.select(*KEY, "write", value.alias("value"), F.when(plain, F.col("w.ts_ms") + F.col("w.ttl_ms")).alias("expires_at")).where("value is not null")
    expiry = log.where("op in ('EXPIRE', 'PERSIST')").groupBy(*KEY).agg(F.max_by(F.struct("seq", (F.col("ts_ms") + F.when(F.col("op") == "EXPIRE", F.col("ttl_ms"))).alias("at")), "seq").alias("e"))
    state = state.join(expiry, KEY, "left")
    return state.select(*KEY, "value", F.when(F.col("e.seq") > F.col("write"), F.col("e.at")).otherwise(F.col("expires_at")).alias("expires_at"))


def counters(log: DataFrame) -> DataFrame:
    """State of keys that are only ever incremented: a sum, whatever one key's share of the log."""
    return log.where("op = 'INCRBY'").groupBy(*KEY).agg(F.sum("delta").cast("string").alias("value")).withColumn("expires_at", F.lit(None).cast("long"))


REPLY = "db int, key string, seq bigint, reply string, value string, expires_at bigint, last boolean"


def step(state: tuple[str | None, int | None], op: str, ts: int, value: str | None, delta: int | None, ttl: int | None) -> tuple[tuple[str | None, int | None], str | None]:
    """One mutation: state (value, expires_at) before -> state after and reply. No value is no key."""
    held, expires = state
    if held is not None and expires is not None and ts > expires:
        held, expires = None, None
    until = ts + ttl if ttl is not None else None
    if op in ("SET", "SETNX", "SETXX", "GETSET"):
        if op == "SETNX" and held is not None or op == "SETXX" and held is None:
            return (held, expires), "0"
        return (value or "", until), held if op == "GETSET" else "1"
    if op in ("DEL", "GETDEL"):
        return (None, None), held if op == "GETDEL" else str(int(held is not None))
    if op == "INCRBY":
        try:
            total = int(held or "0") + (delta or 0)
        except ValueError:
            total = 1 << 63
        if not -(1 << 63) <= total < 1 << 63:
            return (held, expires), "ERR value is not an integer or out of range"
        return (str(total), until), str(total)
    if op == "APPEND":
        held = (held or "") + (value or "")
        return (held, None), str(len(held.encode()))
    if held is None:
        return (None, None), None if op == "GETEX" else "0"
    if op in ("EXPIRE", "PERSIST", "GETEX"):
        after = None if op == "PERSIST" else until if until is not None else expires
        return (held, after), held if op == "GETEX" else "1"
    return (held, expires), f"ERR unknown op {op}"


def replay(log: DataFrame) -> DataFrame:
    """Every log row with its reply, in the exact sequential semantics; `last` marks the rows that leave the final state.

    Ops: SET, SETNX, SETXX, GETSET, DEL, GETDEL, INCRBY, APPEND, EXPIRE, PERSIST, GETEX. A key's rows are cut where a SET or
    DEL sets its whole state: pieces don't depend on each other, so a busy key is replayed by many tasks, each streaming
    sorted rows with one value in hand. Such a row ends the piece before it (for its reply) and begins the next.
    """
    whole = F.col("op").isin("SET", "GETSET", "DEL", "GETDEL")
    rows = carried(log, KEY, "seq", F.when(whole, F.col("seq")), "piece")
    ends = carried(log, KEY, "seq", F.when(whole, F.col("seq")), "piece", include_self=False).where(whole)
    rows = rows.withColumn("role", F.when(whole, F.lit("begin")).otherwise(F.lit("step"))).unionByName(ends.withColumn("role", F.lit("end")))
    rows = rows.withColumn("piece", F.coalesce("piece", F.lit(-1).cast("long"))).select(F.col("db").cast("int").alias("db"), "key", "piece", "seq", "role", "ts_ms", "op", "value", "delta", "ttl_ms")
    rows = rows.repartition("db", "key", "piece").sortWithinPartitions("db", "key", "piece", "seq")

    def run(batches):
        at, state, held = None, (None, None), None
        for batch in batches:
            out = []
            for db, key, piece, seq, role, ts, op, value, delta, ttl in zip(*(c.to_pylist() for c in batch.columns)):
                if (db, key, piece) != at:
                    if held:
                        out.append((*held, True))
                    at, state, held = (db, key, piece), (None, None), None
                before = held
                state, reply = step(state, op, ts, value, delta, ttl)
                if before:
                    out.append((*before, False))
                if role == "end":  # the piece's state is overwritten here: nothing of it is final
                    out.append((db, key, seq, reply, None, None, False))
                    held = None
                else:
                    held = (db, key, seq, None if role == "begin" else reply, *state)
            yield pa.RecordBatch.from_pylist([dict(zip(("db", "key", "seq", "reply", "value", "expires_at", "last"), r)) for r in out], schema=SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(("db", "key", "seq", "reply", "value", "expires_at", "last"), (*held, True)))], schema=SCHEMA)

    replied = rows.mapInArrow(run, REPLY)
    # a whole write comes twice: its reply from the piece it ends, its state from the piece it begins
    return replied.groupBy("db", "key", "seq").agg(F.max("reply").alias("reply"), F.max("value").alias("value"), F.max("expires_at").alias("expires_at"), F.max("last").alias("last"))


SCHEMA = pa.schema([("db", pa.int32()), ("key", pa.string()), ("seq", pa.int64()), ("reply", pa.string()), ("value", pa.string()), ("expires_at", pa.int64()), ("last", pa.bool_())])


def final_state(replied: DataFrame) -> DataFrame:
    return replied.where("last and value is not null").select(*KEY, "value", "expires_at")


# whole-table writes


def ordered(moves: DataFrame) -> DataFrame:
    """moves with _at, which orders them: their seq, or where they have none their key and db."""
    return moves.withColumn("_at", F.struct(*(c for c in ("seq", "key", "db", "to") if c in moves.columns)))


def renamed(kv: DataFrame, moves: DataFrame, if_absent: bool = False) -> DataFrame:
    """kv after moves (db, key, to; seq if there is one orders them): values go over, expiries don't.

    All moves start from the state before. A key goes with its first move. Of several moves to one name the last wins and
    the others' keys are gone, as if they had been overwritten one after the other; with if_absent only names not taken are
    given, each to its first move, and the other keys stay.
    """
    moves = ordered(moves).join(kv.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("to", "_at").alias("to"), F.min("_at").alias("_at"))
    if if_absent:
        moves = moves.join(kv.select("db", F.col("key").alias("to")), ["db", "to"], "left_anti")
    winner = (F.min_by if if_absent else F.max_by)("key", "_at").alias("key")
    won = moves.groupBy("db", "to").agg(winner)
    gone = (won if if_absent else moves).select(*KEY).unionByName(won.select("db", F.col("to").alias("key"))).distinct()
    new = won.join(kv, KEY).select("db", F.col("to").alias("key"), "value", F.lit(None).cast("long").alias("expires_at"))
    return kv.join(gone, KEY, "left_anti").select(*KEY, "value", "expires_at").unionByName(new)


def copied(kv: DataFrame, moves: DataFrame, replace: bool = False) -> DataFrame:
    """kv and copies (db, key, to; seq if there is one orders them) of values without expiry.

    A name that is taken, by kv or by an earlier copy, stays; with `replace` it is written over, so the last copy wins.
    """
    new = ordered(moves).join(kv.select(*KEY, "value"), KEY)
    new = new.groupBy("db", F.col("to").alias("key")).agg((F.max_by if replace else F.min_by)("value", "_at").alias("value"))
    new = new.withColumn("expires_at", F.lit(None).cast("long"))
    if replace:
        return kv.join(new.select(*KEY), KEY, "left_anti").select(*KEY, "value", "expires_at").unionByName(new)
    return kv.select(*KEY, "value", "expires_at").unionByName(new.join(kv.select(*KEY), KEY, "left_anti"))


def moved(kv: DataFrame, wanted: DataFrame, to_db: int) -> DataFrame:
    """kv with the wanted keys (db, key) in another database, expiries kept, unless a key of that name is there.

    Of keys of one name in several databases the one of the least database goes.
    """
    free = wanted.join(kv.select(*KEY), KEY, "left_semi").join(kv.where(F.col("db") == to_db).select("key"), "key", "left_anti")
    free = free.groupBy("key").agg(F.min("db").alias("db")).withColumn("_go", F.lit(True))
    out = kv.join(free, KEY, "left")
    return out.withColumn("db", F.when(F.col("_go"), F.lit(to_db)).otherwise(F.col("db"))).select(*KEY, "value", "expires_at")


def set_if_none(kv: DataFrame, batches: DataFrame) -> DataFrame:
    """kv after multi-key writes (batch, db, key, value) in order of batch, each done whole or not at all.

    A batch is done if none of its keys is there before it: not in kv, nor by an earlier batch that was done. Each round does
    every batch that comes first for all of its keys among those undecided, and drops those that share a key with one done;
    rounds are as many as the longest chain of batches that wait for one another. A key that a batch names twice takes the
    greater value.
    """
    rows = batches.select("batch", *KEY, "value")
    taken = rows.join(kv.select(*KEY), KEY, "left_semi").select("batch").distinct()
    waiting = durable(rows.join(taken, "batch", "left_anti"), "waiting")
    out = kv.select(*KEY, "value", "expires_at")
    while not waiting.isEmpty():
        first = waiting.groupBy(*KEY).agg(F.min("batch").alias("_first"))
        judged = waiting.join(first, KEY).groupBy("batch").agg(F.min(F.col("batch") == F.col("_first")).alias("_go")).where("_go").select("batch")
        done = durable(waiting.join(judged, "batch", "left_semi"), "done")
        out = out.unionByName(done.groupBy(*KEY).agg(F.max("value").alias("value")).withColumn("expires_at", F.lit(None).cast("long")))
        lost = waiting.join(done.select(*KEY).distinct(), KEY, "left_semi").select("batch").distinct()
        waiting = durable(waiting.join(lost, "batch", "left_anti"), "waiting")
    return out


def flushed(kv: DataFrame, db: int | None = None) -> DataFrame:
    """kv without the keys of a database, or of all."""
    return kv.where(F.lit(False) if db is None else F.col("db") != db)


def summary(kv: DataFrame, now_ms: int) -> DataFrame:
    """Per database: keys, keys with expiry, mean of the time they have left, bytes."""
    expires: Column = F.col("expires_at")
    return live_keys(kv, now_ms).groupBy("db").agg(
        F.count("*").alias("keys"),
        F.count(expires).alias("expires"),
        F.coalesce(F.floor(F.avg(expires - now_ms)), F.lit(0)).cast("long").alias("avg_ttl"),
        F.sum(F.octet_length("value") + F.octet_length("key") + ENTRY_BYTES).cast("long").alias("bytes"),
    )
