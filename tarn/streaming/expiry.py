"""Expiry as it happens: a stream of mutations with times to live becomes a stream of keys that have expired.

A key's state is the moment at which it expires, one long; a timer on event time fires when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "db int, key string, expired_at bigint"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (expires,) = state.get
        state.remove()
        yield pd.DataFrame({"db": [key[0]], "key": [key[1]], "expired_at": [expires]})
        return
    rows = pd.concat(list(batches)).sort_values("seq")
    expires = state.get[0] if state.exists else None
    gone = []
    for ts, op, ttl in zip(rows["ts_ms"], rows["op"], rows["ttl_ms"]):
        if expires is not None and ts > expires:  # it had expired before this write
            gone.append(expires)
            expires = None
        if op == "EXPIRE" or op == "SET" and not pd.isna(ttl):
            expires = int(ts + ttl)
        elif op in ("SET", "DEL", "PERSIST"):
            expires = None
    if gone:
        yield pd.DataFrame({"db": key[0], "key": key[1], "expired_at": gone})
    if expires is None:
        if state.exists:
            state.remove()
        return
    if expires < state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        yield pd.DataFrame({"db": [key[0]], "key": [key[1]], "expired_at": [expires]})
        return
    state.update((expires,))
    state.setTimeoutTimestamp(expires + 1)


def expired(mutations: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """mutations (seq, ts_ms, db, key, op, ttl_ms) with ops SET, DEL, EXPIRE and PERSIST -> db, key, expired_at.

    Rows later than the watermark allows are left out. Expiry is announced once the watermark has passed it. One key's rows
    of one micro-batch are sorted in memory, so the source's limit per trigger is the bound.
    """
    timed = mutations.select("seq", "ts_ms", F.col("db").cast("int").alias("db"), "key", "op", "ttl_ms", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", lateness)
    return timed.groupBy("db", "key").applyInPandasWithState(_follow, OUT, "expires bigint", "append", GroupStateTimeout.EventTimeTimeout)
