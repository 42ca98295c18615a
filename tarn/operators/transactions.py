"""Optimistic transactions over the log: a batch is appended whole, or not at all if a key it watched has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import numbered

KEY = ["db", "key"]


def versions(log: DataFrame) -> DataFrame:
    """The last sequence number that touched each key."""
    return log.groupBy(*KEY).agg(F.max("seq").alias("version"))


def admitted(log: DataFrame, watched: DataFrame) -> DataFrame:
    """watched (txn, db, key, version; version null: not there) -> the transactions none of whose keys changed."""
    now = watched.join(versions(log).withColumnRenamed("version", "_now"), KEY, "left")
    broken = now.where(~F.col("version").eqNullSafe(F.col("_now"))).select("txn").distinct()
    return watched.select("txn").distinct().join(broken, "txn", "left_anti")


def committed(log: DataFrame, queued: DataFrame, watched: DataFrame, after: int) -> DataFrame:
    """Rows to append: queued (txn, nth, and the log's columns but seq) of transactions that may go, numbered from after + 1.

    All transactions are judged against the same log. Rows are numbered in order of transaction, then place, so those of one
    transaction are contiguous.
    """
    blocked = watched.select("txn").distinct().join(admitted(log, watched), "txn", "left_anti")
    rows = numbered(queued.join(blocked, "txn", "left_anti").withColumn("_all", F.lit(0)), ["_all"], [F.col("txn"), F.col("nth")], "seq")
    return rows.withColumn("seq", F.col("seq") + after + 1).drop("_all", "nth")
