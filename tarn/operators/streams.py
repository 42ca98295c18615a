"""Append-only streams as rows: entries(db, key, ms, nth, fields); an entry's id is (ms, nth), nth counting within a millisecond."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["db", "key"]


def appended(log: DataFrame) -> DataFrame:
    """log (seq, ts_ms, db, key, fields) -> entries with their ids. Only the entries of one stream and millisecond are ordered together."""
    order = Window.partitionBy(*KEY, "ts_ms").orderBy("seq")
    return log.select(*KEY, F.col("ts_ms").alias("ms"), (F.row_number().over(order) - 1).alias("nth"), "fields")


def lengths(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEY).agg(F.count("*").alias("n"))


def between(entries: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Entries whose ids lie from first_ms to last_ms, both included: a filter that reaches the scan."""
    return entries.where(F.col("ms").between(first_ms, last_ms))


def read_after(entries: DataFrame, positions: DataFrame, count: int) -> DataFrame:
    """positions (db, key, after_ms, after_nth) -> the next `count` entries of each stream behind its position, in order of place."""
    later = entries.join(positions, KEY).where((F.col("ms") > F.col("after_ms")) | (F.col("ms") == F.col("after_ms")) & (F.col("nth") > F.col("after_nth")))
    order = Window.partitionBy(*KEY).orderBy("ms", "nth")
    return later.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("after_ms", "after_nth")
