"""Sorted sets as rows: zset(db, key, member, score), in order of score, then member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import numbered

KEY, MEMBER = ["db", "key"], ["db", "key", "member"]


def written(log: DataFrame) -> DataFrame:
    """Members after a log (seq, db, key, member, score): the last score wins, a null score removes."""
    last = log.groupBy(*MEMBER).agg(F.max_by(F.struct("score"), "seq").alias("w"))
    return last.select(*MEMBER, F.col("w.score").alias("score")).where("score is not null")


def incremented(zset: DataFrame, deltas: DataFrame) -> DataFrame:
    """Members after deltas (db, key, member, delta) are added; a missing member starts at 0."""
    sums = deltas.groupBy(*MEMBER).agg(F.sum("delta").alias("_d"))
    return zset.join(sums, MEMBER, "full").select(*MEMBER, (F.coalesce("score", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))).alias("score"))


def ranked(zset: DataFrame, reverse: bool = False) -> DataFrame:
    """zset with rank from 0; sets too large for one task's sort are ranked range by range."""
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    return numbered(zset, KEY, order, "rank")


def rank_of(zset: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, db, key, member) -> rank and score, null where there is no such member; only the sets asked for are ranked."""
    only = zset.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    return wanted.join(ranked(only), MEMBER, "left").select("pos", *MEMBER, "rank", "score")


def in_range(zset: DataFrame, start: int, stop: int) -> DataFrame:
    """Members from rank start to stop, both included, negative from the end, with rank and score."""
    rows = ranked(zset).join(cardinalities(zset), KEY)
    end = lambda i: F.lit(i) if i >= 0 else F.col("n") + i
    return rows.where((F.col("rank") >= end(start)) & (F.col("rank") <= end(stop))).select(*MEMBER, "score", "rank")


def top(zset: DataFrame, k: int) -> DataFrame:
    """The k highest members of each set, with rank from the top: each task cuts its rows to k before they are shuffled."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), F.desc("member"))
    return zset.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).withColumn("rank", (F.col("_n") - 1).cast("long")).drop("_n")


def count_between(zset: DataFrame, low: float, high: float) -> DataFrame:
    """Per set how many scores lie between low and high, both included; sets with none count 0."""
    return zset.groupBy(*KEY).agg(F.count_if(F.col("score").between(low, high)).alias("n"))


def cardinalities(zset: DataFrame) -> DataFrame:
    return zset.groupBy(*KEY).agg(F.count("*").alias("n"))
