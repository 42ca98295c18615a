"""Snapshots and the mutation log as Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kv import final_state, replay

MANIFEST = "manifest"


def save(tables: dict[str, DataFrame], folder: str, at_ms: int) -> str:
    """Write a snapshot of the tables; it counts once its line in the manifest is there, so a reader never sees half of one."""
    name = f"{folder}/snapshot-{at_ms}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{name}/{table}")
    spark = next(iter(tables.values())).sparkSession
    line = spark.createDataFrame([(at_ms, name, sorted(tables))], "at_ms bigint, path string, tables array<string>")
    line.coalesce(1).write.mode("append").parquet(f"{folder}/{MANIFEST}")
    return name


def last_save(spark: SparkSession, folder: str):
    """at_ms, path and tables of the latest whole snapshot."""
    return spark.read.parquet(f"{folder}/{MANIFEST}").orderBy(F.desc("at_ms"), F.desc("path")).first()


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = last_save(spark, folder)
    return {t: spark.read.parquet(f"{found['path']}/{t}") for t in found["tables"]}


def append(log: DataFrame, folder: str) -> None:
    log.write.mode("append").parquet(folder)


def compact(log: DataFrame, seq: int) -> DataFrame:
    """The shortest log with the same final state: one SET row per key, all at the given seq."""
    state = final_state(replay(log))
    return state.select(F.lit(seq).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), "db", "key", F.lit("SET").alias("op"), "value", F.lit(None).cast("long").alias("delta"), F.col("expires_at").alias("ttl_ms"))
