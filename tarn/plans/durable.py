"""Plan building blocks: intermediates that survive lost executors, size-checked broadcasts, numbering without hot tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows (ids, depths, a few numbers) that may be broadcast: tens of megabytes at most.
BROADCAST_ROWS = 500_000
#: Rows of one key that a single task may sort; keys with more are numbered range by range.
HOT_ROWS = 5_000_000
#: Rows of one task where keys are dealt by counted rows.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). In local mode, where one machine is all there is, a
    folder of our own stands in for it if it is unset; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_WRITTEN: list[str] = []


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and scanned again: lineage ends here. `release` deletes what is no longer needed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every intermediate that this process has written so far, and say how many. Call it once the results that were
    made from them are written or collected: frames not yet computed would miss them."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def tasks(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: a task's share stays the same however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by keys to as many tasks as its counted rows need. What is aggregated by these keys next is so within a task's
    share; nothing is aggregated before the shuffle, where a task's memory would grow with the files that it is given."""
    return df.repartition(tasks(df.sparkSession, rows), *keys)


def bucketed(df: DataFrame, table: str, n: int, key: str) -> DataFrame:
    """df as a table of n buckets of a key, a file each: later joins on the key leave it where it is. The caller drops the table."""
    df.repartition(n, key).write.option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    return df.sparkSession.table(table)


def carried(df: DataFrame, keys: list[str], seq: str, value: Column, name: str, include_self: bool = True, width: int = 1 << 20) -> DataFrame:
    """df with `name`: per key the last non-null `value` in order of seq, of the row itself and those before (or only before).

    A key's rows are dealt to chunks of `width` sequence numbers; chunk ends are aggregated, so a key that holds a third of
    the log is still many tasks.
    """
    marked = df.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(seq) / width))
    ends = marked.where("_v is not null").groupBy(*keys, "_chunk").agg(F.max_by("_v", seq).alias("_end"))
    chunks = marked.select(*keys, "_chunk").distinct().join(ends, [*keys, "_chunk"], "left")
    order = Window.partitionBy(*keys).orderBy("_chunk")
    before = chunks.withColumn("_before", F.last("_end", True).over(order.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    rows = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    out = marked.withColumn("_within", F.last("_v", True).over(rows)).join(before, [*keys, "_chunk"])
    return out.withColumn(name, F.coalesce("_within", "_before")).drop("_v", "_chunk", "_within", "_before")


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `name`: 0, 1, 2, ... within each key in the given order (columns).

    The largest key is counted first. While it fits a task's sort, a window does it; else the rows are dealt by ranges of
    (key, order), numbered within each range, and the sizes of the ranges before are added.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= hot_rows:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    ranges = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranges = durable(ranges, "ranges")
    sizes = ranges.groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    out = ranges.withColumn("_within", within).join(sizes, [*keys, "_range"])
    return out.withColumn(name, (F.col("_base") + F.col("_within")).cast("long")).drop("_range", "_base", "_within")


def running(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of value over the row itself and all before it in the given order, over the whole table.

    Rows are dealt by ranges of the order; what is summed in one task is a range, or one number per range.
    """
    ranges = durable(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.sum("_value").alias("_all"))  # a row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranges.withColumn("_within", within).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within", "_value")
