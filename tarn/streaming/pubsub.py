"""Channels as streams: messages meet a table of subscriptions, batch or streaming alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import glob_regex
from ..plans.durable import BROADCAST_ROWS, durable, hinted, running, tasks

#: Deliveries that one task makes of its messages.
DELIVERED_ROWS = 5_000_000
#: Clients in one list of a channel; fewer than a byte counts, which is what a client then takes in a file before it is compressed.
LISTED = 250


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages (channel, message, ...) and subscriptions (client, channel) -> a row per message and subscriber.

    A table of messages is dealt to tasks by the rows that it makes, which are far more than it has, whatever files and
    channels it comes in: a channel that has most of the messages or subscribers is not one task's. A message meets lists of
    its channel's clients, which cost less than to look up each client; a list stays within about LISTED. A list that makes
    more than a task's share has tasks of its own, and smaller ones come one after the other: in a task's rows the same few
    clients then follow each other again and again, and files of them take a fraction of the room.
    """
    subscriptions = subscriptions.select("client", "channel").distinct()
    if messages.isStreaming:
        return messages.join(subscriptions, "channel")
    most = subscriptions.groupBy("channel").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("client"), F.lit(-(-most // LISTED)))
    lists = subscriptions.groupBy("channel", part.alias("_list")).agg(F.collect_list(F.struct("client")).alias("_clients"))
    lists = durable(lists.select("channel", "_list", F.transform("_clients", lambda c: c["client"]).alias("_clients")), "lists")  # with a null client, if there is one
    total = subscriptions.count()
    asked = messages.groupBy("channel").agg(F.count("*").alias("_m")).join(lists.select("channel", "_list", F.size("_clients").alias("_n")), "channel")
    asked = durable(asked.withColumn("_rows", F.col("_m") * F.col("_n")), "asked")
    made, met, n_asked = asked.agg(F.sum("_rows"), F.sum("_m"), F.count("*")).first()
    share = max(1, min(DELIVERED_ROWS, -(-(made or 0) // int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    asked = asked.withColumn("_few", F.col("_rows") < share).withColumn("_room", F.when(F.col("_few"), F.col("_rows")).otherwise(F.ceil(F.col("_rows") / share) * share))
    asked = durable(running(asked, ["_few", "channel", "_list"], F.col("_room"), "_end").select("channel", "_list", "_m", "_room", "_end"), "places")
    n = 1 + (asked.agg(F.max("_end")).first()[0] or 0) // share
    # a message's place in a list's room: one that its hash decides
    nth = F.pmod(F.xxhash64(*(c for c, kind in messages.dtypes if "map<" not in kind)), F.col("_m"))
    place = F.col("_end") - F.col("_room") + F.floor(nth * (F.col("_room") / F.col("_m")))
    many = messages.repartition(tasks(messages.sparkSession, met or 0))  # a row per list is made of each
    placed = many.join(hinted(asked, n_asked), "channel").select(*messages.columns, "_list", F.floor(place / share).cast("int").alias("_task"))
    placed = placed.repartitionById(n, "_task").drop("_task")
    return placed.join(hinted(lists, total), ["channel", "_list"]).select("channel", *(c for c in messages.columns if c != "channel"), F.explode("_clients").alias("client"))


def pattern_deliveries(messages: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """The same for subscriptions by glob: {pattern: clients}. Patterns are a short list that the caller holds, so they are
    part of the plan: a message is expanded into its subscribers without a join."""
    if sum(map(len, patterns.values())) > BROADCAST_ROWS // 100:
        raise ValueError("too many pattern subscriptions for one plan; split them")
    clients = F.array().cast("array<struct<client: string, pattern: string>>")
    for pattern, names in sorted(patterns.items()):
        some = F.array(*(F.struct(F.lit(n).alias("client"), F.lit(pattern).alias("pattern")) for n in sorted(set(names))))
        clients = F.concat(clients, F.when(F.col("channel").rlike(glob_regex(pattern)), some).otherwise(F.array().cast("array<struct<client: string, pattern: string>>")))
    return messages.select("*", F.explode(clients).alias("_c")).select(*messages.columns, "_c.client", "_c.pattern")


def message_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder that Parquet files of messages are added to, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def publish(messages: DataFrame, subscriptions: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None]):
    """Start delivering a stream: send(rows, batch) gets each batch's deliveries; a batch may be sent again after a failure."""
    return deliveries(messages, subscriptions).writeStream.option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()


def append_to_log(mutations: DataFrame, folder: str, checkpoint: str):
    """Start appending a stream of mutations to the log's folder; the file sink writes each batch once."""
    return mutations.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(mutations: DataFrame) -> DataFrame:
    """Running state of a stream of SET and DEL rows (update mode): the last write of each key so far."""
    last = mutations.groupBy("db", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return last.select("db", "key", F.when(F.col("w.op") != "DEL", F.col("w.value")).alias("value"))
