"""Channels and mutation streams over files."""

from tarn.operators import kv
from tarn.streaming import pubsub

MESSAGES = "channel string, message string"


def test_deliveries(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("news", "m1"), ("other", "m2"), ("news", "m3")], MESSAGES).write.parquet(folder)
    subscriptions = spark.createDataFrame([("ann", "news"), ("ann", "news"), ("bob", "news")], "client string, channel string")
    got = []
    run = pubsub.publish(pubsub.message_stream(spark, folder, MESSAGES), subscriptions, str(tmp_path / "check"), lambda df, _: got.extend(df.collect()))
    run.awaitTermination(60)
    assert sorted((r["client"], r["message"]) for r in got) == [("ann", "m1"), ("ann", "m3"), ("bob", "m1"), ("bob", "m3")]


def test_patterns(spark):
    messages = spark.createDataFrame([("news.de", "x"), ("sport", "y")], MESSAGES)
    got = pubsub.pattern_deliveries(messages, {"news.*": ["ann", "bob"], "*": ["eve"], "n?": ["zoe"]}).collect()
    assert sorted((r["channel"], r["client"], r["pattern"]) for r in got) == [("news.de", "ann", "news.*"), ("news.de", "bob", "news.*"), ("news.de", "eve", "*"), ("sport", "eve", "*")]


def test_log_stream(spark, tmp_path):
    schema = "seq bigint, ts_ms bigint, db int, key string, op string, value string, delta bigint, ttl_ms bigint"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(1, 0, 0, "a", "SET", "1", None, None), (2, 0, 0, "a", "SET", "2", None, None), (3, 0, 0, "b", "DEL", None, None, None)], schema).write.parquet(source)
    pubsub.append_to_log(pubsub.message_stream(spark, source, schema), log, str(tmp_path / "check")).awaitTermination(60)
    assert [tuple(r) for r in kv.last_write(spark.read.parquet(log)).collect()] == [(0, "a", "2", None)]
    state = pubsub.latest_by_key(pubsub.message_stream(spark, source, schema))
    query = state.writeStream.outputMode("complete").format("memory").queryName("tarn_latest").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tarn_latest").collect())) == [(0, "a", "2"), (0, "b", None)]


def test_expiry(spark, tmp_path):
    from tarn.streaming.expiry import expired

    schema = "seq bigint, ts_ms bigint, db int, key string, op string, ttl_ms bigint"
    batches = [
        [(1, 1000, 0, "a", "SET", 5000), (2, 1000, 0, "b", "SET", 5000), (3, 1500, 0, "c", "SET", None)],
        [(4, 2000, 0, "b", "PERSIST", None), (5, 2500, 0, "c", "EXPIRE", 1000)],
        [(6, 60_000, 0, "d", "SET", None)],
        [(7, 61_000, 0, "d", "SET", None)],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run = expired(pubsub.message_stream(spark, str(source), schema)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, "a", 6000), (0, "c", 3500)]


def test_deliveries_of_one_file_are_many_tasks(spark, tmp_path, monkeypatch):
    """A table in one file and one channel, read as one task: what it makes is dealt to as many as it needs."""
    monkeypatch.setattr(pubsub, "DELIVERED_ROWS", 1_000, raising=False)
    monkeypatch.setattr(pubsub, "LISTED", 7, raising=False)
    spark.range(400).selectExpr("id message", "'c' channel").coalesce(1).write.parquet(str(tmp_path / "in"))
    subscriptions = spark.range(50).selectExpr("nullif(id, 9) client", "'c' channel")
    got = pubsub.deliveries(spark.read.parquet(str(tmp_path / "in")), subscriptions.union(subscriptions))
    assert got.columns == ["channel", "message", "client"] and got.rdd.getNumPartitions() >= 20
    rows = {(r["message"], r["client"]) for r in got.collect()}
    assert len(rows) == got.count() == 20_000 and (0, None) in rows and (399, 49) in rows


def test_deliveries_in_a_file_repeat_the_same_clients(spark, tmp_path, monkeypatch):
    """Messages of many channels, in any order: a channel's rows come together, so that files of them are small."""
    monkeypatch.setattr(pubsub, "DELIVERED_ROWS", 12_000)
    monkeypatch.setattr(pubsub, "LISTED", 250)
    spark.range(400).selectExpr("id message", "concat('c', pmod(xxhash64(id), 8)) channel").write.parquet(str(tmp_path / "in"))
    subscriptions = spark.range(8_000).selectExpr("id client", "concat('c', id % 8) channel")
    messages = spark.read.parquet(str(tmp_path / "in"))
    got = pubsub.deliveries(messages, subscriptions)
    got.write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 400_000 and found.distinct().exceptAll(messages.join(subscriptions, "channel").select(*found.columns)).count() == 0
    assert found.distinct().count() == 400_000
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert size < 400_000  # 231,001 when this was written; 1,502,685 with messages dealt in any order
    assert all(n <= 20_000 for (n,) in found.groupBy("_metadata.file_name").count().select("count").collect())
