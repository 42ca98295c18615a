"""Keyed collections: small cases with known results, and the log's replay against a plain interpreter."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarn.functions import columns as C
from tarn.operators import hashes, kv, lists, sets, transactions, zsets
from tarn.plans import durable as plans

LOG = "seq bigint, ts_ms bigint, db int, key string, op string, value string, delta bigint, ttl_ms bigint"


def log(spark, *rows):
    return spark.createDataFrame([(i, ts, 0, key, op, value, delta, ttl) for i, (ts, key, op, value, delta, ttl) in enumerate(rows)], LOG)


def replies(spark, *rows):
    return [r["reply"] for r in kv.replay(log(spark, *rows)).orderBy("seq").collect()]


def test_counters(spark):
    assert replies(spark, *((i, "n", "INCRBY", None, d, None) for i, d in enumerate((1, 1, -1, 10, -5)))) == ["1", "2", "1", "11", "6"]
    assert replies(spark, (0, "n", "SET", "abc", None, None), (1, "n", "INCRBY", None, 1, None))[1].startswith("ERR")
    assert replies(spark, (0, "n", "SET", str(2**63 - 1), None, None), (1, "n", "INCRBY", None, 1, None))[1].startswith("ERR")


def test_append_and_conditions(spark):
    assert replies(spark, (0, "a", "APPEND", "hello", None, None), (1, "a", "APPEND", " world", None, None)) == ["5", "11"]
    assert replies(spark, (0, "k", "SETNX", "1", None, None), (1, "k", "SETNX", "2", None, None)) == ["1", "0"]
    assert replies(spark, (0, "k", "SETXX", "1", None, None), (1, "k", "SET", "2", None, None), (2, "k", "SETXX", "3", None, None), (3, "k", "GETDEL", None, None, None), (4, "k", "DEL", None, None, None)) == ["0", "1", "1", "3", "0"]
    assert replies(spark, (0, "k", "GETSET", "1", None, None), (1, "k", "GETSET", "2", None, None)) == [None, "1"]


def test_expiry_within_the_log(spark):
    got = replies(spark, (0, "l", "SETNX", "a", None, 10), (5, "l", "SETNX", "b", None, 10), (11, "l", "SETNX", "c", None, 10), (12, "l", "PERSIST", None, None, None), (99, "l", "GETEX", None, None, None), (99, "m", "EXPIRE", None, None, 5))
    assert got == ["1", "0", "1", "1", "c", "0"]


def interpreted(rows):
    state, out = {}, []
    for _, ts, db, key, op, value, delta, ttl in rows:
        after, reply = kv.step(state.get((db, key), (None, None)), op, ts, value, delta, ttl)
        state[db, key] = after
        out.append(reply)
    return {k: v for k, v in state.items() if v[0] is not None}, out


def test_replay_like_an_interpreter(spark):
    rnd = random.Random(5)
    ops = ["SET", "SETNX", "SETXX", "GETSET", "DEL", "GETDEL", "INCRBY", "APPEND", "EXPIRE", "PERSIST", "GETEX"]
    rows = []
    for i in range(600):
        # one key has a third of all rows
        key = "hot" if rnd.random() < 0.33 else f"k{rnd.randrange(9)}"
        rows.append((i, i * 3, rnd.randrange(2), key, rnd.choice(ops), rnd.choice(["7", "x", ""]), rnd.randrange(-5, 6), rnd.choice([None, 20, 200])))
    state, out = interpreted(rows)
    found = kv.replay(spark.createDataFrame(rows, LOG).repartition(5)).cache()
    assert [r["reply"] for r in found.orderBy("seq").collect()] == out
    assert {(r["db"], r["key"]): (r["value"], r["expires_at"]) for r in kv.final_state(found).collect()} == state


def test_fold_like_an_interpreter(spark):
    rnd = random.Random(6)
    rows = [(i, i, 0, f"k{rnd.randrange(12)}", rnd.choice(["SET", "SETNX", "DEL", "INCRBY", "EXPIRE", "PERSIST"]), str(rnd.randrange(50)), rnd.randrange(9), rnd.choice([None, 10**6])) for i in range(400)]
    rows = [r[:7] + (10**6,) if r[4] == "EXPIRE" else r for r in rows]
    rows = [r[:7] + (None,) if r[4] in ("INCRBY", "PERSIST", "DEL") else r for r in rows]
    state, _ = interpreted(rows)
    assert {(r["db"], r["key"]): (r["value"], r["expires_at"]) for r in kv.fold(spark.createDataFrame(rows, LOG)).collect()} == state
    with pytest.raises(PySparkException):
        kv.fold(log(spark, (0, "k", "INCRBY", None, 1, None), (1, "k", "APPEND", "x", None, None))).collect()


def test_empty_log(spark):
    none = spark.createDataFrame([], LOG)
    assert kv.fold(none).count() == kv.replay(none).count() == kv.last_write(none).count() == 0


def test_carried_and_numbered_in_pieces(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, i if i % 5 == 0 else None) for i in range(100)], "key string, seq bigint, v bigint")
    got = plans.carried(df, ["key"], "seq", F.col("v"), "last", width=7).orderBy("seq").collect()
    last = {}
    for r in got:
        if r["v"] is not None:
            last[r["key"]] = r["v"]
        assert r["last"] == last.get(r["key"])
    whole = plans.numbered(df, ["key"], [F.desc("seq")], "n").orderBy("seq").collect()
    assert plans.numbered(df, ["key"], [F.desc("seq")], "n", hot_rows=10).orderBy("seq").collect() == whole


def test_globs():
    import re

    hit = lambda p, s: bool(re.match(C.glob_regex(p), s))
    assert hit("hello*", "hello world") and hit("h?llo", "hello") and not hit("h?llo", "hllo")
    assert hit("user:*:name", "user:1:name") and not hit("user:*:name", "user:1:mail") and hit("a.b", "a.b") and not hit("a.b", "axb")


def test_keys_and_scan(spark):
    state = kv.last_write(log(spark, *((0, k, "SET", "v", None, None) for k in ("hello", "hallo", "help", "other"))))
    assert sorted(r["key"] for r in kv.keys_like(state, "h?llo", 0).collect()) == ["hallo", "hello"]
    first = [r["key"] for r in kv.scan_page(state, None, 2, 0).collect()]
    assert first == ["hallo", "hello"] and [r["key"] for r in kv.scan_page(state, (first[-1], 0), 9, 0).collect()] == ["help", "other"]
    assert kv.any_key(state, 0).count() == 1 and kv.flushed(state).count() == 0 and kv.flushed(state, 1).count() == 4


def test_rename_copy_move(spark):
    state = kv.last_write(log(spark, (0, "a", "SET", "1", None, 50), (0, "b", "SET", "2", None, None)))
    moves = spark.createDataFrame([(0, "a", "b")], "db int, key string, to string")
    assert {r["key"] for r in kv.renamed(state, moves, if_absent=True).collect()} == {"a", "b"}
    assert [tuple(r) for r in kv.renamed(state, moves).collect()] == [(0, "b", "1", None)]
    assert {r["key"]: r["value"] for r in kv.copied(state, moves).collect()} == {"a": "1", "b": "2"}
    assert {r["key"]: r["value"] for r in kv.copied(state, moves, replace=True).collect()} == {"a": "1", "b": "1"}
    assert {(r["db"], r["key"], r["expires_at"]) for r in kv.moved(state, moves.select("db", "key"), 3).collect()} == {(3, "a", 50), (0, "b", None)}


def test_eviction_keeps_what_fits(spark):
    state = spark.createDataFrame([(0, f"k{i}", "v" * i, None, i * 1000) for i in range(40)], "db int, key string, value string, expires_at bigint, last_access bigint")
    kept = sorted(r["last_access"] for r in kv.evicted(state, 500, buckets=7).collect())
    size, expected = 0, []
    for i in reversed(range(40)):
        size += i + len(f"k{i}") + 56
        if size <= 500:
            expected.append(i * 1000)
    assert kept == sorted(expected)


def items(spark, *values):
    return spark.createDataFrame([(0, "l", i, v) for i, v in enumerate(values)], "db int, key string, pos bigint, value string")


def contents(df):
    return [r["value"] for r in df.orderBy("pos").collect()]


def test_lists(spark):
    pushes = spark.createDataFrame([(1, 0, "l", "R", "a"), (2, 0, "l", "R", "b"), (3, 0, "l", "L", "z")], "seq bigint, db int, key string, side string, value string")
    assert contents(lists.pushed(pushes)) == ["z", "a", "b"]
    five = items(spark, *"abcde")
    assert [r["value"] for r in lists.in_range(five, 1, 3).orderBy("index").collect()] == ["b", "c", "d"]
    assert [r["value"] for r in lists.in_range(five, -2, -1).orderBy("index").collect()] == ["d", "e"]
    assert lists.in_range(five, 3, 1).count() == 0
    changed = lists.replaced(items(spark, *"abaca"), spark.createDataFrame([(0, "l", 1, "B"), (0, "l", 9, "no")], "db int, key string, at int, new string"))
    assert contents(changed) == ["a", "B", "a", "c", "a"] and contents(lists.removed(changed, "a", 2)) == ["B", "c", "a"]
    assert contents(lists.removed(changed, "a", -1)) == ["a", "B", "a", "c"] and contents(lists.removed(changed, "a")) == ["B", "c"]
    three = items(spark, *"xyz")
    assert [[r["value"] for r in lists.at_index(three, i).collect()] for i in (-1, -3, -4, 3)] == [["z"], ["x"], [], []]
    off, rest = lists.popped(three, 2, "R")
    assert [r["value"] for r in off.orderBy("nth").collect()] == ["z", "y"] and contents(rest) == ["x"]
    assert contents(lists.trimmed_to_last(three, 2)) == ["y", "z"]


def test_array_forms(spark):
    df = spark.createDataFrame([(["a", "b", "c"], {"x": "1"})], "l array<string>, m map<string,string>")
    got = df.select(C.list_index(F.col("l"), -1), C.list_index(F.col("l"), 3), C.list_range(F.col("l"), -2, 9), C.list_range(F.col("l"), 5, 9), C.list_set(F.col("l"), 0, F.lit("A")), C.list_set(F.col("l"), 3, F.lit("A")), C.hash_get(F.col("m"), "x", "y"), C.hash_set(F.col("m"), F.create_map(F.lit("x"), F.lit("2"))), C.hash_delete(F.col("m"), "x")).first()
    assert tuple(got) == ("c", None, ["b", "c"], [], ["A", "b", "c"], None, ["1", None], {"x": "2"}, {})


def test_hash_increment(spark):
    none = spark.createDataFrame([], "db int, key string, field string, value string")
    for_ = lambda d: spark.createDataFrame([(0, "h", "f", d)], "db int, key string, field string, delta bigint")
    once = hashes.incremented(none, for_(5))
    assert once.first()["value"] == "5" and hashes.incremented(once, for_(-3)).first()["value"] == "2"
    assert hashes.new_fields(once, for_(1)).count() == 0 and hashes.new_fields(none, for_(1)).first()["n"] == 1


def test_sets(spark):
    members = spark.createDataFrame([(0, k, m) for k, ms in {"a": "123", "b": "234", "c": "24"}.items() for m in ms], "db int, key string, member string")
    ask = lambda *keys: spark.createDataFrame([(1, i, 0, k) for i, k in enumerate(keys)], "request int, nth int, db int, key string")
    of = lambda how, *keys: sorted(r["member"] for r in sets.combined(members, ask(*keys), how).collect())
    assert of("union", "a", "b") == list("1234") and of("inter", "a", "b") == ["2", "3"] and of("diff", "a", "c") == ["1", "3"]
    assert of("inter", "a", "none") == [] and of("diff", "none", "a") == [] and of("diff", "a", "a") == [] and of("inter", "a", "a") == list("123")
    assert sets.without(members, members.where("key = 'a'")).count() == 5 and sets.added(members, members).count() == 8


def test_sorted_sets(spark):
    z = spark.createDataFrame([(0, "lb", "c", 30.0), (0, "lb", "a", 10.0), (0, "lb", "b", 20.0), (0, "lb", "b2", 20.0)], "db int, key string, member string, score double")
    assert [r["member"] for r in zsets.in_range(z, 0, -1).orderBy("rank").collect()] == ["a", "b", "b2", "c"]
    wanted = spark.createDataFrame([(0, 0, "lb", "c"), (1, 0, "lb", "zz")], "pos int, db int, key string, member string")
    assert [(r["rank"], r["score"]) for r in zsets.rank_of(z, wanted).orderBy("pos").collect()] == [(3, 30.0), (None, None)]
    assert zsets.count_between(z, 10, 20).first()["n"] == 3 and zsets.count_between(z, 50, 100).first()["n"] == 0
    writes = spark.createDataFrame([(1, 0, "lb", "a", 10.0), (2, 0, "lb", "a", 99.0), (3, 0, "lb", "b", 1.0), (4, 0, "lb", "b", None)], "seq int, db int, key string, member string, score double")
    assert [tuple(r) for r in zsets.written(writes).collect()] == [(0, "lb", "a", 99.0)]


def test_transactions(spark):
    base = log(spark, (0, "a", "SET", "1", None, None), (0, "b", "SET", "2", None, None))
    watched = spark.createDataFrame([(1, 0, "a", 0), (2, 0, "b", 0), (3, 0, "new", None)], "txn int, db int, key string, version bigint")
    assert sorted(r["txn"] for r in transactions.admitted(base, watched).collect()) == [1, 3]
    queued = spark.createDataFrame([(t, n, 9, 0, f"k{t}", "SET", "v", None, None) for t in (1, 2, 4) for n in (0, 1)], "txn int, nth int, " + LOG.replace("seq bigint, ", ""))
    got = transactions.committed(base, queued, watched, after=1).orderBy("seq").collect()
    assert [(r["seq"], r["txn"], r["key"]) for r in got] == [(2, 1, "k1"), (3, 1, "k1"), (4, 4, "k4"), (5, 4, "k4")]


def test_moves_that_collide(spark):
    """Several keys to one name, one key to several, and names that are taken."""
    state = spark.createDataFrame([(0, k, k * 2, 9) for k in "abcd"] + [(1, "a", "1a", None)], "db int, key string, value string, expires_at bigint")
    moves = spark.createDataFrame([(2, 0, "b", "t"), (1, 0, "a", "t"), (3, 0, "c", "u"), (4, 0, "c", "v"), (5, 0, "none", "w"), (6, 1, "a", "t")], "seq int, db int, key string, to string")
    rows = lambda df: sorted((r["db"], r["key"], r["value"]) for r in df.collect())
    assert rows(kv.renamed(state, moves)) == [(0, "d", "dd"), (0, "t", "bb"), (0, "u", "cc"), (1, "t", "1a")]
    assert rows(kv.renamed(state, moves, if_absent=True)) == [(0, "b", "bb"), (0, "d", "dd"), (0, "t", "aa"), (0, "u", "cc"), (1, "t", "1a")]
    kept = [(0, k, k * 2) for k in "abcd"] + [(1, "a", "1a")]
    assert rows(kv.copied(state, moves)) == sorted(kept + [(0, "t", "aa"), (0, "u", "cc"), (0, "v", "cc"), (1, "t", "1a")])
    assert rows(kv.copied(state, moves, replace=True)) == sorted(kept + [(0, "t", "bb"), (0, "u", "cc"), (0, "v", "cc"), (1, "t", "1a")])
    assert rows(kv.moved(state, state.select("db", "key"), 5)) == [(1, "a", "1a"), (5, "a", "aa"), (5, "b", "bb"), (5, "c", "cc"), (5, "d", "dd")]


def test_multi_key_writes_all_or_nothing(spark):
    rnd = random.Random(3)
    state = spark.createDataFrame([(0, f"k{i}", "old", None) for i in range(10)], "db int, key string, value string, expires_at bigint")
    batches = [(b, 0, f"k{rnd.randrange(200)}", f"v{b}") for b in range(150) for _ in range(rnd.randrange(1, 5))]
    held = {f"k{i}": "old" for i in range(10)}
    for b in range(150):
        names = [k for n, _, k, _ in batches if n == b]
        if not any(k in held for k in names):
            held |= dict.fromkeys(names, f"v{b}")
    rows = spark.createDataFrame(batches, "batch int, db int, key string, value string")
    assert {r["key"]: r["value"] for r in kv.set_if_none(state, rows).collect()} == held
    assert kv.set_if_none(state, rows.where("false")).count() == 10


def test_evicted_in_one_moment(spark):
    """A bulk load: all keys were last accessed at once, and the order of their names decides."""
    state = spark.range(300).selectExpr("0 db", "concat('k', id) key", "repeat('x', cast(id % 7 as int)) value", "77L last_access")
    left, want = 5000, set()
    for r in sorted(state.collect(), key=lambda r: r["key"], reverse=True):
        left -= len(r["value"]) + len(r["key"]) + kv.ENTRY_BYTES
        if left < 0:
            break
        want.add(r["key"])
    assert {r["key"] for r in kv.evicted(state, 5000).collect()} == want and want
    assert kv.evicted(state.where("false"), 10).count() == 0


def test_scan_pages_share_names(spark):
    """One name in several databases at a page's end."""
    state = spark.createDataFrame([(d, k, "v", None) for d in range(3) for k in "ab"], "db int, key string, value string, expires_at bigint")
    seen, after = [], None
    while page := kv.scan_page(state, after, 2, 0).collect():
        seen += [(r["key"], r["db"]) for r in page]
        after = seen[-1]
    assert seen == sorted((k, d) for d in range(3) for k in "ab")


def test_intermediates_are_released(spark):
    from tarn.plans import durable

    folder = durable.shared_dir(spark).removeprefix("file:")
    durable.release(spark)
    before = len(os.listdir(folder))
    durable.durable(spark.range(3), "x")
    assert len(os.listdir(folder)) == before + 1 and durable.release(spark) == 1 and len(os.listdir(folder)) == before
