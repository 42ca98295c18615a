"""Lists as rows: list_items(db, key, pos, value), ordered by pos within a key; positions need not be dense."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import numbered

KEY = ["db", "key"]


def pushed(pushes: DataFrame) -> DataFrame:
    """Lists after pushes (seq, db, key, side, value): a push to the left goes before all, to the right behind all, so a
    row's own sequence number, negated on the left, is its position. Nothing is sorted or shuffled."""
    return pushes.select(*KEY, F.when(F.col("side") == "L", -F.col("seq")).otherwise(F.col("seq")).cast("long").alias("pos"), "value")


def placed(items: DataFrame) -> DataFrame:
    """items with index (from the head, 0 first) and size of their list."""
    return numbered(items, KEY, [F.col("pos")], "index").join(items.groupBy(*KEY).agg(F.count("*").alias("size")), KEY)


def lengths(items: DataFrame) -> DataFrame:
    return items.groupBy(*KEY).agg(F.count("*").alias("n"))


def popped(items: DataFrame, n: int = 1, side: str = "L") -> tuple[DataFrame, DataFrame]:
    """(what comes off the given end of each list, at most n each, in order of nth; the lists without it)."""
    rows = numbered(items, KEY, [F.col("pos") if side == "L" else F.desc("pos")], "nth")
    return rows.where(F.col("nth") < n), rows.where(F.col("nth") >= n).drop("nth")


def at_index(items: DataFrame, index: int) -> DataFrame:
    """Per list the item at an index; lists that don't reach that far are left out."""
    rows = placed(items)
    return rows.where(F.col("index") == (F.lit(index) if index >= 0 else F.col("size") + index)).select(*KEY, "value")


def in_range(items: DataFrame, start: int, stop: int) -> DataFrame:
    """Items from start to stop, both included, clamped to the list, with their index."""
    end = lambda i: F.lit(i) if i >= 0 else F.col("size") + i
    return placed(items).where((F.col("index") >= end(start)) & (F.col("index") <= end(stop))).select(*KEY, "index", "value")


def replaced(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Lists after changes (db, key, at, new), at most one per place; a place out of range is left alone (`out_of_range` names it)."""
    rows = placed(items)
    changes = changes.join(lengths(items), KEY).select(*KEY, F.when(F.col("at") < 0, F.col("at") + F.col("n")).otherwise(F.col("at")).alias("index"), "new", F.lit(True).alias("_hit"))
    return rows.join(changes, [*KEY, "index"], "left").select(*KEY, "pos", F.when(F.col("_hit"), F.col("new")).otherwise(F.col("value")).alias("value"))


def out_of_range(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Of changes (db, key, at, new) those that `replaced` cannot make, with the error: no such list, or no such place in it."""
    met = changes.join(lengths(items), KEY, "left")
    fits = (F.col("at") < F.col("n")) & (F.col("at") >= -F.col("n"))
    error = F.when(F.col("n").isNull(), "ERR no such key").when(~fits, "ERR index out of range")
    return met.select(*KEY, "at", error.alias("error")).where("error is not null")


def removed(items: DataFrame, value: str, count: int = 0) -> DataFrame:
    """Lists without `value`: its first count occurrences from the head, from the tail if count < 0, all if 0."""
    if count == 0:
        return items.where(~F.col("value").eqNullSafe(F.lit(value)))
    hit = F.col("value").eqNullSafe(F.lit(value))
    matching = numbered(items.where(hit), KEY, [F.col("pos") if count > 0 else F.desc("pos")], "_nth")
    return items.where(~hit).unionByName(matching.where(F.col("_nth") >= abs(count)).drop("_nth"))


def as_arrays(items: DataFrame) -> DataFrame:
    """One array per list, for lists that fit a row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x.value)
    return items.groupBy(*KEY).agg(ordered.alias("items"))


def trimmed_to_last(items: DataFrame, n: int) -> DataFrame:
    """The n items nearest each list's tail, as a window: what a bounded log keeps."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("pos"))
    return items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
