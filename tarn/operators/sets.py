"""Sets as rows: set_members(db, key, member), distinct; and algebra over named sets, for one or many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import dealt

KEY, MEMBER = ["db", "key"], ["db", "key", "member"]


def added(members: DataFrame, new: DataFrame, rows: int | None = None) -> DataFrame:
    """members and new, each once. rows: about how many they are together, counted if it isn't given."""
    both = members.select(*MEMBER).unionByName(new.select(*MEMBER))
    return dealt(both, MEMBER, both.count() if rows is None else rows).distinct()


def without(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select(*MEMBER).distinct(), MEMBER, "left_anti")


def is_member(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, db, key, member) -> with found (boolean)."""
    return wanted.join(members.select(*MEMBER, F.lit(True).alias("_f")), MEMBER, "left").select("pos", *MEMBER, F.coalesce("_f", F.lit(False)).alias("found"))


def of(members: DataFrame, keys: DataFrame) -> DataFrame:
    """Members of the sets asked for (db, key); a set that isn't there has none."""
    return members.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*MEMBER)


def cardinalities(members: DataFrame) -> DataFrame:
    return members.groupBy(*KEY).agg(F.count("*").alias("n"))


def combined(members: DataFrame, requests: DataFrame, how: str) -> DataFrame:
    """requests (request, nth, db, key), nth from 0 -> (request, member) of their union, intersection or difference.

    A key that isn't there is the empty set; a key named twice counts once in an intersection. All requests are one join
    and one aggregation whose state is a pair of counts, so large sets cost no memory.
    """
    named = requests.groupBy("request", *KEY).agg(F.min("nth").alias("nth"))
    met = named.join(members, KEY).groupBy("request", "member").agg(F.count("*").alias("_n"), F.min("nth").alias("_first"))
    if how == "union":
        return met.select("request", "member")
    if how == "inter":
        n = named.groupBy("request").agg(F.count("*").alias("_all"))
        return met.join(n, "request").where("_n = _all").select("request", "member")
    if how == "diff":
        # the first key again among the rest takes everything away
        again = requests.groupBy("request", *KEY).agg(F.min("nth").alias("_a"), F.max("nth").alias("_b")).where("_a = 0 and _b > 0").select("request")
        return met.where("_first = 0 and _n = 1").join(again, "request", "left_anti").select("request", "member")
    raise ValueError(how)
