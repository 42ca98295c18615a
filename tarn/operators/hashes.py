"""Hashes as rows: hash_fields(db, key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, FIELD = ["db", "key"], ["db", "key", "field"]


def written(log: DataFrame) -> DataFrame:
    """Fields after a log (seq, db, key, field, value) in which the last write of a field wins; a null value deletes it."""
    last = log.groupBy(*FIELD).agg(F.max_by(F.struct("value"), "seq").alias("w"))
    return last.select(*FIELD, F.col("w.value").alias("value")).where("value is not null")


def new_fields(fields: DataFrame, writes: DataFrame) -> DataFrame:
    """Per key how many of the written fields (db, key, field) were not there before."""
    return writes.select(*FIELD).distinct().join(fields.select(*FIELD), FIELD, "left_anti").groupBy(*KEY).agg(F.count("*").alias("n"))


def get(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, db, key, field) -> with value, null where there is none."""
    return wanted.join(fields, FIELD, "left").select("pos", *FIELD, "value")


def exists(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, db, key, field) -> with found (boolean)."""
    return wanted.join(fields.select(*FIELD, F.lit(True).alias("_f")), FIELD, "left").select("pos", *FIELD, F.coalesce("_f", F.lit(False)).alias("found"))


def field_names(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Field names of the hashes asked for (db, key)."""
    return fields.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*FIELD)


def field_values(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of the hashes asked for (db, key), as often as fields have them."""
    return fields.join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "value")


def deleted(fields: DataFrame, gone: DataFrame) -> DataFrame:
    """Fields without those of gone (db, key, field); a hash without fields is no hash, as it has no rows."""
    return fields.join(gone.select(*FIELD).distinct(), FIELD, "left_anti")


def sizes(fields: DataFrame) -> DataFrame:
    return fields.groupBy(*KEY).agg(F.count("*").alias("n"))


def not_integers(fields: DataFrame, deltas: DataFrame) -> DataFrame:
    """Of deltas (db, key, field, delta) those that `incremented` cannot add: their field holds what is no integer, or the sum leaves the range."""
    number = F.expr("try_cast(value as bigint)")
    met = deltas.select(*FIELD, "delta").join(fields, FIELD)
    return met.where(number.isNull() | F.try_add(number, F.col("delta")).isNull()).select(*FIELD, "delta", F.lit("ERR hash value is not an integer").alias("error"))


def incremented(fields: DataFrame, deltas: DataFrame) -> DataFrame:
    """Fields after deltas (db, key, field, delta) are added; a missing field starts at 0, one that isn't an integer stays
    (`not_integers` names it)."""
    sums = deltas.groupBy(*FIELD).agg(F.sum("delta").alias("_d"))
    total = F.try_add(F.expr("try_cast(coalesce(value, '0') as bigint)"), F.col("_d")).cast("string")
    return fields.join(sums, FIELD, "full").select(*FIELD, F.when(F.col("_d").isNull(), F.col("value")).otherwise(F.coalesce(total, F.col("value"))).alias("value"))


def as_maps(fields: DataFrame) -> DataFrame:
    """One map per hash, for hashes that fit a row."""
    return fields.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
