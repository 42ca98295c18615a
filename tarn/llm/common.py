"""What the corpus operators share: reading tables, ids, hashing in numpy."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import BROADCAST_ROWS, durable, hinted

__all__ = ["BROADCAST_ROWS", "NULL_ID", "WHITE", "WORD_GAP", "durable", "id_or_last", "id_or_null", "lean", "mix32", "mix64", "small", "table", "texts_of"]

#: Stands for a null id wherever ids are compared or joined; such rows sort last.
NULL_ID = 2**63 - 1
#: The white space that separates words, as a pattern and as the characters themselves.
WORD_GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_or_null(column):
    return F.when(column != NULL_ID, column)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column of an Arrow batch as strings; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or "" for x in column.to_pylist()]


def lean(run):
    """A function for mapInArrow that hands freed memory back to the system when its task ends.

    Spark keeps Python workers for later tasks, so what a worker still holds is taken from whatever runs next beside it.
    """

    @functools.wraps(run)
    def then_freed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # there with glibc alone
                trim(0)

    return then_freed


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with full avalanche (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit integers with full avalanche."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (narrow, already durable) marked for broadcast if it has few rows; else as it is, for a shuffled join."""
    return hinted(df, df.count() if rows is None else rows)
