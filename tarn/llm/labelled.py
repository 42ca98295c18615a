"""Bounded samples of labelled documents, and the split that keeps test documents out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this document must not be learned from; true for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Characters of the longest text that is learned from, which bounds what a sample takes on the driver.
LONGEST_LEARNED = 200_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most `per_class` labelled documents of either class, in the order of a hash of their ids.

    Labels of held-out documents, null labels, and ids that are labelled both ways are left out, as are texts of over
    `LONGEST_LEARNED` characters (they are scored like others).
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    known = known.withColumn("order", F.xxhash64("doc_id"))
    chosen = known.where("label = 0").orderBy("order").limit(per_class).unionByName(known.where("label = 1").orderBy("order").limit(per_class))
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST_LEARNED).join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
    rows = rows.groupBy("doc_id").agg(F.first("order").alias("order"), F.first("label").alias("label"), F.min("text").alias("text"))
    return [(r["text"] or "", int(r["label"])) for r in rows.orderBy("order", "doc_id").collect()]


def shares(labels: DataFrame, label: str) -> dict[int, float]:
    """How the labels that may be learned from split into 0 and 1, over all of them."""
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(label).count().collect()  # two rows
    total = sum(r["count"] for r in rows)
    return {int(r[label]): r["count"] / total for r in rows}
