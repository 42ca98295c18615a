"""A corpus from raw documents to packed sequences: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents, whatever further columns there are and whatever their names. Their results are written as Parquet and read again
in between. An empty table gives an empty one in every stage. Rows that share an id, or have none, are documents of their
own, each judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import lines, minhash, packing, pii, registry, rules
from tarn.llm.common import durable, table


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as its text has them now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the surface rules or are far from their language go.

    A null or empty text has no words and goes; a null language is compared with all others of no known language; repeated
    rows are judged alike.
    """
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first occurrence (least id, nulls last, then place).

    A null text stays null and an empty one empty; a null source is a site of its own; n_chars follows the text.
    """
    return measured(lines.drop_boilerplate(docs, counts=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more), the one with the least id.

    Null and wordless texts are nobody's duplicates and stay; of rows with equal id and text one stays.
    """
    return minhash.keep_first(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null and empty texts stay as they are, and n_chars follows the text."""
    return measured(pii.mask(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences, one row per piece; a null or empty text is the end token alone."""
    return packing.pack_documents(docs, registry.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: Signatures, a trained classifier and the packing plan are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
