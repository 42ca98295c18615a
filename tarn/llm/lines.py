"""Line dedup by distinct-site spread, on DataFrame functions alone.

Every line's hash gets a HyperLogLog sketch of the sites (sources) it stands on; the sketches are built per partition and
merged by aggregation, so no line's rows are gathered. Estimates well above or below the threshold decide; lines with an
estimate near it get an exact distinct count. A line that is spread over enough sites is boilerplate: all but its first
occurrence go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WHITE, durable, id_or_last, small

MIN_SITES = 8
#: Estimates within this fraction of the threshold are near it; the sketches' standard error is about a quarter of that.
NEAR = 0.4
LG_K = 8
#: Parts that the documents of one line are dealt to when they meet the list of boilerplate lines.
SALTS = 32


def line_rows(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per line with something on it: id (nulls last), doc (hash of the text), pos, site ('' for null), hash of the trimmed line."""
    rows = docs.select(id_or_last(doc_id).alias("id"), F.xxhash64(text).alias("doc"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    bare = F.btrim("line", F.lit(WHITE))
    return rows.where(bare != "").select("id", "doc", "pos", "site", F.xxhash64(bare).alias("hash"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """hash and first (struct of id, pos and doc) of every line that stands on `min_sites` sites or more."""
    spread = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("id", "pos", "doc")).alias("first"))
    spread = spread.where(F.col("sites") >= min_sites * (1 - NEAR)).select("hash", "first", (F.col("sites") <= min_sites * (1 + NEAR)).alias("near"))
    spread = durable(spread, "spread")
    near = spread.where("near").select("hash", "first")
    # a line's sites are made distinct before the shuffle
    exact = lines.join(small(near.select("hash")), "hash", "left_semi").groupBy("hash", "site").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where("not near").select("hash", "first").unionByName(near.join(exact.select("hash"), "hash", "left_semi"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", counts: bool = True) -> DataFrame:
    """docs with `text` less its repeated boilerplate lines, and after all columns of docs n_lines and n_removed.

    A line is what newlines part; lines are equal if they are so without white space at their ends; blank lines are never
    boilerplate. The first occurrence (least id, then place) of a boilerplate line stays. A null site is a site of its
    own; a null id comes last; a null text has no lines and stays null. Rows that share an id and a text are taken
    for the same document; others that share an id, or have none, are documents of their own. An empty table gives an
    empty one. Columns of docs stay, whatever their names, but those that are named like the added ones are replaced;
    without `counts` none are added.
    """
    lines = line_rows(docs, text, site, doc_id)
    spread = durable(boilerplate(lines, min_sites), "boilerplate")
    n = spread.count()
    if n > BROADCAST_ROWS:  # a shuffled join: a hot line's rows are dealt to SALTS tasks
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("id", "doc"), F.lit(SALTS)))
        met = lines.join(spread.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS))))), ["hash", "salt"])
    else:
        met = lines.join(small(spread, n), "hash")
    gone = (
        met.where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")) | (F.col("doc") != F.col("first.doc")))
        .groupBy(F.col("id").alias("_id"), F.col("doc").alias("_doc"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    )
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    # the text goes as its lines, the other columns as one struct that no name of theirs can clash with
    every = F.split(F.col(text), "\n", -1)
    joined = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns if c != text)).alias("_row"), every.alias("_lines"), id_or_last(doc_id).alias("_id"), F.xxhash64(text).alias("_doc")
    ).join(gone, ["_id", "_doc"], "left")
    # what stands between two removed lines is a slice: all slices together are one pass over the lines
    between = lambda i: F.slice("_lines", F.coalesce(F.get("_gone", i - 1) + 1, F.lit(0)) + 1, F.coalesce(F.get("_gone", i), F.size("_lines")) - F.coalesce(F.get("_gone", i - 1) + 1, F.lit(0)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), between))
    left = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept), "\n")
    blank = F.col("_lines").isNull() | ((F.size("_lines") == 1) & (F.get("_lines", F.lit(0)) == ""))
    added = [F.when(blank, 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*(left.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns), *(added if counts else ()))
