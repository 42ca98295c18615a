"""Registered queries against their SQL, the pipeline's stages against brute force, and independence of the rest."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from tarn.llm import minhash, registry


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, sf_dir)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    tidy = lambda names, rows: sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert tidy(df.columns, df.collect()) == tidy(columns, found.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.durable(stage(spark, before, sf_dir), name)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality_rules":
            verdict = {r["doc_id"] for r in registry.op7_rules(spark, sf_dir).where("kept").collect()}
            assert ids == verdict
        if name == "near_dedup":
            from test_dedup import near_truth

            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert ids == {r[0] for r in near_truth(rows, 5, 80) if r[3]}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    strip = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(whole) == strip(last) and {r["doc_id"] for r in whole} == ids


def test_pipeline_of_odd_rows(spark, make_docs, odd):
    for docs in (make_docs(*odd), make_docs()):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_near_dedup_keeps_one_of_each(spark, make_docs):
    words = " ".join(f"w{i}" for i in range(60))
    kept = minhash.keep_first(make_docs((3, words), (1, words + " more"), (2, "other " * 3), (4, None), (5, None)), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_the_rest_does_without(tmp_path):
    """Without the corpus operators the entry points import and keep the other queries."""
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tarn.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "graph_traverse" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
