"""Corpus queries against their SQL twins, the pipeline's stages, and the package without its corpus operators."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import decontaminate, mixing, queries
from plumbline.llm.common import documents
from test_catalog import canonical
from test_operators import listed, plain_components

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    result = con.execute(queries.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in result.description], result.fetchall())


def test_stages(spark, sf):
    docs = documents(spark, sf)
    good = corpus_pipeline.good_quality(spark, docs, sf)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum((d in kept) == bool(q) for d, q in labels.items()) > 0.95 * len(labels)
    single = corpus_pipeline.without_near_copies(spark, docs, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in plain_components(rows)})
    clean = corpus_pipeline.without_benchmark(spark, docs, sf)
    assert decontaminate.find_matches(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    mixed = corpus_pipeline.mixed(spark, docs, sf)
    assert listed(mixed.groupBy("doc_id").count()) == listed(mixing.schedule(docs).selectExpr("doc", "cast(size(finishes) as long) n").where("n > 0"))
    for df in (good, single, clean, mixed):
        assert df.columns == docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("plumbline", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "plumbline" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'column_profile' in q and 'pipeline' not in q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
