"""The registered queries against their SQL, and the pipeline against its stages' meaning."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from conftest import dicts
from sprintloom.llm.queries import ORACLE, QUERIES
from sprintloom.llm.simhash import near_duplicates

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert check.rows([tuple(r) for r in frame.collect()], frame.columns) == check.rows(result.fetchall(), columns)


def test_numbers():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 !", "en", "s", 4), (9003, "the of and to that", "en", "s", 18)], given.schema)
    docs = given.union(odd)
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == given.columns
        left.append({r["doc_id"]: r["text"] for r in dicts(docs)})
    texts = {r["doc_id"]: r["text"] for r in dicts(given.union(odd))}
    language, exact, near, clean = left
    assert set(texts) - set(language) == {9001, 9002}
    last = {}
    for i, t in language.items():
        last[t] = max(i, last.get(t, i))
    assert set(exact) == set(last.values())
    component = {r["doc_id"]: r["component_id"] for r in dicts(near_duplicates(given.union(odd).filter(F.col("doc_id").isin(list(exact)))))}
    assert set(near) == set(component.values())
    items = [r["text"] for r in dicts(spark.read.parquet(f"{FOLDER}/benchmark.parquet"))]
    assert set(near) - set(clean) == {i for i, t in near.items() if any(x in t for x in items)}
    packed = dicts(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER))
    assert {r["doc_id"] for r in packed} == set(clean)


def test_pipeline_names():
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "simhash", "benchmark", "packing"]
