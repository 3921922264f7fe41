"""The corpus pipeline stage by stage, and the SQL of registered queries."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute
from engines import duck, same

import corpus_pipeline
from pagelith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), queries.ORACLES[name], duck(data))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, found[-1], data)
        found.append(spark.createDataFrame(df.collect(), df.schema))
    rows = [{r.doc_id: r for r in f.collect()} for f in found[:5]]
    assert all(f.columns == columns for f in found[:5])
    assert set(rows[1]) <= set(rows[0]) and all(rows[1][d] == rows[0][d] for d in rows[1])
    assert all(brute.base_statistics(r.text)[0] >= 50 for r in rows[1].values())
    lines = brute.lines_dedup([tuple(r) for r in rows[1].values()], 40, 5)
    assert {d: (r.text, r.n_chars) for d, r in rows[2].items()} == {d: (t, len(t)) for d, (_, _, t) in lines.items()}
    groups = brute.near([tuple(r) for r in rows[2].values()])
    assert set(rows[3]) == {d for d, (root, _, _) in groups.items() if root == d}
    clean = lambda t: " ".join("".join(c for c in t.lower() if c.isalnum() or c.isspace()).split())
    items = [clean(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(rows[4]) == {d for d, r in rows[3].items() if not any(f" {i} " in f" {clean(r.text)} " for i in items)}
    assert {r.doc_id for r in found[5].collect()} == set(rows[4])


def test_run_gives_the_stages_result(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_empty_and_null_documents(spark, data):
    docs = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], brute.SCHEMA)
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, data).count() <= 3
