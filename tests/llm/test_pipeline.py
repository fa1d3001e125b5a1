"""The pipeline, stage by stage, and the SQL of the queries that have one."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from feira.llm import decontaminate, near_dup, quality
from feira.llm._store import scratch
from feira.llm.oracle import ORACLE
from feira.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, f"test-{name}")
        stage(spark, docs, sf_small).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_remove_rows(stages):
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    for name, (before, after) in stages.items():
        assert ids(after) <= ids(before) and after.count() == len(ids(after)) > 0
        if name != "mixing":
            assert after.columns == before.columns


def test_each_stage_equals_its_operator(spark, sf_small, stages):
    before, after = stages["quality"]
    assert ids(after) == ids(quality.quality(before).filter("kept"))
    before, after = stages["near_duplicates"]
    assert ids(after) == ids(near_dup.near_duplicates(before).filter("is_kept"))
    before, after = stages["decontamination"]
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    assert ids(after) == ids(before) - ids(decontaminate.matches(before, bench))


def test_labelled_toxic_documents_go_and_others_stay(spark, sf_small, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    clean = [d for d in ids(before) if labels.get(d) == 0]
    assert sum(d in ids(after) for d in clean) >= 0.98 * len(clean)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, sf_small, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_small}/{table}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, sf_small).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = got[order].sort_values(order).reset_index(drop=True)
    b = want[order].sort_values(order).reset_index(drop=True)
    for c in order:
        assert (a[c] == b[c]).all(), c
