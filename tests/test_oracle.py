"""Every query with SQL against its DuckDB oracle (sf0.001): row
count, column names and types, exact order-insensitive values — the driver's
correctness gate, run locally."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest, family

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    s_rows, o_rows = [tuple(r) for r in df.collect()], rel.fetchall()
    assert len(s_rows) == len(o_rows)
    assert sorted(df.columns) == sorted(rel.columns)
    s_types = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    o_types = {c: family(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert s_types == o_types
    assert digest(s_rows, df.columns)[0] == digest(o_rows, list(rel.columns))[0]
