"""Each query against its SQL in DuckDB, on whole small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert ours == theirs
    assert ours


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 500


@pytest.mark.parametrize("name", ["cluster_stream", "cluster_leader"])
def test_classes_beyond_a_thousand_rows(spark, duck, tmp_path, name):
    import numpy as np

    rng = np.random.default_rng(4)
    z = rng.normal(size=(1300, 64))
    z = (z / np.linalg.norm(z, axis=1)[:, None]).astype("float32").tolist()
    rows = spark.createDataFrame([(i, v, i % 7 // 6) for i, v in enumerate(z)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = SQL["cluster_stream"] if name == "cluster_stream" else SQL["cluster_stream"].replace('"label" as src', "0 as src")
    want = sorted(tuple(plain(v) for v in r) for r in c.sql(sql).fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
