"""Every query against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from basewright import queries as base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "pages", "lineitem", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_equals_sql(spark, con, name):
    a, b = base.queries()[name](spark, DATA).toPandas(), con.execute(base.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: Counter(map(tuple, d[sorted(d.columns)].astype(object).values.tolist()))
    assert rows(a) == rows(b)


def test_acc_solve_meets_neighbours_beyond_a_chunk(spark, tmp_path):
    """All edges count: a cluster's light reaches those of other chunks, and many clusters of one pixel are no trouble."""
    import numpy as np

    n = 700
    rng = np.random.default_rng(2)
    spark.createDataFrame([(v, [float(x) for x in rng.normal(0, 0.2, 64)], 0) for v in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = np.arange(n)
    x, y = (v * v * 31 + v * 7919) % 499, (v * v * 17 + v * 10473) % 97
    near = (abs(x[:, None] - x) <= 4) & (abs(y[:, None] - y) <= 4) & (v[:, None] != v)
    z = np.array([r.v for r in base.signals(spark, str(tmp_path)).selectExpr("cluster", "signal[0][0] AS v").orderBy("cluster").collect()])
    want = np.linalg.solve(np.eye(n) + near * ((v[:, None] * 7 + v * 3) % 10 / 100), z)
    got = {r.cluster: r.v for r in base.queries()["acc_solve"](spark, str(tmp_path)).collect()}
    assert len(got) == n and max(abs(got[k] - want[k]) for k in range(n)) < 2e-6
