"""Table functions in SQL against the DataFrame functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import frame, simulated

from basewright import sql
from basewright.functions import expr as E
from basewright.operators import estimate, spatial


@pytest.fixture(scope="module")
def signals(spark):
    d = frame(spark, simulated(90, 12, 3)[1], "t").unionByName(frame(spark, simulated(40, 12, 4)[1], "u"))
    sql.registered(spark)
    d.createOrReplaceTempView("signals")
    return d


def same(a, b, digits=9):
    rows = lambda d: {(r.tile, r.end_id, r.cluster): np.round(r.signal, digits).tolist() for r in d.collect()}
    x, y = rows(a), rows(b)
    return x == y and len(x) > 0


def test_basecall(spark, signals):
    got = {(r.tile, r.cluster): r.seq for r in spark.sql("SELECT * FROM basecall(TABLE(signals) PARTITION BY tile)").collect()}
    want = signals.select("tile", "cluster", F.array_join(F.transform("signal", lambda v: E.base(E.call(v))), "").alias("seq")).collect()
    assert got == {(r.tile, r.cluster): r.seq for r in want} and len(got) == 130
    assert spark.sql("SELECT count(DISTINCT seq) > 1 AS many FROM basecall(TABLE(SELECT * FROM signals WHERE cluster < 20))").first().many


def test_deconvolve(spark, signals):
    sql.chunked_view(signals, "chunked", 30)
    got = spark.sql("SELECT * FROM deconvolve(TABLE(chunked) PARTITION BY (tile, end_id) ORDER BY (chunk, cluster))")
    assert same(got, estimate.basecall(signals, most=30))


def test_correct(spark, signals):
    loc = spark.createDataFrame([(t, i, float(i * 7 % 400), float(i * 3 % 30)) for t, n in (("t", 90), ("u", 40)) for i in range(n)], "tile string, cluster int, x double, y double")
    sql.striped_view(signals, loc, "striped")
    got = spark.sql("SELECT * FROM correct(TABLE(striped) PARTITION BY (tile, end_id, stripe))")
    assert same(got, spatial.correct_acc(signals, signals, loc))


def test_files_in_sql(spark, tmp_path):
    from basewright.sources import formats
    v = np.arange(-24, 24).reshape(3, 4, 4)
    (tmp_path / "a.cif").write_bytes(formats.cif_bytes(v))
    sql.registered(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW raw USING intensities OPTIONS (path '{tmp_path}', layout 'cycles')")
    got = spark.sql("SELECT cluster, v FROM raw WHERE cycle = 2 AND cluster >= 2").collect()
    assert sorted((r.cluster, r.v) for r in got) == [(c, v[1, :, c].tolist()) for c in (2, 3)]
