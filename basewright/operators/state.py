"""Reliable checkpoints between driver-side steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one in local mode; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = sc.getConf().get("spark.checkpoint.dir", None)
        if not own and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df from a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """df from a table in the shared warehouse, dealt to buckets by keys: joins by these keys with other such tables of as many buckets
    need no exchange. The table stays for the session's catalog; dropped() drops it."""
    name = f"stored_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name).alias(name)


def dropped(spark: SparkSession) -> int:
    """Drop all tables that stored() has made in this session's catalog; how many."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("stored_") and not t.isTemporary]
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return len(names)
