"""Intermediate tables for operators that work in rounds.

A round's table is written below ``spark.checkpoint.dir`` and read again, so plans stay small and a lost executor
costs a re-read. Where that setting is absent a folder of this machine stands in, but only on a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        _own[app] = f"{base.rstrip('/')}/rounds-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _own[app]


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder, as a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
