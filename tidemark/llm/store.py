"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs a re-read and nothing else. Where that setting is absent a fresh local folder stands
in for it, but only on a local master (tests); elsewhere its absence is an error. What is written lives until the application ends, since
results are lazy, or until ``discard`` is called on a table that a later one replaces.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a temporary one where none is set."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        _own[app] = f"{base.rstrip('/')}/tidemark-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _own[app]


@contextmanager
def batches_of(spark: SparkSession, most: int | None):
    """Within it, Arrow functions get about so many bytes at a time where they are run."""
    before = spark.conf.get(BATCH_SETTING, None)
    if most is not None:
        spark.conf.set(BATCH_SETTING, str(most))
    try:
        yield
    finally:
        if most is not None and before is None:
            spark.conf.unset(BATCH_SETTING)
        elif most is not None:
            spark.conf.set(BATCH_SETTING, before)


def save(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and return a reader of what was written.

    batch_bytes: about how much the Arrow functions in df get at a time, or one longer row. By default
    batches have ten thousand rows, which for texts are tens of megabytes on both sides of the worker's pipe.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch_bytes):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing lazy reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._tidemark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(column: Column) -> Column:
    """The same value, in a form through which no filter is pushed down.

    A filter on a computed column is else pushed to the scan with every expression below it copied into it,
    once for each use, which for stacked array expressions doubles at every level. The optimizer takes
    this condition, which always holds, for non-deterministic and keeps the filter where it stands.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)
