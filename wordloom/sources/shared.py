"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session, as in tests, has a temporary folder; on a cluster that is an error, as executors would not see it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt to tasks of so many rows, by the columns if there are any; df, which is counted, should be cheap to read.

    Spark sizes tasks by bytes, and so gives a table of short rows to few, however long the work on each row takes.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *by)


_kept: dict[tuple, tuple[str, object]] = {}


def kept(spark: SparkSession, name: str, d: str, tables: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once for a session and what it is made of: the tables of the folder d, as their files are now.

    Several queries over one folder then share the work. A table that has gone, or whose input has changed, is made again.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def state(path: str) -> tuple:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf)
        return tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(at)) if files.exists(at) else ()

    key = (spark.sparkContext.applicationId, name, d, *(state(f"{d}/{t}.parquet") for t in tables))
    if key in _kept and state(f"{_kept[key][0]}/_SUCCESS"):
        path, schema = _kept[key]
        return spark.read.schema(schema).parquet(path)
    rows, path = make(), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _kept[key] = (path, rows.schema)
    return spark.read.schema(rows.schema).parquet(path)
