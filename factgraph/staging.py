"""Tables and files between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch handed to Python.
BYTES_PER_BATCH = 8 << 20

_OWN_DIR: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset and all work is done on this machine, under a temporary folder; on a cluster it has to be set."""
    app = spark.sparkContext.applicationId
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        where = f"file://{_OWN_DIR[app]}"
    path = f"{where.rstrip('/')}/factgraph/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(app, []).append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: cuts its lineage and survives lost executors."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; called by operators that hand wide rows to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def drop_staged(spark: SparkSession) -> int:
    """Delete what this application has staged, once no result that reads it is needed any more; the number of folders."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        drop(spark, path)
    return len(made)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders ``<name>=n`` in ``path``, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(f[len(name) + 1 :]) for f in found if f.startswith(f"{name}="))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
