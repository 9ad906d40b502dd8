"""Intermediate tables on the shared folder of the cluster.

A result that several later jobs read (for instance a de-duplicated table that is first
measured and then changed) is written once as Parquet, so that later scans prune columns
and a lost executor costs a re-read instead of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this driver and not dropped yet.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session may do without."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="convlens-"))
    return context.getCheckpointDir()


def stage(t: DataFrame, label: str) -> DataFrame:
    """Write the table to the shared folder and read it back."""
    spark = t.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    t.write.parquet(path)
    _written.append(path)
    # the shuffles behind the table are done with; Spark deletes their files once the driver's JVM has
    # collected what refers to them, which a large heap puts off for long
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(t.schema).parquet(path)


def staged() -> list[str]:
    """Paths of the tables staged so far."""
    return list(_written)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; nothing may read them any more."""
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written:
            _written.remove(path)
