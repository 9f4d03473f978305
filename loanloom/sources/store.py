"""Where derived tables are written: under the directory the cluster names for checkpoints.

A job that is read many times, or that must not be recomputed, goes to a Parquet table in
shared storage, so that losing executors costs only the running tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


@cache
def _local_dir() -> str:
    """One temporary folder for a local run."""
    return tempfile.mkdtemp(prefix="loanloom-")


def shared_dir(spark: SparkSession) -> str:
    """The shared directory for derived tables."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_dir()
    raise ValueError(f"set {CHECKPOINT_SETTING} to a directory all executors can reach")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared directory."""
    return f"{shared_dir(spark)}/loanloom/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path no earlier run has used."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame, name: str, partition_by: str | None = None, spread: bool = True) -> DataFrame:
    """Write the frame once as Parquet and read it back with the same schema.

    With ``partition_by``, filters on that column choose files; the rebalance gives each value
    few files, and large values several. Without ``spread`` there is none: no row is shuffled for the write,
    and each task writes a file per value it has.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    if partition_by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    rows = df.hint("rebalance", partition_by) if spread else df
    rows.write.partitionBy(partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def remove_stored(spark: SparkSession) -> bool:
    """Delete what this application has stored; frames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files below the paths, to notice that an input has changed."""
    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in files.listStatus(path):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
