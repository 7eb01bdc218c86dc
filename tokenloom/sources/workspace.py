"""Folders for stage tables: under the cluster's shared checkpoint folder when it names one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, below `spark.checkpoint.dir`. Where that is unset, a local session (as in tests)
    gets a fresh temporary folder; on a cluster, whose machines could not read it, this is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Stage tables by application that `discard` has not removed.
WRITTEN: dict[str, set[str]] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a stage table and read it back: cuts lineage, survives executor loss, and gives later
    passes a scan that prunes columns. `sweep` removes what is left of them at the end of a job."""
    path = new_folder(df.sparkSession, label)
    WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stages: DataFrame) -> None:
    """Remove stage tables whose readers are done."""
    for df in stages:
        spark = df.sparkSession
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _remove(spark, name)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> int:
    """Remove the stage tables that this application has written and not yet discarded; how many there were. For the end
    of a job, when its results are written: DataFrames that read a stage table cannot be used afterwards."""
    left = WRITTEN.pop(spark.sparkContext.applicationId, set())
    for path in left:
        _remove(spark, path)
    return len(left)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a scan over all cores when it has fewer tasks than there are cores, as with one
    file of a single row group. A scan of many splits is left alone, so large tables never shuffle here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
