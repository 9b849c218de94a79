"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation of the steps
before.  Where the session names no folder (tests on one machine) a default is used.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI: ``spark.checkpoint.dir``, or a default where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or LOCAL_DEFAULT
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder name under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/seasonlark/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as a table scan."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps (it does so when the JVM collects)."""
    for pause in (0.5, 1.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/seasonlark/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(hconf).delete(path, True)
