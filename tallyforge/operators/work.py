"""Work tables in the folder that all machines share: they cut a loop's lineage, so that a lost executor repeats one read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir of the session; a local one of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/tallyforge/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a loop's plan stays short."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing will read again."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.work_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
