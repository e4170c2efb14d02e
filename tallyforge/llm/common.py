"""Shared helpers of the training-data operators: tables, work tables and word splitting."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode (tests) one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/tallyforge/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, so a lost executor repeats one read only.

    The table stays until the application's folder is removed, because results that are not read yet depend on it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing will read again."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.work_path
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of one Arrow batch, so that a Python worker holds few whole texts at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        text = (spark.conf.get(key) or "0").lower()
        now = int(text) if text.lstrip("-").isdigit() else most + 1
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory it no longer uses back to the system when a task ends, as workers live on between tasks."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return go


#: Columns of documents that operators read by name.
OWN = ("doc_id", "text", "source", "lang", "n_chars")


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that keeps all columns of its documents, whatever the others are called: it sees them under names that clash with nothing."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        plain = [c if c in OWN else f"other_{i}" for i, c in enumerate(docs.columns)]
        return stage(docs.toDF(*plain), *args, **more).toDF(*docs.columns)

    return run


def text_of(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(column: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(column, SPACE, " ")


def words_of(column: Column) -> Column:
    """The array of words; empty for a text without words."""
    return F.filter(F.split(column, SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
