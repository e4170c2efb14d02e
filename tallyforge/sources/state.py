"""What a run knew of a project, for the next one: versions of a few tables, of which a pointer names the one that counts.

A version is written whole under a name of its own, and then the pointer is replaced by a rename, so that a run that is
lost leaves the last state as it was, and readers of the old one are not disturbed. The version before the last stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyforge.sources.extract import ENDINGS

#: Version of the stored tables, and of the readers whose facts they hold: another one makes every record a miss.
SCHEMA, READERS = 1, "3"
VERSION = ("schema", "readers", "sha256", "context", "scope")


class StateStore:
    """Named tables of the last run of one project under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointer = f"{self.folder}/CURRENT"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The name of the version that counts."""
        if not self._fs().exists(self._path(self.pointer)):
            return None
        rows = self.spark.read.text(self.pointer).limit(1).collect()
        return rows[0]["value"].strip() or None if rows else None

    def read(self, *names: str) -> dict[str, DataFrame] | None:
        """The tables of the version that counts; None without one, or if it is broken: the run then starts anew."""
        version = self.version()
        if version is None:
            return None
        try:
            found = {n: self.spark.read.parquet(f"{self.folder}/{version}/{n}") for n in names}
            if any("schema" in df.columns and df.filter(~F.col("schema").eqNullSafe(F.lit(SCHEMA))).limit(1).count() for df in found.values()):
                return None
            return found
        except (AnalysisException, Exception) as broken:  # noqa: B014  (Spark's and py4j's errors)
            if isinstance(broken, KeyboardInterrupt):
                raise
            return None

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Store tables as the version that counts from now on."""
        last, version = self.version(), f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{version}/{name}")
        self._point(version)
        for old in self._fs().listStatus(self._path(self.folder)):
            name = old.getPath().getName()
            if name.startswith("v-") and name not in (version, last):
                self._fs().delete(old.getPath(), True)
        return version

    def _point(self, version: str) -> None:
        """Replace the pointer in one step, where the store can rename over a file; else by one small write."""
        fs, jvm = self._fs(), self.spark._jvm
        place = self._path(f"{self.pointer}-{uuid.uuid4().hex}")
        out = fs.create(place, True)
        out.write(bytearray(version.encode()))
        out.close()
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark.sparkContext._gateway.new_array(kinds, 1)
            how[0] = kinds.OVERWRITE
            context.rename(place, self._path(self.pointer), how)
        except Exception:  # noqa: BLE001  (a store without such a rename)
            out = fs.create(self._path(self.pointer), True)
            out.write(bytearray(version.encode()))
            out.close()
            fs.delete(place, False)


def to_read(listed: DataFrame, known: DataFrame | None) -> DataFrame:
    """listed (path, byte_size, mtime) -> the rows whose text must be read: new ones and those of another size or time."""
    if known is None:
        return listed
    same = known.select("path", "byte_size", "mtime")
    return listed.join(same, ["path", "byte_size", "mtime"], "left_anti")


def moved_bases(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two tables of all paths (path) -> (base): what module paths may now mean another file, as one came or went there."""
    gone = before.select("path").join(now.select("path"), "path", "left_anti")
    came = now.select("path").join(before.select("path"), "path", "left_anti")
    bases = [F.when(F.col("path").endswith(e), F.expr(f"substring(path, 1, length(path) - {len(e)})")) for e in ENDINGS]
    return gone.unionByName(came).select(F.explode(F.array_compact(F.array(*bases))).alias("base")).distinct()


def stale_importers(resolved: DataFrame, bases: DataFrame) -> DataFrame:
    """resolved (source, bases) -> (path) of the files with a statement that may mean another file now."""
    tries = resolved.filter("bases IS NOT NULL").select("source", F.explode("bases").alias("base"))
    return tries.join(bases, "base", "left_semi").select(F.col("source").alias("path")).distinct()
