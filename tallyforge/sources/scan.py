"""Source files of a directory tree as rows, with what was left out and why.

A tree that all machines mount is walked and read by tasks (walk.py), so that excluded folders are never listed; of any
other file system Spark's binary file source lists all files.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.sources import walk as W

RELEVANT = r"(?i)\.(tsx?|jsx?|[mc]ts|[mc]js)$"


def valid_pattern(spark: SparkSession, pattern: str) -> tuple[str, str | None]:
    """The pattern and no warning, or its letters taken literally and a warning, if it is no regular expression of Java and Python."""
    literal = re.sub(r"([^A-Za-z0-9_/])", r"\\\1", pattern), f"not a regular expression, taken literally: {pattern}"
    try:
        re.compile(pattern)
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return pattern, None
    except re.error:
        return literal
    except Exception as wrong:  # noqa: BLE001  (py4j wraps the JVM's error)
        if "PatternSyntaxException" not in str(wrong):
            raise
        return literal


def _first_excluded(path: Column, patterns: list[str]) -> Column:
    """The shortest beginning of the path, down to a folder or itself, that a pattern matches; null if none does."""
    if not patterns:
        return F.lit(None).cast("string")
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = F.filter(prefixes, lambda p: F.exists(F.array(*map(F.lit, patterns)), lambda e: F.rlike(p, e)))
    return F.get(hit, F.lit(0))


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, scope: str = "all", max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """(path, byte_size, mtime, kind, script, reason, skipped, is_directory) of all files under root, without their content.

    reason is null for files to be analysed and for files that are no sources (script Unknown). skipped is what is left
    out: the file, or the folder above it that a pattern excludes. Patterns are compared with paths relative to root.
    """
    patterns = [valid_pattern(spark, p)[0] for p in exclude or []]
    if W.mounted(root):
        found = W.walk(spark, root, patterns)
        rows = found.select("path", "byte_size", "mtime", F.col("reason").alias("out"), F.col("is_directory").alias("folder"), F.when(F.col("reason") == W.EXCLUDED, F.col("path")).alias("hit"))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
        inside = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30)
        rows = raw.select(inside.alias("path"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("mtime"), F.lit(None).cast("string").alias("out"))
        rows = rows.withColumn("hit", _first_excluded(F.col("path"), patterns)).withColumn("folder", F.col("hit").isNotNull() & (F.col("hit") != F.col("path")))
    rows = rows.withColumn("kind", P.file_kind("path")).withColumn("script", P.script_kind("path"))
    source = F.col("path").rlike(RELEVANT)
    reason = (
        F.when(F.col("hit").isNotNull(), W.EXCLUDED)
        .when(F.col("out").isNotNull(), F.col("out"))
        .when(source & ~P.in_scope("kind", scope), f"Excluded by analysis scope ({scope})")
        .when(source & (F.col("byte_size") > max_bytes), f"File size exceeds {max_bytes} bytes")
    )
    rows = rows.withColumn("reason", reason).withColumn("skipped", F.when(F.col("reason").isNotNull(), F.coalesce("hit", "path")))
    return rows.withColumn("is_directory", F.col("folder")).drop("hit", "out", "folder")


def skipped_files(listed: DataFrame) -> DataFrame:
    """(path, reason, is_directory): what a scan left out, a folder once."""
    return listed.filter("reason IS NOT NULL").groupBy(F.col("skipped").alias("path"), "reason").agg(F.bool_or("is_directory").alias("is_directory"))


def sources_of(listed: DataFrame) -> DataFrame:
    """The rows of a listing that are analysed."""
    return listed.filter(F.col("reason").isNull() & (F.col("script") != "Unknown"))


def source_files(
    spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int = 10 * 1024 * 1024, scope: str = "all", only: DataFrame | None = None, since: datetime | None = None
) -> DataFrame:
    """(path, kind, byte_size, mtime, sha256, line_count, encoding, trailing_newline, content) of the files to be analysed.

    A byte order mark (UTF-8) is dropped before hashing and named in encoding. only (path, kind), rows of a listing,
    names the files that are wanted; since, the earliest change among them, keeps older files from being opened at all.
    """
    kept = (sources_of(listing(spark, root, exclude, scope, max_bytes)) if only is None else only).select("path", "kind")
    if W.mounted(root):
        rows = W.contents(kept, root, max_bytes)
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,js,jsx,mts,cts,mjs,cjs,TS,TSX,JS,JSX,MTS,CTS,MJS,CJS}").load(root)
        raw = raw if since is None else raw.filter(F.col("modificationTime") >= F.lit(since))
        rows = raw.filter(F.col("length") <= max_bytes).withColumn("path", F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30)).join(kept, "path")
    decoded = F.decode("content", "UTF-8")
    text = F.regexp_replace(decoded, "^﻿", "")
    return rows.select(
        "path", "kind", F.col("length").alias("byte_size"), F.col("modificationTime").alias("mtime"), F.sha2(text.cast("binary"), 256).alias("sha256"), F.size(F.split(text, "\r?\n")).alias("line_count"),
        F.when(decoded.startswith("﻿"), "utf-8-bom").otherwise("utf-8").alias("encoding"), text.rlike(r"\n$").alias("trailing_newline"), text.alias("content"),
    )


def evidence_paths(spark: SparkSession, root: str, listed: DataFrame, tops: frozenset[str]) -> DataFrame:
    """(path): files of a listing that are no sources, and all files in the named folders of the first level, excluded or hidden ones, too."""
    found = listed.filter("reason IS NULL AND script = 'Unknown'").select("path")
    if W.mounted(root):
        found = found.unionByName(W.walk(spark, root, [r"(^|/)node_modules$"], tops).filter("reason IS NULL").select("path"))
    return found.distinct()
