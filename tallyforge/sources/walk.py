"""Folders of a file system that all machines mount, walked by Spark tasks: excluded folders are never listed, links end.

A round lists the folders that the last one left; a task goes down from its folders until it has listed its budget and
hands the rest back, so that a small project takes one round and a large one spreads over all tasks. Real entries come
first. Then links are settled: of links to one target the first by path counts; one to a folder that was listed already
is a duplicate, or a cycle if it lies under that folder; others are walked level by level, without what was listed.
"""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.work import cut, discard

#: what: file, excluded, link, failed, folder (listed), pending (to be listed). origin: for what a link leads to, the
#: folder that holds the link. mtime in milliseconds.
ROWS = "what string, path string, real string, origin string, is_directory boolean, byte_size long, mtime long, failure string"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
BUDGET, BATCH = 1000, 10_000
CYCLE, DUPLICATE, EXCLUDED = "Directory cycle detected", "Duplicate symlink target", "Excluded pattern match"


def mounted(root: str) -> bool:
    """Whether root is a path of a file system that tasks can open."""
    return not re.match(r"^[a-zA-Z][\w+.-]*:", root) or root.startswith("file:")


def place_of(root: str) -> str:
    """The path of a mounted root."""
    return re.sub(r"^file:/+", "/", root).rstrip("/") or "/"


def _named(path: str) -> bool:
    try:
        path.encode()
    except UnicodeEncodeError:
        return False
    return True


def _entries(base: str, path: str, real: str, origin: str | None, patterns: list[re.Pattern], tops: frozenset[str] | None) -> Iterator[tuple]:
    """The rows of one folder's entries; its real folders are pending."""
    try:
        with os.scandir(os.path.join(base, path)) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as wrong:
        yield "failed", path, real, origin, True, None, None, f"cannot be read: {wrong.strerror}"
        return
    yield "folder", path, real, origin, True, None, None, None
    for e in entries:
        inside = f"{path}/{e.name}" if path else e.name
        if not _named(e.name):
            yield "failed", inside.encode("utf-8", "replace").decode(), real, origin, False, None, None, "its name is not UTF-8"
            continue
        try:
            link = e.is_symlink()
            info = e.stat()
        except OSError:  # a link to nothing, or gone by now
            continue
        folder = stat.S_ISDIR(info.st_mode)
        if not folder and not stat.S_ISREG(info.st_mode):
            continue
        facts = (folder, info.st_size, info.st_mtime_ns // 1_000_000, None)
        if tops is not None and not path and folder and e.name not in tops:
            continue
        if any(p.search(inside) for p in patterns):
            yield "excluded", inside, None, origin, *facts
        elif link:
            yield "link", inside, os.path.realpath(os.path.join(base, inside)), real, *facts
        else:
            yield "pending" if folder else "file", inside, f"{real.rstrip('/')}/{e.name}", origin, *facts


def _listed(frontier: DataFrame, base: str, patterns: list[str], tops: frozenset[str] | None, budget: int) -> DataFrame:
    """The rows below pending folders (path, real, origin); a task lists its own folders and then up to budget more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, out = [re.compile(p) for p in patterns], []
        todo = deque((r["path"], r["real"], r["origin"]) for b in batches for r in b.to_pylist())
        own = len(todo)
        most = max(own, budget)
        done = 0
        while todo:
            path, real, origin = todo.popleft()
            done += 1
            for row in _entries(base, path, real or os.path.realpath(os.path.join(base, path)), origin, compiled, tops):
                if row[0] == "pending" and budget and done + len(todo) < most:
                    todo.append((row[1], row[2], row[3]))
                else:
                    out.append(row)
            while len(out) >= BATCH:
                yield _batch(out[:BATCH])
                del out[:BATCH]
        if out:
            yield _batch(out)

    return frontier.select("path", "real", "origin").mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    kinds = [types[c.split()[1]] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def _spread(frontier: DataFrame, count: int) -> DataFrame:
    return frontier.repartition(max(1, min(count, 4 * frontier.sparkSession.sparkContext.defaultParallelism)))


def _under(inner: str, outer: str):
    """Whether the path in one column is that in another or lies below it."""
    return F.concat(F.col(inner), F.lit("/")).startswith(F.concat(F.rtrim(F.col(outer), F.lit("/")), F.lit("/")))


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None, tops: frozenset[str] | None = None) -> DataFrame:
    """(path, byte_size, mtime, is_directory, reason): the files under root, and what was left out with the reason.

    Paths are relative to root; exclude holds regular expressions for them, of which one that matches a folder leaves out
    all below. tops, if given, names the folders of the first level that are entered. Other entries than files and folders, and
    links to nothing, are no rows. A missing root or an empty one gives no files.
    """
    base, patterns = place_of(root), list(exclude or [])
    parts: list[DataFrame] = []
    reasons = spark.createDataFrame([], "path string, is_directory boolean, reason string")

    frontier, count = spark.createDataFrame([("", None, None)], "path string, real string, origin string"), 1
    while count:
        level = cut(_listed(_spread(frontier, count), base, patterns, tops, BUDGET), "walked")
        parts.append(level)
        frontier = level.filter("what = 'pending'")
        count = frontier.count()

    def rows(what: str) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.filter(F.col("what") == what)

    settled: DataFrame | None = None
    while True:
        open_links = rows("link") if settled is None else rows("link").join(settled, "path", "left_anti")
        if open_links.isEmpty():
            break
        first = rows("link").groupBy("real").agg(F.min(F.struct("path", "origin", "is_directory")).alias("f")).select("real", "f.*")
        fresh = cut(open_links.select("path", "real", "is_directory", "origin"), "links")
        kept = fresh.join(first.select("path"), "path", "left_semi")
        later = fresh.join(first.select("path"), "path", "left_anti")
        listed = rows("folder").select("real").distinct()
        known = kept.filter("is_directory").join(listed, "real", "left_semi")
        new = kept.filter("is_directory").join(listed, "real", "left_anti")
        above = new.select(F.col("path").alias("inner"), F.explode(F.expr("transform(sequence(1, size(split(real, '/')) - 1), n -> concat_ws('/', slice(split(real, '/'), 1, n)))")).alias("real"))
        nested = above.join(new.select("real"), "real", "left_semi").select(F.col("inner").alias("path")).distinct()
        start = cut(new.join(nested, "path", "left_anti").select("path", "real", "origin"), "targets")
        cycle = F.when(_under("origin", "real"), CYCLE).otherwise(DUPLICATE)
        now = later.select("path", "is_directory", F.lit(DUPLICATE).alias("reason")).unionByName(known.select("path", "is_directory", cycle.alias("reason")))
        reasons = cut(reasons.unionByName(now), "reasons")
        done = fresh.select("path").join(nested, "path", "left_anti")
        settled = cut(done if settled is None else settled.unionByName(done), "settled")
        count = start.count()
        while count:
            level = cut(_listed(_spread(start, count), base, patterns, None, 0), "walked")
            parts.append(level)
            listed = rows("folder").select("real").distinct()
            again = level.filter("what = 'pending'").join(listed, "real", "left_semi")
            reasons = cut(reasons.unionByName(again.select("path", F.lit(True).alias("is_directory"), cycle.alias("reason"))), "reasons")
            start = cut(level.filter("what = 'pending'").join(listed, "real", "left_anti").select("path", "real", "origin"), "targets")
            count = start.count()

    files = rows("file").select("path", "byte_size", "mtime", F.lit(False).alias("is_directory"), F.lit(None).cast("string").alias("reason"))
    firsts = rows("link").filter("NOT is_directory").join(reasons.select("path"), "path", "left_anti")
    files = files.unionByName(firsts.select("path", "byte_size", "mtime", "is_directory", F.lit(None).cast("string").alias("reason")))
    none = F.lit(None).cast("long")
    out = files.unionByName(rows("excluded").select("path", "byte_size", "mtime", "is_directory", F.lit(EXCLUDED).alias("reason")))
    out = out.unionByName(rows("failed").select("path", "byte_size", "mtime", "is_directory", F.col("failure").alias("reason")))
    out = out.unionByName(reasons.select("path", none.alias("byte_size"), none.alias("mtime"), "is_directory", "reason"))
    result = cut(out.withColumn("mtime", F.timestamp_millis("mtime")), "walk")
    discard(*parts)
    return result


CONTENTS = "path string, kind string, length long, modified long, content binary"


def contents(rows: DataFrame, root: str, max_bytes: int) -> DataFrame:
    """(path, kind) -> (path, kind, length, modificationTime, content) of files up to max_bytes, a few at a time; those that are gone by now are left out."""
    base = place_of(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("content", pa.binary())])
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                try:
                    with open(os.path.join(base, r["path"]), "rb") as f:
                        info = os.fstat(f.fileno())
                        if info.st_size > max_bytes:
                            continue
                        text = f.read()
                except OSError:
                    continue
                out.append({"path": r["path"], "kind": r["kind"], "length": len(text), "modified": info.st_mtime_ns // 1_000_000, "content": text})
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    spread = rows.select("path", "kind").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, CONTENTS).withColumn("modificationTime", F.timestamp_millis("modified"))
