"""Repeated comparison of a growing change log with one baseline, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Folders whose changes count for nothing, and the endings of those that do.
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "coverage", ".nyc_output")
ENDINGS = r"\.(ts|tsx|js|jsx)$"
#: Milliseconds without a change after which a run starts.
QUIET = 400


def relevant(changes: DataFrame, cache_dir: str = ".tallyforge-cache") -> DataFrame:
    """Change rows (path) of source files outside the ignored folders and the program's own cache."""
    inside = F.exists(F.split("path", "/"), lambda part: part.isin(*IGNORED, cache_dir))
    return changes.filter(~inside & F.col("path").rlike(ENDINGS))


def watch(changes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, debounce: str | None = None) -> StreamingQuery:
    """Call run(distinct changed paths, batch) for each batch with relevant changes.

    One batch runs at a time and changes that come meanwhile wait for the next, so there is at most one run and one
    pending; debounce is the trigger interval (all available changes once if not given).
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = batch.select("path").distinct()
        if not paths.isEmpty():
            run(paths, number)

    writer = relevant(changes).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=debounce) if debounce else writer.trigger(availableNow=True)).start()


def bursts(changes: DataFrame, quiet: int = QUIET) -> DataFrame:
    """Streamed changes (project, path) -> (project, n_changes), one row when a project has been quiet for so many milliseconds.

    Each project has its own state, a count, and a timer that every change sets anew: changes that keep coming make one
    row at their end, wherever batches are cut.
    """

    def count(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"project": [key[0]], "n_changes": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(map(len, rows))
        state.update((n,))
        state.setTimeoutDuration(quiet)

    keyed = relevant(changes).select("project", "path").groupBy("project")
    return keyed.applyInPandasWithState(count, "project string, n_changes long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch_bursts(changes: DataFrame, run: Callable[[str, int], None], checkpoint: str, quiet: int = QUIET, every: str = "200 milliseconds") -> StreamingQuery:
    """Call run(project, changes) once after each burst of changes; one run at a time, and what comes meanwhile is one more."""

    def each(batch: DataFrame, number: int) -> None:
        for r in batch.groupBy("project").agg(F.sum("n_changes").alias("n")).collect():  # projects that have just become quiet
            run(r["project"], r["n"])

    return bursts(changes, quiet).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch_diff(spark: SparkSession, changes: DataFrame, baselines: dict[str, str], out: str, checkpoint: str, config: dict[str, Any] | None = None, quiet: int = QUIET) -> StreamingQuery:
    """Compare a project with its stored baseline (project root -> report path) after each burst of changes, under out."""
    from tallyforge.plans.analyze import diff

    def run(project: str, n: int) -> None:
        if project in baselines:
            diff(spark, project, baselines[project], out, config)

    return watch_bursts(changes, run, checkpoint, quiet)
