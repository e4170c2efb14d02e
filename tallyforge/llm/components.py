"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, work_table


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs -> (node, root): every node that has an edge, and the smallest node of its component.

    Each step hangs neighbours on the smallest node in reach, so paths halve; rows per step never exceed the edges.
    Every step is written to the shared folder, and the one before it removed. No edges give an empty table.
    """
    now = work_table(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = work_table(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(least, F.col("u") == F.col("of"))
        small = small.select("u", "m").unionByName(small.select(F.col("v").alias("u"), "m")).filter("u != m").select("u", F.col("m").alias("v")).distinct()
        last, now = now, work_table(small, "cc")
        discard(last, large)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
