"""Writers: CSV with quoted cells, JSON lines, and graph text for drawing tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all).mode("overwrite").csv(path)


def write_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """One partition of a snapshot table; another snapshot's rows stay."""
    df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def quoted(value: Column) -> Column:
    """A value as a quoted name of the graph language."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, in_degree), edges (source, target) -> (part, line): the lines of a DOT graph; colour tells how many edges come in."""
    d = F.col("in_degree")
    colour = F.when(d > 10, "red").when(d > 5, "orange").when(d > 2, "yellow").otherwise("white")
    label = quoted(F.element_at(F.split("id", "/"), -1))
    a = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [label="), label, F.lit(", fillcolor="), colour, F.lit("];")).alias("line"))
    b = edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(";")).alias("line"))
    return a.unionByName(b).orderBy("part", "line")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): nodes and then edges as JSON, each in order of its names."""
    a = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("k"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    b = edges.select(F.lit("edge").alias("kind"), F.concat_ws("\u0000", "source", "target").alias("k"), F.to_json(F.struct(*edges.columns)).alias("json"))
    return a.unionByName(b).orderBy(F.desc("kind"), "k").select("kind", "json")


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value
