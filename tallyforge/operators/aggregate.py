"""Roll-ups, rankings and joins of facts, parameterised by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.exprs import ratio


def size_matrix(df: DataFrame, size: Column, complexity: Column) -> DataFrame:
    """(cluster, n) of all nine clusters, those without rows with 0."""
    spark = df.sparkSession
    every = spark.createDataFrame([(s + c,) for s in "SML" for c in "123"], "cluster string")
    counts = df.groupBy(F.concat(size, complexity).alias("code")).agg(F.count(F.lit(1)).alias("k"))
    return F.broadcast(every).join(counts, F.col("cluster") == F.col("code"), "left").select("cluster", F.coalesce("k", F.lit(0)).alias("n"))


def distribution(df: DataFrame, kind: str, *measures: str) -> DataFrame:
    """Per kind: count, share of all rows and the mean of each measure."""
    g = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in measures])
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select(kind, "n", ratio("n", "total").alias("share"), *[f"avg_{m}" for m in measures])


def level_counts(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """One row per axis: how many rows are low, medium and high on it."""
    levels = ("low", "medium", "high")
    one = df.agg(*[F.count_if(c == v).alias(f"{a}_{v}") for a, c in axes.items() for v in levels])
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), *[F.col(f"{a}_{v}").alias(v) for v in levels]) for a in axes])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def usage_by_context(df: DataFrame, context: str, name: str, limit: int = 10) -> DataFrame:
    """(context, name, n, rank): the most used names of each context."""
    counts = df.groupBy(context, name).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, [context], [F.desc("n"), F.asc(name)], limit).select(context, name, "n", "rank")


def weighted_rate(df: DataFrame, matched: Column, weight: Column, *by: str) -> DataFrame:
    """Sum of the weights that match over all weights in percent, 0 without weights; with counts."""
    g = df.groupBy(*by).agg(
        F.sum(F.when(matched, weight).otherwise(0)).alias("hit"), F.sum(weight).alias("all"), F.count(F.lit(1)).alias("n_targets"), F.count_if(matched).alias("n_matched")
    )
    return g.select(*by, "n_targets", "n_matched", ratio("hit", "all", 100.0).alias("rate"))


def peak(df: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """Per group the largest value and the first position that has it."""
    return df.groupBy(by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(position)).alias("p"))).alias("m")).select(by, F.col("m.v").alias("peak"), (-F.col("m.p")).alias("at"))


def top_mean(df: DataFrame, by: str, value: str, k: int = 3) -> DataFrame:
    """Per group the mean of its k largest values."""
    w = Window.partitionBy(by).orderBy(F.desc(value))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).groupBy(by).agg(F.avg(value).alias("top_mean"))


def evidence(targets: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """targets with matched_by: the first of the named sources (each with the key column) that has the key, else none."""
    out, by = targets, F.lit("none")
    for i, (_, source) in enumerate(sources):
        out = out.join(source.select(F.col(key).alias(f"_k{i}")).distinct(), F.col(key) == F.col(f"_k{i}"), "left")
    for i, (name, _) in reversed(list(enumerate(sources))):
        by = F.when(F.col(f"_k{i}").isNotNull(), name).otherwise(by)
    return out.withColumn("matched_by", by).drop(*[f"_k{i}" for i in range(len(sources))])


def cache_hits(current: DataFrame, index: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Per key of current: reused if the index has it with equal version columns, changed if with others, new if not."""
    i = index.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in version])
    same = F.lit(True)
    for v in version:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    state = F.when(F.col("_k").isNull(), "new").when(same, "reused").otherwise("changed")
    return current.join(i, F.col(key) == F.col("_k"), "left").select(key, state.alias("state"))


def findings(df: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule, line, text): each line that a rule's pattern is found in, lines counted from 1."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "raw"))
    hits = F.array_compact(F.array(*[F.when(F.col("raw").rlike(p), F.lit(r)) for r, p in rules.items()]))
    return lines.select(key, F.explode(hits).alias("rule"), (F.col("n") + 1).cast("long").alias("line"), F.trim("raw").alias("text"))


def suggestions(unknown: DataFrame, known: DataFrame, below: int = 3) -> DataFrame:
    """unknown (name), known (name) -> (unknown, suggestion, distance): for each unknown name the nearest known one at a distance below the limit, ties by name.

    Names are joined by their length, as a distance is at least the difference of lengths; no other pairs are made.
    """
    k = known.select(F.col("name").alias("suggestion")).distinct().withColumn("n", F.length("suggestion"))
    u = unknown.select(F.col("name").alias("unknown")).distinct()
    u = u.withColumn("n", F.explode(F.sequence(F.length("unknown") - (below - 1), F.length("unknown") + (below - 1))))
    near = F.levenshtein("unknown", "suggestion", below - 1)
    pairs = u.join(k, "n").filter("unknown <> suggestion").withColumn("distance", near).filter("distance >= 0")
    best = pairs.groupBy("unknown").agg(F.min(F.struct("distance", "suggestion")).alias("b"))
    return best.select("unknown", "b.suggestion", "b.distance")
