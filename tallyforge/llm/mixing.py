"""Mixing sources to target weights with hash-threshold histograms (operator 1).

Every document gets a 60-bit hash. Words are summed by source and by the top 12 bits of the hash; in the running sum
over the buckets each source's budget falls into one boundary bucket, and only that bucket is split by the next 12 bits,
until it holds one hash. A document is then taken by comparing its hash with its source's threshold: no sort of rows.
Thresholds nest: a larger budget takes all that a smaller one takes.

Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is a source of its own and comes
last; rows with equal id and equal size share one hash and so are taken together; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD, any_names, text_of, work_table

BITS, STEP = 60, 12
#: A table of so many sources at most is broadcast (some 40 bytes each); beyond, both sides are shuffled by source.
MOST_SOURCES = 1_000_000


def doc_hash(doc_id: Column, size: Column) -> Column:
    """60 uniform bits from id and size."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("#"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size): adds target, the source's part of share times all sizes by weight.

    No target exceeds most times its source's size; the excess is shared again by weight. The sources that reach their
    cap are those with the smallest size per weight, so the level of the rest follows from running sums in that order.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("n", F.row_number().over(in_order) - 1).withColumn("weight", weight)
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("all_size") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct("ratio", "n", "level"))).over(every)
    s = s.withColumn("level", open_level["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (source, h, size), goals (source, goal): per source the hash up to which rows are taken (-1: none).

    The boundary bucket's last hash is taken when that brings the sum nearer to the goal.
    """
    rows = rows.filter(F.col("size") > 0)
    state = goals.select("source", "goal", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("prefix"))
    shift, done, n_sources = BITS, [], state.count()
    while shift > 0:
        prefix = F.shiftright("h", shift)
        shift -= STEP
        named = rows.select(F.col("source").alias("src"), prefix.alias("pre"), F.shiftright("h", shift).alias("bucket"), "size", "h")
        # only rows of the boundary bucket are summed; at first that is every row
        few = F.broadcast(state) if n_sources <= MOST_SOURCES else state
        named = named.join(few, F.col("source").eqNullSafe(F.col("src")) & (F.col("prefix") == F.col("pre")))
        joined = named.groupBy("source", "goal", "before", "bucket").agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = Window.partitionBy("source").orderBy("bucket")
        joined = joined.withColumn("upto", F.col("before") + F.sum("size").over(running))
        over = F.col("upto") > F.col("goal")
        found = joined.groupBy("source").agg(
            F.first("goal").alias("goal"),
            F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "size", "first", "last"))).alias("b"),
            F.max(F.when(~over, F.col("last"))).alias("inside"),
        )
        found = work_table(found, "mix_level")
        near = F.when(F.col("b").isNull(), F.col("inside"))
        gap, size = F.col("goal") - F.col("b.before"), F.col("b.size")
        near = near.when(gap > F.col("b.before") + size - F.col("goal"), F.col("b.last")).otherwise(F.col("b.first") - 1)
        settled = F.col("b").isNull() | (F.col("b.first") == F.col("b.last"))
        done.append(found.filter(settled).select("source", near.alias("threshold")))
        state = found.filter(~settled).select("source", "goal", F.col("b.before").alias("before"), F.col("b.bucket").alias("prefix"))
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, Column]:
    """rows (doc_id, source, size, h), one row per source with its target and threshold, and how often a joined row is taken."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size")).withColumn("h", doc_hash(F.col("doc_id"), F.col("size")))
    rows = work_table(rows, "mix_rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = work_table(targets(sizes, weights, share, most), "mix_targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("times", whole)
    cut = thresholds(rows, aims.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("goal")))
    cut = cut.withColumnRenamed("source", "cut_source")
    aims = aims.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source").withColumnRenamed("source", "aim_source")
    more = (F.col("h") <= F.coalesce("threshold", F.lit(-1))).cast("long")
    return rows, work_table(aims, "mix_aims"), F.least(F.col("times") + more, F.floor(F.lit(most)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken, one row for each row of docs."""
    rows, aims, times = _plan(docs, weights, share, most)
    return rows.join(aims, F.col("source").eqNullSafe(F.col("aim_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


@any_names
def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken; those of size 0 stay once."""
    _, aims, times = _plan(docs, weights, share, most)
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", size.alias("size"), doc_hash(F.col("doc_id"), size).alias("h"))
    taken = F.when(F.col("size") > 0, times).otherwise(1).cast("int")
    rows = rows.join(aims, F.col("source").eqNullSafe(F.col("aim_source"))).select("row", taken.alias("taken")).filter("taken > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("taken"))).alias("nth")).select("row.*")
