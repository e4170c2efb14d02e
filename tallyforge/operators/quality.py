"""Metric verdicts, their roll-up to categories and overall, trends between reports, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.exprs import trend


def verdict_at_least(value: Column, good: float, fair: float) -> Column:
    """pass from good, warn from fair, else fail; a missing value is manual."""
    return F.when(value.isNull(), "manual").when(value >= good, "pass").when(value >= fair, "warn").otherwise("fail")


def verdict_at_most(value: Column, good: float, fair: float) -> Column:
    return F.when(value.isNull(), "manual").when(value <= good, "pass").when(value <= fair, "warn").otherwise("fail")


def with_manual(metrics: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual evidence (id, verdict, seq) replaces the verdict of metrics whose automation is manual; the last of an id wins."""
    last = manual.groupBy("id").agg(F.max(F.struct("seq", "verdict")).alias("m")).select(F.col("id").alias("mid"), F.col("m.verdict").alias("mv"))
    j = metrics.join(last, F.col("id") == F.col("mid"), "left")
    own = F.when((F.col("automation") == "manual") & F.col("mv").isNotNull(), F.col("mv")).otherwise(F.col("verdict"))
    return j.withColumn("verdict", own).drop("mid", "mv")


def with_failures(metrics: DataFrame, failures: DataFrame) -> DataFrame:
    """Metrics (id) of a collection phase that failed (id, seq, reason) become manual; the first failure wins."""
    first = failures.groupBy("id").agg(F.min(F.struct("seq", "reason")).alias("f")).select(F.col("id").alias("fid"), F.col("f.reason").alias("failure"))
    j = metrics.join(first, F.col("id") == F.col("fid"), "left").drop("fid")
    lost = F.col("failure").isNotNull()
    return j.withColumn("verdict", F.when(lost, "manual").otherwise(F.col("verdict"))).withColumn("automation", F.when(lost, "manual").otherwise(F.col("automation")))


def _has(verdict: str) -> Column:
    return F.count_if(F.col("verdict") == verdict)


def category_verdicts(metrics: DataFrame) -> DataFrame:
    """Primary metrics (category, verdict, aggregation) -> (category, verdict, n_metrics)."""
    g = metrics.filter("aggregation = 'primary'").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_metrics"), *[_has(v).alias(v) for v in ("fail", "warn", "partial", "pass", "manual")]
    )
    resolved = F.col("pass") + F.col("fail") + F.col("warn") + F.col("partial")
    verdict = (
        F.when(F.col("fail") > 0, "fail")
        .when(F.col("warn") > 0, "warn")
        .when(F.col("partial") > 0, "partial")
        .when(resolved == 0, F.when(F.col("manual") > 0, "manual").otherwise("not_applicable"))
        .when(F.col("manual") > 0, "partial")
        .otherwise("pass")
    )
    return g.select("category", verdict.alias("verdict"), "n_metrics")


def overall_verdict(categories: DataFrame) -> DataFrame:
    """Category verdicts -> one row (verdict and the counts)."""
    names = ("pass", "warn", "fail", "partial", "manual", "not_applicable")
    g = categories.agg(F.count(F.lit(1)).alias("n"), *[_has(v).alias(f"n_{v}") for v in names])
    verdict = (
        F.when(F.col("n_fail") > 0, "fail")
        .when(F.col("n_warn") > 0, "warn")
        .when((F.col("n_partial") > 0) | ((F.col("n_pass") > 0) & (F.col("n_manual") > 0)), "partial")
        .when(F.col("n_pass") > 0, "pass")
        .when(F.col("n_manual") > 0, "manual")
        .when((F.col("n") > 0) & (F.col("n_not_applicable") == F.col("n")), "not_applicable")
        .otherwise("pass")
    )
    return g.select(verdict.alias("verdict"), *[f"n_{v}" for v in names])


def quality_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two metric tables (category, id, verdict, actual, threshold, automation, aggregation) -> one row per metric with its trend."""
    names = ["verdict", "actual", "threshold", "automation", "aggregation"]
    c = current.select(F.col("category").alias("c1"), F.col("id").alias("i1"), *[F.col(x).alias(f"cur_{x}") for x in names])
    b = baseline.select(F.col("category").alias("c2"), F.col("id").alias("i2"), *[F.col(x).alias(f"base_{x}") for x in names])
    j = c.join(b, (F.col("c1") == F.col("c2")) & (F.col("i1") == F.col("i2")), "full_outer")
    changed = F.lit(False)
    for x in names[:4]:
        changed = changed | ~F.col(f"cur_{x}").eqNullSafe(F.col(f"base_{x}"))
    status = F.when(F.col("i2").isNull(), "added").when(F.col("i1").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    t = trend("cur_verdict", "base_verdict", "cur_actual", "base_actual", "cur_threshold")
    return j.select(
        F.coalesce("c1", "c2").alias("category"), F.coalesce("i1", "i2").alias("id"), status.alias("status"), t.alias("trend"),
        "cur_verdict", "base_verdict", "cur_automation", "base_automation", F.coalesce("cur_aggregation", "base_aggregation").alias("aggregation"),
    )


def blocking_regressions(diff: DataFrame, blocking: list[str] | None = None, monitoring: list[str] | None = None) -> DataFrame:
    """Rows of quality_diff that block: regressed primaries with a changed verdict, automatic or with evidence lost; monitored ids never."""
    lost = (F.col("base_automation") == "automatic") & (F.col("cur_automation") == "manual")
    rows = diff.filter((F.col("aggregation") == "primary") & (F.col("trend") == "regressed") & (F.col("cur_verdict") != F.col("base_verdict")))
    rows = rows.filter((F.col("cur_automation") == "automatic") | lost)
    if monitoring:
        rows = rows.filter(~F.col("id").isin(*monitoring))
    return rows.filter(F.col("id").isin(*blocking)) if blocking else rows


def gate(metrics: DataFrame, regressions: DataFrame) -> DataFrame:
    """One row: counts of failing automatic primaries and blocking regressions, and the exit code 0 or 2."""
    a = metrics.agg(F.count_if((F.col("aggregation") == "primary") & (F.col("automation") == "automatic") & (F.col("verdict") == "fail")).alias("n_failing"))
    b = regressions.agg(F.count(F.lit(1)).alias("n_regressions"))
    return a.crossJoin(b).withColumn("exit_code", F.when((F.col("n_failing") > 0) | (F.col("n_regressions") > 0), 2).otherwise(0))
