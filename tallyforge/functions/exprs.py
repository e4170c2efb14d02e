"""Column expressions of the classification, scoring and verdict rules; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a size/complexity cluster; every other cluster weighs 1.
CLUSTER_WEIGHTS = {"L3": 18, "M3": 12, "L2": 10, "S3": 8, "M2": 6, "L1": 4, "S2": 3}
#: Rank of a verdict when two are compared; higher is worse.
VERDICT_RANKS = {"pass": 0, "not_applicable": 0, "partial": 1, "manual": 2, "warn": 3, "fail": 4}
#: Weights of the hot-spot, type-safety and structure scores.
HOTSPOT = {"complexity": 5, "dependencies": 2, "any": 4}
TYPE_SAFETY = {"any": 4, "unsafe": 4, "double": 5, "bare": 1, "non_null": 2, "ignore": 5, "expect_error": 4, "nocheck": 20}
#: Older names of the clusters.
OLD_CLUSTERS = {"S-L": "S1", "S-M": "S2", "S-H": "S3", "M-L": "M1", "M-M": "M2", "M-H": "M3", "L-L": "L1", "L-M": "L2", "L-H": "L3"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(value: Column | str, first: float, second: float, names: tuple[str, str, str]) -> Column:
    """One of three names by two inclusive upper limits."""
    v = _c(value)
    return F.when(v <= first, names[0]).when(v <= second, names[1]).otherwise(names[2])


def complexity_risk(value: Column | str) -> Column:
    return band(value, 6, 12, ("low", "medium", "high"))


def size_band(code_lines: Column | str, small: float = 100, middle: float = 300) -> Column:
    return band(code_lines, small, middle, ("S", "M", "L"))


def complexity_band(value: Column | str, low: float = 6, middle: float = 12) -> Column:
    return band(value, low, middle, ("1", "2", "3"))


def cluster_code(size: Column, complexity: Column) -> Column:
    return F.concat(size, complexity)


def cluster_weight(code: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CLUSTER_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(code)), F.lit(1))


def normal_cluster(code: Column | str) -> Column:
    """A cluster in today's names."""
    table = F.create_map(*[F.lit(x) for kv in OLD_CLUSTERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(code)), _c(code))


def hotspot_score(complexity, dependencies, any_count, hooks, weight) -> Column:
    w = HOTSPOT
    return w["complexity"] * _c(complexity) + w["dependencies"] * _c(dependencies) + w["any"] * _c(any_count) + _c(hooks) + _c(weight)


def hotspot_severity(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 120, "Critical").when(s >= 80, "High").when(s >= 40, "Medium").otherwise("Low")


def bare_assertions(assertion, unsafe, double, const) -> Column:
    return F.greatest(F.lit(0), _c(assertion) - _c(unsafe) - _c(double) - _c(const))


def type_safety_score(any_, unsafe, double, assertion, const, non_null, ignore, expect_error, nocheck) -> Column:
    w = TYPE_SAFETY
    bare = bare_assertions(assertion, unsafe, double, const)
    out = w["any"] * _c(any_) + w["unsafe"] * _c(unsafe) + w["double"] * _c(double) + w["bare"] * bare + w["non_null"] * _c(non_null)
    return out + w["ignore"] * _c(ignore) + w["expect_error"] * _c(expect_error) + w["nocheck"] * _c(nocheck)


def type_safety_risk(score: Column | str) -> Column:
    return band(score, 0, 4, ("low", "medium", "high"))


def structure_score(dependencies, hooks, lines) -> Column:
    return 2 * _c(dependencies) + _c(hooks) + F.when(_c(lines) > 300, 4).when(_c(lines) > 100, 2).otherwise(0)


def structure_risk(score: Column | str) -> Column:
    return band(score, 8, 18, ("low", "medium", "high"))


def primary_axis(type_safety, complexity, structure) -> Column:
    """The axis with the largest score; of equal ones type safety (unless 0) before complexity before structure."""
    t, c, s = _c(type_safety), _c(complexity), _c(structure)
    return F.when((t >= c) & (t >= s) & (t > 0), "typeSafety").when(c >= s, "complexity").otherwise("structure")


def file_warnings(complexity, threshold, any_count, dependencies) -> Column:
    """The names of the warnings that apply, in a fixed order."""
    c, a, d = _c(complexity), _c(any_count), _c(dependencies)
    return F.array_compact(
        F.array(
            F.when(c >= threshold, F.lit("complexity-threshold-exceeded")),
            F.when(a > 0, F.lit("explicit-any-usage")),
            F.when(d > 20, F.lit("high-dependency-count")),
        )
    )


def ratio(part: Column | str, whole: Column | str, scale: float = 1.0) -> Column:
    """part / whole times scale, 0 where whole is 0."""
    return F.when(_c(whole) > 0, _c(part) / _c(whole) * F.lit(scale)).otherwise(F.lit(0.0))


def verdict_rank(verdict: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VERDICT_RANKS.items() for x in kv])
    return F.try_element_at(table, _c(verdict))


def leading_number(text: Column | str) -> Column:
    """The number that a text starts with, or null."""
    return F.regexp_extract(_c(text), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def higher_is_better(threshold: Column | str) -> Column:
    """Direction of a threshold text: true, false, or null where it says none."""
    t = _c(threshold)
    return F.when(t.contains(">"), True).when(t.contains("<"), False).when(t.startswith("100%"), True).when(t.rlike(r"^\s*\d+(\.\d+)?\s*$"), False)


def trend(cur_verdict, base_verdict, cur_actual, base_actual, threshold) -> Column:
    """improved, regressed or neutral, from verdict ranks and, for equal warn or fail verdicts, from the leading numbers."""
    c, b = _c(cur_verdict), _c(base_verdict)
    x, y, better = leading_number(cur_actual), leading_number(base_actual), higher_is_better(threshold)
    moved = F.when(x.isNull() | y.isNull() | better.isNull() | (x == y), "neutral").when((x > y) == better, "improved").otherwise("regressed")
    return (
        F.when(c.isNull() | b.isNull(), "neutral")
        .when((b != "manual") & (c == "manual"), "regressed")
        .when(verdict_rank(c) > verdict_rank(b), "regressed")
        .when(verdict_rank(c) < verdict_rank(b), "improved")
        .when((c == b) & c.isin("warn", "fail"), moved)
        .otherwise("neutral")
    )
