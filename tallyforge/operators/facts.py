"""Scores of files from their functions, components, hooks, dependencies and type escapes, and roll-ups of them.

Tables: files (path, kind, code_lines, total_lines, comment_lines); functions (path, name, cc, nesting, start_line);
components (path, name, jsx, hook_count, render, start_line); hooks (path, name); dependencies (source, target, type,
is_external, is_type_only, module); types (path, any_count, assertion, unsafe, double, const, non_null, ts_ignore,
ts_expect, ts_nocheck). Counts of a file without rows in a table are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.functions import paths as P

#: Weights of the parts of a file's score, and of type escapes.
SCORE = {"avg_fn": 0.3, "peak_fn": 0.4, "top3_fn": 0.2, "avg_render": 1.2, "peak_render": 0.8, "nesting": 0.7, "hooks": 0.4, "elevated": 1.1}
ESCAPES = {"any_count": 4, "unsafe": 4, "double": 5, "non_null": 2, "ts_ignore": 6, "ts_expect": 4, "ts_nocheck": 20}
BARE_ESCAPE = 1.5
TYPE_COUNTS = ("any_count", "assertion", "unsafe", "double", "const", "non_null", "ts_ignore", "ts_expect", "ts_nocheck")


def fixed(value: Column | str, digits: int = 2) -> Column:
    """The value rounded half up to so many digits."""
    v = F.col(value) if isinstance(value, str) else value
    scale = 10**digits
    return F.floor(v * scale + F.lit(0.5)) / scale


def plain(value: Column | str, digits: int = 2) -> Column:
    """A number as text: at most so many digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}f", fixed(value, digits))
    return F.regexp_replace(text, r"\.?0+$", "")


def function_risk(cc: Column | str) -> Column:
    return E.band(cc, 5, 10, ("low", "medium", "high"))


def _top(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)


def breakdown(files: DataFrame, functions: DataFrame, components: DataFrame, hooks: DataFrame) -> DataFrame:
    """(path, n_functions, n_components, n_hooks, the parts of the score, weighted_score, complexity) of every file.

    complexity is 0 for a file without functions, components and hooks, else the rounded score, at least 1.
    """
    elevated = (F.col("cc") >= 5) | (F.col("nesting") >= 4)
    per_fn = functions.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_functions"), F.avg("cc").alias("avg_fn"), F.max("cc").alias("peak_fn"), F.max("nesting").alias("peak_nesting"), F.count_if(elevated).alias("elevated")
    )
    top = _top(functions, "path", [F.desc("cc")], 3).groupBy("path").agg(F.avg("cc").alias("top3_fn"))
    per_component = components.groupBy("path").agg(F.count(F.lit(1)).alias("n_components"), F.avg("render").alias("avg_render"), F.max("render").alias("peak_render"))
    per_hook = hooks.groupBy("path").agg(F.count(F.lit(1)).alias("n_hooks"))
    j = files.select("path")
    for side in (per_fn, top, per_component, per_hook):
        j = j.join(side, "path", "left")
    j = j.fillna(0)
    pressure = F.col("n_hooks") / F.greatest(F.col("n_components"), F.lit(1))
    nesting = F.least(F.lit(6), F.greatest(F.lit(0), F.col("peak_nesting") - 2))
    w = SCORE
    score = (
        F.col("avg_fn") * w["avg_fn"] + F.col("peak_fn") * w["peak_fn"] + F.col("top3_fn") * w["top3_fn"] + F.col("avg_render") * w["avg_render"]
        + F.col("peak_render") * w["peak_render"] + nesting * w["nesting"] + F.least(F.lit(4.0), pressure) * w["hooks"] + F.least(F.lit(3), F.col("elevated")) * w["elevated"]
    )
    some = F.col("n_functions") + F.col("n_components") + F.col("n_hooks") > 0
    overall = F.when(some, F.greatest(F.lit(1), F.floor(fixed(score) + 0.5))).otherwise(0).cast("long")
    return j.select(
        "path", "n_functions", "n_components", "n_hooks", fixed("avg_fn").alias("avg_fn"), "peak_fn", fixed("top3_fn").alias("top3_fn"), fixed("avg_render").alias("avg_render"), "peak_render",
        fixed(pressure).alias("hook_pressure"), "peak_nesting", "elevated", fixed(score).alias("weighted_score"), overall.alias("complexity"),
    )


def peak_functions(functions: DataFrame) -> DataFrame:
    """(path, peak_name, peak_cc, peak_line): the first of the most complex functions of each file."""
    first = _top(functions, "path", [F.desc("cc"), F.asc("start_line"), F.asc("name")], 1)
    return first.select("path", F.col("name").alias("peak_name"), F.col("cc").alias("peak_cc"), F.col("start_line").alias("peak_line"))


def drivers(b: DataFrame) -> Column:
    """What drives a file's complexity, as 'name=value' texts; b has the columns of breakdown() and peak_functions()."""

    def part(name: str, text: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"{name}="), text))

    function = F.concat(F.col("peak_cc").cast("string"), F.lit(" ("), F.col("peak_name"), F.lit(", line "), F.col("peak_line").cast("string"), F.lit(")"))
    return F.array_compact(
        F.array(
            part("weighted", plain("weighted_score"), F.lit(True)), part("peakFn", function, F.col("peak_cc") > 0), part("top3avg", plain("top3_fn"), F.col("n_functions") >= 2),
            part("nesting", F.col("peak_nesting").cast("string"), F.col("peak_nesting") > 0), part("renderPeak", F.col("peak_render").cast("string"), F.col("peak_render") > 0),
            part("hookPressure", plain("hook_pressure"), F.col("hook_pressure") > 0), part("elevatedFns", F.col("elevated").cast("string"), F.col("elevated") > 0),
        )
    )


def scored_files(files: DataFrame, functions: DataFrame, components: DataFrame, hooks: DataFrame, dependencies: DataFrame, types: DataFrame) -> DataFrame:
    """files with everything known of them: breakdown, peak function, dependency counts, type counts, cluster and risk scores."""
    deps = dependencies.groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n_dependencies"), F.count_if("is_external").alias("n_external"))
    out = files.join(breakdown(files, functions, components, hooks), "path").join(peak_functions(functions), "path", "left")
    out = out.join(deps, "path", "left").join(types, "path", "left").fillna(0, ["n_dependencies", "n_external", *TYPE_COUNTS, "peak_cc"])
    cluster = E.cluster_code(E.size_band("code_lines"), E.complexity_band("complexity"))
    safety = E.type_safety_score("any_count", "unsafe", "double", "assertion", "const", "non_null", "ts_ignore", "ts_expect", "ts_nocheck")
    return out.withColumns(
        {"cluster": cluster, "structure": E.structure_score("n_dependencies", "n_hooks", "code_lines"), "type_safety": F.when(P.is_hotspot_target("kind"), safety).otherwise(0)}
    )


def hot_spots(scored: DataFrame, threshold: int, limit: int) -> DataFrame:
    """The files with the highest scores: (rank, path, score, severity, cluster, reasons, drivers, action)."""
    anys = F.col("any_count")
    score = E.hotspot_score("complexity", "n_dependencies", anys, "n_hooks", E.cluster_weight("cluster"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("complexity") >= threshold, F.lit(f"complexity>={threshold}")), F.when(F.col("cluster").endswith("3"), F.concat(F.lit("cluster="), F.col("cluster"))),
            F.when(F.col("n_dependencies") >= 5, F.concat(F.lit("dependencies="), F.col("n_dependencies").cast("string"))),
            F.when(anys > 0, F.concat(F.lit("any="), anys.cast("string"))), F.when(F.col("n_hooks") >= 2, F.concat(F.lit("hooks="), F.col("n_hooks").cast("string"))),
        )
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.concat(F.lit("cluster="), F.col("cluster"))))
    axis = E.primary_axis("type_safety", "complexity", "structure")
    action = (
        F.when(axis == "typeSafety", F.when(anys > 0, "remove-any").otherwise("remove-assertions"))
        .when(axis == "complexity", F.when(F.col("peak_cc") >= 8, F.concat(F.lit("split-function:"), F.col("peak_name")))
              .when((F.col("n_hooks") >= 2) & (F.col("n_components") > 0), "split-hooks").when(F.col("n_functions") > 0, "split-functions").otherwise("split-render"))
        .when(F.col("n_dependencies") >= 5, "cut-fan-out").when(F.col("n_components") > 0, "extract-subcomponents").otherwise("tidy-dependencies")
    )
    rows = scored.filter(P.is_hotspot_target("kind")).select(
        "path", score.cast("long").alias("score"), "cluster", "complexity", "n_dependencies", "any_count", reasons.alias("reasons"), drivers(scored).alias("drivers"), action.alias("action")
    )
    top = rows.orderBy(F.desc("score"), "path").limit(limit)
    return top.withColumn("severity", E.hotspot_severity("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long"))


def with_warnings(scored: DataFrame, threshold: int = 12) -> DataFrame:
    """Scored files with their warnings."""
    return scored.withColumn("warnings", E.file_warnings("complexity", F.lit(threshold), "any_count", "n_dependencies"))


def file_warnings(scored: DataFrame, threshold: int = 12) -> DataFrame:
    """(path, warnings) of every file."""
    return with_warnings(scored, threshold).select("path", "warnings")


def type_safety_totals(scored: DataFrame) -> DataFrame:
    """One row: sums of the type counts over all but tests and stories, and the critical signals among them."""
    rows = scored.filter(P.is_hotspot_target("kind"))
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TYPE_COUNTS if c != "const"])
    return sums.withColumn("critical_signals", F.col("any_count") + F.col("ts_ignore") + F.col("ts_nocheck"))


def worst_type_safety(scored: DataFrame, limit: int = 10) -> DataFrame:
    """(path, score, share): the files with the highest type-safety scores and their percentage of all."""
    rows = scored.filter(P.is_hotspot_target("kind") & (F.col("type_safety") > 0)).select("path", F.col("type_safety").alias("score"))
    total = rows.agg(F.sum("score").alias("total"))
    top = rows.orderBy(F.desc("score"), "path").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("path", "score", fixed(F.col("score") / F.col("total") * 100, 1).alias("share"))


def risk_levels(scored: DataFrame) -> DataFrame:
    """(axis, low, medium, high): files by risk on each axis, type safety without tests and stories."""
    levels = {
        "complexity": E.complexity_risk("complexity"), "structure": E.structure_risk("structure"),
        "typeSafety": F.when(P.is_hotspot_target("kind"), E.type_safety_risk("type_safety")),
    }
    names = ("low", "medium", "high")
    one = scored.agg(*[F.count_if(c == v).alias(f"{a}_{v}") for a, c in levels.items() for v in names])
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), *[F.col(f"{a}_{v}").alias(v) for v in names]) for a in levels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def totals(scored: DataFrame) -> DataFrame:
    """One row: files, lines, functions, components, dependencies (all, external) and mean complexity."""
    sums = {"total_lines": "total_lines", "functions": "n_functions", "components": "n_components", "dependencies": "n_dependencies", "external": "n_external"}
    return scored.agg(
        F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()], F.coalesce(fixed(F.avg("complexity")), F.lit(0.0)).alias("mean_complexity")
    )


def kind_distribution(scored: DataFrame) -> DataFrame:
    """(kind, n, share, mean_complexity, mean_lines, phrase): kinds of files with how risky they are as a group."""
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    g = scored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("complexity").alias("c"), F.avg("code_lines").alias("l")).crossJoin(F.broadcast(total))
    phrase = F.when(F.col("c") >= 10, F.when(F.col("n") >= 5, "complex-wide").otherwise("complex-local")).when(F.col("n") >= 10, "majority").otherwise("local")
    return g.select("kind", "n", fixed(F.col("n") / F.col("total") * 100, 1).alias("share"), fixed("c").alias("mean_complexity"), fixed("l").alias("mean_lines"), phrase.alias("phrase"))


def external_groups(files: DataFrame, dependencies: DataFrame, limit: int = 10) -> DataFrame:
    """(context, total, package, n, rank): the external packages used most in each context."""
    rows = dependencies.filter("is_external").join(files.select(F.col("path").alias("source"), "kind"), "source")
    counts = rows.groupBy(P.external_context("source", "kind", "target").alias("context"), F.col("target").alias("package")).agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.groupBy("context").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("context").orderBy(F.desc("n"), "package")
    top = counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return top.join(all_, "context").select("context", "total", "package", "n", "rank")


def component_summary(components: DataFrame) -> DataFrame:
    """One row: components, mean of their JSX nodes, and how many use at least two hooks."""
    return components.agg(F.count(F.lit(1)).alias("components"), F.coalesce(fixed(F.avg("jsx"), 1), F.lit(0.0)).alias("mean_jsx"), F.count_if(F.col("hook_count") >= 2).alias("hook_heavy"))


def hook_heavy(components: DataFrame, limit: int = 10) -> DataFrame:
    return components.filter("hook_count >= 2").orderBy(F.desc("hook_count"), "path", "start_line", "name").limit(limit).select("path", "name", "hook_count")


def hook_usage(hooks: DataFrame, visible: int = 5) -> DataFrame:
    """(path, usage): the hooks of a file, those used most first, as 'name×count', and how many more there are."""
    counts = hooks.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), "name")
    ranked = counts.withColumn("r", F.row_number().over(w)).withColumn("text", F.when(F.col("n") > 1, F.concat("name", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("name")))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= visible, F.struct("r", "text")))), lambda s: s["text"]), ", ")
    rest = F.count_if(F.col("r") > visible)
    return ranked.groupBy("path").agg(F.concat(shown, F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"))).otherwise("")).alias("usage"))


def high_responsibility(files: DataFrame, components: DataFrame) -> DataFrame:
    """(path, name, start_line, text) of components that do too much."""
    rows = components.join(files.filter(F.col("kind").isin(*P.RESPONSIBLE)).select("path"), "path", "left_semi")
    text = F.format_string("%s: hooks=%d, jsx=%d, render=%d", "name", "hook_count", "jsx", "render")
    return rows.filter("hook_count >= 4 OR jsx >= 12 OR render >= 5").select("path", "name", "start_line", text.alias("text"))


def fan_in(dependencies: DataFrame) -> DataFrame:
    """(path, fan_in): internal statements that name a file."""
    return dependencies.filter("NOT is_external").groupBy(F.col("target").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))


def type_escapes(files: DataFrame, types: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(path, kind, score, reasons) of strictly checked files: escapes by weight, kind and fan-in."""
    j = files.filter(P.is_strict_target("kind")).join(types, "path", "left").join(fan_in(dependencies), "path", "left").fillna(0, [*TYPE_COUNTS, "fan_in"])
    raw = E.bare_assertions("assertion", "unsafe", "double", "const") * F.lit(BARE_ESCAPE)
    for c, weight in ESCAPES.items():
        raw = raw + F.col(c) * weight
    score = fixed(raw * P.escape_weight("kind") * (1 + F.least(F.lit(1.5), F.col("fan_in") * 0.15)))
    named = {"any": "any_count", "unsafeAssertion": "unsafe", "doubleAssertion": "double", "nonNull": "non_null", "tsIgnore": "ts_ignore", "tsExpectError": "ts_expect", "tsNoCheck": "ts_nocheck", "fanIn": "fan_in"}
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in named.items()]))
    return j.select("path", "kind", score.alias("score"), reasons.alias("reasons"))


def type_escape_stats(escapes: DataFrame) -> DataFrame:
    """One row: total and mean score, files of high risk (8 and more), and files."""
    return escapes.agg(
        F.coalesce(fixed(F.sum("score")), F.lit(0.0)).alias("total_score"), F.coalesce(fixed(F.avg("score")), F.lit(0.0)).alias("mean_score"),
        F.count_if(F.col("score") >= 8).alias("high_risk"), F.count(F.lit(1)).alias("files"),
    )


def skip_groups(skipped: DataFrame, examples: int = 3) -> DataFrame:
    """skipped (seq, path, reason) -> (class, grp, n, examples): skips by class, configured ones by group, with the first paths."""
    kind = P.skip_class("path", "reason")
    rows = skipped.select("seq", "path", kind.alias("class"), F.when(kind == "configured", P.skip_group("path")).otherwise("").alias("grp"))
    w = Window.partitionBy("class", "grp").orderBy("seq")
    first = rows.withColumn("r", F.row_number().over(w))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.struct("r", "path")))), lambda s: s["path"])
    return first.groupBy("class", "grp").agg(F.count(F.lit(1)).alias("n"), F.array_join(shown, ", ").alias("examples"))
