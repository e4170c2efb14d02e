"""Audits of what files hold against what their kind is for, use of the shared component library, and workspace roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators.graph import cut

# Limits and ranks of the audit.
ROUTE_LIMIT, SHARED_LIMIT, SHARED_LINES = 12, 8, 40
SEVERITY = {"high": 0, "medium": 1, "low": 2}
REACT = r"^react(?:-dom)?(?:/|$)"


def limits(threshold: int | None = None) -> tuple[int, int, int]:
    """Limits of complexity for routes and shared files and of lines for shared files, from a configured threshold or by default."""
    if not threshold or threshold <= 0:
        return ROUTE_LIMIT, SHARED_LIMIT, SHARED_LINES
    return threshold, max(1, -(-threshold * 2 // 3)), SHARED_LINES


def purpose_findings(scored: DataFrame, components: DataFrame, dependencies: DataFrame, threshold: int | None = None) -> DataFrame:
    """(path, kind, rule, severity, value): where a file's content does not fit its kind; value counts targets or gives the complexity.

    scored has path, kind, code_lines, complexity, n_functions, n_components and n_hooks.
    """
    route, shared, shared_lines = limits(threshold)
    run = dependencies.filter("NOT is_type_only")
    react = run.filter(F.col("is_external") & F.col("module").rlike(REACT)).select(F.col("source").alias("path")).distinct().withColumn("imports_react", F.lit(True))
    infra = run.filter("NOT is_external").withColumn("tk", P.file_kind("target")).filter("tk = 'API/Infrastructure'").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n_infra"))
    folder = F.element_at(F.split("path", "/"), -2)
    own = scored.filter("kind = 'Barrel'").select("path", F.when(F.size(F.split("path", "/")) > 1, folder).alias("folder"))
    own = own.filter(P.is_pascal("folder")).join(components.select("path", "name"), "path").filter("name = folder").select("path").distinct().withColumn("own_component", F.lit(True))
    j = scored.join(react, "path", "left").join(infra, "path", "left").join(own, "path", "left").fillna(False, ["imports_react", "own_component"]).fillna(0, ["n_infra"])
    kind, some_components, some_functions = F.col("kind"), F.col("n_components") > 0, F.col("n_functions") > 0
    uses_react = F.col("imports_react") | (F.col("n_hooks") > 0)
    none = F.lit(0).cast("long")
    rules = [
        ("component-in-non-ui-layer", "high", kind.isin("Utils", "API/Infrastructure") & some_components, none),
        ("react-in-data-layer", "high", kind.isin("Schema", "Validation") & (some_components | uses_react), none),
        ("implementation-in-barrel", "medium", (kind == "Barrel") & (some_functions | some_components) & ~F.col("own_component"), none),
        ("runtime-code-in-type-support", "medium", (kind == "Type Support") & (some_functions | some_components), none),
        ("ui-depends-on-infrastructure", "medium", kind.isin("UI component", "Layout") & some_components & (F.col("n_infra") > 0), F.col("n_infra")),
        ("heavy-logic-in-route", "medium", (kind == "Route") & (F.col("complexity") >= route), F.col("complexity")),
        ("jsx-in-hook", "medium", (kind == "Hook") & some_components, none),
        ("unclassified-shared-growth", "low", (kind == "Shared") & ((F.col("code_lines") >= shared_lines) | (F.col("complexity") >= shared)), F.col("complexity")),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), v.cast("long").alias("value"))) for r, s, when, v in rules]))
    return j.select("path", "kind", F.explode(found).alias("f")).select("path", "kind", "f.rule", "f.severity", "f.value")


def severity_rank(severity: Column | str) -> Column:
    return P.lookup(F.col(severity) if isinstance(severity, str) else severity, SEVERITY, 3)


def purpose_report(findings: DataFrame, limit: int = 20, many: int = 5) -> DataFrame:
    """(position, path, kind, rule, severity, n): findings in order of severity, path and rule; a rule with many findings takes one row, its first."""
    counts = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("k"))
    order = [severity_rank("severity"), F.col("path"), F.col("rule")]
    first = F.row_number().over(Window.partitionBy("rule").orderBy(*order))
    rows = findings.join(F.broadcast(counts), "rule").withColumn("r", first).filter((F.col("k") < many) | (F.col("r") == 1))
    rows = rows.select("path", "kind", "rule", "severity", F.when(F.col("k") >= many, F.col("k")).otherwise(1).alias("n"))
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def purpose_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY])


def library_backed(used: DataFrame) -> DataFrame:
    """used (source, target, module, is_external): imports whose names a file renders -> (path) of files that the shared component library backs, directly or through rendered files."""
    edges = cut(used.filter("NOT is_external").select("source", "target").distinct(), "ui_edges")
    done = cut(used.filter(P.is_design_system("module", "target")).select(F.col("source").alias("path")).distinct(), "ui_backed")
    front = done
    while not front.isEmpty():
        more = edges.join(front, edges["target"] == front["path"], "left_semi").select(F.col("source").alias("path")).distinct()
        front = cut(more.join(done, "path", "left_anti"), "ui_front")
        done = cut(done.unionByName(front), "ui_backed")
    return done


def visual_consumers(files: DataFrame, components: DataFrame, used: DataFrame) -> DataFrame:
    """(path, kind, backed, line) of screen files with components: whether the shared library backs them, and their first component's line."""
    first = components.groupBy("path").agg(F.min("start_line").alias("line"))
    backed = library_backed(used).withColumn("backed", F.lit(True))
    rows = files.filter(F.col("kind").isin(*P.VISUAL)).join(first, "path")
    return rows.join(backed, "path", "left").select("path", "kind", F.coalesce("backed", F.lit(False)).alias("backed"), "line")


def rollup(
    scored: DataFrame, escapes: DataFrame, matches: DataFrame, responsible: DataFrame, visual: DataFrame, texts: DataFrame, by: str
) -> DataFrame:
    """Files summed up by workspace segment or by feature.

    (id, label, files, components, mean_complexity, max_complexity, type_escapes, responsible, visual, backed, test_targets,
    matched, test_rate, product_texts). by is segment or feature; a feature counts strictly checked files only and its id
    is lower case. responsible (path), visual (path, backed) and texts (path, scope) have a row for each finding; all
    files have their kind in scored. Groups without files have no row.
    """
    kinds = scored.select("path", "kind")
    label = P.segment_id("path") if by == "segment" else P.feature_label("path", "kind")

    def grouped(df: DataFrame, *aggregates: Column) -> DataFrame:
        if "kind" not in df.columns:
            df = df.join(kinds, "path")
        return df.withColumn("id", F.lower(label)).filter("id IS NOT NULL").groupBy("id").agg(*aggregates)

    counted = scored if by == "segment" else scored.filter(P.is_strict_target("kind"))
    out = grouped(
        counted, F.min(label).alias("label"), F.count(F.lit(1)).alias("files"), F.sum("n_components").alias("components"), F.avg("complexity").alias("mean_complexity"), F.max("complexity").alias("max_complexity")
    )
    sides = [
        grouped(escapes.drop("kind"), F.sum(F.floor(F.col("score") + 0.5)).cast("long").alias("type_escapes")),
        grouped(responsible, F.count(F.lit(1)).alias("responsible")),
        grouped(visual.drop("kind"), F.count(F.lit(1)).alias("visual"), F.count_if("backed").alias("backed")),
        grouped(texts.filter("scope = 'product'"), F.count(F.lit(1)).alias("product_texts")),
        grouped(matches.select("path", "matched", "weight"), F.count(F.lit(1)).alias("test_targets"), F.count_if("matched").alias("matched"),
                (F.sum(F.when(F.col("matched"), F.col("weight")).otherwise(0)) / F.sum("weight") * 100).alias("test_rate")),
    ]
    for side in sides:
        out = out.join(side, "id", "left")
    return out.fillna(0)


def feature_order() -> list[Column]:
    """Features with most type escapes first, then those with most oversized components, then the most complex, then by label."""
    return [F.desc("type_escapes"), F.desc("responsible"), F.desc("max_complexity"), F.asc("label")]


def shows_segments(segments: DataFrame) -> DataFrame:
    """One row: whether at least two segments other than 'other' have files."""
    return segments.agg((F.count_if((F.col("id") != "other") & (F.col("files") > 0)) >= 2).alias("shown"))
