"""Entry points: a project folder from scan to reports, its graph, its difference to a stored snapshot, and its quality."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators import audit as U
from tallyforge.operators import evidence as V
from tallyforge.operators import facts as A
from tallyforge.operators import graph as G
from tallyforge.operators import impact as I
from tallyforge.operators import lookup as L
from tallyforge.operators import metrics as M
from tallyforge.operators import quality as Q
from tallyforge.operators.diff import merge_edges
from tallyforge.operators.graph import cut
from tallyforge.operators.lookup import ALIASES
from tallyforge.sources import artifacts as R
from tallyforge.sources import config as C
from tallyforge.sources import evidence_files as D
from tallyforge.sources import extract as X
from tallyforge.sources import reports as W
from tallyforge.sources import scan as S
from tallyforge.sources import state as T
from tallyforge.sources.sinks import dot_lines, graph_json


@dataclass
class Artifacts:
    """What is known of a project; every table is stored and read again."""

    root: str
    config: dict
    listed: DataFrame
    sources: DataFrame  #: with what patterns find in their texts
    nested: DataFrame  #: nested facts of each file
    files: DataFrame
    functions: DataFrame
    components: DataFrame
    hooks: DataFrame
    dependencies: DataFrame  #: resolved, with names and places
    types: DataFrame
    scored: DataFrame
    statements: DataFrame  #: those that make the graph
    texts_of: dict[str, str]  #: configuration files by path
    stats: dict[str, int]  #: files in all, opened, parsed and resolved again, and reused (hits)
    changed: DataFrame | None  #: (id) of the files that the last run did not know like this; None without a last run

    @property
    def in_scope(self) -> DataFrame:
        """Files of the configured scope; the others are known only as evidence of tests."""
        return self.files.filter(P.in_scope("kind", self.config["analysisScope"]))


def _small_texts(spark: SparkSession, root: str, paths: list[str]) -> dict[str, str]:
    """Texts of a few named files of the project."""
    if not paths:
        return {}
    base = root.rstrip("/") + "/"
    rows = spark.read.text([base + p for p in paths], wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()  # files named one by one
    return {p: r["value"] for r in rows for p in paths if r["path"].endswith("/" + p)}


FACTS = ("imports", "functions", "components", "hooks", "types", "has_tests", "rendered", "texts", "raw_html")
TEXT_FACTS = ("total_lines", "code_lines", "comment_lines", "imports_zod", "patient", "mocks", "handlers", "secrets")
RESOLVED = ("source", "target", "type", "is_type_only", "is_external", "module", "line", "column", "start", "names", "bases")


def _state_folder(root: str, config: dict, package: str | None) -> str:
    """Where a project's state is kept: under the configured folder (relative ones below the project), by its package's name and the scope."""
    place = config["cacheDir"]
    place = place if re.match(r"^([a-z]+:|/)", place) else f"{root.rstrip('/')}/{place.removeprefix('./')}"
    name = C.cache_identity(package, config.get("tsConfigPath") or "")
    return f"{place}/state-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def _own_folder(root: str, config: dict) -> list[str]:
    """A pattern for the folder that holds the state, if it lies in the project: what is kept there is no part of it."""
    place, base = config["cacheDir"].removeprefix("file:"), S.W.place_of(root) + "/"
    place = place.removeprefix(base).removeprefix("./").rstrip("/")
    return [f"^{re.escape(place)}(/|$)"] if place and not re.match(r"^([a-z]+:|/)", place) else []


def _contexts(spark: SparkSession, texts: dict[str, str], fallback: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(place, context) and lookup.ALIASES of every configuration, and of none (the empty place): parsed once, a few letters each."""
    rows, aliases = [("", C.context_hash(None, fallback))], [("", k, v) for k, v in fallback.items()]
    for place in texts:
        own = _primary(texts, place)
        known = {**fallback, **(C.aliases_of(own) if own else {})}
        rows.append((place, C.context_hash(own, known)))
        aliases += [(place, k, v) for k, v in known.items()]
    return spark.createDataFrame(rows, "place string, context string"), spark.createDataFrame(aliases, ALIASES)


def build(spark: SparkSession, root: str, config: dict | None = None, all_scopes: bool = False) -> Artifacts:
    """Scan a project and put its facts together; what the last run stored of unchanged files is not read or parsed again.

    A file whose size and time are as stored is not opened; one that was touched but has the same text is not parsed. Its
    statements are resolved again only if its configuration changed, or if a file came or went that one of its module
    paths may mean. A run that finds nothing new writes no state.
    """
    config = C.merged(config)
    scope = "all" if all_scopes else config["analysisScope"]
    listed = cut(S.listing(spark, root, [*config["excludePatterns"], *_own_folder(root, config)], scope, config["maxFileSizeBytes"]), "listing")
    every = listed.filter("reason IS NULL").select("path")
    wanted = S.sources_of(listed).select("path", "kind", "byte_size", "mtime")
    named = every.filter(F.col("path").rlike(r"(^|/)(jsconfig\.json|tsconfig(\.[^./]+)*\.json)$") | (F.col("path") == "package.json"))
    texts = _small_texts(spark, root, [r["path"] for r in named.collect()])  # one for each configuration
    package = texts.pop("package.json", None)
    fallback = {k: [v] if isinstance(v, str) else list(v) for k, v in config["pathMappings"].items()}
    contexts, aliases = _contexts(spark, texts, fallback)
    owners = L.nearest_places(wanted, contexts.filter("place <> ''")).select("path", F.coalesce("place", F.lit("")).alias("place"))
    owners = cut(owners.join(F.broadcast(contexts), "place"), "owners")  # contexts: one row for each configuration

    store = T.StateStore(spark, _state_folder(root, config, package)) if config["enableCache"] else None
    last = store.read("files", "paths") if store else None
    old = last["files"].filter((F.col("readers") == T.READERS)).join(wanted.select("path"), "path", "left_semi") if last else None
    read = cut(T.to_read(wanted, old), "to_read")
    since = read.agg(F.min("mtime")).first()[0]
    sources = cut(S.source_files(spark, root, config["excludePatterns"], config["maxFileSizeBytes"], scope, read, since), "sources")
    if old is not None:
        touched = cut(sources.select("path", "sha256", "byte_size", "mtime").join(old.select("path", "sha256"), ["path", "sha256"], "left_semi"), "touched")
        kept = old.join(wanted.select("path", "byte_size", "mtime"), ["path", "byte_size", "mtime"], "left_semi").select("path", "sha256", "byte_size", "mtime")
        kept = kept.unionByName(touched.select("path", "sha256", "byte_size", "mtime"))
        parse = sources.join(touched.select("path"), "path", "left_anti")
    else:
        parse = sources
    fresh = X.source_facts(parse).join(X.text_facts(parse), "path").join(parse.select("path", "sha256", "byte_size", "mtime"), "path")
    columns = ["path", "sha256", "byte_size", "mtime", *FACTS, *TEXT_FACTS]
    fresh = cut(fresh.select(*columns), "fresh")
    facts = fresh if old is None else fresh.unionByName(old.select("path", *FACTS, *TEXT_FACTS).join(kept, "path").select(*columns))
    facts = cut(facts.join(wanted.select("path", "kind"), "path").join(owners, "path"), "facts")

    stale = facts.select("path")
    if old is not None:
        before = old.select("path", F.inline("resolved"))
        moved = T.stale_importers(before, T.moved_bases(last["paths"], every))
        other = facts.select("path", "context").join(old.select("path", "context"), ["path", "context"], "left_anti").select("path")
        stale = cut(fresh.select("path").unionByName(moved).unionByName(other).distinct(), "stale")
    again = X.statements(facts.join(stale, "path", "left_semi")).join(facts.select("path", "place"), "path")
    deps = X.resolved(again, every, aliases, with_bases=True).select(*RESOLVED)
    if old is not None:
        deps = deps.unionByName(before.join(stale, "path", "left_anti").join(facts.select("path"), "path", "left_semi").select(*RESOLVED))
    deps = cut(deps, "dependencies")

    counts = {"files": facts.count(), "read": sources.count(), "parsed": fresh.count(), "resolved": stale.join(facts.select("path"), "path", "left_semi").count()}
    gone = last["files"].join(wanted.select("path"), "path", "left_anti").count() if last else 0
    if store and (last is None or counts["read"] or counts["resolved"] or gone or T.moved_bases(last["paths"], every).limit(1).count()):
        rows = deps.groupBy(F.col("source").alias("of")).agg(F.collect_list(F.struct(*RESOLVED)).alias("resolved"))
        none = F.array().cast(rows.schema["resolved"].dataType)
        state = facts.join(rows, F.col("path") == F.col("of"), "left").withColumn("resolved", F.coalesce("resolved", none))
        state = state.select(F.lit(T.SCHEMA).alias("schema"), F.lit(T.READERS).alias("readers"), *columns, "context", "resolved")
        store.write({"files": state, "paths": every})
    stats = {"hits": counts["files"] - counts["parsed"], "misses": counts["parsed"], **counts, "removed": gone}

    files = cut(facts.select("path", "kind", "sha256", *TEXT_FACTS), "files")
    nested = facts.select("path", *FACTS)
    tables = {"functions": X.functions(nested), "components": X.components(nested), "hooks": X.hooks(nested), "types": X.types(nested)}
    deps = deps.drop("bases")
    plain = files.select("path", "kind", "sha256", "total_lines", "code_lines", "comment_lines")
    scored = cut(A.scored_files(plain, tables["functions"], tables["components"], tables["hooks"], deps, tables["types"]), "scored")
    statements = cut(G.project_graph(files.filter(P.in_scope("kind", config["analysisScope"])), deps), "statements")
    return Artifacts(root, config, listed, files, nested, plain, **tables, dependencies=deps, scored=scored, statements=statements, texts_of=texts, stats=stats, changed=None if old is None else stale.select(F.col("path").alias("id")))


def _primary(texts: dict[str, str], place: str) -> C.TsConfig | None:
    """The configuration at a place, or of a solution the first that has paths."""
    found = C.leaves(texts, place)
    return next((c for c in found if c.options.get("paths")), found[0] if found else None)


def graph_facts(a: Artifacts) -> dict[str, DataFrame]:
    """Edges, nodes with degrees and rank, components, cycles, totals, top lists and warnings of the graph."""
    edges = cut(G.collapse_edges(a.statements, "source", "target", "type"), "edges")
    pairs = edges.select("source", "target")
    strong = cut(G.strong_components(pairs), "strong")
    nodes = cut(G.degrees(pairs).join(G.pagerank(pairs), "id"), "nodes")
    totals, tops = G.graph_totals(pairs, strong), G.top_degrees(nodes)
    return {
        "edges": edges, "nodes": nodes, "strong": strong, "weak": G.weak_components(pairs), "cycles": G.cycles(pairs, strong), "totals": totals, "tops": tops,
        "warnings": G.graph_warnings(totals, tops), "cuts": G.cut_candidates(a.statements, strong, a.files), "ranks": nodes.orderBy(F.desc("page_rank"), "id").limit(10).select("id", "page_rank"),
    }


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file, wherever Spark can write."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _snapshot(a: Artifacts, g: dict[str, DataFrame], out: str) -> None:
    c = a.config
    scored = a.scored.filter(P.in_scope("kind", c["analysisScope"])).join(A.file_warnings(a.scored, c["complexityThreshold"]), "path")
    scored.write.mode("overwrite").parquet(f"{out}/files")
    A.hot_spots(scored, c["complexityThreshold"], 5).write.mode("overwrite").parquet(f"{out}/hot_spots")
    for name in ("edges", "nodes", "warnings", "totals"):
        g[name].write.mode("overwrite").parquet(f"{out}/{name}")


def analyze(spark: SparkSession, root: str, out: str, config: dict | None = None, prefix: str | None = None) -> Artifacts:
    """Write the report of a project under out: snapshot tables, a JSON summary, CSV tables, Markdown and HTML by the configured formats."""
    a = build(spark, root, config)
    name = f"{out.rstrip('/')}/{prefix or a.config['filePrefix']}"
    g = graph_facts(a)
    _snapshot(a, g, f"{name}_report")
    scored = spark.read.parquet(f"{name}_report/files")
    affected = a.stats["files"] if a.changed is None else G.dependents(g["edges"], a.changed).count() if a.stats["resolved"] else 0
    threshold, formats = a.config["complexityThreshold"], set(a.config["outputFormats"])
    totals, hot = A.totals(scored).first().asDict(), spark.read.parquet(f"{name}_report/hot_spots").orderBy("rank")
    findings = cut(U.purpose_findings(scored, a.components, a.dependencies, threshold), "findings")
    if formats & {"json", "all"}:
        summary = {
            "schemaVersion": D.REPORT_VERSION, "timestamp": datetime.now(UTC).isoformat(), "statistics": totals, "files": [f"{os.path.basename(name)}_report/files"],
            "graph": g["totals"].first().asDict(), "riskSummary": {r["axis"]: r.asDict() for r in A.risk_levels(scored).collect()}, "typeSafety": A.type_safety_totals(scored).first().asDict(),
            "analysisCacheStats": {k: a.stats[k] for k in ("hits", "misses")}, "incrementalStats": {"reusedFiles": a.stats["hits"], "recomputedFiles": a.stats["misses"], "resolvedFiles": a.stats["resolved"], "affectedFiles": affected},
            "topHotSpots": [r.asDict() for r in hot.collect()], "directoryPurposeAudit": U.purpose_counts(findings).first().asDict(),
        }
        _write_text(spark, f"{name}_report.json", json.dumps(summary, ensure_ascii=False, indent=2, default=str))
    if formats & {"csv", "all"}:
        W.write_lines(W.files_csv(scored), W.FILE_HEADERS, f"{name}_files.csv")
        W.write_lines(W.dependencies_csv(a.dependencies), W.DEPENDENCY_HEADERS, f"{name}_dependencies.csv")
        W.write_lines(W.components_csv(a.components), W.COMPONENT_HEADERS, f"{name}_components.csv")
        W.write_lines(W.hooks_csv(a.hooks), W.HOOK_HEADERS, f"{name}_hooks.csv")
    if formats & {"markdown", "html", "all"}:
        skipped = S.skipped_files(a.listed).withColumn("seq", F.col("path"))
        sections = {
            "Hot spots": W.markdown_table(hot, {"path": "file", "score": "score", "severity": "severity", "cluster": "cluster", "reasons": "reasons", "action": "action"}),
            "Totals": "\n".join(f"- {k}: {v}" for k, v in totals.items()),
            "Type safety": W.markdown_table(A.worst_type_safety(scored), {"path": "file", "score": "score", "share": "%"}),
            "Dependencies": W.markdown_table(g["totals"], {"nodes": "nodes", "edges": "edges", "cycles": "cycles", "components": "components", "largest": "largest"})
            + "\n" + W.markdown_table(g["warnings"], {"warning": "warning", "id": "module", "value": "value"}) + "\n" + W.markdown_table(g["cuts"], {"source": "from", "target": "to", "type": "type", "shared": "share"}, 10)
            + "\n" + W.markdown_table(A.external_groups(a.files, a.dependencies).orderBy("context", "rank"), {"context": "context", "package": "package", "n": "uses"}, 40)
            + "\n" + W.markdown_table(G.structure_rows(g["tops"], g["ranks"]), {"aspect": "aspect", "id": "module", "value": "value"}),
            "File types": W.markdown_table(A.kind_distribution(scored).orderBy(F.desc("n"), "kind"), {"kind": "type", "n": "files", "share": "%", "mean_complexity": "complexity", "phrase": "risk"}),
            "Purposes": W.markdown_table(U.purpose_report(findings).orderBy("position"), {"path": "file", "kind": "type", "severity": "severity", "rule": "rule", "n": "findings"}),
            "Clusters": W.markdown_table(scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster"), {"cluster": "cluster", "n": "files"}),
            "Components": W.markdown_table(A.component_summary(a.components), {"components": "components", "mean_jsx": "mean JSX"}) + "\n" + W.markdown_table(A.hook_heavy(a.components), {"name": "component", "path": "file", "hook_count": "hooks"}),
            "Scan": W.markdown_table(A.skip_groups(skipped).orderBy("class", "grp"), {"class": "class", "grp": "group", "n": "skips", "examples": "examples"}),
            "Risks": W.markdown_table(A.risk_levels(scored).orderBy("axis"), {"axis": "axis", "low": "low", "medium": "medium", "high": "high"}),
        }
        text = W.page("Static analysis", sections)
        if formats & {"markdown", "all"}:
            _write_text(spark, f"{name}_report.md", text)
        if formats & {"html", "all"}:
            drawn = G.drawn_nodes(g["edges"].select("source", "target"))
            script = f'<script type="application/json" id="graph">{W.graph_script(g["nodes"].orderBy("id"), drawn)}</script>'
            _write_text(spark, f"{name}_report.html", W.html_page(text).replace("</body>", script + "</body>"))
    return a


def graph(spark: SparkSession, root: str, out: str, config: dict | None = None) -> DataFrame:
    """Write a project's graph as JSON lines and DOT under out, and without cycles the order of its modules; gives its totals."""
    a = build(spark, root, config)
    g, name = graph_facts(a), f"{out.rstrip('/')}/{a.config['filePrefix']}"
    lines = graph_json(g["nodes"], g["edges"])
    lines.select("json").write.mode("overwrite").text(f"{name}_graph.json")
    order = G.topological_order(g["edges"])
    if order is not None:
        order.write.mode("overwrite").parquet(f"{name}_graph_order")
    dots = dot_lines(g["nodes"].select("id", "in_degree"), g["edges"])
    ends = spark.createDataFrame([(-1, "digraph dependencies {"), (9, "}")], "part int, line string")
    dots.unionByName(ends).orderBy("part", "line").coalesce(1).select("line").write.mode("overwrite").text(f"{name}_graph.dot")
    return g["totals"]


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that analyze() stored under a path; the summary beside it must be of an analysis."""
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}.json").collect())
    D.baseline(text, "analysis")
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("files", "hot_spots", "edges", "nodes", "warnings", "totals")}


def diff(spark: SparkSession, root: str, baseline: str, out: str, config: dict | None = None) -> DataFrame:
    """Analyse a project again beside a stored snapshot (as <prefix>_current) and write the difference; gives the row of the gate."""
    config = {**(config or {}), "outputFormats": ["json", *(config or {}).get("outputFormats", [])]}
    b = read_snapshot(spark, baseline)
    prefix = C.merged(config)["filePrefix"]
    a = analyze(spark, root, out, config, f"{prefix}_current")
    c = read_snapshot(spark, f"{out.rstrip('/')}/{prefix}_current_report")
    name = f"{out.rstrip('/')}/{prefix}_diff"
    changes = cut(I.file_changes(c["files"], b["files"]), "changes")
    changes.write.mode("overwrite").parquet(f"{name}/files")
    hot = cut(I.hot_spot_changes(c["hot_spots"], b["hot_spots"]), "hot")
    hot.write.mode("overwrite").parquet(f"{name}/hot_spots")
    edges = cut(merge_edges(*[s["edges"].select("source", "target", "weight") for s in (c, b)]).select("source", "target"), "merged")
    roots = changes.filter("status <> 'unchanged'").select("path")
    pressures = I.pressure(c["files"], b["files"])
    listed = cut(I.impacted(edges, roots, pressures), "impacted_files")
    listed.write.mode("overwrite").parquet(f"{name}/impacted")
    I.subtrees(edges, roots, pressures).write.mode("overwrite").parquet(f"{name}/subtrees")
    threshold = a.config["impactScoreThreshold"]
    gate = cut(I.impact_gate(listed, threshold, a.config["failOnImpactThreshold"]), "impact_gate")
    counts = I.summary(changes)
    sections = {
        "Verdict": W.markdown_table(I.headline(counts, gate, threshold), {"headline": "verdict", "max_score": "highest score", "violations": "above the threshold"})
        + "\n" + W.markdown_table(counts, {"added": "added", "removed": "removed", "changed": "changed", "unchanged": "unchanged"}),
        "Hot spots": W.markdown_table(hot.orderBy(F.desc(F.abs("d_score")), "path"), {"path": "file", "status": "status", "d_score": "score", "cluster_before": "before", "cluster_after": "after", "drivers": "drivers"}, 10),
        "Impact": W.markdown_table(listed.orderBy(F.desc("score"), "path"), {"path": "file", "score": "score", "distance": "distance", "in_degree": "in", "out_degree": "out", "reasons": "reasons"}, 10),
        "Changed files": W.markdown_table(changes.filter("status <> 'unchanged'").orderBy("path"), {"path": "file", "status": "status", "d_complexity": "complexity", "d_dependencies": "dependencies", "warnings": "warnings"}, 50),
    }
    text = W.page("Difference to the baseline", sections)
    summary = {"baseline": baseline, "generatedAt": datetime.now(UTC).isoformat(), "summary": counts.first().asDict(), "gate": gate.first().asDict()}
    _write_text(spark, f"{name}.json", json.dumps(summary, ensure_ascii=False, indent=2))
    _write_text(spark, f"{name}.md", text)
    _write_text(spark, f"{name}.html", W.html_page(text))
    return gate


def _test_files(a: Artifacts) -> DataFrame:
    """Files that hold tests: by a call of a test function, or by name and a framework's import."""
    known = a.config["testPresenceSettings"]["knownFrameworkModules"]
    framework = a.dependencies.filter(F.col("is_external") & F.col("target").isin(*known)).select(F.col("source").alias("path")).distinct().withColumn("framework", F.lit(True))
    rows = a.files.select("path").join(a.nested.select("path", "has_tests"), "path").join(framework, "path", "left")
    return rows.filter(P.is_executable_test("path", "has_tests", "framework")).select("path")


def quality_facts(spark: SparkSession, a: Artifacts) -> dict:
    """The facts row of the metrics as a dictionary; sources that were not found are left out."""
    present = cut(S.evidence_paths(spark, a.root, a.listed, D.TOPS), "present")
    paths = [r["path"] for r in D.evidence(present).collect()]  # reports and their like
    odd = spark.createDataFrame([], "path string, kind string, warning string")
    base, settings = a.root.rstrip("/") + "/", a.config["testPresenceSettings"]

    def texts(kind: str) -> DataFrame | None:
        found = [base + p for p in D.find(paths, kind) if p in paths]
        return R.texts(spark, *found) if found else None

    out: dict = {}
    files, deps = a.in_scope, a.dependencies
    visual = U.visual_consumers(files, a.components, X.rendered_imports(a.nested, deps))
    out |= visual.agg(F.count(F.lit(1)).alias("visual_total"), F.count_if("backed").alias("visual_backed"), F.count_if(~F.col("backed")).alias("bespoke")).first().asDict()
    escapes = A.type_escape_stats(A.type_escapes(files, a.types, deps)).first()
    out |= {"escape_total": escapes["total_score"], "escape_mean": escapes["mean_score"], "escape_high": escapes["high_risk"]}
    out["responsible"] = A.high_responsibility(files, a.components).count()
    out["cycles"] = G.cycles(a.statements, G.strong_components(a.statements)).count()
    strict = C.strictness([c for p in a.texts_of for c in C.leaves(a.texts_of, p) if c.files is not None or c.include is not None or os.path.basename(p) in ("tsconfig.json", "jsconfig.json")])
    out |= {k: strict[k] for k in ("configs", "strict_configs", "fully_strict_configs")} if strict else {}
    out["type_check_skipped"] = True  # the compiler is not run

    lines, junit = [base + p for p in D.find(paths, "lcov")], texts("junit")
    lines = R.lcov_records(spark, *lines) if lines else None
    records = R.lcov(lines).select(F.col("file").alias("path"), F.col("lines_found").alias("line_found"), F.col("lines_hit").alias("line_hit")) if lines else spark.createDataFrame([], "path string, line_found int, line_hit int")
    if lines:
        out |= {"lcov_files": lines.select("path").distinct().count(), "line_coverage": R.coverage(R.lcov(lines)).first()["percent"]}
    if junit and (counts := R.junit(junit).agg(*[F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped")]).first())["total"] is not None:
        out |= {f"junit_{k}": v for k, v in counts.asDict().items()}
    if junit:
        odd = odd.unionByName(R.warnings(junit, "junit"))
    ran = spark.createDataFrame([], "path string, label string")
    for kind, prefix in (("playwright", "e2e"), ("storybook", "storybook")):
        found = texts(kind)
        if found:
            tests = cut(D.ui_tests(found, kind), "ui_tests")
            counts = D.run_summary(tests).first()
            odd = odd.unionByName(tests.filter("warning IS NOT NULL").select("path", F.lit(kind).alias("kind"), F.lit("not JSON").alias("warning")))
            out |= {f"{prefix}_{k}": v for k, v in counts.asDict().items()} if counts["total"] is not None else {}
            if kind == "playwright":
                ran = ran.unionByName(tests.filter("files IS NOT NULL").select(F.explode("files").alias("path"), F.lit("playwright").alias("label")))
    package = _small_texts(spark, a.root, ["package.json"]).get("package.json") if not a.listed.filter("path = 'package.json' AND reason IS NULL").isEmpty() else None
    out["vitest"] = D.vitest(paths + [r["path"] for r in a.files.filter("path LIKE 'vitest.%'").select("path").collect()], package) is not None
    matches = cut(V.test_matches(a.files.join(files.select("path"), "path", "left_semi"), _test_files(a), deps, records, ran, settings["runtimeLineCoverageMinPercent"], settings["staticImportTraversalMaxDepth"]), "matches")
    whole = V.presence(matches).first()
    out |= {"presence_targets": whole["targets"], "presence_rate": whole["rate"] or 0.0}
    by_bucket = {r["bucket"]: r for r in V.presence(matches, "bucket").collect()}
    for b in ("route", "feature", "form", "ui"):
        out |= {f"{b}_targets": by_bucket[b]["targets"] if b in by_bucket else 0, f"{b}_rate": by_bucket[b]["rate"] if b in by_bucket else 0.0}

    axe, light, diffs = texts("axe"), texts("lighthouse"), texts("openapi-diff")
    axe, light = (cut(D.results(t, kind), "results") if t else None for kind, t in (("axe", axe), ("lighthouse", light)))
    for kind, found in (("axe", axe), ("lighthouse", light)):
        odd = odd.unionByName(found.filter("warning IS NOT NULL").select("path", F.lit(kind).alias("kind"), "warning")) if found else odd
    odd = odd.unionByName(R.warnings(diffs, "openapi-diff")) if diffs else odd
    if axe and not (found := R.axe(axe)).isEmpty():
        sums = found.agg(*[F.sum(c).alias(c) for c in ("critical", "serious", "moderate", "minor")]).first()
        out |= {"axe_critical": sums["critical"], "axe_serious": sums["serious"], "axe_total": sum(sums)}
    if light:
        worst = R.lighthouse(light).first()
        out |= {"lighthouse_files": light.filter("warning IS NULL").select("path").distinct().count(), "lh_score": worst["score"], "lh_lcp": worst["lcp_s"], "lh_tti": worst["tti_s"]}
    out["openapi_specs"] = len(D.find(paths, "openapi-spec"))
    if diffs:
        out["openapi_breaking"] = R.openapi_breaking(diffs).agg(F.sum("breaking")).first()[0]
    audit_texts = {tool: t for tool in ("npm-audit", "trivy") if (t := texts(tool))}
    for tool, t in audit_texts.items():
        odd = odd.unionByName(R.warnings(t, tool))
    audits = [(tool, r) for tool, read in (("npm-audit", R.npm_audit), ("trivy", R.trivy)) if tool in audit_texts for r in read(audit_texts[tool]).orderBy("path").collect()]
    if audits:
        out |= {"audit_text": ", ".join(f"{tool}(critical={r['critical']},high={r['high']})" for tool, r in audits), "audit_severe": any(r["critical"] or r["high"] for _, r in audits)}
    sources = a.sources.join(files.select("path"), "path", "left_semi")
    signals = X.api_signals(sources).first().asDict()
    out |= {k: signals[k] for k in ("api_files", "resilient_files", "msw_handlers")} | {k: v for k, v in X.zod_use(sources).first().asDict().items() if k != "adopted"}
    nested = a.nested.join(files.select("path"), "path", "left_semi")
    out |= {"dangerous_html": X.raw_html(nested).count(), "secrets": sources.agg(F.coalesce(F.sum(F.size("secrets")), F.lit(0))).first()[0], "product_texts": X.shown_texts(nested).filter("scope = 'product'").count()}
    out |= {"docs": len(D.find(paths, "docs")), "ci": bool(D.find(paths, "ci")), "packages": deps.join(files.select(F.col("path").alias("source")), "source", "left_semi").filter("is_external").select("target").distinct().count()}
    out["warnings"] = odd
    return out


def quality(
    spark: SparkSession, root: str, out: str, mode: str = "collect", baseline: str | None = None, config: dict | None = None, failures: list[tuple[str, int, str]] | None = None
) -> DataFrame:
    """Collect a project's quality metrics, write them under out, compare them with a stored report in modes diff and gate; gives the gate's row.

    failures (phase, order, reason) name collection phases that failed; their metrics are manual. Manual evidence is
    read from quality.manual.json of the project, or the configured path.
    """
    a = build(spark, root, config, all_scopes=True)
    c = a.config
    known = quality_facts(spark, a)
    row = {k: v for k, v in known.items() if k in M.FACTS}
    facts = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {M.FACTS[k]}" for k in row))
    metrics = M.build_metrics(facts, c["qualityProfile"])
    listed = {r["path"] for r in a.listed.filter("path = 'quality.manual.json'").select("path").collect()}
    text = _small_texts(spark, root, ["quality.manual.json"]).get("quality.manual.json") if listed and not c["manualInputPath"] else None
    if c["manualInputPath"]:
        text = "\n".join(r["value"] for r in spark.read.text(c["manualInputPath"]).collect())
    if text:
        entries = [(e["id"], i, e["verdict"]) for i, e in enumerate(D.manual_evidence(text)) if e["verdict"]]
        metrics = Q.with_manual(metrics, spark.createDataFrame(entries, "id string, seq int, verdict string"))
    if failures:
        metrics = Q.with_failures(metrics, M.phase_failures(spark.createDataFrame(failures, "phase string, seq int, reason string"))).drop("failure")
    metrics = cut(metrics, "metrics")
    checked = M.validate_gate(metrics, c["qualityGateBlockingMetricIds"], c["qualityGateMonitoringMetricIds"])
    if mode == "gate" and checked["blocking_all_unknown"]:
        raise C.ConfigError(f"none of the blocking metric ids is known: {', '.join(c['qualityGateBlockingMetricIds'])}")
    name = f"{out.rstrip('/')}/{c['filePrefix']}_quality_report"
    categories = Q.category_verdicts(metrics)
    metrics.write.mode("overwrite").parquet(f"{name}/metrics")
    categories.write.mode("overwrite").parquet(f"{name}/categories")
    odd = cut(known["warnings"].withColumn("path", F.regexp_replace("path", "^.*/(?=[^/]+$)", "")).distinct(), "odd")
    odd.write.mode("overwrite").parquet(f"{name}/warnings")
    overall = Q.overall_verdict(categories).first().asDict()
    summary = {"schemaVersion": D.REPORT_VERSION, "summary": overall, "categories": [r.asDict() for r in categories.orderBy("category").collect()], "coverage": M.coverage(metrics).first().asDict()}
    _write_text(spark, f"{name}.json", json.dumps(summary, ensure_ascii=False, indent=2))
    W.write_lines(M.csv_lines(metrics).orderBy("position"), W.QUALITY_HEADERS, f"{name}.csv", always=True)
    regressions = metrics.select("id").limit(0)
    if baseline and mode in ("diff", "gate"):
        D.baseline("\n".join(r["value"] for r in spark.read.text(f"{baseline}.json").collect()), "quality")
        old, old_categories = (spark.read.parquet(f"{baseline}/{t}") for t in ("metrics", "categories"))
        compared = cut(Q.quality_diff(metrics, old), "quality_diff")
        compared.join(M.metric_changes(metrics, old), ["category", "id"]).write.mode("overwrite").parquet(f"{name}_diff/metrics")
        M.category_changes(compared, categories, old_categories).write.mode("overwrite").parquet(f"{name}_diff/categories")
        regressions = Q.blocking_regressions(compared, c["qualityGateBlockingMetricIds"], c["qualityGateMonitoringMetricIds"])
    gate = cut(Q.gate(metrics, regressions), "gate")
    sections = {
        "Verdict": "\n".join(f"- {k}: {v}" for k, v in overall.items()), "Gate": W.markdown_table(gate, {"n_failing": "failing", "n_regressions": "regressions", "exit_code": "exit code"}),
        "Priorities": W.markdown_table(M.priorities(metrics).orderBy("rank"), {"category": "category", "id": "metric", "verdict": "verdict"}),
        "Categories": W.markdown_table(categories.orderBy("category"), {"category": "category", "verdict": "verdict", "n_metrics": "metrics"}),
        "Metrics": W.markdown_table(metrics.orderBy("position"), {"category": "category", "label": "metric", "actual": "actual", "threshold": "threshold", "verdict": "verdict"}, 200),
        "Waiting for evidence": W.markdown_table(M.pending(metrics).orderBy("category"), {"category": "category", "n": "metrics", "ids": "ids"}),
        "Files that gave no figures": W.markdown_table(odd.orderBy("kind", "path"), {"path": "file", "kind": "kind", "warning": "warning"}, 50),
    }
    text = W.page("Quality", sections)
    _write_text(spark, f"{name}.md", text)
    _write_text(spark, f"{name}.html", W.html_page(text))
    return gate
