"""A small project on disk through the entry points, and the readers of settings and evidence files."""

import json

import pytest

from tallyforge.plans import analyze as Z
from tallyforge.sources import config as C
from tallyforge.sources import evidence_files as D
from tallyforge.sources import reports as W

FILES = {
    "tsconfig.json": '{ // strict\n "compilerOptions": {"strict": true, "baseUrl": ".", "paths": {"@/*": ["src/*"]}}, "include": ["src"], }',
    "package.json": '{"name": "small", "scripts": {"test": "vitest run"}, "devDependencies": {"vitest": "1"}}',
    "README.md": "x",
    "src/app/page.tsx": "import React from 'react'\nimport { Button } from '@/components/ui/Button'\nimport { load } from '../services/api'\nexport default function Page() { const [s] = React.useState(load() as any); return <Button title=\"Go\">{s && 'now'}</Button> }\n",
    "src/components/ui/Button.tsx": "export const Button = ({ children }) => <button>{children}</button>\n",
    "src/services/api.ts": "import { z } from 'zod'\nimport './loop'\nexport async function load() { try { return await fetch('/x') } catch (e) { return null } }\n",
    "src/services/loop.ts": "import { load } from './api'\nexport const again = () => load()\n",
    "src/services/api.test.ts": "import { load } from './api'\nimport { it } from 'vitest'\nit('works', () => load())\n",
    "node_modules/react/index.js": "module.exports = 1",
    "coverage/lcov.info": "SF:src/services/api.ts\nLF:4\nLH:3\nend_of_record\n",
    "reports/playwright.json": '{"suites": [{"specs": [{"tests": [{"status": "flaky", "location": {"file": "e2e/a.spec.ts"}}, {"results": [{"status": "failed"}, {"status": "passed"}]}]}]}]}',
    "audit.json": "{",
    "quality.manual.json": '{"figma_delta": {"verdict": "pass"}, "typescript_errors": {"verdict": "pass"}}',
}


@pytest.fixture
def project(tmp_path):
    for path, text in FILES.items():
        (tmp_path / "p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / path).write_text(text)
    return f"file:{tmp_path}/p", f"file:{tmp_path}/out", tmp_path


def test_analyze_and_diff(spark, project):
    root, out, tmp = project
    a = Z.analyze(spark, root, out, {"outputFormats": ["all"]})
    rows = {r["path"]: r for r in a.scored.collect()}
    assert set(rows) == {p for p in FILES if p.startswith("src/")}
    assert rows["src/app/page.tsx"]["kind"] == "Route" and rows["src/app/page.tsx"]["any_count"] == 1 and rows["src/services/api.ts"]["peak_cc"] == 2
    deps = {(r["source"], r["target"], r["is_external"]) for r in a.dependencies.collect()}
    assert ("src/app/page.tsx", "src/components/ui/Button.tsx", False) in deps and ("src/services/api.ts", "zod", True) in deps
    assert {(r["path"], r["reason"]) for r in Z.S.skipped_files(a.listed).collect()} == {("node_modules", "Excluded pattern match"), ("coverage", "Excluded pattern match")}
    files = "\n".join(p.read_text() for p in sorted((tmp / "out/analysis_files.csv").glob("part*")))
    assert files.startswith(",".join(W.FILE_HEADERS)) and "src/services/api.ts,API/Infrastructure,Yes,S1," in files
    report = json.loads((tmp / "out/analysis_report.json").read_text())
    assert report["statistics"]["files"] == 5 and report["graph"]["cycles"] == 1
    assert "# Static analysis" in (tmp / "out/analysis_report.md").read_text() and "<table>" in (tmp / "out/analysis_report.html").read_text()

    (tmp / "p/src/services/loop.ts").write_text("import { load } from './api'\nexport const again = (a) => a ? (a > 1 ? load() : 1) : a && 2\n")
    (tmp / "p/src/extra.ts").write_text("export const x = 1\n")
    gate = Z.diff(spark, root, f"{out}/analysis_report", out, {"impactScoreThreshold": 100, "failOnImpactThreshold": True}).first()
    assert gate["exit_code"] == 2
    changes = {r["path"]: r["status"] for r in spark.read.parquet(f"{out}/analysis_diff/files").collect()}
    assert changes["src/extra.ts"] == "added" and changes["src/services/loop.ts"] == "changed" and changes["src/services/api.ts"] == "unchanged"
    reached = {r["path"]: r for r in spark.read.parquet(f"{out}/analysis_diff/impacted").collect()}
    assert reached["src/services/api.ts"]["distance"] == 1 and "changed" in reached["src/services/loop.ts"]["reasons"]


def test_graph_and_quality(spark, project):
    root, out, tmp = project
    totals = Z.graph(spark, root, out).first()
    assert (totals["cycles"], totals["largest"]) == (1, 2)
    assert next((tmp / "out/analysis_graph.dot").glob("part*")).read_text().startswith("digraph")
    gate = Z.quality(spark, root, out, config={"analysisScope": "source-only"}).first()
    assert gate["exit_code"] == 2
    m = {r["id"]: r for r in spark.read.parquet(f"{out}/analysis_quality_report/metrics").collect()}
    assert m["circular_dependencies"]["verdict"] == "fail" and m["tsconfig_type_safety"]["actual"] == "full=0/1, strict=1/1"
    assert m["design_system_usage_rate"]["actual"] == "100.0%" and m["zod_adoption"]["actual"] == "50.0%" and m["e2e_pass_rate"]["verdict"] == "pass"
    assert m["hardcoded_jsx_text"]["actual"] == "1" and m["figma_delta"]["verdict"] == "pass" and m["typescript_errors"]["verdict"] == "pass"
    assert m["coverage_rate"]["verdict"] == "fail" and m["coverage_rate"]["actual"].startswith("75")  # its folder is left out of the scan, not of the search for reports
    assert [tuple(r) for r in spark.read.parquet(f"{out}/analysis_quality_report/warnings").collect()] == [("audit.json", "npm-audit", "not JSON")]
    lost = Z.quality(spark, root, f"{out}2", "gate", f"{out}/analysis_quality_report", {"analysisScope": "source-only"}, [("zod-adoption", 1, "broken")]).first()
    assert lost["n_regressions"] == 1
    with pytest.raises(C.ConfigError):
        Z.quality(spark, root, out, "gate", None, {"qualityGateBlockingMetricIds": ["nothing"]})


def test_settings_in_layers():
    file, unknown = C.from_file('{"complexityThreshold": 9, "excludeGroups": ["package-distribution"], "typo": 1}', "f")
    c = C.merged(file, C.from_dotenv("# x\nANALYZER_PREFIX='p'\nANALYZER_VERBOSE=true"), C.from_arguments({"complexityThreshold": "7", "format": "csv,html", "impactScoreThreshold": None}))
    assert unknown == ["typo"] and (c["complexityThreshold"], c["filePrefix"], c["verbose"], c["outputFormats"]) == (7, "p", True, ["csv", "html"])
    assert len(c["excludeGroups"]) == 8 and c["excludePatterns"][0].startswith("(?:^|")
    for wrong in ({"complexityThreshold": "abc"}, {"format": "pdf"}, {"analysisScope": "some"}):
        with pytest.raises(C.ConfigError):
            C.from_arguments(wrong)
    for text in ("{", "[]", '{"complexityThreshold": -1}', '{"outputFormats": ["x"]}'):
        with pytest.raises(C.ConfigError):
            C.from_file(text, "f")
    more = C.merged({"testPresenceSettings": {"bucketWeights": {"route": 9, "nothing": 1}, "staticImportTraversalMaxDepth": -2, "thresholds": {"application": {"pass": "x", "warn": 1}}}})["testPresenceSettings"]
    assert more["bucketWeights"]["route"] == 9 and "nothing" not in more["bucketWeights"] and more["staticImportTraversalMaxDepth"] == 0 and more["thresholds"]["application"] == {"pass": 80, "warn": 1}


def test_typescript_configurations():
    import re

    out = re.compile(C.glob_pattern("out"))
    assert out.search("out/a.ts") and not out.search("checkout.ts") and re.search(C.glob_pattern("src/**/*.gen.ts"), "src/a/b/x.gen.ts")
    files = {
        "tsconfig.json": '{"files": [], "references": [{"path": "./app"}, {"path": "./tsconfig.node.json"}]}', "app/tsconfig.json": '{"extends": "../base.json", "compilerOptions": {"paths": {"~/*": ["src/*"]}}, "include": ["src"]}',
        "tsconfig.node.json": '{"files": ["vite.config.ts"], "compilerOptions": {"strict": false}}', "base.json": '{"compilerOptions": {"strict": true, "noImplicitAny": false}}',
    }
    assert [c.path for c in C.leaves(files, "tsconfig.json")] == ["app/tsconfig.json", "tsconfig.node.json"]
    assert C.config_for(files, "vite.config.ts").path == "tsconfig.node.json" and C.config_for(files, "app/src/x.ts").path == "app/tsconfig.json" and C.config_for(files, "other.ts").path == "app/tsconfig.json"
    assert C.aliases_of(C.config_for(files, "app/src/x.ts")) == {"~/*": ["app/src/*"]}
    s = C.strictness(C.leaves(files, "tsconfig.json"))
    assert (s["configs"], s["strict_configs"], s["noImplicitAny"], s["strictNullChecks"]) == (2, 1, 0, 1)
    assert C.cache_identity('{"name": "x"}', "tsconfig.json") == "x::tsconfig.json" and C.context_hash(None, {}).startswith("fallback:")


def test_evidence_files():
    paths = ["reports/a/b/my-junit.xml", "reports/a/b/c/d/junit.xml", "junit.xml", "lighthouse-audit.json", "reports/lighthouse-audit.json", "reports/a11y-audit.json", "reports/audit.json", "taxes.json", ".github/workflows/ci.yml"]
    assert D.find(paths, "junit") == ["junit.xml", "reports/a/b/my-junit.xml"] and D.find(paths, "npm-audit") == ["reports/audit.json"] and D.find(paths, "axe") == []
    assert D.find(paths, "ci") == [".github/workflows"] and D.vitest(["x"], '{"scripts": {"t": "vitest run"}}') == {"files": ["package.json"], "scripts": ["t: vitest run"]}
    assert D.storybook({"numTotalTests": 3, "numPassedTests": 3}) == {"total": 3, "passed": 3, "failed": 0, "skipped": 0, "files": []}
    assert D.storybook({"entries": [{"status": "pass"}, {"status": "todo"}, {"status": "?"}]})["failed"] == 1
    assert D.playwright([{"results": [{"status": "skipped"}], "file": "./x.ts"}], "reports/p.json") == {"total": 1, "passed": 0, "failed": 0, "skipped": 1, "files": ["reports/x.ts"]}
    assert len(D.shaped({"results": [{"lhr": {"categories": {"a": 1}, "audits": {"b": 1}}}]}, "lighthouse")) == 1 and len(D.shaped([{"violations": []}], "axe")) == 1
    got = D.manual_evidence('{"metrics": [{"id": "a", "verdict": "odd", "actual": 3, "evidence": [{"filePath": "x.md"}, 1]}, {"id": " "}]}', "docs")
    assert got == [{"id": "a", "actual": None, "threshold": None, "summary": None, "verdict": None, "evidence": [{"type": "note", "label": "manual", "value": "docs/x.md", "file": "docs/x.md"}]}]
    assert D.baseline('{"files": [], "statistics": {}}', "analysis") and D.baseline('{"categories": [], "summary": {}, "schemaVersion": 1}', "quality")
    for text, kind in (('{"files": [], "statistics": {}}', "quality"), ('{"files": [], "statistics": {}, "schemaVersion": 2}', "analysis"), ("[]", "analysis"), ("{", "analysis")):
        with pytest.raises(ValueError):
            D.baseline(text, kind)
