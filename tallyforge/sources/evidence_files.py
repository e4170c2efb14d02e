"""Files that other tools leave in a project: where they are looked for, UI test results, manual evidence and baselines."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Places that are looked at first, folders that are searched three deep, and patterns of names there.
PLACES = {
    "junit": (
        ("junit.xml", "junit-report.xml", "reports/junit.xml", "reports/junit-report.xml", "test-results/junit.xml", "test-results/results.xml", "coverage/junit.xml"),
        ("reports", "test-results", "coverage", ".artifacts"), r"^(?=.*(?i:junit|result)).*\.xml$"),
    "lcov": (("coverage/lcov.info", "lcov.info", "reports/lcov.info", "test-results/lcov.info"), (), r"$^"),
    "playwright": (
        ("playwright-report/results.json", "playwright-report/report.json", "test-results/playwright-report.json", "reports/playwright.json", "artifacts/playwright.json"),
        ("playwright-report", "reports", "test-results", "artifacts", ".artifacts"), r"(?i)(playwright|e2e).+\.json$"),
    "storybook": (
        ("storybook-results.json", "storybook-test-results.json", "reports/storybook.json", "reports/storybook-results.json", "test-results/storybook.json", "artifacts/storybook.json"),
        ("reports", "test-results", "artifacts", ".artifacts"), r"(?i)storybook.+\.json$"),
    "axe": (
        ("axe-results.json", "axe-report.json", "reports/axe.json", "reports/axe-results.json", "test-results/axe.json", "artifacts/axe.json"),
        ("reports", "test-results", "artifacts", ".artifacts"), r"(?i)^axe([-.][\w.-]*)?\.json$"),
    "lighthouse": (
        ("lighthouse.json", "lighthouse-report.json", "reports/lighthouse.json", "reports/lighthouse-report.json", "test-results/lighthouse.json", "artifacts/lighthouse.json"),
        ("reports", "test-results", "artifacts", ".artifacts"), r"(?i)^lighthouse([-.][\w.-]*)?\.json$"),
    "openapi-spec": (
        ("openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json", "docs/openapi.yaml", "docs/openapi.yml", "docs/openapi.json"),
        ("docs", "api", "specs", "contracts"), r"(?i)(openapi|swagger).+\.(json|ya?ml)$"),
    "openapi-diff": (
        ("openapi-diff.json", "reports/openapi-diff.json", "reports/openapi-validation.json", "artifacts/openapi-diff.json"), ("reports", "artifacts", ".artifacts", "contracts"),
        r"(?i)openapi.+(diff|validation).+\.json$"),
    "npm-audit": (("npm-audit.json", "reports/npm-audit.json", "audit.json", "artifacts/npm-audit.json"), ("reports", "artifacts", ".artifacts"), r"(?i)^(npm-)?audit([-.][\w.-]*)?\.json$"),
    "trivy": (("trivy.json", "trivy-results.json", "reports/trivy.json", "reports/trivy-results.json", "artifacts/trivy.json"), ("reports", "artifacts", ".artifacts"), r"(?i)^trivy([-.][\w.-]*)?\.json$"),
    "ci": ((".github/workflows", ".gitlab-ci.yml", ".circleci/config.yml", "circle.yml", "Jenkinsfile", "azure-pipelines.yml"), (), r"$^"),
    "docs": (("README.md", "README.ja.md", "docs", "adr", "ADR"), (), r"$^"),
    "vitest": (
        tuple(f"vitest.config.{e}" for e in ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")) + tuple(f"vitest.workspace.{e}" for e in ("ts", "js", "mts", "cts")), (), r"$^"),
}
DEPTH = 3


#: Folders of the first level that hold places.
TOPS = frozenset(p.split("/")[0] for places, folders, _ in PLACES.values() for p in (*places, *folders) if "/" in p or "." not in p or p in folders)


def evidence(paths: DataFrame) -> DataFrame:
    """(path) -> (path): the paths and folders that find() looks at, so that only these reach the driver."""
    places = [p for named, _, _ in PLACES.values() for p in named]
    parts = F.split("path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    named = paths.select(F.explode(F.filter(begins, lambda b: b.isin(*places))).alias("path"))
    fits = F.lit(False)
    for _, folders, pattern in PLACES.values():
        if folders:
            fits = fits | (F.get(parts, F.lit(0)).isin(*folders) & F.element_at(parts, -1).rlike(pattern))
    searched = paths.filter((F.size(parts) > 1) & (F.size(parts) <= DEPTH + 2) & fits)
    return named.unionByName(searched.select("path")).distinct()


def find(paths: list[str], kind: str) -> list[str]:
    """The paths (relative to a project) that hold evidence of a kind, in order. A folder among the places stands for itself."""
    places, folders, pattern = PLACES[kind]
    known = set(paths) | {"/".join(p.split("/")[: i + 1]) for p in paths for i in range(p.count("/"))}
    out = {p for p in places if p in known}
    for p in paths:
        top, *rest = p.split("/")
        if rest and top in folders and len(rest) <= DEPTH + 1 and re.search(pattern, rest[-1]):
            out.add(p)
    return sorted(out)


def vitest(paths: list[str], package_json: str | None) -> dict | None:
    """Files and scripts that show vitest in use, or None."""
    files, scripts = find(paths, "vitest"), []
    try:
        package = json.loads(package_json or "{}")
    except ValueError:
        package = {}
    package = package if isinstance(package, dict) else {}
    fields = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    if any(isinstance(package.get(f), dict) and "vitest" in package[f] for f in fields):
        files.append("package.json")
    if isinstance(package.get("scripts"), dict):
        scripts = sorted(f"{k}: {v}" for k, v in package["scripts"].items() if isinstance(v, str) and re.search(r"\bvitest\b", v))
    files = sorted({*files, *(["package.json"] if scripts else [])})
    return {"files": files, "scripts": scripts} if files else None


def source_place(artifact: str, named: str) -> str:
    """The source that an artifact names: absolute as it is, with a leading . seen from the artifact, else from the project."""
    named = named.strip()
    if not named:
        return artifact
    if os.path.isabs(named):
        return os.path.normpath(named)
    return os.path.normpath(os.path.join(os.path.dirname(artifact), named) if named.startswith(".") else named)


def _nested(payload, keys: tuple[str, ...], is_entry) -> list[dict]:
    """All records below a payload that are entries, through lists and the named keys."""
    out, queue = [], [payload]
    while queue:
        x = queue.pop(0)
        if isinstance(x, list):
            queue[:0] = x
        elif isinstance(x, dict):
            if is_entry(x):
                out.append(x)
            else:
                queue[:0] = [x[k] for k in keys if isinstance(x.get(k), list)]
    return out


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def playwright_status(test: dict) -> str:
    """The final status if it is stated, else that of the last run."""
    stated = _text(test.get("status")).lower()
    if stated in ("passed", "expected", "flaky"):
        return "passed"
    if stated in ("failed", "unexpected", "timedout", "interrupted"):
        return "failed"
    if stated == "skipped" or _text(test.get("expectedStatus")).lower() == "skipped":
        return "skipped"
    runs = [s for r in test.get("results") or [] if isinstance(r, dict) and (s := _text(r.get("status")).lower())]
    if runs and runs[-1] == "passed":
        return "passed"
    return "skipped" if runs and all(s == "skipped" for s in runs) else "failed"


def playwright(payload, artifact: str = "") -> dict:
    """Counts by status and the test files of a Playwright report."""
    tests = _nested(payload, ("suites", "specs", "tests", "projects", "results"), lambda r: isinstance(r.get("results"), list) or isinstance(r.get("status"), str) or isinstance(r.get("expectedStatus"), str))
    status = [playwright_status(t) for t in tests]
    files = set()
    for t in tests:
        place = t.get("location") if isinstance(t.get("location"), dict) else {}
        name = _text(place.get("file")).strip() or _text(t.get("file")).strip() or _text(t.get("path")).strip()
        if name:
            files.add(source_place(artifact, name))
    return {"total": len(tests), **{s: status.count(s) for s in ("passed", "failed", "skipped")}, "files": sorted(files)}


def _number(x) -> float | None:
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x else None


def storybook(payload, artifact: str = "") -> dict:
    """Counts by status of a Storybook report: its summary if it has one, else its entries."""
    if isinstance(payload, dict) and _number(payload.get("numTotalTests")) is not None and _number(payload.get("numPassedTests")) is not None:
        n = {k: int(_number(payload.get(k)) or 0) for k in ("numTotalTests", "numPassedTests", "numFailedTests", "numRuntimeErrorTestSuites", "numPendingTests", "numTodoTests")}
        failed, skipped = n["numFailedTests"] + n["numRuntimeErrorTestSuites"], n["numPendingTests"] + n["numTodoTests"]
        failed = failed or max(0, n["numTotalTests"] - n["numPassedTests"] - skipped)
        return {"total": n["numTotalTests"], "passed": n["numPassedTests"], "failed": failed, "skipped": skipped, "files": []}
    entries = _nested(payload, ("stories", "results", "tests", "entries"), lambda r: isinstance(r.get("status"), str))
    status = [s if s in ("passed", "skipped") else "failed" for s in ({"pass": "passed", "success": "passed", "pending": "skipped", "todo": "skipped"}.get(x, x) for x in (e["status"].lower() for e in entries))]
    return {"total": len(entries), **{s: status.count(s) for s in ("passed", "failed", "skipped")}, "files": []}


def shaped(payload, kind: str) -> list[dict]:
    """The axe or Lighthouse results below a payload: through lists, results and lhr."""
    fits = (lambda r: isinstance(r.get("violations"), list)) if kind == "axe" else (lambda r: bool(r.get("categories")) and bool(r.get("audits")))
    out, queue = [], [payload]
    while queue:
        x = queue.pop(0)
        if isinstance(x, list):
            queue[:0] = x
        elif isinstance(x, dict):
            if fits(x):
                out.append(x)
            else:
                inner = (x.get("lhr") if kind == "lighthouse" else None) or x.get("results")
                queue[:0] = [inner] if inner else []
    return out


def results(files: DataFrame, kind: str) -> DataFrame:
    """files (path, text) of axe or Lighthouse -> (path, text, warning): a row for each result in a file, or one with a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    found = [(path, json.dumps(r), None) for r in shaped(json.loads(text or ""), kind)]
                    rows += found or [(path, None, "not a report of this kind")]
                except ValueError:
                    rows.append((path, None, "not JSON"))
            yield pd.DataFrame(rows, columns=["path", "text", "warning"])

    return files.select("path", "text").mapInPandas(run, "path string, text string, warning string")


READERS = {"playwright": playwright, "storybook": storybook}


def ui_tests(files: DataFrame, kind: str) -> DataFrame:
    """files (path, text) -> (path, total, passed, failed, skipped, files, warning); a file that is no JSON has only a warning."""
    read = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    rows.append({"path": path, **read(json.loads(text or ""), path), "warning": None})
                except ValueError:
                    rows.append({"path": path, "total": None, "passed": None, "failed": None, "skipped": None, "files": None, "warning": f"{path}: not JSON"})
            if rows:
                yield pd.DataFrame(rows).astype({c: "Int64" for c in ("total", "passed", "failed", "skipped")})

    return files.select("path", "text").mapInPandas(run, "path string, total long, passed long, failed long, skipped long, files array<string>, warning string")


def run_summary(tests: DataFrame) -> DataFrame:
    """ui_tests() -> one row of sums, null where no file was read."""
    return tests.filter("warning IS NULL").agg(*[F.sum(c).alias(c) for c in ("total", "passed", "failed", "skipped")])


VERDICTS = ("pass", "partial", "warn", "fail", "manual", "not_applicable")


def manual_evidence(text: str, folder: str = "") -> list[dict]:
    """Manual entries of a JSON text: a list, {"metrics": [...]}, or an object by metric id. Entries without an id are left out.

    Values of wrong types count as not given; evidence gets the label manual and the type note where it has none.
    """
    try:
        raw = json.loads(text)
    except ValueError as wrong:
        raise ValueError(f"manual evidence is not JSON: {wrong}") from wrong
    if isinstance(raw, dict):
        raw = raw["metrics"] if isinstance(raw.get("metrics"), list) else [{"id": k, **(v if isinstance(v, dict) else {})} for k, v in raw.items()]
    out = []
    for entry in raw if isinstance(raw, list) else []:
        if not isinstance(entry, dict) or not _text(entry.get("id")).strip():
            continue
        row = {"id": entry["id"], **{k: entry[k] if isinstance(entry.get(k), str) else None for k in ("actual", "threshold", "summary")}}
        row["verdict"] = entry.get("verdict") if entry.get("verdict") in VERDICTS else None
        row["evidence"] = [_evidence(e, folder) for e in entry["evidence"] if isinstance(e, dict)] if isinstance(entry.get("evidence"), list) else None
        out.append(row)
    return out


def _evidence(entry: dict, folder: str) -> dict:
    place = os.path.normpath(os.path.join(folder, entry["filePath"])) if isinstance(entry.get("filePath"), str) else None
    value = _text(entry.get("value"))
    kind = entry.get("type") if entry.get("type") in ("file", "metric", "note") else "note"
    return {"type": kind, "label": entry["label"] if isinstance(entry.get("label"), str) else "manual", "value": place if place and not value else value, "file": place}


#: Fixed value: the newest version of reports that is understood.
REPORT_VERSION = 1


def baseline(text: str, kind: str) -> dict:
    """A stored report, checked to be of the kind (analysis or quality) and not newer than this program."""
    try:
        record = json.loads(text)
    except ValueError as wrong:
        raise ValueError("the baseline is not JSON") from wrong
    shapes = {
        "analysis": lambda r: isinstance(r.get("files"), list) and isinstance(r.get("statistics"), dict),
        "quality": lambda r: isinstance(r.get("categories"), list) and isinstance(r.get("summary"), dict),
    }
    if not isinstance(record, dict) or not shapes[kind](record):
        other = next((k for k, fits in shapes.items() if k != kind and isinstance(record, dict) and fits(record)), None)
        raise ValueError(f"the baseline is no {kind} report" + (f", but seems to be a report of kind {other}" if other else ""))
    version = record.get("schemaVersion")
    if version is None:
        return record
    if isinstance(version, bool) or not isinstance(version, int) or version < 1:
        raise ValueError(f"the baseline's version {version!r} is not valid")
    if version > REPORT_VERSION:
        raise ValueError(f"the baseline's version {version} is newer than {REPORT_VERSION}")
    return record
