"""Settings of an analysis: defaults, files, environment and arguments in layers, and what a TypeScript configuration adds."""

from __future__ import annotations

import hashlib
import json
import os
import re
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

_SEP = r"[/\\]"


def _folder(*names: str) -> list[str]:
    return [rf"(?:^|{_SEP}){n}(?:$|{_SEP})" for n in names]


# Groups of folders that are left out by default, and all settings with their defaults.
EXCLUDE_GROUPS = {
    "dependencies": _folder("node_modules"), "build-output": _folder("dist", "build", r"\.next", "out", r"\.output"), "coverage": _folder("coverage", r"\.nyc_output"), "vcs": _folder(r"\.git"),
    "storybook-assets": _folder(rf"storybook-static{_SEP}assets"), "deployment-artifacts": _folder(r"\.firebase", r"\.vercel", r"\.netlify"),
    "tool-cache": _folder(r"\.turbo", r"\.cache", r"\.parcel-cache"), "package-distribution": _folder(rf"lib{_SEP}(?:esm|cjs|modern)", "(?:esm|cjs|umd)"),
}
DEFAULTS: dict[str, Any] = {
    "analysisScope": "all", "qualityProfile": "application",
    "testPresenceSettings": {
        "thresholds": {"application": {"pass": 80, "warn": 50}, "library-repo": {"pass": 60, "warn": 25}},
        "bucketWeights": {"route": 5, "feature": 4, "form": 3, "layout": 2, "api": 2, "schema": 2, "validation": 2, "hook": 2, "context": 2, "ui": 1, "shared": 1},
        "staticImportTraversalMaxDepth": 3, "runtimeLineCoverageMinPercent": 0, "knownCallNames": ["test", "it", "describe", "specify"],
        "knownFrameworkModules": ["vitest", "jest", "@jest/globals", "@playwright/test", "cypress"],
    },
    "excludeGroups": ["dependencies", "build-output", "coverage", "vcs", "storybook-assets", "deployment-artifacts", "tool-cache"], "excludePatterns": [],
    "outputFormats": ["json", "markdown", "csv"], "outputDir": "./analysis-reports", "filePrefix": "analysis", "complexityThreshold": 12, "impactScoreThreshold": 0, "failOnImpactThreshold": False,
    "maxFileSizeBytes": 10 * 1024 * 1024, "verbose": False, "enableCache": True, "cacheDir": "./.tallyforge-cache", "logFile": "./analysis.log", "manualInputPath": None,
    "qualityGateBlockingMetricIds": [], "qualityGateMonitoringMetricIds": [], "maxTypeCheckRootNames": 5000, "tsCompilerOptions": {}, "pathMappings": {},
}
KNOWN = frozenset(DEFAULTS) | {"tsConfigPath", "projectRoot"}
FORMATS = ("csv", "markdown", "json", "html", "all")
NUMBERS = ("complexityThreshold", "impactScoreThreshold", "maxFileSizeBytes", "maxTypeCheckRootNames")
ENVIRONMENT = {
    "ANALYZER_ANALYSIS_SCOPE": "analysisScope", "ANALYZER_QUALITY_PROFILE": "qualityProfile", "ANALYZER_EXCLUDE_GROUPS": "excludeGroups", "ANALYZER_OUTPUT_DIR": "outputDir",
    "ANALYZER_FORMATS": "outputFormats", "ANALYZER_PREFIX": "filePrefix", "ANALYZER_VERBOSE": "verbose", "ANALYZER_CACHE_DIR": "cacheDir", "ANALYZER_MAX_FILE_SIZE": "maxFileSizeBytes",
    "ANALYZER_COMPLEXITY_THRESHOLD": "complexityThreshold", "ANALYZER_IMPACT_SCORE_THRESHOLD": "impactScoreThreshold", "ANALYZER_FAIL_ON_IMPACT_THRESHOLD": "failOnImpactThreshold",
    "ANALYZER_LOG_FILE": "logFile", "ANALYZER_MANUAL_INPUT": "manualInputPath", "ANALYZER_QUALITY_GATE_BLOCKING_METRICS": "qualityGateBlockingMetricIds",
    "ANALYZER_QUALITY_GATE_MONITORING_METRICS": "qualityGateMonitoringMetricIds", "ANALYZER_MAX_TYPECHECK_ROOT_NAMES": "maxTypeCheckRootNames",
}
ARGUMENTS = {
    "output": "outputDir", "format": "outputFormats", "prefix": "filePrefix", "manualInput": "manualInputPath", "qualityGateBlockingMetrics": "qualityGateBlockingMetricIds",
    "qualityGateMonitoringMetrics": "qualityGateMonitoringMetricIds", "maxFileSize": "maxFileSizeBytes",
}
LISTS = ("excludeGroups", "excludePatterns", "outputFormats", "qualityGateBlockingMetricIds", "qualityGateMonitoringMetricIds")
FLAGS = ("verbose", "failOnImpactThreshold")
STRICT_OPTIONS = ("strict", "noImplicitAny", "strictNullChecks", "noUncheckedIndexedAccess", "exactOptionalPropertyTypes", "useUnknownInCatchVariables")


class ConfigError(ValueError):
    """A setting that cannot be used, with what would be right."""


def whole_number(name: str, text: str) -> int:
    if not re.fullmatch(r"\d+", text.strip()):
        raise ConfigError(f'{name} needs a whole number of 0 or more, not "{text}"')
    return int(text.strip())


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _checked(name: str, key: str, value: Any) -> Any:
    """A value given as text for a key, in the key's type."""
    if key in LISTS:
        value = _listed(value)
        wrong = [v for v in value if key == "outputFormats" and v not in FORMATS]
        if wrong:
            raise ConfigError(f"{name} has unknown formats {', '.join(wrong)}; known: {', '.join(FORMATS)}")
        return value
    if key in NUMBERS:
        return whole_number(name, value)
    if key in FLAGS:
        return value == "true"
    return _choice(name, key, value) if key in CHOICES else value


CHOICES = {"analysisScope": ("all", "source-only"), "qualityProfile": ("application", "library-repo")}


def _choice(name: str, key: str, value: str) -> str:
    if value.strip() not in CHOICES[key]:
        raise ConfigError(f'{name} cannot be "{value}"; known: {", ".join(CHOICES[key])}')
    return value.strip()


def from_environment(env: dict[str, str]) -> dict[str, Any]:
    return {key: _checked(name, key, env[name]) for name, key in ENVIRONMENT.items() if env.get(name)}


def from_dotenv(text: str) -> dict[str, Any]:
    """Lines NAME=value; # begins a comment line, quotes around a value are dropped."""
    env = {}
    for line in re.split(r"\r?\n", text):
        name, sign, value = line.strip().partition("=")
        if sign and not name.startswith("#"):
            env[name.strip()] = re.sub(r"^['\"]|['\"]$", "", value.strip())
    return from_environment(env)


def from_arguments(args: dict[str, str | bool | None]) -> dict[str, Any]:
    out = {}
    for name, value in args.items():
        key = ARGUMENTS.get(name, name)
        if key not in KNOWN or value is None:
            continue
        out[key] = value if isinstance(value, bool) else _checked(f"--{re.sub('([A-Z])', lambda m: '-' + m[1].lower(), name)}", key, value)
    return out


def from_file(text: str, place: str) -> tuple[dict[str, Any], list[str]]:
    """The settings of a JSON file, checked, and the keys in it that nothing knows."""
    try:
        record = json.loads(text)
    except ValueError as wrong:
        raise ConfigError(f"{place} is not JSON: {wrong}") from wrong
    if not isinstance(record, dict):
        raise ConfigError(f"{place} must hold an object")
    for key in CHOICES:
        if key in record:
            if not isinstance(record[key], str):
                raise ConfigError(f'"{key}" in {place} must be a text')
            _choice(f'"{key}" in {place}', key, record[key])
    if "outputFormats" in record:
        given = record["outputFormats"]
        if not isinstance(given, list) or not all(isinstance(x, str) for x in given):
            raise ConfigError(f'"outputFormats" in {place} must be a list of texts')
        _checked(f'"outputFormats" in {place}', "outputFormats", ",".join(given))
    for key in NUMBERS:
        value = record.get(key)
        if key in record and (isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < 0):
            raise ConfigError(f'"{key}" in {place} needs a whole number of 0 or more')
    return record, [k for k in record if k not in KNOWN]


def _presence(current: dict, given: Any) -> dict:
    """Test-presence settings with the usable parts of given: finite numbers and lists of texts."""
    out = deepcopy(current)
    if not isinstance(given, dict):
        return out

    def number(x: Any) -> float | None:
        return x if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf") else None

    for profile, own in out["thresholds"].items():
        more = (given.get("thresholds") or {}).get(profile) if isinstance(given.get("thresholds"), dict) else None
        if isinstance(more, dict):
            own.update({k: more[k] for k in ("pass", "warn") if number(more.get(k)) is not None})
    if isinstance(given.get("bucketWeights"), dict):
        out["bucketWeights"].update({k: v for k, v in given["bucketWeights"].items() if k in out["bucketWeights"] and number(v) is not None})
    if number(given.get("staticImportTraversalMaxDepth")) is not None:
        out["staticImportTraversalMaxDepth"] = max(0, int(given["staticImportTraversalMaxDepth"]))
    if number(given.get("runtimeLineCoverageMinPercent")) is not None:
        out["runtimeLineCoverageMinPercent"] = max(0, given["runtimeLineCoverageMinPercent"])
    for key in ("knownCallNames", "knownFrameworkModules"):
        if isinstance(given.get(key), list):
            out[key] = [x for x in given[key] if isinstance(x, str) and x.strip()]
    return out


def merged(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Defaults and then the layers in order; later ones win.

    Exclude groups and patterns add up, path mappings and compiler options are joined by key, the patterns of the groups
    go before the others.
    """
    out = deepcopy(DEFAULTS)
    for layer in layers:
        for key, value in (layer or {}).items():
            if value is None:
                continue
            if key in CHOICES:
                out[key] = value if value in CHOICES[key] else out[key]
            elif key in ("excludeGroups", "excludePatterns") and isinstance(value, list):
                out[key] = list(dict.fromkeys([*out[key], *[x for x in value if isinstance(x, str) and x]]))
            elif key in ("pathMappings", "tsCompilerOptions"):
                out[key] = {**out[key], **value}
            elif key == "testPresenceSettings":
                out[key] = _presence(out[key], value)
            else:
                out[key] = list(value) if isinstance(value, list) else value
    groups = [p for g in out["excludeGroups"] for p in EXCLUDE_GROUPS.get(g, [])]
    out["excludePatterns"] = list(dict.fromkeys([*groups, *out["excludePatterns"]]))
    return out


def glob_pattern(glob: str) -> str:
    """A TypeScript exclude glob as a pattern of whole path parts."""
    body = re.sub(r"/+$", "", re.sub(r"^\./", "", glob.replace("\\", "/")))
    out = ""
    for part in re.findall(r"\*\*|\*|\?|/|[^*?/]+", body):
        out += {"**": ".*", "*": r"[^/\\]*", "?": r"[^/\\]", "/": _SEP}.get(part) or re.escape(part)
    return rf"(?:^|{_SEP}){out}(?:$|{_SEP})"


def relaxed_json(text: str) -> Any:
    """JSON with comments and trailing commas."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif text.startswith("/*", i):
            i = n if (j := text.find("*/", i + 2)) < 0 else j + 2
        else:
            out.append(text[i])
            i += 1
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)))


@dataclass
class TsConfig:
    path: str
    options: dict[str, Any] = field(default_factory=dict)
    files: list[str] | None = None
    include: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)

    @property
    def is_solution(self) -> bool:
        return self.files == [] and not self.include and bool(self.references)

    def owns(self, path: str) -> bool:
        """Whether a file (relative to the configuration's folder) is one of its files."""
        if self.files and path in self.files:
            return True
        include = self.include if self.include is not None else ([] if self.files is not None else ["**/*"])
        hit = any(re.search(r"^(?:" + glob_pattern(g if re.search(r"[*?]|\.[a-z]+$", g) else g + "/**/*")[len(rf"(?:^|{_SEP})") : -len(rf"(?:$|{_SEP})")].replace(rf".*{_SEP}", r"(?:.*/)?") + ")$", path) for g in include)
        return hit and not any(re.search(glob_pattern(g), path) for g in self.exclude)


def read_tsconfig(files: dict[str, str], path: str, seen: frozenset[str] = frozenset()) -> TsConfig | None:
    """The configuration at a path of files (path -> text), with what it extends; None if it is missing or broken."""
    if path not in files or path in seen:
        return None
    try:
        raw = relaxed_json(files[path])
    except ValueError:
        return None
    if not isinstance(raw, dict):
        return None
    folder = os.path.dirname(path)
    out = TsConfig(path)
    for base in [raw["extends"]] if isinstance(raw.get("extends"), str) else raw.get("extends") or []:
        place = os.path.normpath(os.path.join(folder, base))
        found = next((read_tsconfig(files, p, seen | {path}) for p in (place, place + ".json") if p in files), None)
        if found:
            out.options.update(found.options)
            out.files, out.include, out.exclude = found.files, found.include, found.exclude
    out.options.update(raw.get("compilerOptions") or {})
    out.files = raw.get("files", out.files)
    out.include = raw.get("include", out.include)
    out.exclude = raw.get("exclude", out.exclude)
    for r in raw.get("references") or []:
        place = os.path.normpath(os.path.join(folder, r.get("path", "")))
        out.references.append(place if place.endswith(".json") else os.path.join(place, "tsconfig.json"))
    return out


def leaves(files: dict[str, str], path: str) -> list[TsConfig]:
    """The configurations that hold files: the one at path, or those that a solution refers to, each once."""
    root = read_tsconfig(files, path)
    if root is None:
        return []
    if not root.is_solution:
        return [root]
    out, seen, queue = [], {path}, list(root.references)
    while queue:
        place = queue.pop(0)
        if place in seen:
            continue
        seen.add(place)
        found = read_tsconfig(files, place)
        if found:
            queue[:0] = found.references if found.is_solution else []
            out += [] if found.is_solution else [found]
    return out


_CONFIG_NAME = re.compile(r"^(jsconfig\.json|tsconfig(?:\.[^.]+)*\.json)$")


def _rank(name: str) -> int:
    if name in ("tsconfig.json", "jsconfig.json"):
        return int(name == "jsconfig.json")
    return 2 if re.match(r"tsconfig\.(app|lib|src)\.json$", name) else 4 if re.match(r"tsconfig\.(base|shared|options)\.json$", name) else 3


def nearest(configs: list[str], path: str) -> str | None:
    """The configuration for a file: in its folder or the next above that has one, the first by rank and name."""
    folder = os.path.dirname(path)
    while True:
        here = sorted((_rank(os.path.basename(c)), c) for c in configs if os.path.dirname(c) == folder and _CONFIG_NAME.match(os.path.basename(c)))
        if here:
            return here[0][1]
        if not folder:
            return None
        folder = os.path.dirname(folder)


def config_for(files: dict[str, str], path: str) -> TsConfig | None:
    """The configuration that a file is resolved by: its nearest one, of a solution the leaf that owns it, or the first leaf with paths."""
    place = nearest(list(files), path)
    if place is None:
        return None
    found = leaves(files, place)
    root = read_tsconfig(files, place)
    if root is None or not root.is_solution or not found:
        return root
    inside = [c for c in found if c.owns(os.path.relpath(path, os.path.dirname(c.path) or "."))]
    return next(iter(inside), None) or next((c for c in found if c.options.get("paths")), root)


def aliases_of(config: TsConfig | None) -> dict[str, list[str]]:
    """paths of a configuration, from the project's root."""
    if config is None:
        return {}
    base = os.path.normpath(os.path.join(os.path.dirname(config.path), config.options.get("baseUrl", ".")))
    return {k: [os.path.normpath(os.path.join(base, p)) for p in places] for k, places in (config.options.get("paths") or {}).items()}


def strictness(configs: list[TsConfig]) -> dict[str, int] | None:
    """How many configurations are strict, fully strict, and have each option; some follow strict where unset. None without configurations."""
    if not configs:
        return None
    out = {"configs": len(configs), "strict_configs": 0, "fully_strict_configs": 0, **dict.fromkeys(STRICT_OPTIONS, 0)}
    for c in configs:
        strict = c.options.get("strict") is True
        on = [strict if o == "strict" else c.options.get(o, strict and o in ("noImplicitAny", "strictNullChecks", "useUnknownInCatchVariables")) is True for o in STRICT_OPTIONS]
        out["strict_configs"] += strict
        out["fully_strict_configs"] += all(on)
        for o, x in zip(STRICT_OPTIONS, on, strict=True):
            out[o] += x
    return out


def stable_json(value: Any) -> str:
    """JSON with keys in order, for hashing."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def context_hash(config: TsConfig | None, options: dict[str, Any]) -> str:
    """What a file's resolution depends on: its configuration's path and options, or the options given without one."""
    own = hashlib.sha256(stable_json(options).encode()).hexdigest()
    if config is None:
        return f"fallback:{own}"
    return hashlib.sha256(f"{config.path}:{stable_json({**options, **config.options})}".encode()).hexdigest()


def cache_identity(package_json: str | None, tsconfig: str = "") -> str:
    """What names a project's cache, wherever it is checked out: its package's name and its configuration's path."""
    name = "project"
    try:
        given = json.loads(package_json or "{}").get("name")
        name = given if isinstance(given, str) and given else name
    except ValueError:
        pass
    return f"{name}::{tsconfig}"
