"""Column expressions over paths of source files: kinds, scopes, labels, and keys that match tests with sources.

All take project-relative paths with '/' or '\\' between segments; relative() makes them from absolute ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the kinds of files, over the lower-cased path, the lower-cased base name and, for one, the
# base name as written; in the order in which they decide.
SOURCE = r"\.[cm]?[jt]sx?$"
TEST = (r"(?:^|\.)(test|spec)\.[cm]?[jt]sx?$", r"(^|/)(?:__tests__|tests?)(/|$)")
STORY = (r"\.stories\.[cm]?[jt]sx?$", r"(^|/)(stories|storybook)/")
FIXTURE = (r"\.fixture\.[cm]?[jt]sx?$", r"(^|/)(__fixtures__|fixtures)/")
STORYBOOK = r"(^|/)\.storybook/"
STORYBOOK_CONFIG = r"^(main|preview|manager|vitest\.setup)\.[cm]?[jt]sx?$"
CONFIG = r"^(tsconfig\.json|jsconfig\.json)$|^(eslint\.config\.|\.eslintrc|\.prettierrc|vite\.config\.|vitest\.config\.|vitest\.workspace\.|jest\.config\.|storybook\.)|\.config\."
BARREL = r"^index\.[cm]?[jt]sx?$"
ROUTE_FOLDER = r"(^|/)(app|pages)/"
ROUTE_NAME = r"^(app|root|page|loading|error|template|route)\.[cm]?[jt]sx?$"
SOURCE_ROOT = r"^(?:src/)?[^/]+$"
SCHEMA = (r"\.schema\.[cm]?[jt]sx?$", r"(^|/)schemas?(/|$)")
VALIDATION = (r"\.(validation|validator)\.[cm]?[jt]sx?$", r"(^|/)(validations?|validators?)(/|$)")
LAYOUT = (r"^(header|sidebar|footer|navbar|layout|shell)\.[cm]?[jt]sx?$", r"(^|/)layouts?(/|$)")
LAYOUT_COMPONENT = r"(layout|container|shell)$"
UI_LIBRARY = r"(^|/)components/(ui|commons)(/|$)"
FEATURE = r"(^|/)(features?|modules?|domains?|scenes?|containers?)(/|$)"
HOOK_NAME = r"^use[A-Z0-9]"
HOOK_FOLDER = r"(^|/)hooks?(/|$)"
STATE = (r"(provider|context|store)(\.[cm]?[jt]sx?)?$", r"(^|/)contexts?(/|$)")
API = r"(^|/)(bases/api|api|services?|repositories?|clients?)(/|$)"
UTILS = r"(^|/)(lib|utils?|helpers?)(/|$)"
TYPES = r"\.d\.[cm]?ts$|shims|global\.d\.ts"
FORM_FOLDER = r"(^|/)(components/forms?|forms?|form-components)(/|$)"
COMPONENTS = r"(^|/)components(/|$)"
PACKAGE_SOURCE = r"(?:^|/)packages(?:-internal)?/[^/]+/src/(.+)$"

# Kinds that an analysis scope, a strict check, a test list, a walk from tests and the audits leave out or take.
SOURCE_ONLY_WITHOUT = ("Test", "Story", "Fixture", "Config", "Storybook Support")
TARGETS_WITHOUT = ("Test", "Story")
TEST_TARGETS_WITHOUT = ("Test", "Story", "Storybook Support", "Fixture", "Config", "Barrel", "Utils", "Type Support")
TRAVERSAL_WITHOUT = ("Test", "Story", "Storybook Support", "Fixture", "Config", "Type Support")
VISUAL = ("Route", "Feature", "Form")
RESPONSIBLE = ("Route", "Feature", "Form", "UI component", "Layout")
WITH_TEXT = ("Route", "Feature", "Form", "UI component", "Layout", "Shared")
# Weight and test bucket of a kind.
ESCAPE_WEIGHTS = {
    "API/Infrastructure": 1.4, "Context/State": 1.4, "Hook": 1.4, "Schema": 1.4, "Validation": 1.4, "Type Support": 1.4,
    "Route": 1.2, "Feature": 1.2, "Form": 1.2, "Layout": 1.2, "Barrel": 0.8,
}
TEST_WEIGHTS = {
    "Route": 5, "Feature": 4, "Form": 3, "Layout": 2, "API/Infrastructure": 2, "Schema": 2, "Validation": 2, "Hook": 2, "Context/State": 2,
    "UI component": 1, "Shared": 1,
}
TEST_BUCKETS = {"Route": "route", "Form": "form", "UI component": "ui", "Layout": "ui", "Shared": "ui"}
# Folders and endings that a test's path has and its source's path has not.
TEST_FOLDERS = ("__tests__", "tests", "test", "e2e", "playwright", "cypress", ".storybook")
TEST_ENDING = r"\.(test|spec|e2e|cy|ct|stories|story|fixture)$"
TEST_PATH = r"(?:^|/)(?:tests?|__tests__|e2e|playwright|cypress)(?:/|$)"
TEST_NAME = r"\.(?:test|spec|e2e|cy|ct)\.[jt]sx?$"
FEATURE_FOLDER = r"^(?i)(features?|modules?|domains?|scenes?|containers?)$"
API_LAYER = r"(?i)(^|/)(api|infra|service|services|client|clients|repository|repositories|gateway)(/|$)"
#: Kinds of script by file ending.
SCRIPT_KINDS = {".tsx": "TSX", ".ts": "TS", ".mts": "TS", ".cts": "TS", ".jsx": "JSX", ".js": "JS", ".mjs": "JS", ".cjs": "JS"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key: Column, table: dict, default) -> Column:
    """The table's value for key, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def slashes(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def base_name(path: Column | str) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def relative(path: Column | str, root: str | None = None) -> Column:
    """The path below root; other absolute paths and all paths without a root as they are."""
    p = slashes(path)
    if not root:
        return p
    top = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(top), F.substring(p, F.lit(len(top) + 1), F.length(p))).otherwise(p)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), SOURCE, "")


def script_kind(path: Column | str) -> Column:
    """TSX, TS, JSX or JS by the ending, else Unknown."""
    return lookup(F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1)), SCRIPT_KINDS, "Unknown")


def package_source_segments(path: Column | str) -> Column:
    """The segments below packages/<name>/src, empty elsewhere."""
    rest = F.regexp_extract(slashes(path), PACKAGE_SOURCE, 1)
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "/"))


def file_kind(path: Column | str, component: Column | str | None = None, has_children: Column | str | None = None) -> Column:
    """The kind of a source file; the first rule that matches decides. component is the name of a component in it, if known."""
    p = slashes(path)
    low, raw = F.lower(p), base_name(p)
    base, plain = F.lower(raw), F.regexp_replace(raw, SOURCE, "")
    name = F.coalesce(_c(component), F.lit("")) if component is not None else F.lit("")
    children = F.coalesce(_c(has_children), F.lit(False)) if has_children is not None else F.lit(False)

    def either(patterns: tuple[str, str]) -> Column:
        return base.rlike(patterns[0]) | low.rlike(patterns[1])

    in_storybook = low.rlike(STORYBOOK)
    library, low_name, low_stem = low.rlike(UI_LIBRARY), F.lower(name), F.lower(plain)
    form = low.rlike(FORM_FOLDER) | low_stem.endswith("form") | low_name.endswith("form")
    segments = package_source_segments(p)
    capital = F.exists(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: s.rlike("^[A-Z]"))
    package_ui = (F.size(segments) > 0) & (plain.rlike("^[A-Z]") | capital | name.rlike("^[A-Z]"))
    layout = either(LAYOUT) | (children & low_name.rlike(LAYOUT_COMPONENT))
    return (
        F.when(either(TEST), "Test")
        .when(either(STORY), "Story")
        .when(either(FIXTURE), "Fixture")
        .when(in_storybook & base.rlike(SOURCE) & ~base.rlike(STORYBOOK_CONFIG), "Storybook Support")
        .when(base.rlike(CONFIG) | in_storybook, "Config")
        .when(base.rlike(BARREL), "Barrel")
        .when(low.rlike(ROUTE_FOLDER) | (base.rlike(ROUTE_NAME) & low.rlike(SOURCE_ROOT)), "Route")
        .when(either(SCHEMA), "Schema")
        .when(either(VALIDATION), "Validation")
        .when(layout, F.when(library, "UI component").otherwise("Layout"))
        .when(low.rlike(FEATURE), "Feature")
        .when(plain.rlike(HOOK_NAME) | low.rlike(HOOK_FOLDER), "Hook")
        .when(either(STATE), "Context/State")
        .when(low.rlike(API), "API/Infrastructure")
        .when(low.rlike(UTILS), "Utils")
        .when(base.rlike(TYPES), "Type Support")
        .when((low.rlike(COMPONENTS) | package_ui) & ~form, "UI component")
        .when(form, "Form")
        .otherwise("Shared")
    )


def in_scope(kind: Column | str, scope: str = "source-only") -> Column:
    """Whether an analysis of this scope (all or source-only) takes a file of this kind."""
    return F.lit(True) if scope == "all" else ~_c(kind).isin(*SOURCE_ONLY_WITHOUT)


def is_strict_target(kind: Column | str) -> Column:
    return ~_c(kind).isin(*SOURCE_ONLY_WITHOUT)


def is_hotspot_target(kind: Column | str) -> Column:
    return ~_c(kind).isin(*TARGETS_WITHOUT)


def is_test_target(kind: Column | str) -> Column:
    return ~_c(kind).isin(*TEST_TARGETS_WITHOUT)


def ends_test_walk(kind: Column | str) -> Column:
    """Whether a walk along imports from a test stops at a file of this kind and takes it as tested."""
    return ~_c(kind).isin(*TRAVERSAL_WITHOUT)


def is_test_path(path: Column | str) -> Column:
    p = F.lower(slashes(path))
    return p.rlike(TEST_PATH) | p.rlike(TEST_NAME)


def is_executable_test(path: Column | str, has_test_call: Column | str | None, imports_framework: Column | str | None) -> Column:
    """Whether a test path holds tests: a call of a test function, or a test's name with a framework's import; unparsed files (null) go by name."""
    named = F.lower(_c(path)).rlike(TEST_NAME)
    call, framework = (_c(x) if x is not None else F.lit(None).cast("boolean") for x in (has_test_call, imports_framework))
    return is_test_path(path) & F.when(call.isNull(), named).otherwise(call | (named & F.coalesce(framework, F.lit(False))))


def is_barrel(path: Column | str) -> Column:
    """The narrower test of the cycle report: index with one of four endings, as written."""
    return base_name(path).rlike(r"^index\.(tsx?|jsx?)$")


def is_api_layer(path: Column | str) -> Column:
    return slashes(path).rlike(API_LAYER)


def is_pascal(name: Column | str) -> Column:
    return _c(name).rlike(r"^[A-Z][A-Za-z0-9]*$")


def escape_weight(kind: Column | str) -> Column:
    return lookup(_c(kind), ESCAPE_WEIGHTS, 1.0)


def test_weight(kind: Column | str) -> Column:
    return lookup(_c(kind), TEST_WEIGHTS, 1)


def test_bucket(kind: Column | str) -> Column:
    return lookup(_c(kind), TEST_BUCKETS, "feature")


def text_scope(path: Column | str, kind: Column | str) -> Column:
    """library or product, for texts found in a file."""
    low = F.lower(slashes(path))
    shared = reduce(Column.__or__, [low.contains(x) for x in ("/components/ui/", "/shared/ui/", "/components/commons/")])
    return F.when((_c(kind) == "UI component") | shared, "library").otherwise("product")


def is_design_system(module: Column | str, target: Column | str) -> Column:
    """Whether an import is of the shared component library."""
    m, t = F.lower(slashes(module)), F.lower(slashes(target))
    by_module = [m.contains(x) for x in ("components/ui", "shared/ui", "components/commons", "design-system")]
    by_target = [t.contains(x) for x in ("/components/ui/", "/shared/ui/", "/components/commons/")]
    return reduce(Column.__or__, by_module + by_target)


def segment_id(path: Column | str) -> Column:
    """The workspace segment that a path starts with."""
    p = F.lower(slashes(path))
    return F.when(p.startswith("apps/"), "apps").when(p.startswith("packages/"), "packages").when(p.startswith("src/"), "src").otherwise("other")


def feature_label(path: Column | str, kind: Column | str) -> Column:
    """The path down to the feature a file belongs to, or null; a file directly below the features' folder is a feature itself, if strictly checked."""
    parts = F.filter(F.split(slashes(path), "/"), lambda s: s != "")
    at = F.array_position(F.transform(parts, lambda s: s.rlike(FEATURE_FOLDER)), True).cast("int")
    n = F.size(parts)
    own = F.concat(F.slice(parts, F.lit(1), at), F.array(F.regexp_replace(F.element_at(parts, F.greatest(n, F.lit(1))), "(?i)" + SOURCE, "")))
    return (
        F.when((at == 0) | (at >= n), F.lit(None).cast("string"))
        .when(at + 1 < n, F.array_join(F.slice(parts, F.lit(1), at + 1), "/"))
        .when(is_strict_target(kind), F.array_join(own, "/"))
    )


def external_context(path: Column | str, kind: Column | str, package: Column | str) -> Column:
    """runtime, storybook, test or dev: what an external package is used for."""
    p, k = F.lower(slashes(path)), _c(kind)
    name = F.lower(_c(package))
    return (
        F.when(name.startswith("@storybook/") | (name == "storybook"), "storybook")
        .when(name.rlike(r"^(vitest|jest|@testing-library/|jsdom|happy-dom)\b"), "test")
        .when(k.isin("Story", "Storybook Support") | p.startswith(".storybook/"), "storybook")
        .when(k.isin("Test", "Type Support") | p.rlike(r"(?:^|/)(test|tests|__tests__)(/|$)"), "test")
        .when(k == "Config", "dev")
        .otherwise("runtime")
    )


def skip_class(path: Column | str, reason: Column | str) -> Column:
    """expected, generated, configured or unexpected: why a scan left a file out."""
    p, r = slashes(path), _c(reason)
    excluded = r == "Excluded pattern match"
    return (
        F.when(excluded & p.rlike(r"(^|/)(node_modules|\.next|\.git|\.venv)(/|$)|(^|/)storybook-static/assets(/|$)"), "expected")
        .when(excluded & p.rlike(r"(^|/)(out|storybook-static|coverage|dist|build)(/|$)"), "generated")
        .when(r.rlike(r"^Excluded by analysis scope\b"), "configured")
        .otherwise("unexpected")
    )


def skip_group(path: Column | str) -> Column:
    """Which kind of configured skip a path is: storybook, test, story, config or other."""
    p = slashes(path)
    return (
        F.when(p.rlike(r"(^|/)\.storybook(/|$)"), "storybook")
        .when(p.rlike(r"(^|/)__tests__(/|$)|(?:^|/)tests?(/|$)|\.(test|spec)\.[cm]?[jt]sx?$"), "test")
        .when(p.rlike(r"\.stories\.[cm]?[jt]sx?$|(^|/)(stories|storybook)(/|$)"), "story")
        .when(p.rlike(r"(^|/)(next|vite|vitest|jest)\.config\.|(^|/)tsconfig\.json$"), "config")
        .otherwise("other")
    )


def match_path(path: Column | str, root: str | None = None) -> Column:
    """A path as a key: relative, without the source ending, lower case."""
    return F.lower(F.regexp_replace(relative(path, root), "(?i)" + SOURCE, ""))


def _variants(key: Column) -> Column:
    """The key with and without a leading src folder; no empty ones."""
    other = F.when(key.startswith("src/"), F.substring(key, F.lit(5), F.length(key))).when(~key.startswith("/") & (key != ""), F.concat(F.lit("src/"), key))
    return F.filter(F.array_distinct(F.array_compact(F.array(key, other))), lambda k: k != "")


def source_keys(path: Column | str, root: str | None = None) -> Column:
    """The keys under which a source file is looked up."""
    return _variants(match_path(path, root))


def tested_keys(path: Column | str, root: str | None = None) -> Column:
    """The keys of the sources that a test is for by its path: without test folders and endings."""
    parts = F.filter(F.split(match_path(path, root), "/"), lambda s: ~s.isin(*TEST_FOLDERS))
    return _variants(F.regexp_replace(F.array_join(parts, "/"), TEST_ENDING, ""))


def config_rank(name: Column | str) -> Column:
    """Order in which the TypeScript configurations of a folder are tried."""
    n = base_name(name)
    return (
        F.when(n == "tsconfig.json", 0)
        .when(n == "jsconfig.json", 1)
        .when(n.rlike(r"^tsconfig\.(app|lib|src)\.json$"), 2)
        .when(n.rlike(r"^tsconfig\.(base|shared|options)\.json$"), 4)
        .otherwise(3)
    )


def project_path(path: Column | str, root: str | None = None) -> Column:
    """The path that rules are applied to: below root, or as given without ./ in front; of other absolute paths the base name only."""
    p = slashes(path)
    absolute = p.rlike(r"^(/|[A-Za-z]:)")
    inside = relative(path, root)
    return F.when(~absolute, F.regexp_replace(p, r"^\./", "")).when(inside != p, inside).otherwise(F.substring_index(p, "/", -1))
