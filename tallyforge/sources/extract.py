"""Facts from source texts: module dependencies, functions, components, hooks, type escapes, line classes and findings.

Files are read side by side by the reader in syntax.py, one row of nested facts each (source_facts), of which the other
functions take tables; patterns over lines stay in SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators.contract import doubled
from tallyforge.operators.lookup import ALIASES, matched_aliases
from tallyforge.sources.syntax import Component, Function, Source

COMMENT = r"""(?s)/\*.*?\*/|(?m)//[^\n]*"""
#: Where a module path without ending is looked for, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.d.ts")


def package_name(specifier: Column) -> Column:
    """The package of an external module path: scope and name, or the first part."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(F.get(parts, 0))


TYPE_FIELDS = "any_count unknown_count assertion unsafe double const non_null ts_ignore ts_expect ts_nocheck".split()
#: Facts that are lists of rows, and their columns.
ROWS = {
    "imports": "type: string, module: string, is_type_only: boolean, line: int, column: int, start: int, names: array<struct<name: string, alias: string, kind: string>>",
    "functions": "name: string, cc: long, nesting: long, start_line: long, end_line: long, branches: int, loops: int, ternaries: int, logical: int, is_async: boolean",
    "components": "name: string, start_line: long, end_line: long, jsx: long, hook_count: long, render: long, has_children: boolean, uses_ref: boolean, forwards_ref: boolean, hooks: array<string>",
    "hooks": "name: string, line: int, args: int, has_dependencies: boolean",
    "texts": "line: int, text: string",
}
#: Types of all facts of a file, for Spark and for Arrow.
FACTS = {
    "imports": f"array<struct<{ROWS['imports']}>>", "functions": f"array<struct<{ROWS['functions']}>>", "components": f"array<struct<{ROWS['components']}>>", "hooks": f"array<struct<{ROWS['hooks']}>>",
    "types": f"struct<{', '.join(f'{t}: long' for t in TYPE_FIELDS)}>", "has_tests": "boolean", "rendered": "array<string>", "texts": f"array<struct<{ROWS['texts']}>>", "raw_html": "array<int>",
}
_NAMED = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "alias", "kind")]))
_PLAIN = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<struct<name: string, alias: string, kind: string>>": _NAMED}
_ARROW = {k: pa.list_(pa.struct([(n, _PLAIN[t]) for n, t in re.findall(r"(\w+): (array<.*>|\w+)", v)])) for k, v in ROWS.items()}
_ARROW |= {"types": pa.struct([(t, pa.int64()) for t in TYPE_FIELDS]), "has_tests": pa.bool_(), "rendered": _PLAIN["array<string>"], "raw_html": pa.list_(pa.int32())}
#: Files whose facts a worker holds at once.
AT_ONCE = 256


def _function(x: Function) -> dict:
    return {"name": x.name, "cc": x.cc, "nesting": x.nesting, "start_line": x.line, "end_line": x.end_line, "branches": x.branches, "loops": x.loops, "ternaries": x.ternaries, "logical": x.logical, "is_async": x.is_async}


def _component(x: Component) -> dict:
    return {
        "name": x.name, "start_line": x.line, "end_line": x.end_line, "jsx": x.jsx, "hook_count": len(x.hooks), "render": x.render, "has_children": x.has_children, "uses_ref": x.uses_ref,
        "forwards_ref": x.forwards_ref, "hooks": [h[0] for h in x.hooks],
    }


#: How each fact is written as plain values.
_VALUES = {
    "imports": lambda f: [r | {"names": [dict(zip(("name", "alias", "kind"), n, strict=True)) for n in r["names"]]} for r in f.imports],
    "functions": lambda f: [_function(x) for x in f.functions],
    "components": lambda f: [_component(x) for x in f.components],
    "hooks": lambda f: [dict(zip(("name", "line", "args", "has_dependencies"), h, strict=True)) for h in f.hooks],
    "types": lambda f: f.types,
    "has_tests": lambda f: f.tests,
    "rendered": lambda f: f.rendered,
    "texts": lambda f: [{"line": n, "text": t} for n, t in f.texts],
    "raw_html": lambda f: f.raw_html,
}


def read_facts(path: str | None, content: str | None, wanted: tuple[str, ...] = tuple(FACTS)) -> dict:
    """The wanted facts of one file; a null text counts as empty."""
    f = Source(content or "", path or "").facts(*["tests" if w == "has_tests" else w for w in wanted])
    return {w: _VALUES[w](f) for w in wanted}


def source_facts(files: DataFrame, *wanted: str) -> DataFrame:
    """files (path, content) -> one row of nested facts (FACTS) a file: the wanted ones, all by default."""
    wanted = wanted or tuple(FACTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                paths = part.column(0).to_pylist()
                rows = [read_facts(p, c, wanted) for p, c in zip(paths, part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array([r[w] for r in rows], _ARROW[w]) for w in wanted]], names=["path", *wanted])

    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{w} {FACTS[w]}" for w in wanted))


def _rows(facts: DataFrame, column: str) -> DataFrame:
    return facts.select("path", F.inline(column))


def statements(facts: DataFrame) -> DataFrame:
    """source_facts() -> (path, type, is_type_only, specifier, line, column, start, names), one row per statement that names a module."""
    return _rows(facts, "imports").select("path", "type", "is_type_only", F.col("module").alias("specifier"), "line", "column", "start", "names")


def dependencies(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, type, is_type_only, specifier), one row per statement."""
    return statements(source_facts(files, "imports")).select("path", "type", "is_type_only", "specifier")


def functions(facts: DataFrame) -> DataFrame:
    return _rows(facts, "functions")


def components(facts: DataFrame) -> DataFrame:
    return _rows(facts, "components")


def hooks(facts: DataFrame) -> DataFrame:
    return _rows(facts, "hooks")


def types(facts: DataFrame) -> DataFrame:
    return facts.select("path", "types.*")


def rendered_imports(facts: DataFrame, resolved_: DataFrame) -> DataFrame:
    """Imports whose names a file renders: resolved() rows with start -> (source, target, module, is_external)."""
    named = statements(facts).filter("type = 'import'").select(F.col("path").alias("source"), "start", F.transform("names", lambda n: n["alias"]).alias("aliases"))
    used = named.join(facts.select(F.col("path").alias("source"), "rendered"), "source").filter(F.arrays_overlap("aliases", "rendered")).select("source", "start")
    return resolved_.join(used, ["source", "start"]).select("source", "target", "module", "is_external")


def barrel_imports(facts: DataFrame, resolved_: DataFrame) -> DataFrame:
    """(source, barrel, name, alias) of names imported from internal index files."""
    rows = resolved_.filter(~F.col("is_external") & (F.col("type") == "import") & P.is_barrel("target"))
    names = statements(facts).select(F.col("path").alias("source"), "start", F.explode("names").alias("n"))
    return rows.join(names, ["source", "start"]).select("source", F.col("target").alias("barrel"), "n.name", "n.alias")


def re_exports(resolved_: DataFrame) -> DataFrame:
    """resolved() rows with names -> (file, name, next_file, next_name): where an internal module takes a name from that it only hands on.

    A name that a file hands on twice is taken from the last statement.
    """
    rows = resolved_.filter(~F.col("is_external") & (F.col("type") == "export")).select("source", "target", "start", F.explode("names").alias("n")).filter("n.name <> '*'")
    last = F.max_by(F.struct("target", F.col("n.name").alias("name")), "start")
    return rows.groupBy(F.col("source").alias("file"), F.coalesce("n.alias", "n.name").alias("name")).agg(last.alias("l")).select("file", "name", F.col("l.target").alias("next_file"), F.col("l.name").alias("next_name"))


def defining_files(handed_on: DataFrame) -> DataFrame:
    """re_exports() -> (file, name, end_file, end_name, hops): the file that a name handed on comes from in the end.

    Pointers are doubled, so that a chain costs rounds by the logarithm of its length; names that are handed on in a ring
    have no end (null).
    """
    size = handed_on.count()
    if not size:
        return handed_on.select("file", "name", F.col("next_file").alias("end_file"), F.col("next_name").alias("end_name"), F.lit(0).cast("long").alias("hops"))
    here, there = F.struct(F.col("file"), F.col("name")), F.struct(F.col("next_file").alias("file"), F.col("next_name").alias("name"))
    ends = doubled(handed_on.select(here.alias("id"), there.alias("at"), F.lit(1).cast("long").alias("hops")), size, [("hops", F.col("p.hops") + F.col("q.hops"))], "re_exports")
    end = F.when(~F.col("open"), F.col("at"))
    return ends.select("id.file", "id.name", end["file"].alias("end_file"), end["name"].alias("end_name"), F.when(~F.col("open"), F.col("hops")).alias("hops"))


def raw_html(facts: DataFrame) -> DataFrame:
    """(path, line) of attributes that set markup directly."""
    return facts.select("path", F.explode("raw_html").alias("line"))


def shown_texts(facts: DataFrame) -> DataFrame:
    """(path, line, text, scope) of texts written out in files that show texts."""
    rows = _rows(facts, "texts").withColumn("kind", P.file_kind("path"))
    return rows.filter(F.col("kind").isin(*P.WITH_TEXT)).select("path", "line", "text", P.text_scope("path", "kind").alias("scope"))


# What looks like a secret; signals of schemas, mock servers and patience with a network.
SECRETS = (r"(?i)api[_-]?key\s*[:=]\s*['\"][^'\"\n]+", r"(?i)secret\s*[:=]\s*['\"][^'\"\n]+", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", r"AKIA[0-9A-Z]{16}")
ZOD_PATH = r"(^|/)(api|infra|service|services|client|clients|repository|repositories|schema|schemas|validation|validations)(/|$)"
PATIENT = r"(AbortController|AbortSignal\.timeout|axios-retry|p-retry|\b(?:timeout|retry)\b\s*[:=])"


def secrets(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, line, text) of what looks like a secret: at most 80 letters of each match, with the line it begins in."""

    def matches(pattern: str) -> Column:
        found = F.regexp_extract_all("content", F.lit(f"({pattern})"), 1)
        parts = F.split("content", pattern)
        before = F.transform(found, lambda m, i: F.size(F.split(F.concat(F.array_join(F.slice(parts, 1, i + 1), ""), F.array_join(F.slice(found, 1, i), "")), "\n")))
        return F.arrays_zip(before.alias("line"), F.transform(found, lambda m: F.substring(m, 1, 80)).alias("text"))

    rows = files.select("path", F.explode(F.array(*[matches(p) for p in SECRETS])).alias("m"))
    return rows.select("path", F.inline("m")).toDF("path", "line", "text")


def signals() -> dict[str, Column]:
    """What the content of a file says of schemas, mock servers and patience with a network."""
    has = lambda pattern: F.coalesce(F.col("content").rlike(pattern), F.lit(False))
    handlers = F.regexp_count("content", F.lit(r"\b(?:http|rest)\.(get|post|put|patch|delete|options|head)\("))
    return {
        "imports_zod": has("from\\s+[\"']zod[\"']"), "patient": has(PATIENT),
        "mocks": has("from\\s+[\"']msw(?:/node)?[\"']|setupServer\\("), "handlers": F.coalesce(handlers, F.lit(0)),
    }


def _signals(files: DataFrame) -> DataFrame:
    """files with their signals: stored ones (text_facts) or those of their content."""
    return files.select("path", *[how.alias(name) for name, how in signals().items()]) if "content" in files.columns else files


def zod_use(files: DataFrame) -> DataFrame:
    """One row: files of the data layers, and how many of them import zod."""
    p = F.lower(P.slashes("path"))
    rows = _signals(files).filter(p.rlike(ZOD_PATH) & ~P.is_test_path("path") & ~p.rlike(r"stories?\."))
    adopted, total = F.count_if("imports_zod"), F.count(F.lit(1))
    return rows.agg(total.alias("zod_files"), adopted.alias("adopted"), F.when(total > 0, adopted / total * 100).otherwise(0.0).alias("zod_rate"))


def api_signals(files: DataFrame) -> DataFrame:
    """One row: files of the network layer, those with timeouts or retries, files with a mock server, and its handlers."""
    api = P.is_api_layer("path")
    return _signals(files).agg(
        F.count_if(api).alias("api_files"), F.count_if(api & F.col("patient")).alias("resilient_files"),
        F.count_if("mocks").alias("mock_files"), F.coalesce(F.sum(F.when(F.col("mocks"), F.col("handlers")).otherwise(0)), F.lit(0)).alias("msw_handlers"),
    )


def _joined(path: Column, specifier: Column) -> Column:
    """The specifier seen from the path's directory, with . and .. resolved."""
    parts = F.split(F.concat_ws("/", F.regexp_replace(path, "/?[^/]*$", ""), specifier), "/")
    none = F.array().cast("array<string>")
    up = F.aggregate(parts, none, lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(acc)).otherwise(F.array_append(acc, x)))
    return F.array_join(up, "/")


def resolved(deps: DataFrame, files: DataFrame, aliases: dict[str, list[str] | str] | DataFrame | None = None, with_bases: bool = False) -> DataFrame:
    """Statements (path, type, is_type_only, specifier, and others) -> (source, target, type, is_type_only, is_external, module, and others).

    Relative specifiers and those that an alias matches are internal: the first candidate path that is a file, or else
    the first candidate. Any other is external, and its target is the package. An alias is a pattern with at most one *
    (or a prefix that ends in /) and the paths it stands for, tried in order; a longer pattern goes before a shorter one.
    Aliases given as a table (lookup.ALIASES) hold for the statements of the same place, a column of deps; with_bases
    adds the paths that candidates begin with.
    """
    if aliases is None or isinstance(aliases, dict):
        known = [("", pattern, [places] if isinstance(places, str) else list(places)) for pattern, places in (aliases or {}).items()]
        aliases = deps.sparkSession.createDataFrame(known, ALIASES) if known else None
        deps = deps.withColumn("place", F.lit(""))
    rows = deps
    near = F.when(F.col("specifier").startswith("."), F.array(_joined(F.col("path"), F.col("specifier"))))
    if aliases is not None:
        rows = rows.join(matched_aliases(deps.filter(~F.col("specifier").startswith(".")), aliases).drop("pattern"), ["place", "specifier"], "left")
        rows = rows.withColumn("bases", F.coalesce(near, F.col("bases")))
    else:
        rows = rows.withColumn("bases", near)
    keys = rows.filter("bases IS NOT NULL").select("bases").distinct()  # many statements mean the same file
    tries = keys.select("bases", F.posexplode("bases").alias("place", "base"))
    tries = tries.select("bases", "place", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS])).alias("rank", "candidate"))
    hit = tries.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("bases").agg(F.min(F.struct("place", "rank", "candidate")).alias("h"))
    out = rows.join(hit.select(F.col("bases").alias("b"), F.col("h.candidate").alias("found")), F.col("bases") == F.col("b"), "left")
    target = F.coalesce("found", F.get("bases", F.lit(0)), package_name(F.col("specifier")))
    more = [c for c in deps.columns if c not in ("path", "type", "is_type_only", "specifier", "place")] + ["bases"] * with_bases
    return out.select(
        F.col("path").alias("source"), target.alias("target"), "type", "is_type_only", F.col("bases").isNull().alias("is_external"), F.col("specifier").alias("module"), *more
    )


def text_facts(files: DataFrame) -> DataFrame:
    """files (path, content) -> one row a file of what patterns find in its text: line classes, signals, and what looks like a secret."""
    found = secrets(files).groupBy(F.col("path").alias("of")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("secrets"))
    out = line_classes(files).join(files.select("path", *[how.alias(name) for name, how in signals().items()]), "path").join(found, F.col("path") == F.col("of"), "left").drop("of")
    return out.withColumn("secrets", F.coalesce("secrets", F.array().cast("array<struct<line:int,text:string>>")))


def line_classes(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, total_lines, code_lines, comment_lines); a running state knows whether a block comment is open."""
    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("comment"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        blank = line == ""
        opens = ~acc["open"] & line.startswith("/*")
        comment = ~blank & (acc["open"] | opens | line.startswith("//") | line.startswith("*"))
        still = F.when(blank, acc["open"]).when(acc["open"], ~line.contains("*/")).otherwise(opens & ~F.substring(line, F.lit(3), F.length(line)).contains("*/"))
        return F.struct(still.alias("open"), (acc["code"] + F.when(blank | comment, 0).otherwise(1)).alias("code"), (acc["comment"] + F.when(comment, 1).otherwise(0)).alias("comment"))

    rows = files.select("path", F.split(F.coalesce("content", F.lit("")), "\r?\n").alias("l")).select("path", F.size("l").cast("long").alias("total_lines"), F.aggregate("l", start, step).alias("s"))
    return rows.select("path", "total_lines", F.col("s.code").alias("code_lines"), F.col("s.comment").alias("comment_lines"))


def directives(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, ts_ignore, ts_expect_error, ts_nocheck), counted inside comments only."""
    comments = F.array_join(F.regexp_extract_all("content", F.lit(f"({COMMENT})"), 1), "\n")
    rows = files.select("path", comments.alias("c"))
    return rows.select("path", *[F.regexp_count("c", F.lit(rf"@ts-{k}\b")).alias("ts_" + k.replace("-", "_")) for k in ("ignore", "expect-error", "nocheck")])
