"""A source project made of the shared tables: files, functions, components, hooks, dependencies, type escapes and artifacts.

Every part is a file, every line item a statement or a function of it; nothing is left out. Each table exists as a
DataFrame and as a SQL common table expression of the same rows, so that queries over both can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import paths as P

FOLDERS = [
    "src/app/dashboard", "src/features/chat", "src/features/order/api", "src/components/ui", "src/components/forms", "src/components/commons", "src/hooks",
    "src/contexts/chat", "src/lib", "src/utils", "src/bases/api", "src/services", "tests/unit", "src/__tests__", ".storybook/decorators", "src/stories", "src/__fixtures__",
    "src/schemas", "src/validators", "src/layouts", "packages/mui/src/Button", "packages/core/src", "apps/web/src", "docs", "src/modules/user/schemas", "e2e", "src", "src/features",
]
NAMES = ["Card", "useThing", "table", "Sidebar", "order", "UserStore", "shims", "Chat", "app", "list"]
ENDINGS = [".tsx", ".ts", ".test.tsx", ".jsx", ".stories.tsx", "Form.tsx", ".schema.ts", ".d.ts", ".config.ts", "Provider.tsx", ".mjs", ".validator.ts", ".fixture.ts", ".tsx"]
PACKAGES = ["react", "vitest", "@storybook/react", "zod", "msw", "lodash", "@testing-library/react", "next", "jest", "design-system", "axios", "storybook"]
TYPES = ["import", "import", "export", "dynamic-import", "side-effect-import"]
#: The baseline snapshot holds what shipped before this day.
BASELINE_DAY = "1999-01-01"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def path_sql(p: str) -> str:
    folder = f"({_list(FOLDERS)})[1 + ({p} * 7 + {p} // 28) % 28]"
    return f"({folder} || CASE WHEN {p} % 17 = 0 THEN '/m' || {p} || '/index.ts' ELSE '/' || ({_list(NAMES)})[1 + ({p} // 3) % 10] || {p} || ({_list(ENDINGS)})[1 + ({p} // 5) % 14] END)"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def path_of(p: Column) -> Column:
    div = lambda n: F.floor(p / n)
    folder, text = _pick(FOLDERS, (p * 7 + div(28)) % 28), p.cast("string")
    named = F.concat(F.lit("/"), _pick(NAMES, div(3) % 10), text, _pick(ENDINGS, div(5) % 14))
    return F.concat(folder, F.when(p % 17 == 0, F.concat(F.lit("/m"), text, F.lit("/index.ts"))).otherwise(named))


def _either(patterns: tuple[str, str]) -> str:
    return f"(regexp_matches(base, '{patterns[0]}') OR regexp_matches(low, '{patterns[1]}'))"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


#: The kind of a file as SQL over path, low, raw, base and stem.
KIND_SQL = f"""CASE WHEN {_either(P.TEST)} THEN 'Test' WHEN {_either(P.STORY)} THEN 'Story' WHEN {_either(P.FIXTURE)} THEN 'Fixture'
  WHEN {_has('low', P.STORYBOOK)} AND {_has('base', P.SOURCE)} AND NOT {_has('base', P.STORYBOOK_CONFIG)} THEN 'Storybook Support'
  WHEN {_has('base', P.CONFIG)} OR {_has('low', P.STORYBOOK)} THEN 'Config' WHEN {_has('base', P.BARREL)} THEN 'Barrel'
  WHEN {_has('low', P.ROUTE_FOLDER)} OR ({_has('base', P.ROUTE_NAME)} AND {_has('low', P.SOURCE_ROOT)}) THEN 'Route'
  WHEN {_either(P.SCHEMA)} THEN 'Schema' WHEN {_either(P.VALIDATION)} THEN 'Validation'
  WHEN {_either(P.LAYOUT)} THEN CASE WHEN {_has('low', P.UI_LIBRARY)} THEN 'UI component' ELSE 'Layout' END
  WHEN {_has('low', P.FEATURE)} THEN 'Feature' WHEN {_has('stem', P.HOOK_NAME)} OR {_has('low', P.HOOK_FOLDER)} THEN 'Hook'
  WHEN {_either(P.STATE)} THEN 'Context/State' WHEN {_has('low', P.API)} THEN 'API/Infrastructure' WHEN {_has('low', P.UTILS)} THEN 'Utils'
  WHEN {_has('base', P.TYPES)} THEN 'Type Support'
  WHEN NOT form AND ({_has('low', P.COMPONENTS)} OR (inner_path <> '' AND ({_has('stem', '^[A-Z]')} OR {_has('inner_path', '(^|/)[A-Z][^/]*/')}))) THEN 'UI component'
  WHEN form THEN 'Form' ELSE 'Shared' END"""

#: files (part, path, kind, code_lines, total_lines, comment_lines)
FILES = f"""f0 AS (
  SELECT p_partkey AS part, {path_sql('p_partkey')} AS path, (p_size * 8)::BIGINT AS code_lines, (p_size * 8 + p_partkey % 30)::BIGINT AS total_lines,
    (p_partkey % 12)::BIGINT AS comment_lines FROM part
), f1 AS (
  SELECT *, lower(path) AS low, regexp_extract(path, '[^/]*$') AS raw, regexp_extract(path, '{P.PACKAGE_SOURCE}', 1) AS inner_path FROM f0
), f2 AS (
  SELECT *, lower(raw) AS base, regexp_replace(raw, '{P.SOURCE}', '') AS stem FROM f1
), f3 AS (
  SELECT *, {_has('low', P.FORM_FOLDER)} OR lower(stem) LIKE '%form' AS form FROM f2
), files AS (
  SELECT part, path, {KIND_SQL} AS kind, code_lines, total_lines, comment_lines FROM f3
)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        p.alias("part"), path_of(p).alias("path"), (F.col("p_size") * 8).cast("long").alias("code_lines"),
        (F.col("p_size") * 8 + p % 30).cast("long").alias("total_lines"), (p % 12).cast("long").alias("comment_lines"),
    )
    return rows.withColumn("kind", P.file_kind("path"))


def numbered_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).withColumn("path", F.col("part"))


def named(rows: DataFrame, column: str = "path") -> DataFrame:
    """Rows of numbered files with their paths."""
    return rows.withColumn(column, path_of(F.col(column)))


#: Line items with their file; the baseline snapshot has the earlier ones.
def _items(name: str, where: str) -> str:
    return f"{name} AS (SELECT *, {path_sql('l_partkey')} AS path, l_quantity::BIGINT AS q FROM lineitem{where})"


def items(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    """Line items with the path of their file, or its number, which path_of() names: what is shuffled by number stays small."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    if baseline:
        rows = rows.filter(F.col("l_shipdate") < F.lit(BASELINE_DAY).cast("timestamp_ntz"))
    return rows.withColumn("path", F.col("l_partkey") if numbered else path_of(F.col("l_partkey"))).withColumn("q", F.col("l_quantity").cast("long"))


def facts_sql(suffix: str = "", where: str = "") -> str:
    """functions, components, hooks, dependencies and types (each with the suffix) as SQL."""
    s = suffix
    return f"""{_items('i' + s, where)}, functions{s} AS (
  SELECT path, 'f' || l_orderkey || 'x' || l_linenumber AS name, 1 + q % 13 AS cc, (l_orderkey + l_linenumber) % 7 AS nesting, 1 + l_orderkey % 400 AS start_line FROM i{s} WHERE l_returnflag <> 'R'
), components{s} AS (
  SELECT path, 'C' || l_orderkey || 'x' || l_linenumber AS name, q % 16 AS jsx, l_suppkey % 6 AS hook_count, l_linenumber + l_orderkey % 5 AS render, 1 + l_orderkey % 400 AS start_line
  FROM i{s} WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 2
), hooks{s} AS (
  SELECT path, 'use' || (l_suppkey % 19) AS name FROM i{s} WHERE l_linestatus = 'O' AND l_linenumber = 1
), next{s} AS (
  SELECT path AS source, lead(path) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target, l_linenumber, l_partkey FROM i{s}
), dependencies{s} AS (
  SELECT source, target, ({_list(TYPES)})[1 + (l_partkey + l_linenumber) % 5] AS type, false AS is_external, l_linenumber % 5 = 0 AS is_type_only, target AS module FROM next{s} WHERE target IS NOT NULL
  UNION ALL
  SELECT path, ({_list(PACKAGES)})[1 + l_suppkey % 12], 'import', true, false, ({_list(PACKAGES)})[1 + l_suppkey % 12] FROM i{s} WHERE l_linenumber = 3
), types{s} AS (
  SELECT path, count(*) FILTER ((l_orderkey + l_linenumber) % 13 = 0) AS any_count, count(*) FILTER (l_orderkey % 3 = 0) AS assertion, count(*) FILTER (l_orderkey % 9 = 0) AS unsafe,
    count(*) FILTER (l_orderkey % 27 = 0) AS double, count(*) FILTER (l_orderkey % 6 = 0) AS const, count(*) FILTER (l_orderkey % 7 = 0) AS non_null, count(*) FILTER (l_orderkey % 31 = 0) AS ts_ignore,
    count(*) FILTER (l_orderkey % 37 = 0) AS ts_expect, count(*) FILTER (l_orderkey % 97 = 0) AS ts_nocheck FROM i{s} GROUP BY path
)"""


FACTS = f"{FILES}, {facts_sql()}"
BASELINE = facts_sql("_b", f" WHERE l_shipdate < TIMESTAMP '{BASELINE_DAY}'")


def functions(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("l_orderkey"), F.lit("x"), F.col("l_linenumber"))
    return items(spark, d, baseline, numbered).filter("l_returnflag <> 'R'").select(
        "path", name.alias("name"), (1 + F.col("q") % 13).alias("cc"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 7).alias("nesting"), (1 + F.col("l_orderkey") % 400).alias("start_line")
    )


def components(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    name = F.concat(F.lit("C"), F.col("l_orderkey"), F.lit("x"), F.col("l_linenumber"))
    return items(spark, d, baseline, numbered).filter("l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 2").select(
        "path", name.alias("name"), (F.col("q") % 16).alias("jsx"), (F.col("l_suppkey") % 6).alias("hook_count"),
        (F.col("l_linenumber") + F.col("l_orderkey") % 5).alias("render"), (1 + F.col("l_orderkey") % 400).alias("start_line"),
    )


def hooks(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    return items(spark, d, baseline, numbered).filter("l_linestatus = 'O' AND l_linenumber = 1").select("path", F.concat(F.lit("use"), F.col("l_suppkey") % 19).alias("name"))


def statements(spark: SparkSession, d: str, baseline: bool = False) -> DataFrame:
    """(source, target, type, is_type_only) of the internal dependencies, one row per statement, by the numbers of parts: path_of() names them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    kind = _pick(TYPES, (F.col("l_partkey") + F.col("l_linenumber")) % 5)
    rows = items(spark, d, baseline).select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), kind.alias("type"), (F.col("l_linenumber") % 5 == 0).alias("is_type_only"))
    return rows.filter("target IS NOT NULL")


def dependencies(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    """(source, target, type, is_external, is_type_only, module), one row per statement; numbered for the sources alone."""
    outer = items(spark, d, baseline, numbered).filter("l_linenumber = 3").select(F.col("path").alias("source"), _pick(PACKAGES, F.col("l_suppkey") % 12).alias("target"))
    inner = statements(spark, d, baseline).select(F.col("source") if numbered else path_of(F.col("source")).alias("source"), path_of(F.col("target")).alias("target"), "type", "is_type_only")
    return inner.select("source", "target", "type", F.lit(False).alias("is_external"), "is_type_only", F.col("target").alias("module")).unionByName(
        outer.select("source", "target", F.lit("import").alias("type"), F.lit(True).alias("is_external"), F.lit(False).alias("is_type_only"), F.col("target").alias("module"))
    )


def types(spark: SparkSession, d: str, baseline: bool = False, numbered: bool = False) -> DataFrame:
    every = {"assertion": 3, "unsafe": 9, "double": 27, "const": 6, "non_null": 7, "ts_ignore": 31, "ts_expect": 37, "ts_nocheck": 97}
    counts = [F.count_if(F.col("l_orderkey") % n == 0).alias(k) for k, n in every.items()]
    return items(spark, d, baseline, numbered).groupBy("path").agg(F.count_if((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0).alias("any_count"), *counts)


#: Line coverage of some files (path, line_found, line_hit) and the tests that ran (path, label).
ARTIFACTS = f"""coverage AS (
  SELECT {path_sql('p_partkey')} AS path, 10 + p_partkey % 50 AS line_found, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_partkey % 10 END AS line_hit FROM part WHERE p_partkey % 4 = 0
), executed AS (
  SELECT path, CASE WHEN part % 2 = 0 THEN 'junit' ELSE 'playwright' END AS label FROM files WHERE kind = 'Test' AND part % 3 = 0
)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").filter(p % 4 == 0)
    return rows.select(path_of(p).alias("path"), (10 + p % 50).alias("line_found"), F.when(p % 8 == 0, F.lit(0).cast("long")).otherwise(p % 10).alias("line_hit"))


def executed(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).filter((F.col("kind") == "Test") & (F.col("part") % 3 == 0))
    return rows.select("path", F.when(F.col("part") % 2 == 0, "junit").otherwise("playwright").alias("label"))
