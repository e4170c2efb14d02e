"""Registered queries of the source reader: each part is a file of code, one statement for each of its line items, with SQL for what is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import lookup as L
from tallyforge.operators.graph import cut
from tallyforge.plans import project as S
from tallyforge.plans.queries import register
from tallyforge.sources import extract as X

#: What a line item writes, by (l_orderkey + l_linenumber) % 6; {o}, {l}, {s} and {q} are order, line, supplier and quantity.
CODE = [
    "import {{ a{o}, type B{o} }} from './m{s}'",
    'import type {{ T{o} }} from "pkg{s}/sub"; export * from "@scope/all{s}/x"',
    "export const f{o}x{l} = (a: number) => a > {q} ? (a && {q}) : a",
    "function g{o}x{l}(s) {{ switch (s) {{ case {q}: return s?.a?.b; case 0: break }} for (const x of s) {{ if (x) {{ continue }} }} return s as any }}",
    'const C{o}x{l} = () => {{ const [s] = useState({q}); useEffect(() => {{}}, [s]); return <div title="T{q}">{{s && <b>it\'s</b>}}</div> }}',
    "/* @ts-ignore {q}\n import x from 'no' */ const d{o}x{l} = v{o}! as unknown as D",
]
ROWS = "r AS (SELECT *, l_quantity::BIGINT AS q, 'part' || l_partkey || '.tsx' AS path, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem)"


def sources(spark, d) -> DataFrame:
    """(path, content) of every part that a line item names; numbers are gathered, and the code is written from them."""

    def code(s: Column) -> Column:
        text = F.element_at(F.array(*map(F.lit, CODE)), ((s["o"] + s["l"]) % 6 + 1).cast("int"))
        for mark in "olsq":
            text = F.replace(text, F.lit(f"{{{mark}}}"), s[mark].cast("string"))
        return F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))

    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    item = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))
    parts = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return parts.select(F.concat(F.lit("part"), "l_partkey", F.lit(".tsx")).alias("path"), F.array_join(F.transform("items", code), "\n").alias("content"))


def facts(spark, d, *wanted: str) -> DataFrame:
    return X.source_facts(sources(spark, d), *wanted)


@register(f"""WITH {ROWS} SELECT path, 'import' AS type, false AS is_type_only, './m' || l_suppkey AS specifier FROM r WHERE k = 0 UNION ALL
SELECT path, 'import', true, 'pkg' || l_suppkey || '/sub' FROM r WHERE k = 1 UNION ALL SELECT path, 'export', false, '@scope/all' || l_suppkey || '/x' FROM r WHERE k = 1""")
def source_statements(spark, d):
    return X.statements(facts(spark, d, "imports")).select("path", "type", "is_type_only", "specifier")


@register(f"""WITH {ROWS} SELECT path AS source, 'm' || l_suppkey AS target, 'import' AS type, false AS is_type_only, false AS is_external FROM r WHERE k = 0 UNION ALL
SELECT path, 'pkg' || l_suppkey, 'import', true, true FROM r WHERE k = 1 UNION ALL SELECT path, '@scope/all' || l_suppkey, 'export', false, true FROM r WHERE k = 1""")
def source_dependencies(spark, d):
    f = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("part"), "l_partkey", F.lit(".tsx")).alias("path")).distinct()
    statements = cut(source_statements(spark, d).select("path", "type", "is_type_only", "specifier"), "source_statements")
    return X.resolved(statements, f).select("source", "target", "type", "is_type_only", "is_external")


@register(f"""WITH {ROWS} SELECT path, 'f' || l_orderkey || 'x' || l_linenumber AS name, 3 AS cc, 1 AS nesting, 1 AS ternaries, 1 AS logical, 0 AS loops FROM r WHERE k = 2 UNION ALL
SELECT path, 'g' || l_orderkey || 'x' || l_linenumber, 6, 2, 0, 0, 1 FROM r WHERE k = 3 UNION ALL SELECT path, 'C' || l_orderkey || 'x' || l_linenumber, 2, 0, 0, 1, 0 FROM r WHERE k = 4 UNION ALL
SELECT path, 'anonymous', 1, 0, 0, 0, 0 FROM r WHERE k = 4""")
def source_functions(spark, d):
    return X.functions(facts(spark, d, "functions")).select("path", "name", "cc", "nesting", "ternaries", "logical", "loops")


@register(f"WITH {ROWS} SELECT path, 'C' || l_orderkey || 'x' || l_linenumber AS name, 2 AS jsx, 2 AS hook_count, 1 AS render, false AS has_children FROM r WHERE k = 4")
def source_components(spark, d):
    return X.components(facts(spark, d, "components")).select("path", "name", "jsx", "hook_count", "render", "has_children")


@register(f"WITH {ROWS} SELECT path, 'useState' AS name, 1 AS args, false AS has_dependencies FROM r WHERE k = 4 UNION ALL SELECT path, 'useEffect', 2, true FROM r WHERE k = 4")
def source_hooks(spark, d):
    return X.hooks(facts(spark, d, "hooks")).select("path", "name", "args", "has_dependencies")


@register(f"""WITH {ROWS} SELECT path, count(*) FILTER (k = 3) AS any_count, count(*) FILTER (k = 5) AS unknown_count, count(*) FILTER (k = 3) + 2 * count(*) FILTER (k = 5) AS assertion,
  count(*) FILTER (k = 3) + count(*) FILTER (k = 5) AS unsafe, count(*) FILTER (k = 5) AS double, 0 AS const, count(*) FILTER (k = 5) AS non_null, count(*) FILTER (k = 5) AS ts_ignore, 0 AS ts_expect, 0 AS ts_nocheck
FROM r GROUP BY path""")
def source_types(spark, d):
    return X.types(facts(spark, d, "types"))


@register(f"WITH {ROWS} SELECT path, (count(*) + count(*) FILTER (k = 5))::BIGINT AS total_lines, count(*) FILTER (k <> 5) AS code_lines, 2 * count(*) FILTER (k = 5) AS comment_lines FROM r GROUP BY path")
def source_lines(spark, d):
    return X.line_classes(sources(spark, d))


@register(f"WITH {ROWS} SELECT path, count(*) FILTER (k = 4) * 2 AS n_texts, count(*) FILTER (k = 4) > 0 AS renders FROM r GROUP BY path")
def source_texts(spark, d):
    return facts(spark, d, "texts", "rendered").select("path", F.size("texts").cast("long").alias("n_texts"), F.array_contains("rendered", "div").alias("renders"))


#: Lines of documents that look like secrets.
@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '(?i)api[_-]?key\\s*[:=]\\s*[''"][^''"\\n]+') || regexp_extract_all(line, '(?i)secret\\s*[:=]\\s*[''"][^''"\\n]+')
  || regexp_extract_all(line, '-----BEGIN (?:RSA |EC )?PRIVATE KEY-----') || regexp_extract_all(line, 'AKIA[0-9A-Z]{16}')) AS text FROM l)
SELECT doc_id::VARCHAR AS path, n::INT AS line, substr(text, 1, 80) AS text FROM m""")
def secret_findings(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return X.secrets(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


#: Every customer is a file that writes out a key, a secret and an access key, a private key, or nothing.
@register("""SELECT 'c' || c_custkey || '.ts' AS path, line::INT AS line, text FROM (
  SELECT c_custkey, 2 AS line, 'api_key = ''' || c_name AS text FROM customer WHERE c_custkey % 4 = 0 UNION ALL
  SELECT c_custkey, 1, 'SECRET: "' || c_name FROM customer WHERE c_custkey % 4 = 1 UNION ALL
  SELECT c_custkey, 3, 'AKIA' || lpad(c_custkey::VARCHAR, 16, '0') FROM customer WHERE c_custkey % 4 = 1 UNION ALL
  SELECT c_custkey, 4, '-----BEGIN RSA PRIVATE KEY-----' FROM customer WHERE c_custkey % 4 = 2)""")
def secret_indicators(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    content = (
        F.when(k % 4 == 0, F.concat(F.lit("// x\nconst api_key = '"), name, F.lit("'")))
        .when(k % 4 == 1, F.concat(F.lit('let SECRET: "'), name, F.lit('"\n\nAKIA'), F.lpad(k.cast("string"), 16, "0")))
        .when(k % 4 == 2, F.lit("a\nb\n\n  `-----BEGIN RSA PRIVATE KEY-----`")).otherwise(F.lit("const open = 1"))
    )
    return X.secrets(spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".ts")).alias("path"), content.alias("content")))


#: Every part hands its name on to the next one, up to the end of its fifty; in every seventh fifty the last hands on to the first.
HANDED_ON = f"""h AS (
  SELECT p_partkey AS p, {S.path_sql('p_partkey')} AS file, CASE WHEN p_partkey % 50 <> 49 THEN p_partkey + 1 WHEN p_partkey // 50 % 7 = 3 THEN p_partkey - 49 END AS q FROM part
), m AS (SELECT h.p, h.file, o.p AS q, o.file AS next_file FROM h JOIN h o ON h.q = o.p
), w AS (
  SELECT p, file, q AS last, next_file AS end_file, 1 AS hops FROM m UNION ALL SELECT w.p, w.file, m.q, m.next_file, hops + 1 FROM w JOIN m ON m.p = w.last WHERE hops < 50
)"""


@register(f"""WITH RECURSIVE {HANDED_ON} SELECT file, 'n' || p AS name, arg_max(CASE WHEN hops < 50 THEN end_file END, hops) FILTER (hops < 50) AS end_file,
  'n' || arg_max(w.last, hops) AS end_name, max(hops)::BIGINT AS hops FROM w GROUP BY file, p HAVING max(hops) < 50
UNION ALL SELECT file, 'n' || p, NULL, NULL, NULL FROM w GROUP BY file, p HAVING max(hops) >= 50""")
def re_export_ends(spark, d):
    p = F.col("p_partkey")
    to = F.when(p % 50 != 49, p + 1).when(F.floor(p / 50) % 7 == 3, p - 49)
    parts = spark.read.parquet(f"{d}/part.parquet")
    there = parts.select(p.alias("q"), S.path_of(p).alias("next_file"))
    rows = parts.select(p.alias("p"), S.path_of(p).alias("file"), to.alias("q")).join(there, "q")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return X.defining_files(rows.select("file", name("p").alias("name"), "next_file", name("q").alias("next_name")))


CONFIGS = ("tsconfig.json", "src/tsconfig.app.json", "src/features/jsconfig.json", "src/features/tsconfig.json", "src/features/order/tsconfig.base.json", "packages/core/tsconfig.json", "src/modules/user/schemas/tsconfig.lib.json")
ALIAS_ROWS = [("tsconfig.json", "@/*", "src/*"), ("tsconfig.json", "@/components/*", "src/components/ui/*"), ("src/tsconfig.app.json", "@/*", "src/*"), ("src/features/tsconfig.json", "@/features/*", "src/features/chat/*"), ("packages/core/tsconfig.json", "core", "packages/core/src/index.ts")]
_VALUES = ", ".join(f"('{c}', '{c.rpartition('/')[0]}')" for c in CONFIGS)
NEAREST_SQL = f"""cfg AS (SELECT place, folder, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN place LIKE '%jsconfig.json' THEN 1 WHEN regexp_matches(place, '(^|/)tsconfig\.json$') THEN 0
  WHEN regexp_matches(place, 'tsconfig\.(app|lib|src)\.json$') THEN 2 WHEN regexp_matches(place, 'tsconfig\.base\.json$') THEN 4 ELSE 3 END, place) AS n FROM (VALUES {_VALUES}) t(place, folder)
), near AS (
  SELECT f.path, c.place FROM files f JOIN cfg c ON c.n = 1 AND (c.folder = '' OR starts_with(f.path, c.folder || '/')) QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(c.folder) DESC) = 1
)"""


@register(f"WITH {S.FILES}, {NEAREST_SQL} SELECT path, place FROM near")
def nearest_configurations(spark, d):
    return L.nearest_places(S.files(spark, d), spark.createDataFrame([(c,) for c in CONFIGS], "place string"))


_ALIASES = ", ".join(f"('{p}', '{a}', '{b}')" for p, a, b in ALIAS_ROWS)


@register(f"""WITH {S.FILES}, {NEAREST_SQL}, named AS (SELECT DISTINCT place, '@' || substr(path, 4) AS specifier FROM near WHERE path LIKE 'src/%' UNION SELECT place, 'core' FROM near
), al AS (SELECT place, a, b, rtrim(a, '*') AS head FROM (VALUES {_ALIASES}) t(place, a, b)
) SELECT n.place, specifier, a AS pattern, replace(b, '*', substr(specifier, length(head) + 1)) AS base FROM named n JOIN al ON al.place = n.place AND CASE WHEN a LIKE '%*' THEN starts_with(specifier, head) ELSE specifier = a END
QUALIFY row_number() OVER (PARTITION BY n.place, specifier ORDER BY length(head) DESC) = 1""")
def matched_aliases(spark, d):
    near = nearest_configurations(spark, d)
    names = near.filter("path LIKE 'src/%'").select("place", F.concat(F.lit("@"), F.substring(F.col("path"), F.lit(4), F.length("path"))).alias("specifier"))
    names = names.unionByName(near.select("place", F.lit("core").alias("specifier"))).distinct()
    aliases = spark.createDataFrame([(p, a, [b]) for p, a, b in ALIAS_ROWS], L.ALIASES)
    return L.matched_aliases(names, aliases).select("place", "specifier", "pattern", F.col("bases")[0].alias("base"))
