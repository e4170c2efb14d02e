"""Reports: the four CSV tables, Markdown and HTML pages, graph files and stored snapshots. Pages show top lists only, tables everything."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.functions import paths as P
from tallyforge.functions import text as T
from tallyforge.operators.evidence import with_matching_test
from tallyforge.operators.facts import fixed

# Headers of the CSV tables, and what the clusters are called.
FILE_HEADERS = (
    "File", "File Type", "Has Test File", "Matrix Cluster", "Lines", "Code Lines", "Comment Lines", "Functions", "Complexity", "Components", "Hooks", "Dependencies", "Risk Level", "Type Safety",
    "Matrix Cluster Label",
)
DEPENDENCY_HEADERS = ("Source", "Target", "Type", "External", "Imported Items")
COMPONENT_HEADERS = ("Component", "File", "File Type", "JSX Elements", "Hooks", "Props Count", "Has Children", "Uses Ref", "Is ForwardRef", "Render Complexity")
HOOK_HEADERS = ("Hook", "Count", "Files", "Average Args", "With Dependencies")
QUALITY_HEADERS = ("Category", "Metric", "Metric ID", "Aggregation", "Automation", "Actual", "Threshold", "Verdict", "Summary")
SIZES, LEVELS = {"S": "小規模", "M": "中規模", "L": "大規模"}, {"1": "低複雑度", "2": "中複雑度", "3": "高複雑度"}


def cluster_label(code: Column | str) -> Column:
    c = E.normal_cluster(code)
    known = {s + k: f"{a}・{b}" for s, a in SIZES.items() for k, b in LEVELS.items()}
    return P.lookup(c, known, "未分類")


def _yes(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def files_csv(scored: DataFrame) -> DataFrame:
    """(line): a row for each file, in order of its path."""
    rows = with_matching_test(scored)
    safety = F.concat(F.col("any_count").cast("string"), F.lit(" any / "), F.col("assertion").cast("string"), F.lit(" assertions"))
    cells = [
        "path", "kind", _yes(F.col("has_test")), "cluster", "total_lines", "code_lines", "comment_lines", "n_functions", "complexity", "n_components", "n_hooks", "n_dependencies",
        E.complexity_risk("complexity"), safety, cluster_label("cluster"),
    ]
    return rows.orderBy("path").select(T.csv_row(*cells).alias("line"))


def dependencies_csv(dependencies: DataFrame) -> DataFrame:
    """dependencies with names (array of name, alias, kind) -> (line)."""
    names = F.array_join(F.transform("names", lambda n: F.coalesce(n["alias"], n["name"])), "; ")
    return dependencies.orderBy("source", "line").select(T.csv_row("source", "target", "type", _yes(F.col("is_external")), names).alias("line"))


def components_csv(components: DataFrame) -> DataFrame:
    kind = P.file_kind("path", "name", "has_children")
    cells = ["name", "path", kind, "jsx", F.array_join("hooks", ", "), F.lit("0"), _yes(F.col("has_children")), _yes(F.col("uses_ref")), _yes(F.col("forwards_ref")), "render"]
    return components.orderBy("path", "start_line").select(T.csv_row(*cells).alias("line"))


def hooks_csv(hooks: DataFrame) -> DataFrame:
    """hooks (path, name, args, has_dependencies) -> (line): each hook with how often and how it is used."""
    g = hooks.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"), F.avg("args").alias("args"), F.count_if("has_dependencies").alias("with_list"))
    listed = F.concat(F.col("with_list").cast("string"), F.lit("/"), F.col("n").cast("string"))
    return g.orderBy(F.desc("n"), "name").select(T.csv_row("name", "n", "files", F.format_string("%.2f", fixed("args")), listed).alias("line"))


def write_lines(lines: DataFrame, headers: tuple[str, ...], path: str, always: bool = False) -> None:
    """A CSV table as text files; the first line of the first is the header."""
    spark = lines.sparkSession
    quoted = [f'"{h}"' if always else h for h in headers]
    ordered = lines.select("line").withColumn("n", F.monotonically_increasing_id())
    head = spark.createDataFrame([(",".join(quoted), -1)], "line string, n long")
    head.unionByName(ordered).orderBy("n").select("line").write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, headers: dict[str, str], limit: int = 20) -> str:
    """The first rows of df as a table; headers name its columns."""
    cells = [T.markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit("—"))).alias(c) for c in headers]
    rows = df.select(*cells).limit(limit).collect()  # a top list
    if not rows:
        return "—\n"
    lines = ["| " + " | ".join(headers.values()) + " |", "|" + "---|" * len(headers)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def anchor(title: str) -> str:
    kept = "".join(c for c in title.lower() if c.isalnum() or c.isspace() or c == "-")
    return "-".join(kept.split())


def page(title: str, sections: dict[str, str]) -> str:
    """A Markdown page with a table of contents of its sections."""
    contents = "\n".join(f"{i}. [{h}](#{anchor(h)})" for i, h in enumerate(sections, 1))
    body = "\n\n".join(f"## {h}\n\n{text.strip()}" for h, text in sections.items())
    return f"# {title}\n\n## Contents\n\n{contents}\n\n{body}\n"


def html_page(markdown: str) -> str:
    """A page of markdown_table() and headings as HTML."""
    out, table = [], False
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    for line in markdown.split("\n"):
        if line.startswith("|---"):
            continue
        if line.startswith("| "):
            cells = [c.strip().replace("\\|", "|") for c in line[2:-1].replace("\\|", "\0").split("|")]
            cells = [c.replace("\0", "|") for c in cells]
            tag = "td" if table else "th"
            out.append(("" if table else "<table>") + "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>")
            table = True
            continue
        if table:
            out.append("</table>")
            table = False
        hashes = len(line) - len(line.lstrip("#"))
        if hashes:
            title = line[hashes:].strip()
            out.append(f'<h{hashes} id="{anchor(title)}">{escape(title)}</h{hashes}>')
        elif line.strip():
            out.append(f"<p>{escape(line.strip())}</p>")
    return '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' + "\n".join(out) + ("</table>" if table else "") + "</body></html>\n"


def graph_script(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> str:
    """The drawn part of a graph as JSON that can stand in a script element."""
    drawn = {"nodes": [r.asDict() for r in nodes.limit(limit).collect()], "edges": [r.asDict() for r in edges.limit(limit * limit).collect()]}  # bounded by limit
    return json.dumps(drawn, ensure_ascii=False, sort_keys=True).replace("<", "\\u003c")
