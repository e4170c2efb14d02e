"""Graph operators over edge tables: every one is a bounded number of joins and aggregations, or a checkpointed loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import paths as P
from tallyforge.operators.contract import strong_components, topological_layers, topological_order, weak_components  # noqa: F401  (part of this module's operators)
from tallyforge.operators.spread import two_steps
from tallyforge.operators.work import cut

#: Graphs may have numbers as ids, so that little is shuffled: what is shown or compared as text is then named from the number.
Name = Callable[[Column], Column]


def _same(id_: Column) -> Column:
    return id_


def collapse_edges(statements: DataFrame, source: str, target: str, kind: str, type_only: str | None = None) -> DataFrame:
    """Dependency statements -> (source, target, weight, types, is_type_only), one row per edge."""
    only = F.bool_and(F.coalesce(F.col(type_only), F.lit(False))) if type_only else F.lit(False)
    return statements.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_set(kind)).alias("types"), only.alias("is_type_only")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """edges (source, target), distinct -> (id, in_degree, out_degree) of all nodes on an edge."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops."""
    e = edges.select("source", "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source != target").distinct()


def cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, length, edge_count, severity) of the strong components with a cycle; a loop alone is a cycle of length 1."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("length"))
    inner = edges.select("source", "target").distinct()
    inner = inner.join(components.select(F.col("id").alias("source"), F.col("component").alias("cs")), "source")
    inner = inner.join(components.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target").filter("cs = ct")
    counts = inner.groupBy(F.col("cs").alias("component")).agg(F.count(F.lit(1)).alias("edge_count"))
    severity = F.when(F.col("length") >= 6, "critical").when(F.col("length") >= 3, "high").otherwise("medium")
    return sizes.join(counts, "component").select("component", "length", "edge_count", severity.alias("severity"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, stop: float | None = 1e-6) -> DataFrame:
    """(id, page_rank): start 1/n, what nodes without way out hold is spread evenly; stops when the sum of changes is below stop * n."""
    e = cut(edges.select("source", "target").distinct(), "pr_edges")
    out = e.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    nodes = cut(e.select(F.col("source").alias("id")).union(e.select("target")).distinct().join(out, F.col("id") == F.col("source"), "left").select("id", F.coalesce("out", F.lit(0)).alias("out")), "pr_nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("page_rank"))
    rank = nodes.withColumn("page_rank", F.lit(1.0 / n))
    for _ in range(iterations):
        sink = rank.filter("out = 0").agg(F.coalesce(F.sum("page_rank"), F.lit(0.0)).alias("sink"))
        given = e.join(rank.filter("out > 0"), F.col("source") == F.col("id")).groupBy("target").agg(F.sum(F.col("page_rank") / F.col("out")).alias("got"))
        new = rank.join(given, F.col("id") == F.col("target"), "left").crossJoin(F.broadcast(sink))
        value = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("sink") / n)
        new = cut(new.select("id", "out", value.alias("page_rank"), F.col("page_rank").alias("old")), "pr_rank")
        rank = new.select("id", "out", "page_rank")
        if stop is not None and new.agg(F.sum(F.abs(F.col("page_rank") - F.col("old")))).first()[0] < stop * max(n, 1):
            break
    return rank.select("id", "page_rank")


def spread(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """start (id) -> (id, distance): the least number of steps from source to target from any start, within hops or to the end.

    Each round leaves only from the nodes met in the round before, and a node is met once.
    """
    steps = cut(edges.select("source", "target").filter("source != target").distinct(), "spread_edges")
    seen = front = cut(start.select("id").distinct().withColumn("distance", F.lit(0)), "spread")
    done = 0
    while hops is None or done < hops:
        done += 1
        met = steps.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        front = cut(met.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(done)), "spread")
        if hops is None and front.isEmpty():
            break
        seen = seen.unionByName(front)
        if done % 16 == 0:
            seen = cut(seen, "spread_seen")
    return seen


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """changed (id) -> (id, distance): all files whose facts may rest on a changed one, along imports backwards to the end."""
    return spread(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), changed)


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """roots (id) -> (root, id, distance) of all nodes within so many undirected hops, the root at 0; each hop leaves from nodes first met.

    Two hops over whole numbers go by packed lists of neighbours.
    """
    if hops == 2 and edges.schema["source"].dataType.typeName() == edges.schema["target"].dataType.typeName() == roots.schema["id"].dataType.typeName() == "long":
        e = edges.filter("source != target").select("source", "target")
        return two_steps(e.union(e.select("target", "source")), roots)
    both = undirected(edges)
    reach = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance")).distinct()
    front = reach
    for d in range(1, hops + 1):
        met = front.join(both, front.id == both.source).select("root", F.col("target").alias("id")).distinct()
        front = met.join(reach.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(d).alias("distance"))
        reach = reach.unionByName(front)
    return reach


def impact_scores(edges: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """changed (id) -> (id, distance, score) of every node in reach: nearness, whether changed itself, and its degrees.

    All changes spread at once and a node is met once, so rows follow the nodes and not changes times reach.
    """
    near = spread(undirected(edges), changed, hops)
    d = degrees(edges.select("source", "target").distinct())
    joined = near.join(d, "id", "left").fillna(0, ["in_degree", "out_degree"])
    own = F.when(F.col("distance") == 0, 100).otherwise(0)
    score = own + F.greatest(F.lit(0), 50 - 12 * F.col("distance")) + 5 * F.col("in_degree") + 4 * F.col("out_degree")
    return joined.select("id", F.col("distance").cast("long").alias("distance"), score.cast("long").alias("score"))


def slice_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def project_graph(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """dependencies (source, target, type, is_external, is_type_only) of files (path) -> statements that make the graph: internal, at run time, of files in scope."""
    rows = dependencies.filter("NOT is_external AND NOT is_type_only")
    return rows.join(files.select(F.col("path").alias("source")), "source", "left_semi").select("source", "target", "type")


def graph_totals(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, cycles, strong components and the size of the largest."""
    inside = cycles(edges, components)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    one = sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"))
    n_edges = edges.select("source", "target").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return one.crossJoin(n_edges).crossJoin(inside.agg(F.count(F.lit(1)).alias("cycles")))


def top_degrees(degrees_: DataFrame, limit: int = 10, name: Name = _same) -> DataFrame:
    """(axis, rank, id, degree): the nodes with most edges in and out, ties by id."""
    parts, named = [], degrees_.withColumn("id", name(F.col("id")))
    for axis, column in (("in", "in_degree"), ("out", "out_degree")):
        top = named.orderBy(F.desc(column), "id").limit(limit)
        rank = F.row_number().over(Window.orderBy(F.desc(column), "id")).cast("long")
        parts.append(top.select(F.lit(axis).alias("axis"), rank.alias("rank"), "id", F.col(column).alias("degree")))
    return parts[0].unionByName(parts[1])


def graph_warnings(totals: DataFrame, tops: DataFrame) -> DataFrame:
    """(warning, id, value) from graph_totals() and top_degrees(): cycles, a large component, a hub and a fan-out beyond their thresholds."""
    first = tops.filter("rank = 1")
    hub = first.filter("axis = 'in'").select(F.col("id").alias("hub"), F.col("degree").alias("hub_degree"))
    fan = first.filter("axis = 'out'").select(F.col("id").alias("fan"), F.col("degree").alias("fan_degree"))
    one = totals.join(hub, F.lit(True), "left").join(fan, F.lit(True), "left")
    n = F.greatest(F.col("nodes"), F.lit(1))
    none = F.lit(None).cast("string")

    def row(name: str, when: Column, id_: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("warning"), id_.cast("string").alias("id"), value.cast("long").alias("value")))

    rows = F.array_compact(
        F.array(
            row("cycles", F.col("cycles") > 0, none, F.col("cycles")), row("large-component", F.col("largest") >= 4, none, F.col("largest")),
            row("hub", F.col("hub_degree") >= F.greatest(F.lit(5), F.ceil(n * 0.1)), F.col("hub"), F.col("hub_degree")),
            row("fan-out", F.col("fan_degree") >= F.greatest(F.lit(5), F.ceil(n * 0.18)), F.col("fan"), F.col("fan_degree")),
        )
    )
    return one.select(F.explode(rows).alias("w")).select("w.*")


def structure_rows(tops: DataFrame, ranks: DataFrame) -> DataFrame:
    """(aspect, id, value) worth showing: three hubs of degree 2 and more, three fan-outs of 3 and more, three central nodes above the last of the top ten.

    ranks (id, page_rank) are the top ten.
    """
    hubs = tops.filter("axis = 'in' AND degree >= 2 AND rank <= 3").select(F.lit("hub").alias("aspect"), "id", F.col("degree").cast("double").alias("value"))
    fans = tops.filter("axis = 'out' AND degree >= 3 AND rank <= 3").select(F.lit("fan-out").alias("aspect"), "id", F.col("degree").cast("double").alias("value"))
    least = ranks.agg(F.min("page_rank").alias("least"))
    central = ranks.crossJoin(least).filter("page_rank > least").orderBy(F.desc("page_rank"), "id").limit(3)
    return hubs.unionByName(fans).unionByName(central.select(F.lit("central").alias("aspect"), "id", F.col("page_rank").alias("value")))


def named_components(components: DataFrame, name: Name) -> DataFrame:
    """components (id, component) of numbers -> the same by name, each component called by the first name in it."""
    first = components.groupBy("component").agg(F.min(name(F.col("id"))).alias("first"))
    return components.join(first, "component").select(name(F.col("id")).alias("id"), F.col("first").alias("component"))


def cut_candidates(statements: DataFrame, components: DataFrame, files: DataFrame, name: Name = _same) -> DataFrame:
    """Per cycle the statement to remove first, and the file to take shared parts out of.

    statements (source, target, type); files (path, kind, code_lines), path being an id -> (component, source, target,
    type, barrel, shared). Statements on barrels come first, then exports, then those of files with few statements, then
    by name. The shared file takes part in most of the cycle's statements, then has fewest lines; files of routes,
    features, layouts and forms are preferred. Texts are made only for the statements that lead by all else.
    """
    member = components.join(cycles(statements, components).select("component"), "component", "left_semi")
    out = statements.groupBy("source").agg(F.count(F.lit(1)).alias("n_out"))
    inside = statements.join(member.join(out, F.col("id") == F.col("source"), "left").select("id", "component", "n_out").withColumnRenamed("id", "source"), "source")
    inside = inside.join(member.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target").filter("component = ct").drop("ct")
    barrel = P.is_barrel(name(F.col("source"))) | P.is_barrel(name(F.col("target")))
    lead = F.when(F.col("barrel"), 0).otherwise(1) * 2 + F.when(F.col("type") == "export", 0).otherwise(1)
    inside = cut(inside.withColumn("barrel", barrel).withColumn("lead", F.shiftleft(lead.cast("long"), 48) + F.col("n_out")), "inside")
    least = inside.groupBy("component").agg(F.min("lead").alias("lead"), F.bool_or("barrel").alias("any_barrel"))
    source, target = name(F.col("source")), name(F.col("target"))
    order = F.struct(F.concat(source, F.lit("->"), target).alias("d"), source.alias("source"), target.alias("target"), "type")
    first = inside.join(least, ["component", "lead"]).groupBy("component").agg(F.min(order).alias("m"), F.first("any_barrel").alias("barrel"))
    ends = inside.select("component", F.col("source").alias("id")).unionByName(inside.select("component", F.col("target").alias("id")))
    part = ends.groupBy("component", "id").agg(F.count(F.lit(1)).alias("k")).join(files.select(F.col("path").alias("id"), "kind", "code_lines"), "id", "left").withColumn("id", name(F.col("id")))
    preferred = F.coalesce(F.col("kind"), F.lit("Shared")).isin("Route", "Feature", "Layout", "Form")
    choice = F.struct(F.when(preferred, 0).otherwise(1).alias("a"), (-F.col("k")).alias("b"), F.coalesce("code_lines", F.lit(2**53 - 1)).alias("c"), "id")
    shared = part.groupBy("component").agg(F.min(choice).alias("s"), F.min("id").alias("first")).select("component", F.col("s.id").alias("shared"), "first")
    return first.join(shared, "component").select(F.col("first").alias("component"), "m.source", "m.target", "m.type", "barrel", "shared")


def drawn_nodes(edges: DataFrame, limit: int = 300) -> DataFrame:
    """The edges among the nodes with most edges."""
    d = degrees(edges.select("source", "target").distinct())
    top = d.orderBy((F.col("in_degree") + F.col("out_degree")).desc(), "id").limit(limit)
    return slice_graph(edges, top)


def component_report(components: DataFrame, limit: int = 10, members: int = 20) -> DataFrame:
    """(rank, component, size, members): the largest components, ties by their smallest node, with their first members."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size"), "component").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")).cast("long"))
    w = Window.partitionBy("component").orderBy("id")
    shown = components.join(F.broadcast(top), "component").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= members)
    return shown.groupBy("rank", "component", "size").agg(F.array_sort(F.collect_list("id")).alias("members"))
