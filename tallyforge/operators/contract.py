"""Components and layers of a graph by contraction: what hangs together simply is folded away, so that long paths cost few rounds.

Chains (nodes with one way in and one way out) are folded by pointer doubling, whose rounds grow with the logarithm of
their length; nodes at the ends are taken off. What is folded away is written to tables and unfolded in reverse order.
All work is joins and aggregations over edges; no task holds a graph, but for a last remainder of at most TAIL edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.work import cut, discard


#: What contraction has left of at most so many edges (16 bytes each) is finished by one task, as rounds over it cost more than it does.
TAIL = 1 << 16
#: Chains are folded when at least one node in so many is on one.
FOLD = 8


def in_one_task(rows: DataFrame, columns: str, work: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """Run work over rows, at most TAIL of them, in one task; it gives columns by name."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield pd.DataFrame(work(pd.concat(parts, ignore_index=True)))

    return rows.coalesce(1).mapInPandas(go, columns)


def _numbered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, numbers = np.unique(np.concatenate([rows["source"].to_numpy(), rows["target"].to_numpy()]), return_inverse=True)
    return ids, numbers[: len(rows)], numbers[len(rows) :]


def _links(n: int, source: np.ndarray, target: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges ordered by source and then target: where each node's begin, and their targets."""
    order = np.lexsort((target, source))
    begin = np.searchsorted(source[order], np.arange(n + 1))
    return begin.tolist(), target[order].tolist()


def _strong(ids: np.ndarray, source: np.ndarray, target: np.ndarray) -> dict:
    """Depth-first numbering with an explicit stack; a node that reaches none older than itself closes its component."""
    n = len(ids)
    begin, to = _links(n, source, target)
    number, low, label = [-1] * n, [0] * n, np.full(n, -1)
    open_nodes: list[int] = []
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        path = [(root, begin[root])]
        number[root] = low[root] = count
        count += 1
        open_nodes.append(root)
        while path:
            node, at = path.pop()
            if at < begin[node + 1]:
                path.append((node, at + 1))
                near = to[at]
                if number[near] < 0:
                    number[near] = low[near] = count
                    count += 1
                    open_nodes.append(near)
                    path.append((near, begin[near]))
                elif label[near] < 0:
                    low[node] = min(low[node], number[near])
                continue
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[node])
            if low[node] == number[node]:
                cut_at = len(open_nodes) - 1
                while open_nodes[cut_at] != node:
                    cut_at -= 1
                members = open_nodes[cut_at:]
                del open_nodes[cut_at:]
                label[members] = min(members)
    return {"component": ids[label]}


def _small_strong(rows: pd.DataFrame) -> dict:
    ids, source, target = _numbered(rows)
    return {"id": ids, **_strong(ids, source, target)}


def _small_weak(rows: pd.DataFrame) -> dict:
    """Labels: every node takes the smallest it is linked to, and the label of its label, until nothing changes."""
    ids, source, target = _numbered(rows)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[source], label[target])
        new = label.copy()
        np.minimum.at(new, source, least)
        np.minimum.at(new, target, least)
        new = new[new]
        if (new == label).all():
            return {"id": ids, "component": ids[label]}
        label = new


def _small_layers(rows: pd.DataFrame) -> dict:
    """Layers of edges (source, target, w) whose ends have least layers (cs, ct); nodes on and behind cycles are left out."""
    ids, source, target = _numbered(rows)
    layer, waiting = np.zeros(len(ids), np.int64), np.bincount(target, minlength=len(ids))
    layer[source], layer[target] = rows["cs"].to_numpy(), rows["ct"].to_numpy()
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in zip(source.tolist(), target.tolist(), rows["w"].tolist(), strict=True):
        out.setdefault(a, []).append((b, w))
    queue = np.flatnonzero(waiting == 0).tolist()
    for a in queue:
        for b, w in out.get(a, []):
            layer[b] = max(layer[b], layer[a] + w)
            waiting[b] -= 1
            if not waiting[b]:
                queue.append(b)
    return {"id": ids[queue], "layer": layer[queue]}


def all_nodes(edges: DataFrame) -> DataFrame:
    """edges (source, target) -> (id) of all nodes."""
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that undirected paths reach.

    In a round each node hooks on its smallest neighbour, pointers are doubled until all name a root, and edges are drawn
    anew between roots: every root with an edge left has swallowed a neighbour, so at most half of them remain.
    """
    label = cut(all_nodes(edges).select("id", F.col("id").alias("component")), "weak")
    e = cut(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a != b").distinct(), "weak_edges")
    key = edges.schema["source"].dataType.simpleString()
    while (count := e.count()) > 0:
        if count <= TAIL:
            roots = in_one_task(e.select(F.col("a").alias("source"), F.col("b").alias("target")), f"id {key}, component {key}", _small_weak).select(F.col("id").alias("component"), F.col("component").alias("up"))
            return cut(label.join(roots, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "weak")
        both = e.select(F.col("a").alias("id"), F.col("b").alias("near")).union(e.select("b", "a"))
        up = cut(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("up")), "weak_up")
        while True:
            over = up.select(F.col("id").alias("up"), F.col("up").alias("further"))
            new = cut(up.join(over, "up").select("id", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "weak_up")
            moved = not new.filter("moved").isEmpty()
            discard(up)
            up = new
            if not moved:
                break
        roots = up.select("id", "up")
        drawn = e.join(roots.select(F.col("id").alias("a"), F.col("up").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("up").alias("rb")), "b")
        drawn = cut(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a != b").distinct(), "weak_edges")
        named = label.join(roots.select(F.col("id").alias("component"), "up"), "component", "left")
        named = cut(named.select("id", F.coalesce("up", "component").alias("component")), "weak")
        discard(e, label, up)
        e, label = drawn, named
    return label


def degrees_of(e: DataFrame) -> DataFrame:
    """edges (source, target), distinct -> (id, n_in, n_out)."""
    ends = e.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("target", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def doubled(pointers: DataFrame, size: int, how: list, name: str) -> DataFrame:
    """pointers (id, at, and others) with at moved on until it leaves the ids; those that never do are on rings.

    how gives the other columns from those of the pointer (p.) and of the one it names (q.). After 2^k >= size steps
    what still names one of the ids is on a ring and has been all around it.
    """
    now = cut(pointers.withColumn("open", F.lit(True)), name)
    steps = 1
    while steps < 2 * size:
        steps *= 2
        p, q = now.filter("open").alias("p"), now.alias("q")
        open_ = p.join(q, F.col("p.at") == F.col("q.id"), "left")
        on = F.col("q.id").isNotNull()
        moved = open_.select("p.id", F.coalesce("q.at", "p.at").alias("at"), *[F.when(on, x).otherwise(F.col(f"p.{c}")).alias(c) for c, x in how], (on & F.col("q.open")).alias("open"))
        # a pointer that met a finished one is finished with it
        new = cut(now.filter("NOT open").select(*moved.columns).unionByName(moved), name)
        discard(now)
        now = new
        if now.filter("open").isEmpty():
            break
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes on common cycles share the smallest of them; others are alone.

    Rounds of taking off nodes without a way in or out and of folding chains, until neither helps; then each node takes
    the smallest node that reaches it as its colour, so that all roots search at once, and the nodes of a colour that
    reach its root are a component. A chain belongs to a component if its two ends do.
    """
    nodes = cut(all_nodes(edges), "scc_nodes")
    e = cut(edges.select("source", "target").filter("source != target").distinct(), "scc_edges")
    folded: list[DataFrame] = []
    labels: list[DataFrame] = []
    key = edges.schema["source"].dataType.simpleString()
    count = e.count()
    while count:
        if count <= TAIL:
            labels.append(cut(in_one_task(e, f"id {key}, component {key}", _small_strong), "scc_tail"))
            break
        d = cut(degrees_of(e), "scc_degrees")
        live = e.join(d.filter("n_in > 0").select(F.col("id").alias("source")), "source", "left_semi").join(d.filter("n_out > 0").select(F.col("id").alias("target")), "target", "left_semi")
        live = cut(live, "scc_edges")
        discard(e, d)
        d = cut(degrees_of(live), "scc_degrees")
        chain = d.filter("n_in = 1 AND n_out = 1").select("id")
        size = chain.count()
        e = live
        if size:
            out = live.join(chain.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("at"), F.col("source").alias("last"), F.col("source").alias("low"))
            ends = doubled(out, size, [("last", F.col("q.last")), ("low", F.least("p.low", "q.low"))], "scc_chain")
            rings = cut(ends.filter("open").select("id", F.col("low").alias("component")), "scc_rings")
            labels.append(rings)
            heads = live.join(chain.select(F.col("id").alias("target")), "target", "left_semi").join(chain.select(F.col("id").alias("source")), "source", "left_anti")
            heads = heads.join(ends.select(F.col("id").alias("target"), "last"), "target").select("last", F.col("source").alias("head"))
            done = cut(ends.filter("NOT open").select("id", F.col("at").alias("tail"), "last").join(heads, "last").select("id", "head", "tail"), "scc_folded")
            folded.append(done)
            rest = live.join(chain.select(F.col("id").alias("source")), "source", "left_anti").join(chain.select(F.col("id").alias("target")), "target", "left_anti")
            e = cut(rest.select("source", "target").union(done.select("head", "tail").filter("head != tail")).distinct(), "scc_edges")
            discard(live, ends)
        left = e.count()
        if left == count:
            found, e = _coloured(e)
            labels.append(found)
            left = e.count()
        count = left
    out = reduce(DataFrame.unionByName, labels) if labels else nodes.select("id", F.col("id").alias("component")).limit(0)
    for done in reversed(folded):
        ends = done.join(out.select(F.col("id").alias("head"), F.col("component").alias("ch")), "head", "left").join(out.select(F.col("id").alias("tail"), F.col("component").alias("ct")), "tail", "left")
        same = F.coalesce("ch", "head") == F.coalesce("ct", "tail")
        out = out.unionByName(ends.filter(same).select("id", F.coalesce("ch", "head").alias("component")))
        out = cut(out, "scc_labels")
    every = cut(nodes.join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "scc_all")
    least = every.groupBy("component").agg(F.min("id").alias("least"))
    return cut(every.join(least, "component").select("id", F.col("least").alias("component")), "scc")


def _coloured(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges -> ((id, component) of the components of all colours' roots, the edges among the other nodes)."""
    colour = cut(all_nodes(e).select("id", F.col("id").alias("colour")), "scc_colour")
    while True:
        near = e.join(colour.select(F.col("id").alias("source"), "colour"), "source").groupBy("target").agg(F.min("colour").alias("m"))
        new = colour.join(near, F.col("id") == F.col("target"), "left")
        new = cut(new.select("id", F.least("colour", F.coalesce("m", "colour")).alias("colour"), F.coalesce(F.col("m") < F.col("colour"), F.lit(False)).alias("moved")), "scc_colour")
        moved = not new.filter("moved").isEmpty()
        discard(colour)
        colour = new
        if not moved:
            break
    inside = e.join(colour.select(F.col("id").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("ct")), "target")
    inside = cut(inside.filter("cs = ct").select("source", "target"), "scc_inside")
    found = front = cut(colour.filter("id = colour").select("id", F.col("colour").alias("component")), "scc_found")
    while True:
        back = inside.join(front.select(F.col("id").alias("target"), "component"), "target").select(F.col("source").alias("id"), "component").distinct()
        front = cut(back.join(found, "id", "left_anti"), "scc_front")
        if front.isEmpty():
            break
        found = cut(found.unionByName(front), "scc_found")
    rest = e.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti")
    out = found, cut(rest.select("source", "target"), "scc_edges")
    discard(e, inside, colour)
    return out


def topological_layers(edges: DataFrame) -> DataFrame:
    """(id, layer): steps on the longest way to a node; nodes on or behind a cycle have no row.

    Edges carry a length and nodes a least layer. A round settles nodes without a way in, puts those without a way out
    aside, and folds chains: a node of a chain is max(c, layer of the chain's start + d), and such functions compose.
    What was put aside is settled in reverse order.
    """
    nodes = cut(all_nodes(edges), "topo_nodes")
    e = cut(edges.select("source", "target").distinct().withColumn("w", F.lit(1).cast("long")), "topo_edges")
    base = cut(nodes.select("id", F.lit(0).cast("long").alias("c")), "topo_base")
    aside: list[tuple[str, DataFrame]] = []
    settled: list[DataFrame] = []
    key = edges.schema["source"].dataType.simpleString()
    count, degrees = e.count(), cut(degrees_of(e), "topo_degrees")
    while count:
        if count <= TAIL:
            ends = e.join(base.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(base.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target")
            settled.append(cut(in_one_task(ends, f"id {key}, layer long", _small_layers), "topo_tail"))
            break
        first = degrees.filter("n_in = 0").select("id").join(base, "id")
        last = degrees.filter("n_out = 0").select("id")
        marked = e.join(first.select(F.col("id").alias("source"), F.col("c").alias("known")), "source", "left").join(last.select(F.col("id").alias("target"), F.lit(True).alias("end")), "target", "left")
        marked = cut(marked, "topo_marked")
        given = marked.filter("known IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.max(F.col("known") + F.col("w")).alias("got"))
        new_base = cut(base.join(given, "id", "left").select("id", F.greatest("c", F.coalesce("got", "c")).alias("c")), "topo_base")
        put = marked.filter("known IS NULL AND end").select("source", F.col("target").alias("id"), "w")
        aside.append(("ends", cut(last.join(new_base, "id").join(put, "id", "left"), "topo_ends")))
        left = cut(marked.filter("known IS NULL AND end IS NULL").select("source", "target", "w"), "topo_edges")
        after = cut(degrees_of(left), "topo_degrees")
        # nodes whose edges have all gone had only settled ones before them
        gone = degrees.filter("n_in > 0 AND n_out > 0").select("id").join(after, "id", "left_anti").join(new_base, "id")
        settled.append(cut(first.unionByName(gone).select("id", F.col("c").alias("layer")), "topo_settled"))
        discard(e, base, marked, degrees)
        base, e, degrees = new_base, left, after
        chain = degrees.filter("n_in = 1 AND n_out = 1").select("id")
        size = chain.count()
        if size * FOLD >= degrees.count() and size:
            start = e.join(chain.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("at"), F.col("w").alias("d")).join(base, "id")
            how = [("d", F.col("p.d") + F.col("q.d")), ("c", F.greatest(F.col("p.c"), F.col("q.c") + F.col("p.d")))]
            from_start = doubled(start.select("id", "at", "d", "c"), size, how, "topo_chain")
            done = cut(from_start.filter("NOT open").select("id", "at", "d", "c"), "topo_folded")
            aside.append(("chain", done))
            out = e.join(chain.select(F.col("id").alias("source")), "source", "left_semi").join(chain.select(F.col("id").alias("target")), "target", "left_anti")
            out = cut(out.join(done.withColumnRenamed("id", "source"), "source").select(F.col("at").alias("source"), "target", (F.col("d") + F.col("w")).alias("w"), (F.col("c") + F.col("w")).alias("got")), "topo_out")
            rest = e.join(chain.select(F.col("id").alias("source")), "source", "left_anti").join(chain.select(F.col("id").alias("target")), "target", "left_anti")
            drawn = cut(rest.select("source", "target", "w").union(out.select("source", "target", "w")).groupBy("source", "target").agg(F.max("w").alias("w")), "topo_edges")
            got = out.groupBy(F.col("target").alias("id")).agg(F.max("got").alias("got"))
            new_base = cut(base.join(got, "id", "left").select("id", F.greatest("c", F.coalesce("got", "c")).alias("c")), "topo_base")
            discard(e, base, from_start, out, degrees)
            e, base = drawn, new_base
            degrees = cut(degrees_of(e), "topo_degrees")
        left_now = e.count()
        if left_now == count:
            break  # what is left is on cycles, or between them
        count = left_now
    layers = reduce(DataFrame.unionByName, settled) if settled else base.select("id", F.col("c").alias("layer"))
    for kind, rows in reversed(aside):
        known = layers.select(F.col("id").alias("from"), "layer")
        if kind == "chain":
            more = rows.join(known, F.col("at") == F.col("from")).select("id", F.greatest("c", F.col("layer") + F.col("d")).alias("layer"))
        else:
            more = rows.join(known, F.col("source") == F.col("from"), "left").groupBy("id").agg(F.max("c").alias("c"), F.max(F.col("layer") + F.col("w")).alias("m"), F.count_if(F.col("source").isNotNull() & F.col("layer").isNull()).alias("open"))
            more = more.filter("open = 0").select("id", F.greatest("c", F.coalesce("m", "c")).alias("layer"))
        layers = cut(layers.unionByName(more), "topo_layers")
    return layers.select("id", F.col("layer").cast("int").alias("layer"))


#: Nodes and edges of consecutive small layers that one task puts in order; a larger layer is sorted by all tasks.
SEGMENT = 1 << 16


def _in_order(rows: DataFrame, by: list[str], first: int) -> DataFrame:
    """rows (id, and by) -> (id, position) from first on, sorted by all tasks: ranges are counted and then added up."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = cut(ranged.select("id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth")), "topo_ranges")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(counts), "part").select("id", (F.col("nth") + F.col("before") + first).alias("position"))


def _segment_order(first: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The order of a few layers in one task: by the last predecessor's position, then by name."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place: dict = {}
        out, at = [], first
        for _, layer in rows.groupby("layer", sort=True):
            known = layer["known"].to_numpy()
            last = {}
            for node, source, k in zip(layer["id"], layer["source"], known, strict=True):
                p = place[source] if source in place else (-1 if pd.isna(k) else int(k))
                last[node] = max(last.get(node, -1), p)
            for node in sorted(last, key=lambda n: (last[n], n)):
                place[node] = at
                out.append((node, at))
                at += 1
        return pd.DataFrame(out, columns=["id", "position"]).astype({"position": "int64"})

    return run


def topological_order(edges: DataFrame) -> DataFrame | None:
    """(id, position): nodes without a predecessor by name, then each node as its last predecessor has been placed; None for a cyclic graph.

    Such an order goes layer by layer; in a layer, a node's place follows from its last predecessor's place and its name.
    """
    e = cut(edges.select("source", "target").distinct(), "order_edges")
    layers = cut(topological_layers(e), "order_layers")
    if layers.count() < all_nodes(e).count():
        return None
    key = e.schema["source"].dataType.simpleString()
    into = cut(layers.join(e.select("source", F.col("target").alias("id")), "id", "left"), "order_into")
    sizes = into.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("nodes"))
    upto = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("segment", F.floor(F.coalesce(F.sum("rows").over(upto), F.lit(0)) / SEGMENT))
    segments = sizes.groupBy("segment").agg(F.min("layer").alias("low"), F.max("layer").alias("high"), F.sum("nodes").alias("nodes"), F.sum("rows").alias("rows")).orderBy("segment").collect()  # edges / SEGMENT
    done = e.sparkSession.createDataFrame([], f"id {key}, position long")
    first = 0
    for s in segments:
        rows = into.filter(F.col("layer").between(s["low"], s["high"])).join(done.select(F.col("id").alias("source"), F.col("position").alias("known")), "source", "left")
        if s["rows"] > 2 * SEGMENT and s["low"] == s["high"]:
            ranked = rows.groupBy("id").agg(F.coalesce(F.max("known"), F.lit(-1)).alias("last"))
            new = _in_order(ranked, ["last", "id"], first)
        else:
            new = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_segment_order(first), f"id {key}, position long")
        done = cut(done.unionByName(new), "order")
        first += s["nodes"]
    return done

