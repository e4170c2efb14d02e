import random
import time

import pandas as pd
import pytest

from tallyforge.operators import contract
from tallyforge.operators import graph as G


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, target string")


def ring(n, prefix):
    return [(f"{prefix}{i}", f"{prefix}{(i + 1) % n}") for i in range(n)]


def test_rings_give_cycles_by_size(spark):
    e = edges(spark, *ring(2, "a"), *ring(4, "b"), *ring(6, "c"), ("a0", "b0"), ("b1", "c1"))
    found = {r["component"]: (r["length"], r["edge_count"], r["severity"]) for r in G.cycles(e, G.strong_components(e)).collect()}
    assert found == {"a0": (2, 2, "medium"), "b0": (4, 4, "high"), "c0": (6, 6, "critical")}


def test_loop_is_a_cycle_of_one(spark):
    e = edges(spark, ("x", "x"), ("x", "y"))
    assert [tuple(r) for r in G.cycles(e, G.strong_components(e)).collect()] == [("x", 1, 1, "medium")]


def test_acyclic_graph_has_layers_and_no_cycles(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "c"))
    assert {r["id"]: r["layer"] for r in G.topological_layers(e).collect()} == {"a": 0, "b": 1, "c": 2}
    assert G.cycles(e, G.strong_components(e)).count() == 0


def test_edge_statements_collapse(spark):
    rows = [("a", "b", "import", None), ("a", "b", "import", False), ("a", "b", "dynamic-import", None), ("a", "c", "export", True), ("b", "c", None, None)]
    got = {(r["source"], r["target"]): (r["weight"], r["types"], r["is_type_only"]) for r in G.collapse_edges(spark.createDataFrame(rows, "s string, t string, k string, o boolean"), "s", "t", "k", "o").collect()}
    assert got == {("a", "b"): (3, ["dynamic-import", "import"], False), ("a", "c"): (1, ["export"], True), ("b", "c"): (1, [], False)}


def test_pagerank_sums_to_one(spark):
    e = edges(spark, *ring(3, "a"), ("a0", "z"))
    assert abs(sum(r["page_rank"] for r in G.pagerank(e).collect()) - 1) < 1e-6


def test_weak_components(spark):
    e = edges(spark, ("b", "a"), ("b", "c"), ("y", "x"))
    assert {r["id"]: r["component"] for r in G.weak_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def shuffled(n, seed=1):
    return random.Random(seed).sample(range(n), n)


def numbered(spark, pairs):
    return spark.createDataFrame(pd.DataFrame(pairs, columns=["source", "target"]))


def test_long_chain_and_ring(spark, monkeypatch):
    monkeypatch.setattr(contract, "TAIL", 64)
    n, began = 20_000, time.time()
    for names in (shuffled(n),):
        chain = numbered(spark, list(zip(names, names[1:], strict=False)))
        assert {r["id"]: r["layer"] for r in G.topological_layers(chain).collect()} == {v: i for i, v in enumerate(names)}
        assert {r["component"] for r in G.weak_components(chain).collect()} == {0}
        ring_ = numbered(spark, list(zip(names, [*names[1:], names[0]], strict=True)))
        assert [tuple(r) for r in G.cycles(ring_, G.strong_components(ring_)).collect()] == [(0, n, n, "critical")]
    assert time.time() - began < 4 * 60


def test_order_of_a_long_chain_with_leaves(spark, monkeypatch):
    monkeypatch.setattr(contract, "TAIL", 64)
    n = 3000
    pairs = [(i, i + 1) for i in range(n)] + [(i, 100_000 + i) for i in range(n)]
    order = [r["id"] for r in G.topological_order(numbered(spark, pairs)).orderBy("position").collect()]
    assert order == kahn(pairs)


def kahn(pairs):
    nodes, out, waiting = sorted({x for p in pairs for x in p}), {}, {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
        waiting[b] = waiting.get(b, 0) + 1
    queue = [n for n in nodes if not waiting.get(n)]
    for a in queue:
        for b in out.get(a, []):
            waiting[b] -= 1
            if not waiting[b]:
                queue.append(b)
    return queue


def plain_layers(pairs):
    pairs, layer = set(pairs), {}
    nodes = {x for p in pairs for x in p}
    while True:
        ready = [n for n in nodes - set(layer) if all(a in layer for a, b in pairs if b == n)]
        if not ready:
            return layer
        layer.update({n: max((layer[a] + 1 for a, b in pairs if b == n), default=0) for n in ready})


def plain_components(pairs, strong):
    nodes = {x for p in pairs for x in p}
    out = {n: {n} for n in nodes}
    while True:
        more = {n: set().union(r, *({b for a, b in pairs if a in r} | (set() if strong else {a for a, b in pairs if b in r}),)) for n, r in out.items()}
        if more == out:
            return {n: min(m for m in r if n in out[m]) for n, r in out.items()}
        out = more


def random_graphs():
    r = random.Random(7)
    yield [(r.randrange(30), r.randrange(30)) for _ in range(34)]
    yield [(r.randrange(60), r.randrange(60)) for _ in range(60)]
    yield [(a, b) for a, b in [(r.randrange(40), r.randrange(40)) for _ in range(70)] if a < b]
    two = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a9", "a0"), ("a3", "t1"), ("t1", "t2"), ("t2", "a5"), ("t2", "u1"), ("u1", "u2"), ("u2", "u3"), ("u3", "u2"), ("x", "x"), ("x", "y"), ("v", "a0")]
    yield two
    yield [(i, i + 1) for i in range(30)] + [(i, 100 + i) for i in range(30)] + [(200 + i, i) for i in range(30)] + [(30, 29)]


GRAPHS = list(random_graphs())


@pytest.mark.parametrize(("graph", "tail"), [(3, 12), *((k, contract.TAIL) for k in range(5))])
def test_contraction_gives_what_a_plain_search_gives(spark, monkeypatch, graph, tail):
    monkeypatch.setattr(contract, "TAIL", tail)
    pairs = GRAPHS[graph]
    e = numbered(spark, pairs)
    assert {r["id"]: r["component"] for r in G.weak_components(e).collect()} == plain_components(pairs, False)
    assert {r["id"]: r["component"] for r in G.strong_components(e).collect()} == plain_components(pairs, True)
    layers = plain_layers(pairs)
    assert {r["id"]: r["layer"] for r in G.topological_layers(e).collect()} == layers
    order = G.topological_order(e)
    if len(layers) < len({x for p in pairs for x in p}):
        assert order is None
    else:
        assert [r["id"] for r in order.orderBy("position").collect()] == kahn(pairs)


def test_order_in_segments_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(contract, "SEGMENT", 20)
    r = random.Random(3)
    pairs = [(a, b) for a, b in [(r.randrange(200), r.randrange(200)) for _ in range(400)] if a < b]
    assert [x["id"] for x in G.topological_order(numbered(spark, pairs)).orderBy("position").collect()] == kahn(pairs)


def test_empty_graphs(spark):
    none = edges(spark, ("a", "b")).limit(0)
    assert [f(none).count() for f in (G.weak_components, G.strong_components, G.topological_layers, G.topological_order)] == [0] * 4


def test_order_of_an_acyclic_graph(spark):
    e = edges(spark, ("b", "x"), ("a", "z"), ("a", "y"), ("z", "x"), ("c", "y"))
    assert [r["id"] for r in G.topological_order(e).orderBy("position").collect()] == ["a", "b", "c", "z", "y", "x"]
    assert G.topological_order(edges(spark, *ring(2, "a"))) is None


def test_a_hub_is_left_once(spark):
    e = edges(spark, *[("hub", f"n{i}") for i in range(50)])
    assert G.neighbourhood(e, spark.createDataFrame([("n0",)], "id string"), 2).count() == 51
