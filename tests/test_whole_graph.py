"""The graph queries over a small lineitem, against brute force."""

import random

import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()
ORDERS = [[1000, 1001, 1002, 1000], [1002, 97, 194], [194, 2000, 2001], [2001, 2000], [3000, 3001], [3001, 3002, 3002], [5000]]


def reach(nodes, edges):
    out = {n: {n} for n in nodes}
    while True:
        more = {n: r.union(*(edges.get(x, set()) for x in r)) for n, r in out.items()}
        if more == out:
            return out
        out = more


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    rng = random.Random(3)
    orders = ORDERS + [[10_000 + rng.randrange(30) for _ in range(rng.randrange(1, 4))] for _ in range(25)]
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(7 + 251 * i, n, p) for i, o in enumerate(orders) for n, p in enumerate(o)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    edges = sorted({(a, b) for o in orders for a, b in zip(o, o[1:], strict=False)})
    return path, edges, sorted({x for e in edges for x in e})


def ways(edges, both=False):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if both:
            out.setdefault(b, set()).add(a)
    return out


def strong(edges, nodes):
    r = reach(nodes, ways(edges))
    return {n: min(m for m in r[n] if n in r[m]) for n in nodes}


def test_components(spark, lines):
    path, edges, nodes = lines
    weak = reach(nodes, ways(edges, both=True))
    assert {r["id"]: r["component"] for r in QUERIES["wcc_components"](spark, path).collect()} == {n: min(weak[n]) for n in nodes}
    assert {r["id"]: r["component"] for r in QUERIES["scc_components"](spark, path).collect()} == strong(edges, nodes)


def test_cycles(spark, lines):
    path, edges, nodes = lines
    of, want = strong(edges, nodes), {}
    for c in set(of.values()):
        k = sum(of[a] == of[b] == c for a, b in edges)
        if k:
            want[c] = (sum(x == c for x in of.values()), k)
    assert {r["component"]: (r["length"], r["edge_count"]) for r in QUERIES["cycle_report"](spark, path).collect()} == want


def test_layers(spark, lines):
    path, edges, _ = lines
    up = [(a, b) for a, b in edges if a < b]
    want = {}
    for n in sorted({x for e in up for x in e}):
        want[n] = max((want[a] + 1 for a, b in up if b == n), default=0)
    assert {r["id"]: r["layer"] for r in QUERIES["topo_layers"](spark, path).collect()} == want


def test_impact_and_rank_have_every_node(spark, lines):
    path, edges, nodes = lines
    near, want = ways([(a, b) for a, b in edges if a != b], both=True), {}
    for root in {a for a, _ in edges}:
        one = near.get(root, set())
        for n in {root} | one | {y for x in one for y in near[x]}:
            want[root, n] = 0 if n == root else 1 if n in one else 2
    assert {(r["root"], r["id"]): r["distance"] for r in QUERIES["impact_two_hop"](spark, path).collect()} == want
    assert {r["id"] for r in QUERIES["pagerank"](spark, path).collect()} == set(nodes)
    scores = {r["id"]: r["score"] for r in QUERIES["impact_scores"](spark, path).collect()}
    for n in nodes:
        d = min(d for (_, x), d in want.items() if x == n)
        assert scores[n] == (100 if d == 0 else 0) + max(0, 50 - 12 * d) + 5 * sum(b == n for _, b in edges) + 4 * sum(a == n for a, _ in edges)
