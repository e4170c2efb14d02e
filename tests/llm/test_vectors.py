"""Hard negatives and centroids against brute force on rows with every kind of oddity."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives as H
from tallyforge.llm.centroids import cluster, nearest
from tallyforge.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, weight long, `a.b` int, stripe int, cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "q", 2, 3, 4, 5) for i, v, label in rows], SCHEMA).repartition(3)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def odd_rows(seed, n, dims, labels, values=None):
    r = np.random.default_rng(seed)
    draw = (lambda: [float(x) for x in r.normal(0, 0.2, dims)]) if values is None else (lambda: [float(x) for x in r.choice(values, dims)])
    rows = [(i, draw(), int(r.integers(labels))) for i in range(n)]
    rows += [rows[0], rows[3], (7, rows[3][1], rows[3][2]), (None, rows[4][1], rows[4][2]), (None, None, 1), (n + 1, None, 2), (n + 2, rows[5][1], None)]
    rows += [(n + 3, [float("nan"), *rows[1][1][1:]], 0), (n + 4, [float("inf"), *rows[1][1][1:]], 0), (n + 5, [None, *rows[1][1][1:]], 0), (-100, [0.0] * dims, 1)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_negatives(rows, positives, negatives, low, high):
    rows = [(i, whole(v), label) for i, v, label in usable(rows) if label is not None]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, q, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w, strict=False)), last(i), i, other == label) for b, (i, w, other) in enumerate(rows) if b != a]
        scored.sort(key=lambda s: s[:2])
        for rank, (minus, _, p, _) in enumerate([s for s in scored if s[3]][:positives], 1):
            fits = [s for s in scored if not s[3] and low * -minus <= 100 * -s[0] <= high * -minus][:negatives]
            out += [(anchor, p, n, s[2], -minus, -s[0], rank) for n, s in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(
    ("seed", "n", "dims", "values"), [(1, 700, 16, None), (2, 500, 3, [-0.01, 0.0, 0.004, 0.5]), (3, 420, 9, [-70_000.0, 0.25, 3.0, 90_000.0]), (4, 300, 70, None), (5, 260, 1, None)]
)
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, seed, n, dims, values):
    monkeypatch.setattr(H, "BLOCK", 96)  # several blocks and stripes
    monkeypatch.setattr(H, "ANCHORS", 3)
    rows = odd_rows(seed, n, dims, 3, values) + [(n + 100 - n % 100, [0.3] * (dims + 2), 1), (n + 9, [0.2], 1), (n + 10, [], 2)]
    got = H.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_negatives(rows, 5, 10, 30, 90)


def test_hard_negatives_of_few_rows(spark):
    mine = lambda rows, **more: H.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, **more).collect()
    assert mine([]) == [] and mine([(100, [1.0], 1)]) == [] and mine([(100, [1.0], 1), (2, [1.0], 2)]) == []
    assert [tuple(r) for r in mine([(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 2)], negatives=1)] == [(100, 1, 1, 2, 65536, 32768, 1)]


def test_candidates_drop_out_before_they_are_summed_up():
    r = np.random.default_rng(0)
    x = np.floor(r.normal(0, 32, (6000, 64))).astype(np.int64)
    ids = lambda n: {"rows": np.arange(n, dtype="<i8").tobytes(), "ids": np.arange(n, dtype="<i8").tobytes(), "labels": np.zeros(n, "<i8").tobytes(), "known": np.ones(n, np.uint8).tobytes()}
    ranges = np.array([[[H.LOWEST, H.HIGHEST]]] * 20, "<i8").tobytes()
    search = H.Search({"n": 20, "dims": 64, "q": x[:20].astype("<i4").tobytes(), "ranges": ranges, **ids(20)}, 5, True)
    bits, planes = H.planes_of(x)
    search.add({"n": 6000, "dims": 64, "bits": bits, "planes": planes, **ids(6000)})
    assert search.exact_sums < search.pairs / 20
    scores = x[:20] @ x.T
    scores[np.arange(20), np.arange(20)] = -(1 << 60)
    assert np.array_equal(search.score.reshape(20, 5), -np.sort(-scores, axis=1)[:, :5])


def lloyd(rows, k, rounds, dims):
    rows = [(i, whole(v)) for i, v, _ in usable(rows) if len(v) == dims]
    started = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centres = [list(r[1]) for r in started[:k]]

    def near(q):
        away = [sum((x - y) ** 2 for x, y in zip(q, c, strict=True)) for c in centres]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        of = [near(q)[0] for _, q in rows]
        for c in range(len(centres)):
            own = [q for (_, q), o in zip(rows, of, strict=True) if o == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *near(q)) for i, q in rows]
    total = sum(d for _, _, d in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, sum(e for _, b, e in found if b == c), total, sha[c]) for i, c, d in found], key=str)


@pytest.mark.parametrize(("seed", "n", "dims", "k", "values"), [(1, 300, 6, 8, None), (2, 200, 3, 5, [-0.01, 0.0, 0.5]), (3, 90, 4, 7, [-300_000.0, 0.1, 400_000.0]), (4, 6, 4, 40, None)])
def test_clusters_are_those_of_plain_rounds(spark, seed, n, dims, k, values):
    rows = odd_rows(seed, n, dims, 3, values) + [(n + 50, [0.1] * (dims + 1), 1), (n + 51, [], 1)] + [(5000 + i, [0.1] * dims, 0) for i in range(120)]
    got = cluster(table(spark, rows), k, 3, 2, dims).drop("weight").collect()
    assert sorted([tuple(r) for r in got], key=str) == lloyd(rows, k, 3, dims)


def test_cluster_weights_and_empty_tables(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(40)] + [(100 + i, [float(i), 0.0], 1) for i in range(30)]
    got = {r["vec_id"]: r["weight"] for r in cluster(table(spark, rows), 4, 2, 2, 2).collect()}
    assert got[0] == 40 and got[105] == 1 and len(got) == 70
    assert cluster(table(spark, [])).count() == 0 and cluster(table(spark, [(1, None, 2)])).count() == 0


def test_distances_beyond_doubles_are_exact():
    x, c = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]]), np.array([[-(1 << 27), 1 << 27], [3, 4]])
    best, away = nearest(x, c)
    assert best.tolist() == [1, 1] and away.tolist() == [sum((int(a) - int(b)) ** 2 for a, b in zip(r, c[1], strict=True)) for r in x]


def test_queries_read_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["op12_centroids"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
