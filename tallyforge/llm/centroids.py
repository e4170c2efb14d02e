"""Centroid clustering of whole-number vectors by weighted deduplication (operator 12).

Equal vectors are grouped first, with how often each occurs. Lloyd's rounds then run over the distinct vectors alone: a
task gives, for each centroid, the weighted sums of its vectors' components, exact whole numbers that Spark adds up, and
only these (centroids x components) come to the driver. At the end each distinct vector's cluster is joined back to all
rows that have it. Vectors that more than a thousandth of all rows share are fewer than a thousand, so that they are
looked up; all others are joined by a shuffle in which no key has more than that share.

Defined cases: a row takes part if its vector has exactly the asked number of components, none of them null or not
finite; a component beyond 2^27 after scaling counts as 2^27, and an inertia beyond a long is null. A null vec_id is
written as the empty text for its hash; rows with equal hashes start in order of their vectors. With fewer rows than
centroids every row is one; an empty centroid stays where it is; repeated rows get a row each; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, lean, work_table
from tallyforge.llm.vectors import finite, matrix, packed

DIMENSIONS, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: A vector that more than one in so many rows shares is looked up.
LOOKED_UP = 1000
#: Rows that a task handles at a time.
STEP = 1 << 14
ASSIGNED = "q binary, weight long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, q: the rows that take part, components as whole numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(b.column(1))], names=["vec_id", "q"])

    rows = vectors.filter(finite(F.col("embedding")) & (F.size("embedding") == dimensions)).select("vec_id", "embedding")
    return rows.mapInArrow(lean(run), "vec_id long, q binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance; exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64  # whole numbers up to 2^53 are exact in both
    y, c = x.astype(kind), centroids.astype(kind)
    away = (c * c).sum(1) - 2 * (y @ c.T)
    best = away.argmin(1)
    return best, (away[np.arange(len(x)), best] + (y * y).sum(1)).astype(np.int64)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            yield b.slice(i, STEP)


def sums(distinct: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sum of the vectors that each centroid is nearest to, and their number."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for b in steps(batches):
            x, w = matrix(b.column(0).to_pylist()), np.asarray(b.column(1), np.int64)
            best, _ = nearest(x, c)
            order = np.argsort(best, kind="stable")
            some, first = np.unique(best[order], return_index=True)
            total[some] += np.add.reduceat((x * w[:, None])[order], first, axis=0)
            count[some] += np.add.reduceat(w[order], first)
        some = np.flatnonzero(count)
        both = np.concatenate([total[some], count[some, None]], axis=1)
        where = [np.repeat(some, both.shape[1]), np.tile(np.arange(both.shape[1]), len(some)), both.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in where], names=["cluster", "place", "value"])

    parts = distinct.select("q", "weight").mapInArrow(lean(run), "cluster long, place long, value long")
    out = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():  # centroids x components
        out[r["cluster"], r["place"]] = r["value"]
    shared.unpersist()
    return out[:, :-1], out[:, -1]


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct (q, weight) with the nearest centroid's number and the squared distance."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            best, distance = nearest(matrix(b.column(0).to_pylist()), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], names=["q", "weight", "cluster", "distance"])

    return distinct.select("q", "weight").mapInArrow(lean(run), ASSIGNED)


def first_centroids(rows: DataFrame, count: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors of the rows with the smallest hashes of seed and vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    blobs = [bytes(r["q"]) for r in rows.select(key.alias("key"), "q").orderBy("key", "q").limit(count).collect()]  # count rows
    return matrix(blobs).reshape(len(blobs), dimensions)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, weight.

    weight is the number of rows that have the row's vector.
    """
    spark = vectors.sparkSession
    rows = work_table(whole_vectors(vectors, dimensions), "vectors")
    distinct = work_table(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    now = first_centroids(rows, centroids, seed, dimensions)
    for _ in range(rounds if len(now) else 0):
        total, count = sums(distinct, now)
        some = count > 0
        now = now.copy()
        now[some] = total[some] // count[some, None]
    found = work_table(assigned(distinct, now), "assigned")
    discard(distinct)

    spent = (F.col("weight").cast("decimal(20,0)") * F.col("distance").cast("decimal(18,0)")).cast("decimal(38,0)")
    parts = {r["cluster"]: (int(r["spent"]), r["n"]) for r in found.groupBy("cluster").agg(F.sum(spent).alias("spent"), F.sum("weight").alias("n")).collect()}  # centroids
    long = lambda x: x if x < 1 << 63 else None
    every, n = long(sum(s for s, _ in parts.values())), sum(c for _, c in parts.values())
    about = [(k, long(s), every, hashlib.sha256(",".join(map(str, now[k].tolist())).encode()).hexdigest()) for k, (s, _) in sorted(parts.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    often = F.col("weight") > max(1, n // LOOKED_UP)  # fewer than 2 * LOOKED_UP vectors
    common, rare = found.filter(often), found.filter(~often)
    out = rows.join(F.broadcast(common), "q").unionByName(rows.join(F.broadcast(common.select("q")), "q", "left_anti").join(rare, "q"))
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "weight")
