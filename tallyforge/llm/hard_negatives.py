"""Hard negatives by bit-sliced integer products (operator 11).

Components become whole numbers, and candidates are stored in blocks as bit planes, the most significant first. A task
meets a block of anchors with blocks of candidates and adds one plane's products at a time. What the planes not yet read
can add to a score lies between two sums of the anchor's components, so that every score has an interval which halves
with each plane. A candidate is dropped as soon as its interval cannot meet any range that is asked for (the anchor's
positives: no range; negatives: between two shares of a positive's score) or lies below the last place of a list that is
already full; only what remains is summed up exactly. Each task keeps the best few of a stripe of candidates for each
anchor, and Spark picks the best few of all stripes.

Anchors are a stated query set: they meet all rows, in blocks of bounded size on both sides, dealt by stripe.

Defined cases: rows without a label or vector, or with a component that is null or not finite, take no part; a component
beyond 2^27 after scaling counts as 2^27, and of vectors of different lengths the shorter counts as filled up with zeros
(scores must fit a long). A null vec_id takes part and comes last among equal scores; such a row is no anchor. Rows with
the same vec_id are rows of their own, so one may be the other's positive. An anchor without another row of its label
gives no rows, nor does a positive whose range is empty (any negative score). An empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import lean, work_table
from tallyforge.llm.vectors import finite, matrix, packed

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows in a block of candidates, of anchors, in a stripe; candidates in one step; most components in a block.
BLOCK, ANCHORS, STRIPE, STEP, VALUES = 4096, 1024, 1 << 16, 1024, 1 << 22
LOWEST, HIGHEST = -(1 << 62), 1 << 62
ROWS = "row long, vec_id long, label long, q binary"
IDS = "n int, dims int, rows binary, ids binary, known binary, labels binary"
CANDIDATES = f"stripe int, {IDS}, bits int, planes binary"
QUERIES = f"block long, {IDS}, q binary, ranges binary"
FOUND = "row long, anchor_id long, place int, score long, vec_id long"


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, label, embedding) -> ROWS of those that take part, row a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed(b.column(3))], names=["row", "vec_id", "label", "q"])

    rows = vectors.filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.mapInArrow(lean(run), ROWS)


def planes_of(x: np.ndarray) -> tuple[int, bytes]:
    """The least number of bits (two's complement) that hold all of x, and its packed bit planes, the sign first."""
    bits = 1 + max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=0)).bit_length() if x.size and x.min() < 0 else 0)
    return bits, b"".join(np.packbits(((x >> k) & 1).astype(np.uint8), axis=1).tobytes() for k in range(bits - 1, -1, -1))


def _ids(held: list[tuple]) -> list:
    """n, dims, rows, ids, known, labels of rows (row, vec_id, label, q, ...)."""
    ids = [x[1] for x in held]
    return [
        len(held), max(len(x[3]) for x in held) // 4, np.array([x[0] for x in held], "<i8").tobytes(), np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
        np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([x[2] for x in held], "<i8").tobytes(),
    ]


def in_blocks(batches: Iterator[pa.RecordBatch], size: int, make: Callable[[list[tuple], int], list], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows gathered into blocks of at most size rows and VALUES components; make gives a block's fields."""
    held: list[tuple] = []
    widest = number = 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(make(held, number), types, strict=True)], names=names)

    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            wide = max(widest, len(row[3]) // 4)
            if held and (len(held) >= size or wide * (len(held) + 1) > VALUES):
                yield block()
                held, wide, number = [], len(row[3]) // 4, number + 1
            held.append(row)
            widest = wide
    if held:
        yield block()


_ID_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def candidate_blocks(rows: DataFrame, stripes: int) -> DataFrame:
    """rows -> CANDIDATES: blocks of bit planes, dealt evenly to stripes."""
    names = [c.split(" ")[0] for c in CANDIDATES.split(", ")]

    def make(held: list[tuple], number: int) -> list:
        return [TaskContext.get().partitionId(), *_ids(held), *planes_of(matrix([x[3] for x in held]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_blocks(batches, BLOCK, make, names, [pa.int32(), *_ID_TYPES, pa.int32(), pa.binary()])

    return rows.select("row", "vec_id", "label", "q").repartition(stripes).mapInArrow(lean(run), CANDIDATES)


def anchor_blocks(anchors: DataFrame, count: int) -> DataFrame:
    """anchors (row, vec_id, label, q, ranges: array of (low, high)) -> QUERIES."""
    names = [c.split(" ")[0] for c in QUERIES.split(", ")]

    def make(held: list[tuple], number: int) -> list:
        most = max(len(x[4]) for x in held)
        ranges = np.array([[(r["low"], r["high"]) for r in x[4]] + [(HIGHEST, LOWEST)] * (most - len(x[4])) for x in held], "<i8").reshape(len(held), most, 2)
        return [(TaskContext.get().partitionId() << 33) + number, *_ids(held), matrix([x[3] for x in held]).astype("<i4").tobytes(), ranges.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_blocks(batches, ANCHORS, make, names, [pa.int64(), *_ID_TYPES, pa.binary(), pa.binary()])

    return anchors.select("row", "vec_id", "label", "q", "ranges").repartition(max(1, -(-count // ANCHORS))).mapInArrow(lean(run), QUERIES)


class Search:
    """The best rows of each anchor of a block, for each of its ranges, over the candidate blocks added so far."""

    def __init__(self, block: dict, most: int, same_label: bool) -> None:
        n = block["n"]
        self.most, self.same = most, same_label
        self.rows, self.ids = np.frombuffer(block["rows"], "<i8"), np.frombuffer(block["ids"], "<i8")
        self.labels = np.frombuffer(block["labels"], "<i8")
        self.a = np.frombuffer(block["q"], "<i4").reshape(n, block["dims"]).astype(np.int64)
        ranges = np.frombuffer(block["ranges"], "<i8").reshape(n, -1, 2)
        self.high, self.floor = ranges[:, :, 1], ranges[:, :, 0].copy()
        self.group, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.found, self.unknown = np.zeros(0, np.int64), np.zeros(0, bool)
        self.exact_sums = self.pairs = 0

    def add(self, block: dict) -> None:
        n, dims, bits = block["n"], block["dims"], block["bits"]
        shared = min(dims, self.a.shape[1])  # a shorter vector is filled up with zeros
        a = self.a[:, :shared]
        reach = int(np.abs(a).sum(1).max(initial=0)) << bits
        kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64  # exact in all three
        a = a.astype(kind)
        above, below = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
        planes = np.frombuffer(block["planes"], np.uint8).reshape(bits, n, -1)
        rows, ids, labels = (np.frombuffer(block[k], "<i8") for k in ("rows", "ids", "labels"))
        unknown = np.frombuffer(block["known"], np.uint8) == 0
        for i in range(0, n, STEP):
            part = slice(i, i + STEP)
            cut = [np.unpackbits(p[part], axis=1, count=dims)[:, :shared] for p in planes]
            live = (self.labels[:, None] == labels[None, part]) == self.same
            if self.same:
                live &= self.rows[:, None] != rows[None, part]
            self._step(a, above, below, cut, live, ids[part], unknown[part], kind)

    def _step(self, a, above, below, planes, live, ids, unknown, kind) -> None:
        bits, size = len(planes), live.size
        self.pairs += int(live.sum())
        total = np.zeros(live.shape, kind)
        at = None  # what is left, as pairs, once that is little
        for k, plane in zip(range(bits - 1, -1, -1), planes, strict=True):
            x, worth, rest = plane.astype(kind), kind(-(1 << k) if k == bits - 1 else 1 << k), kind((1 << k) - 1)
            if at is None:
                total += worth * (a @ x.T)
                if k > bits - 4:  # intervals are wider than any range yet
                    continue
                upper, lower = total + rest * above[:, None], total + rest * below[:, None]
                if k == bits // 3 and not len(self.group):
                    self._raise_floors(lower, upper, live)
                live &= (upper >= self.floor.min(1).astype(kind)[:, None]) & (lower <= self.high.max(1).astype(kind)[:, None])
                if 8 * np.count_nonzero(live) <= size:
                    at = np.nonzero(live)
                    total = total[at]
            else:
                i, j = at
                for s in range(0, len(i), 1 << 16):
                    part = slice(s, s + (1 << 16))
                    total[part] += worth * np.einsum("ij,ij->i", a[i[part]], x[j[part]])
                upper, lower = total + rest * above[i], total + rest * below[i]
                keep = ((upper[:, None] >= self.floor[i]) & (lower[:, None] <= self.high[i])).any(1)
                at, total = (i[keep], j[keep]), total[keep]
        if at is None:
            at = np.nonzero(live)
            total = total[at]
        self.exact_sums += len(total)
        self._merge(*at, total.astype(np.int64), ids, unknown)

    def _raise_floors(self, lower: np.ndarray, upper: np.ndarray, live: np.ndarray) -> None:
        """Floors from the lower ends of intervals that lie in a range as a whole."""
        n = lower.shape[1]
        if n < self.most:
            return
        for p in range(self.floor.shape[1]):
            sure = live & (lower >= self.floor[:, p, None]) & (upper <= self.high[:, p, None])
            last = np.partition(np.where(sure, lower, LOWEST), n - self.most, axis=1)[:, n - self.most]
            self.floor[:, p] = np.maximum(self.floor[:, p], last.astype(np.int64))

    def _merge(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        ranges = self.floor.shape[1]
        fits = [np.flatnonzero((score >= self.floor[i, p]) & (score <= self.high[i, p])) for p in range(ranges)]
        if not any(map(len, fits)):
            return
        group = np.concatenate([self.group, *(i[f] * ranges + p for p, f in enumerate(fits))])
        scores = np.concatenate([self.score, *(score[f] for f in fits)])
        found = np.concatenate([self.found, *(ids[j[f]] for f in fits)])
        missing = np.concatenate([self.unknown, *(unknown[j[f]] for f in fits)])
        order = np.lexsort((found, missing, -scores, group))
        group, scores, found, missing = group[order], scores[order], found[order], missing[order]
        _, first, size = np.unique(group, return_index=True, return_counts=True)
        last = first[size >= self.most] + self.most - 1  # the last places of full lists
        floor = self.floor.reshape(-1)
        floor[group[last]] = np.maximum(floor[group[last]], scores[last])
        keep = np.arange(len(group)) - np.repeat(first, size) < self.most
        self.group, self.score, self.found, self.unknown = group[keep], scores[keep], found[keep], missing[keep]

    def result(self) -> pa.RecordBatch:
        ranges = max(1, self.floor.shape[1])
        i = self.group // ranges
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[i]), pa.array(self.ids[i]), pa.array((self.group % ranges).astype(np.int32)), pa.array(self.score), pa.array(self.found, mask=self.unknown)],
            names=["row", "anchor_id", "place", "score", "vec_id"],
        )


def meet(anchors: DataFrame, candidates: DataFrame, stripes: int, most: int, same_label: bool) -> DataFrame:
    """anchors (QUERIES) and candidates (CANDIDATES) -> FOUND: for each anchor and range the best few rows of each stripe."""
    names = [c.split(" ")[0] for c in QUERIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key = None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["stripe"], r["block"]) != key:
                    if search:
                        yield search.result()
                    search, key = Search({k: r[f"a_{k}" if k != "block" else k] for k in names}, most, same_label), (r["stripe"], r["block"])
                search.add(r)
        if search:
            yield search.result()

    every = anchors.select("block", *[F.col(k).alias(f"a_{k}") for k in names[1:]], F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    pairs = every.repartition(stripes, "stripe").hint("merge").join(candidates.repartition(stripes, "stripe"), "stripe")
    return pairs.mapInArrow(lean(run), FOUND)


def best(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each anchor and range over all stripes, with their rank from 1."""
    order = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors (vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    Each anchor's best rows of its own label are its positives; for each of them the best rows of other labels are given
    whose score lies between low and high percent of the positive's, both included.
    """
    spark = vectors.sparkSession
    rows = work_table(whole_rows(vectors), "rows")
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    n, asked = rows.count(), anchors.count()
    stripes = max(1, -(-n // STRIPE), min(-(-n // (BLOCK // 2)), 4 * spark.sparkContext.defaultParallelism))
    candidates = work_table(candidate_blocks(rows, stripes), "planes")

    everything = F.array(F.struct(F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    found = best(meet(anchor_blocks(anchors.withColumn("ranges", everything), asked), candidates, stripes, positives, True), positives)
    near = work_table(found.select("row", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score").cast("decimal(20,0)")
    low_end, high_end = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("positive_rank", low_end.alias("low"), high_end.alias("high")))), lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))
    limits = near.groupBy(F.col("row").alias("of")).agg(ranges.alias("ranges"))  # at most `positives` of them
    asking = anchors.join(limits, F.col("row") == F.col("of")).drop("of")
    out = best(meet(anchor_blocks(asking, asked), candidates, stripes, negatives, False), negatives)
    out = out.select("row", "anchor_id", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(near, ["row", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
