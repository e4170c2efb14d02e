"""N-gram Jaccard join by universe partition and pigeonhole (operator 5).

Sets of word shingles are grouped in size bands. For each band the universe of shingles is hashed into segments, more
than two similar sets can differ in; so of any choice of (largest difference + 1) segments one at least is equal in
both. Each set indexes its segments' subsets, and in some segments also the subsets without one shingle. It probes its
own band and the smaller ones in reach with as many segments as the pigeonhole needs, chosen by cost: segments of
shingles known to be frequent are left out, and a segment may instead count twice by being probed with its
one-deletion neighbourhood. Matches are verified exactly on the whole sets.

Sets are hashed to 64-bit shingles; equal sets are one node. Entries travel as sorted, compressed blobs by bucket of the
signature, so a bucket is one array join whatever the input's size. Where many sets share a signature only the links to
the smallest one are verified first; if that leaves several components, its sets are compared in blocks (by_blocks).
A set that has too few segments to choose from (possible for small sets only) is looked up by shingles instead.

Defined cases: null text counts as empty; a set without shingles is linked with nothing; a null doc_id has a null
component unless linked to others; rows with the same id but other texts are nodes of their own; repeated rows get a row
each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import any_names, discard, lean, small_batches, text_of, work_table
from tallyforge.llm.components import components
from tallyforge.llm.shingles import GOLDEN, mixed, shingle_sets, text_buffer

PERCENT = 75
#: Surplus of segments over what the pigeonhole needs; bands of up to ALL_DELETE segments index deletions in all of them.
SURPLUS, ALL_DELETE, DELETE_PART = 1.2, 48, 8
#: Shingles of at least HOT sets among HOT_RUN documents are counted as frequent; the HOT_KEPT most frequent guide the costs (only).
HOT, HOT_RUN, HOT_KEPT = 4, 8192, 300_000
ENTRIES, MOST_BUCKETS, FLUSH = 2_000_000, 1 << 17, 4_000_000
#: Signatures with more entries than STAR are paired probe by index; where that gives over SPARSE pairs an entry, only
#: links to the smallest set are verified at first.
STAR, SPARSE = 12, 12
#: Most sets, and about the most shingles, of a block of sets that are compared with one another.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000


def most_apart(r: int, s: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of sets of r and s elements whose Jaccard similarity is percent or more."""
    return (100 - percent) * (r + s) // (100 + percent)


class Bands:
    """Size bands (lo, hi), each with its number of segments and of those segments that index deletions."""

    def __init__(self, largest: int, percent: int = PERCENT) -> None:
        self.percent, self.lo, self.hi, self.segments, self.deleting = percent, [], [], [], []
        lo = 1
        while lo <= largest or not self.lo:
            hi = max(lo, lo * 100 // percent)
            need = most_apart(hi * 100 // percent, hi, percent) + 1
            m = 1 if need == 1 else int(np.ceil(SURPLUS * need))
            self.lo.append(lo)
            self.hi.append(hi)
            self.segments.append(m)
            self.deleting.append(m if m <= ALL_DELETE else m // DELETE_PART)
            lo = hi + 1

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.hi, n))

    def reach(self, n: int) -> range:
        """The bands of sets that a set of n probes: its own and those of smaller sets that can be similar."""
        return range(self.of(max(1, -(-n * self.percent // 100))), self.of(n) + 1)

    def entries(self, s: np.ndarray, band: int, index: bool, probe: bool, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Signatures of the sorted set s in a band, their flags (1 index, 2 probe), and whether the probe is complete.

        weight is how frequent each shingle is known to be (0: not known as frequent).
        """
        m, deleting = self.segments[band], self.deleting[band]
        segment = ((s >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        ordered, values, w = segment[order], s[order], weight[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(at, len(ordered)))
        which = ordered[at]
        total = np.add.reduceat(values, at)
        salt = mixed((np.uint64(band) << np.uint64(32)) + which.astype(np.uint64) * GOLDEN)
        signature = mixed(total + salt)
        flags = np.full(len(at), int(index), np.uint32)
        cost = np.minimum.reduceat(w, at).astype(np.int64) * 64 - np.minimum(count, 63)
        chosen_twice = np.zeros(len(at), bool)
        complete = True
        if probe:
            need = most_apart(len(s), min(len(s), self.hi[band]), self.percent) + 1
            # options in order of cost: a segment once (so also equal costs first), and again by its one-deletion neighbourhood
            able = np.flatnonzero((which < deleting) & (count >= 2))
            rare = np.add.reduceat((w == 0).astype(np.int64), at)[able]
            again = np.where(rare >= 2, 0, np.maximum.reduceat(w, at)[able]) * 64 + 8 * count[able]
            rank = np.argsort(np.concatenate([cost, np.maximum(again, cost[able])]), kind="stable")[:need]
            complete = len(rank) == need
            flags[rank[rank < len(at)]] |= 2
            chosen_twice[able[rank[rank >= len(at)] - len(at)]] = True
        variants = np.flatnonzero(((which < deleting) & (count >= 3) & index) | chosen_twice)
        if len(variants):
            rows = np.concatenate([np.arange(at[v], at[v] + count[v]) for v in variants])
            own = np.repeat(variants, count[variants])
            more = mixed(total[own] - values[rows] + salt[own])
            more_flags = (index & (which[own] < deleting) & (count[own] >= 3)).astype(np.uint32) | np.where(chosen_twice[own], 2, 0).astype(np.uint32)
            signature, flags = np.concatenate([signature, more]), np.concatenate([flags, more_flags])
        used = flags > 0
        return signature[used], flags[used], complete


def node_of(s: np.ndarray) -> tuple[int, int]:
    """A set's node and a second, independent fingerprint."""
    if not len(s):
        return 0, 0
    pair = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s + GOLDEN))], np.uint64)
    return tuple(mixed(pair + np.uint64(len(s))).view(np.int64).tolist())


def _sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return shingle_sets(*text_buffer(batch.column(column)))


def nodes_and_hot(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The table (doc_id, n, node, check) and the most frequent shingles with their counts.

    A task counts the shingles of a bounded run of documents and passes on those that several of them hold; the counts
    only steer which segments are probed, never what is found.
    """

    names = ["doc_id", "n", "node", "check", "hot", "hot_n"]
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met: set[int] = set()
        seen = 0

        def counted() -> pa.RecordBatch:
            every, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            hot = n >= HOT
            none = pa.array([None], pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([x], lists) for x in (every[hot].view(np.int64), n[hot])], names=names)

        for b in batches:
            sets = _sets(b, 1)
            keys = [node_of(s) for s in sets]
            for s, k in zip(sets, keys, strict=True):
                if k[0] not in met:
                    met.add(k[0])
                    held.append(s)
            seen += len(sets)
            none = pa.array([None] * len(sets), lists)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys])], none, none], names=names
            )
            if seen >= HOT_RUN:
                yield counted()
                held, met, seen = [], set(), 0
        if held:
            yield counted()

    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(run), "doc_id long, n long, node long, check long, hot array<long>, hot_n array<long>")
    rows = work_table(rows, "jaccard_nodes")
    hot = rows.filter("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_n").alias("n"))
    top = sorted((r["hot"], r["n"]) for r in hot.orderBy(F.desc("n"), "hot").limit(HOT_KEPT).collect())
    shingle, count = np.array([h for h, _ in top], np.int64).view(np.uint64), np.array([c for _, c in top], np.int64)
    order = np.argsort(shingle)
    nodes = rows.filter("hot is null").drop("hot", "hot_n")
    nodes.work_path = rows.work_path
    return nodes, shingle[order], count[order]


def blob_rows(docs: DataFrame, buckets: int, largest: int, hot: np.ndarray, hot_n: np.ndarray, percent: int) -> DataFrame:
    """docs (doc_id, text) -> (bucket, blob): the sorted entries of a run of documents in one bucket; bucket -1: nodes to look up by shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_n))
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n = shared.value
        bands, press = Bands(largest, percent), zstandard.ZstdCompressor(level=1)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        nodes: list[int] = []
        sizes: list[int] = []
        size, met, rest = 0, set(), []

        def flush() -> pa.RecordBatch:
            signature = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            tail = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
            order = np.argsort(signature, kind="stable")
            signature, tail = signature[order], tail[order]
            where = (signature >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(signature), np.int64)
            cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
            node, length = np.array(nodes, np.int64), np.array(sizes, np.uint32)
            low = ((signature << np.uint64(64) - shift if buckets > 1 else signature) >> np.uint64(32)).astype(np.uint32)
            rows, blobs = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(where))[: len(cuts)], strict=True):
                used, local = np.unique(tail[a:b] >> np.uint32(2), return_inverse=True)
                packed = (local.astype(np.uint32) << np.uint32(2)) | (tail[a:b] & np.uint32(3))
                packed = packed.astype(np.uint16) if len(used) < 1 << 14 else packed
                step = np.diff(low[a:b], prepend=np.uint32(0)).astype(np.uint32)
                columns = np.concatenate([step.view(np.uint8).reshape(-1, 4).T.reshape(-1), packed.view(np.uint8).reshape(len(packed), -1).T.reshape(-1)])
                head = np.array([b - a, len(used), packed.itemsize], np.uint32).tobytes()
                rows.append(int(where[a]))
                blobs.append(press.compress(head + node[used].tobytes() + length[used].tobytes() + columns.tobytes()))
            if rest:
                rows.append(-1)
                blobs.append(np.array(rest, np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for s in _sets(batch, 0):
                if not len(s):
                    continue
                node = node_of(s)[0]
                if node in met:
                    continue
                met.add(node)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, known_n[at], 0)
                else:
                    weight = np.zeros(len(s), np.int64)
                own, missed = bands.of(len(s)), False
                for band in bands.reach(len(s)):
                    signature, flags, complete = bands.entries(s, band, band == own, True, weight)
                    parts.append((signature, flags | np.uint32(len(nodes) << 2)))
                    size += len(signature)
                    missed |= not complete
                if missed:
                    rest.append(node)
                nodes.append(node)
                sizes.append(len(s))
            if size >= FLUSH:
                yield flush()
                parts, nodes, sizes, size, met, rest = [], [], [], 0, set(), []
        yield flush()

    return docs.select(text_of().alias("text")).mapInArrow(lean(run), "bucket long, blob binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, nodes, sizes and flags of all entries of a bucket."""
    open_ = zstandard.ZstdDecompressor()
    out: tuple[list, list, list, list] = ([], [], [], [])
    for blob in blobs:
        raw = open_.decompress(blob)
        n, k, width = np.frombuffer(raw, np.uint32, 3).tolist()
        at = 12
        node = np.frombuffer(raw, np.int64, k, at)
        size = np.frombuffer(raw, np.uint32, k, at + 8 * k)
        at += 12 * k
        step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).reshape(-1)
        packed = np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at + 4 * n).reshape(width, n).T).view(f"<u{width}").reshape(-1).astype(np.uint32)
        own = packed >> np.uint32(2)
        for to, x in zip(out, (np.cumsum(step, dtype=np.uint32), node[own], size[own], (packed & np.uint32(3)).astype(np.uint8)), strict=True):
            to.append(x)
    return tuple(np.concatenate(x) for x in out)


def bucket_links(blobs: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Candidate pairs of a bucket (a < b), and for the signatures that many sets share their probing and their indexed nodes."""
    signature, node, size, flag = _unpack(blobs)
    order = np.lexsort((node, signature))
    signature, node, size, flag = signature[order], node[order], size[order].astype(np.int64), flag[order]
    start = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
    length = np.diff(np.append(start, len(signature)))
    again = np.zeros(len(node), bool)
    again[1:] = (signature[1:] == signature[:-1]) & (node[1:] == node[:-1])
    group = np.repeat(np.arange(len(start)), length)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        big, small = np.maximum(size[i], size[j]), np.minimum(size[i], size[j])
        meet = ((flag[i] & 2 > 0) & (flag[j] & 1 > 0) & (size[i] >= size[j])) | ((flag[j] & 2 > 0) & (flag[i] & 1 > 0) & (size[j] >= size[i]))
        ok = (node[i] != node[j]) & (100 * small >= percent * big) & meet
        pairs.append((node[i[ok]], node[j[ok]]))

    small_groups = length <= STAR
    for gap in range(1, STAR):
        i = np.flatnonzero(small_groups[group[:-gap]] & (group[gap:] == group[:-gap])) if len(group) > gap else np.zeros(0, np.int64)
        if not len(i):
            break
        keep(i, i + gap)
    many = []
    for g in np.flatnonzero(~small_groups):
        at = np.arange(start[g], start[g] + length[g])
        at = at[~again[at]]
        if len(at) < 2:
            continue
        # sizes apart cannot be similar: cut where no two neighbours are within reach
        by_size = at[np.argsort(size[at], kind="stable")]
        apart = np.flatnonzero(100 * size[by_size[:-1]] < percent * size[by_size[1:]]) + 1
        for part in np.split(by_size, apart):
            probes, index = part[(flag[part] & 2) > 0], part[(flag[part] & 1) > 0]
            if not len(probes) or not len(index) or len(part) < 2:
                continue
            if len(probes) * len(index) <= SPARSE * len(part):
                keep(np.repeat(probes, len(index)), np.tile(index, len(probes)))
                continue
            first = part[np.argmin(node[part])]
            others = part[part != first]
            pairs.append((np.full(len(others), node[first]), node[others]))
            many.append((np.sort(node[probes]), np.sort(node[index])))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), many
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1], many


def candidates(blobs: DataFrame, percent: int) -> DataFrame:
    """(a, b, probes, indexed): candidate pairs with null lists, and the lists of shared signatures with null pairs."""

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(bucket: pa.Table) -> pa.Table:
        a, b, many = bucket_links(bucket.column("blob").to_pylist(), percent)
        listed = list({(p.tobytes(), i.tobytes()): (p, i) for p, i in many}.values())
        none = [None] * len(listed)
        columns = [[*a.tolist(), *none], [*b.tolist(), *none], *[[None] * len(a) + [m[k] for m in listed] for k in (0, 1)]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["a", "b", "probes", "indexed"])

    return blobs.filter("bucket >= 0").groupBy("bucket").applyInArrow(run, "a long, b long, probes array<long>, indexed array<long>")


def node_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the set of each wanted node (node) as bytes, from one document that has it; from each row that repeats that document."""
    one = nodes.groupBy("node").agg(F.min("doc_id").alias("id")).join(wanted.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left_semi")
    one = one.select("node", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b, 1)
            right = [i for i, (s, n) in enumerate(zip(sets, b.column(0).to_pylist(), strict=True)) if node_of(s)[0] == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(0)[i].as_py() for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["node", "s"]
            )

    texts = docs.select("doc_id", text_of().alias("text")).join(one, F.col("doc_id").eqNullSafe(F.col("id")))
    return texts.select("node", "text").mapInArrow(lean(run), "node long, s binary")


def each_once(sets: DataFrame) -> DataFrame:
    """node_sets() as written, a row for each node: sets are shuffled only if rows are repeated, which the nodes alone tell."""
    if sets.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty():
        return sets
    once = work_table(sets.dropDuplicates(["node"]), "jaccard_sets")
    discard(sets)
    return once


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, with both sets whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                if len(x) < len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int(np.count_nonzero(x[at] == y))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

    left, right = sets.select(F.col("node").alias("x"), F.col("s").alias("sx")), sets.select(F.col("node").alias("y"), F.col("s").alias("sy"))
    both = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y")).select("a", "b", "sx", "sy")
    return both.mapInArrow(lean(run), "a long, b long").distinct()


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs of similar sets of two blocks, as many as connect what similar pairs connect."""
    flat = [np.concatenate(x) for x in (left, right)]
    size = [np.array(list(map(len, x)), np.int64) for x in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), 16384):
        some = shared[at : at + 16384]
        has = []
        for tokens, n in zip(flat, size, strict=True):
            place = np.minimum(np.searchsorted(some, tokens), len(some) - 1)
            hit = some[place] == tokens
            matrix = np.zeros((len(n), len(some)), np.float32)
            matrix[np.repeat(np.arange(len(n)), n)[hit], place[hit]] = 1
            has.append(matrix)
        both += has[0] @ has[1].T
    similar = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
    root = list(range(len(left) + len(right)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(similar)), strict=True):
        a, b = find(i), find(len(left) + j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


#: A list of so many ids at most is broadcast; a longer one is joined by a shuffle.
LOOKED_UP = 2_000_000


def by_blocks(edges: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified pairs (a, b) among the nodes that edges (first, node) tie together, enough to connect what is similar.

    Signatures that many sets share name much the same nodes again and again. Tied nodes form one group, whose sets are
    dealt by size band and hash to blocks of bounded size; blocks of equal or neighbouring bands are compared as
    matrices, so that rows are blocks and links, never candidate pairs.
    """
    group = components(edges.select(F.col("first").alias("a"), F.col("node").alias("b")))
    size = nodes.groupBy("node").agg(F.max("n").alias("n")).withColumnRenamed("node", "w")
    group = group.join(size, F.col("node") == F.col("w")).select("node", "root", "n", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).alias("band"))
    group = work_table(group, "jaccard_group")
    parts = group.groupBy("root", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    parts = parts.select(F.col("root").alias("r"), F.col("band").alias("q"), "parts")
    dealt = group.join(parts, (F.col("root") == F.col("r")) & (F.col("band") == F.col("q")))
    dealt = dealt.select("root", "band", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    dealt = dealt.join(sets.select(F.col("node").alias("w"), "s"), F.col("node") == F.col("w")).select("root", "band", "part", "node", "s")

    def block(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).slice(0, 1).combine_chunks() for c in ("root", "band", "part")]
        listed = pa.array([rows.column("node").to_pylist()], pa.list_(pa.int64())), pa.array([rows.column("s").to_pylist()], pa.list_(pa.binary()))
        return pa.Table.from_arrays([*columns, *listed], names=["root", "band", "part", "nodes", "s"])

    blocks = dealt.groupBy("root", "band", "part").applyInArrow(block, "root long, band long, part int, nodes array<long>, s array<binary>")
    blocks = work_table(blocks, "jaccard_blocks")
    # pairs are made of names alone and dealt to tasks; then each fetches its two blocks
    names = blocks.select("root", "band", "part")
    other = names.select(F.col("root").alias("r"), F.col("band").alias("q"), F.col("part").alias("p"))
    later = (F.col("q") == F.col("band") + 1) | ((F.col("q") == F.col("band")) & (F.col("p") >= F.col("part")))
    pairs = names.join(other, (F.col("root") == F.col("r")) & later).select("root", "band", "part", "q", "p")
    second = blocks.select("root", F.col("band").alias("q"), F.col("part").alias("p"), F.col("nodes").alias("nodes2"), F.col("s").alias("s2"))
    pairs = pairs.join(blocks, ["root", "band", "part"]).join(second, ["root", "q", "p"]).select("nodes", "s", "nodes2", "s2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                names, left, names2, right = (b.column(k)[i].as_py() for k in range(4))
                found = block_links([np.frombuffer(x, np.uint64) for x in left], [np.frombuffer(x, np.uint64) for x in right], percent)
                found = [(names[x], names2[y]) for x, y in found if names[x] != names2[y]]
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    found = work_table(pairs.mapInArrow(lean(compare), "a long, b long"), "jaccard_dense")
    discard(group, blocks)
    return found


def by_shingles(docs: DataFrame, nodes: DataFrame, rest: DataFrame, percent: int, block: int = 1_000_000) -> DataFrame:
    """Candidate pairs of nodes that could not choose enough segments: all sets that share one of their first shingles.

    A similar set shares one of any (size - least overlap + 1) shingles. The nodes' shingles are taken in blocks of
    bounded size, each looked up in all documents.
    """
    sets = node_sets(docs, nodes, rest).dropDuplicates(["node"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, of = [], []
            for node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                use = len(s) - -(-percent * len(s) // 100) + 1
                keys += s[:use].view(np.int64).tolist()
                of += [node] * use
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(of, pa.int64())], names=["shingle", "of"])

    wanted = work_table(sets.mapInArrow(lean(first), "shingle long, of long"), "jaccard_rest")
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for k in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([r[0] for r in part.select("shingle").distinct().collect()], np.int64).view(np.uint64)))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, of = [], []
                for s in _sets(b, 0):
                    hit = s[np.isin(s, shared.value, assume_unique=True)]
                    keys += hit.view(np.int64).tolist()
                    of += [node_of(s)[0]] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(of, pa.int64())], names=["key", "node"])

        hits = docs.select(text_of().alias("text")).mapInArrow(lean(look), "key long, node long").distinct()
        found = part.join(hits, F.col("shingle") == F.col("key")).filter("of != node")
        found = found.select(F.least("of", "node").alias("a"), F.greatest("of", "node").alias("b")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def links(docs: DataFrame, nodes: DataFrame, hot: np.ndarray, hot_n: np.ndarray, percent: int) -> DataFrame:
    """Verified pairs of nodes (a, b) that connect all nodes that similar pairs connect, written."""
    spark = docs.sparkSession
    total, largest = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = 8
    while buckets < MOST_BUCKETS and buckets * ENTRIES < total:
        buckets *= 2
    blobs = work_table(blob_rows(docs, buckets, largest, hot, hot_n, percent), "jaccard_blobs")
    found = work_table(candidates(blobs, percent), "jaccard_candidates")
    pairs = found.filter("probes is null").select("a", "b").distinct()
    if not blobs.filter("bucket = -1").isEmpty():
        unpack = F.udf(lambda b: np.frombuffer(b, np.int64).tolist(), "array<long>")
        short = blobs.filter("bucket = -1").select(F.explode(unpack("blob")).alias("node")).distinct()
        pairs = pairs.unionByName(by_shingles(docs, nodes, short, percent)).distinct()
    pairs = work_table(pairs, "jaccard_pairs")
    many = found.filter("probes is not null").select("probes", "indexed").distinct()
    many = work_table(many.withColumn("gid", F.xxhash64("probes", "indexed")), "jaccard_many")
    discard(blobs, found)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = each_once(work_table(node_sets(docs, nodes, wanted), "jaccard_sets"))
    # first each node's pair with its smallest partner, then what still lies between components
    nearest = work_table(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard_nearest")
    good = work_table(verified(nearest, sets, percent), "jaccard_good")
    roots = work_table(components(good), "jaccard_roots")
    more = pairs.join(nearest, ["a", "b"], "left_anti")

    def named(side: str) -> DataFrame:
        rows = many.select("gid", F.explode(side).alias("node")).join(roots, "node", "left")
        return rows.select("gid", "node", F.coalesce("root", "node").alias("root"))

    members = work_table(named("probes").unionByName(named("indexed")).distinct(), "jaccard_members")
    several = members.groupBy("gid").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("node").alias("first"))
    several = several.filter("least != most").select("gid", "first")
    dense = by_blocks(members.join(several, "gid").select("first", "node"), nodes, sets, percent)
    for side in ("a", "b"):
        at = roots.select(F.col("node").alias("n_"), F.col("root").alias(f"root_{side}"))
        more = more.join(at, F.col(side) == F.col("n_"), "left").drop("n_").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    more = work_table(more.filter("root_a != root_b").select("a", "b").distinct().join(nearest, ["a", "b"], "left_anti"), "jaccard_more")
    out = work_table(good.unionByName(dense).unionByName(verified(more, sets, percent)), "jaccard_links")
    discard(sets, pairs, many, members, nearest, good, more, dense)
    return out


def jaccard_join(docs: DataFrame, percent: int = PERCENT, tables: list[DataFrame] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, one row for each row of docs; tables gets the work tables that it reads."""
    small_batches(docs.sparkSession)
    nodes, hot, hot_n = nodes_and_hot(docs)
    good = links(docs, nodes.filter("n > 0"), hot, hot_n, percent)
    roots = components(good).withColumnRenamed("node", "of")
    at = nodes.join(roots, F.col("node") == F.col("of"), "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    least = work_table(at.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "jaccard_least").withColumnRenamed("root", "r")
    if tables is not None:
        tables += [nodes, good]
    out = at.join(least, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


@any_names
def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, with all their columns; rows of one id go together."""
    tables: list[DataFrame] = []
    found = jaccard_join(docs, percent, tables)
    kept = found.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_kept"))
    dropped = work_table(kept.filter("NOT _kept").select("_id"), "jaccard_dropped")
    discard(*tables)
    few = F.broadcast(dropped) if dropped.count() <= LOOKED_UP else dropped
    return docs.join(few, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
