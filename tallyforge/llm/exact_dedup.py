"""Exact dedup with composable polynomial fingerprints (operator 7).

A text is read in segments; every segment's bytes give a polynomial hash modulo 2^31-1 under two bases, made of hashes
of short chunks. Hashes compose: hash(A+B) = hash(A) * base^len(B) + hash(B), so segments of a huge text are hashed in
parallel and joined afterwards. Rows with equal fingerprint and length form a group; each member is then compared with
the group's keeper chunk by chunk, and a member that differs is grouped anew by digest.

Defined cases: null text counts as empty; a null doc_id comes after all others; of repeated rows with the same id and
text one stays; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import any_names, discard, lean, small_batches, squeezed, text_of, work_table

P = np.uint64(2**31 - 1)
BASES = (np.uint64(1_000_003_9), np.uint64(1_597_334_677))
CHUNK = 1024
#: Chunks hashed at once: bounds the memory beside a batch, as every byte is widened to several 64-bit numbers.
AT_ONCE = 256
#: Code points of one segment, and of one compared piece.
SEGMENT, PIECE = 1 << 20, 1 << 16
#: Members that one copy of the keeper's text is compared with.
PER_COPY = 256

_POWERS = {int(b): np.cumprod(np.ones(1, np.uint64)) for b in BASES}


def power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base^exponents modulo P, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % P, out)
        square = square * square % P
        left = left >> np.uint64(1)
    return out


def combine(left: int, right: int, right_power: int) -> int:
    """The hash of two joined texts; right_power is base^len(right) modulo P."""
    return (left * right_power + right) % int(P)


def fingerprints(data: np.ndarray, offsets: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of the texts data[offsets[i]:offsets[i+1]] (uint8), from those of their chunks."""
    offsets = offsets.astype(np.int64)
    lengths = np.diff(offsets)
    n_chunks = (lengths + CHUNK - 1) // CHUNK
    out = np.zeros(len(lengths), np.uint64)
    if not n_chunks.any():
        return out
    owner = np.repeat(np.arange(len(lengths)), n_chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = offsets[owner] + nth * CHUNK
    end = np.minimum(start + CHUNK, offsets[owner + 1])
    table = _POWERS[int(base)]
    if len(table) < CHUNK:
        table = _POWERS[int(base)] = power(base, np.arange(CHUNK))
    chunk_hash = np.empty(len(start), np.uint64)
    for a in range(0, len(start), AT_ONCE):
        begin, stop = start[a : a + AT_ONCE], end[a : a + AT_ONCE]
        first, last = int(begin[0]), int(stop[-1])
        terms = data[first:last].astype(np.uint64)
        terms += np.uint64(1)
        terms *= table[np.repeat(stop - 1, stop - begin) - np.arange(first, last)]
        chunk_hash[a : a + AT_ONCE] = np.add.reduceat(terms, begin - first) % P
    shifted = chunk_hash * power(base, offsets[owner + 1] - end) % P
    at = np.cumsum(n_chunks) - n_chunks
    some = n_chunks > 0
    out[some] = np.add.reduceat(shifted, at[some]) % P
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("segment"))
        text = text.cast(pa.large_string()) if pa.types.is_string(text.type) else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(lengths)]
        for base in BASES:
            columns += [pa.array(fingerprints(data, offsets, base).astype(np.int64)), pa.array(power(base, lengths).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "h1", "p1", "h2", "p2"])


def segment_hashes(rows: DataFrame) -> DataFrame:
    """rows (…, segment) -> the other columns, n_bytes and per base the segment's hash and its shift."""
    names = [c for c in rows.columns if c != "segment"]
    rows = rows.select(*names, "segment")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != "segment"), "n_bytes long, h1 long, p1 long, h2 long, p2 long"])
    return rows.mapInArrow(lean(_hash_batches), schema)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> rid, doc_id, r1, r2 (hash of the row), sha, f1, f2, n_bytes, one row per document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *row_hash(), squeezed(text_of()).alias("norm"))
    rows = rows.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    n_segments = F.greatest(F.lit(1), F.ceil(F.length("norm") / SEGMENT)).cast("int")
    whole = F.when(F.length("norm") <= SEGMENT, F.array("norm")).otherwise(
        F.transform(F.sequence(F.lit(0), n_segments - 1), lambda i: F.substring(F.col("norm"), i * SEGMENT + 1, F.lit(SEGMENT)))
    )
    rows = rows.select("rid", "doc_id", *ROW, "sha", n_segments.alias("n_segments"), F.posexplode(whole).alias("nth", "segment"))
    parts = work_table(segment_hashes(rows), "dedup_parts")
    one = parts.filter("n_segments = 1").select("rid", "doc_id", *ROW, "sha", F.col("h1").alias("f1"), F.col("h2").alias("f2"), "n_bytes")
    many = parts.filter("n_segments > 1").groupBy("rid", "doc_id", *ROW, "sha").agg(
        F.sort_array(F.collect_list(F.struct("nth", "h1", "p1", "h2", "p2"))).alias("s"), F.sum("n_bytes").alias("n_bytes")
    )

    def joined(k: int):
        return F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: (acc * x[f"p{k}"] + x[f"h{k}"]) % int(P))

    out = one.unionByName(many.select("rid", "doc_id", *ROW, "sha", joined(1).alias("f1"), joined(2).alias("f2"), "n_bytes"))
    out.work_path = parts.work_path
    return out


KEY = ["f1", "f2", "n_bytes"]
#: Hash of a row's id and text as they are, by which lists of rows are looked up.
ROW = ["r1", "r2"]
#: A list of so many rows at most is broadcast (about 16 bytes each, or a group's key and keeper); a longer one is joined by a shuffle.
LOOKED_UP = 2_000_000


def row_hash() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2")]


def looked_up(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= LOOKED_UP else df


def _groups(prints: DataFrame, key: list[str]) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "rid")).alias("keep")
    return prints.groupBy(*key).agg(first, F.count(F.lit(1)).alias("group_size"))


def differing(docs: DataFrame, prints: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, sha) of the members whose text is not that of their group's keeper, found piece by piece.

    several: the groups of more than one row. Only texts of their members leave the scan.
    """
    members = prints.join(looked_up(several.select(*KEY, "keep", "group_size")), KEY)
    copies = F.ceil(F.col("group_size") / PER_COPY).cast("int")
    members = work_table(members.select("doc_id", "sha", *ROW, *KEY, "keep", copies.alias("copies")), "dedup_members")
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("sha") == F.col("keep.sha"))
    texts = docs.select("doc_id", "text", *row_hash()).join(looked_up(members.select(*ROW).distinct()), ROW, "left_semi")
    texts = texts.dropDuplicates(ROW).select(*ROW, squeezed(text_of()).alias("norm"))
    texts = texts.join(members.select(*ROW, "doc_id", "sha", *KEY, "copies", is_keeper.alias("is_keeper")).dropDuplicates(ROW), ROW)
    n_pieces = F.greatest(F.lit(1), F.ceil(F.length("norm") / PIECE)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda i: F.substring(F.col("norm"), i * PIECE + 1, F.lit(PIECE)))
    keepers = texts.filter("is_keeper").groupBy(*KEY).agg(F.first("norm").alias("norm"), F.first("copies").alias("copies"))
    keepers = keepers.select(*KEY, "copies", F.posexplode(pieces).alias("nth", "kept_piece"))
    keepers = keepers.select(*KEY, "nth", "kept_piece", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    copy = F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")
    others = texts.filter(~F.col("is_keeper")).select("doc_id", "sha", *KEY, copy.alias("copy"), F.posexplode(pieces).alias("nth", "piece"))
    compared = others.join(keepers, [*KEY, "nth", "copy"], "left")
    same = F.coalesce(F.col("piece") == F.col("kept_piece"), F.lit(False))
    odd = work_table(compared.filter(~same).select("doc_id", "sha").distinct(), "dedup_odd")
    discard(members)
    return odd


def _several(prints: DataFrame, key: list[str]) -> DataFrame:
    groups = _groups(prints, key).filter("group_size > 1")
    return work_table(groups.select(*key, "keep", "group_size"), "dedup_groups")


def grouped(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """docs (doc_id, text) -> prints with keep (a group's keeper; null for a row of its own) and group_size, and the work tables it reads."""
    prints = fingerprint_table(docs)
    several, key, tables = _several(prints, KEY), KEY, [prints]
    odd = differing(docs, prints, several)
    if odd.isEmpty():
        discard(odd)
    else:
        tables += [several, odd]
        split = odd.select(F.col("doc_id").alias("id"), F.col("sha").alias("split"))
        prints = prints.join(split, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("split")), "left").drop("id")
        prints = prints.withColumn("split", F.coalesce("split", F.lit("")))
        key = [*KEY, "split"]
        several = _several(prints, key)
    tables.append(several)
    return prints.join(looked_up(several), key, "left"), tables


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    alone = F.col("group_size").isNull()
    return grouped(docs)[0].select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


@any_names
def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are dropped by the hash of id and text; of rows with the same id and text one stays.
    """
    rows, tables = grouped(docs)
    members = rows.filter("group_size > 1").select(*[F.col(r).alias(f"_{r}") for r in ROW], (F.col("rid") == F.col("keep.rid")).alias("kept"))
    marked = members.groupBy("_r1", "_r2").agg(F.bool_or("kept").alias("_kept"), (F.count(F.lit(1)) > 1).alias("_again"))
    marked = work_table(marked.filter("NOT _kept OR _again"), "dedup_marked")
    discard(*tables)
    named = docs.withColumns({"_h1": row_hash()[0], "_h2": row_hash()[1]})
    found = named.join(looked_up(marked), (F.col("_h1") == F.col("_r1")) & (F.col("_h2") == F.col("_r2")), "left")
    once = found.filter("_kept AND _again").dropDuplicates(["_h1", "_h2"])
    return found.filter("_kept IS NULL").unionByName(once).select(*docs.columns)
