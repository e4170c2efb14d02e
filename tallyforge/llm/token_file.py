"""Token-ID output in a binary format: ids under one shared frequency table in independent rANS blocks (operator 10).

Texts are encoded with the tokenizers library, an end id follows each document, and documents are dealt to shards by
ranges of doc_id. A file set in the shared folder has two parts: `table`, the shared frequencies of all ids, and
`blocks`, one row per block with the shard, the position in it, the documents' ids and lengths and the rANS payload (see
rans.py). Spark's committed writer stores both, so any store that Spark writes to will do and a lost executor's blocks
are written again. Reading takes whole blocks, alone, in any order and in parallel; a block's checkpoints let a reader that
needs only a stretch decode that (Coder.decode with part).

Defined cases: null text counts as empty and gives just the end id; a null doc_id comes first; rows with the same id are
ordered by text; an empty table gives an empty file set and result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm.bpe import read_spec
from tallyforge.llm.common import lean, new_path, small_batches, text_of
from tallyforge.llm.rans import Coder, scaled

END_ID = 1
BLOCK = 1 << 18
ROWS_PER_SHARD, MOST_SHARDS = 8192, 20_000
#: Most entries of a worker's cache, and the longest chunk kept in it.
CACHED, CACHED_CHARS = 900_000, 40
#: Chunks that are one word of these letters and a run of these marks are looked up as the two, the word in lower case.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)").fullmatch
MARKS = frozenset(".,;:!?*#$%&|")
#: Words that the library is asked for in one text: long texts take it more time per word.
TOGETHER = 256


def parts_of(chunk: str) -> tuple[str, str] | None:
    """The word in lower case and the marks of such a chunk, else None; most need no pattern."""
    if chunk.isascii() and chunk[-1:] in MARKS and chunk[:-1].isalpha():
        return chunk[:-1].lower(), chunk[-1]
    m = SIMPLE(chunk)
    return (m[1].lower(), m[2]) if m else None


def _packed(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


class WordEncoder:
    """Encodes with a tokenizer that drops white space: each chunk between spaces is encoded once and then looked up.

    Ids are kept and given as packed integers (kind), two or four bytes each.
    """

    def __init__(self, spec: str, width: int = 0) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(_packed(max(width, self.tokenizer.get_vocab_size())))
        self.cache: dict[str, bytes] = {}
        #: Tokens that the library looks for before it makes letters small.
        self.capital = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content != t.content.lower()]
        #: Ids that end a word in the tokenizer's vocabulary.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for letters, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = letters.endswith("</w>")

    def _asked(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters or marks alone, which the library takes as one word each: asked for together, cut at word ends."""
        found: dict[str, bytes] = {}
        size = self.kind.itemsize
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for some, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if groups else [], strict=True):
            ids = np.array(encoded.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(stops) != len(some):
                found.update((w, self._asked(w).tobytes()) for w in some)
                continue
            flat = ids.tobytes()
            found.update((w, flat[a:b]) for w, a, b in zip(some, [0, *stops], stops, strict=False))
        return found

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks encoded by the library; simple ones share the encoding of their word and marks."""
        cache, simple, ask, plain = self.cache, [], [], {}
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha() and chunk.islower() and len(chunk) <= CACHED_CHARS:
                plain[chunk] = None
                continue
            parts = parts_of(chunk) if len(chunk) <= CACHED_CHARS else None
            if parts:
                word, marks = parts
                simple.append((chunk, word, marks))
                if word not in cache:
                    plain[word] = None
                if marks and marks not in cache:
                    plain[marks] = None
            else:
                ask.append(chunk)
        found = self._plain(list(plain))
        if ask:
            found.update((c, np.array(e.ids, self.kind).tobytes()) for c, e in zip(ask, self.tokenizer.encode_batch_fast(ask, add_special_tokens=False), strict=True))
        out = dict(found)
        for chunk, word, marks in simple:
            if chunk not in out:
                ids = found[word] if word in found else cache[word]
                out[chunk] = ids + (found[marks] if marks in found else cache[marks]) if marks else ids
        return out

    def _may_be_lowered(self, text: str) -> bool:
        """Whether small letters at once give what the library gives: it composes letters first, and has no final sigma."""
        composed = text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text))
        return composed and not any(c in text for c in self.capital)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each whole text, without special tokens added, packed."""
        # line breaks separate words as spaces do, and none is in a token that the library looks for first
        cut = [(t.lower() if self._may_be_lowered(t) else t).replace("\n", " ").split(" ") for t in texts]
        cache = self.cache
        new = set().union(*cut).difference(cache)
        if new:
            found = self._fresh(list(new))
            room = len(cache) < CACHED
            cache.update(found)
        out = [b"".join(map(cache.__getitem__, chunks)) for chunks in cut]
        if new:  # what is too long, or has no room, is not kept beyond these texts
            for k in found:
                if not room or len(k) > CACHED_CHARS:
                    del cache[k]
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, self.kind).tolist() for x in self.encode_packed(texts)]


_ENCODERS: dict[int, WordEncoder] = {}


def word_encoder(spec: str, width: int) -> WordEncoder:
    key = zlib.crc32(spec.encode()) << 32 | width
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec, width)
    return _ENCODERS[key]


def encode_shards(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, int]:
    """docs (doc_id, text) -> (shard, seq, doc_id, ids as packed integers) in order of doc_id, written; and the vocabulary's size.

    Each task adds one row of shard -1, whose ids hold what ids it wrote and how often (id_counts reads those).
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = read_spec(path)
    width = max(Tokenizer.from_str(text).get_vocab_size(), end_id + 1)
    spec, kind = spark.sparkContext.broadcast(text), _packed(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq, total = word_encoder(spec.value, width), 0, np.zeros(width, np.int64)
        end, names = np.array([end_id], kind).tobytes(), ["shard", "seq", "doc_id", "ids"]
        for b in batches:
            ids = [x + end for x in encoder.encode_packed(b.column(2).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(seq, seq + len(ids))), b.column(1), pa.array(ids, pa.binary())], names=names)
            seq += len(ids)
        if seq:
            some = np.flatnonzero(total)
            blob = some.astype("<u8").tobytes() + total[some].astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0]), pa.array([None], pa.int64()), pa.array([blob], pa.binary())], names=names)

    shards = max(1, min(MOST_SHARDS, -(-docs.count() // ROWS_PER_SHARD)))
    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    rows = rows.mapInArrow(lean(run), "shard int, seq long, doc_id long, ids binary")
    where = new_path(spark, "token_ids")
    rows.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(rows.schema).parquet(where), width


def id_counts(encoded: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in all of encoded, summed over the tasks that wrote it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                some, n = np.frombuffer(blob, "<u8").reshape(2, -1).astype(np.int64)
                total[some] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    counts = encoded.filter("shard = -1").select("ids").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(width, np.int64)
    for r in counts.collect():  # at most one row per id of the vocabulary
        out[r["id"]] = r["n"]
    return out


BLOCKS = "shard int, first_seq long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_blocks(encoded: DataFrame, freq: np.ndarray, where: str) -> None:
    """encoded rows -> `blocks` under where. A block is a run of a shard's documents of about BLOCK ids, or one longer document."""
    kind, table = _packed(len(freq)), encoded.sparkSession.sparkContext.broadcast(freq)
    names = [c.split(" ")[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        held: list[tuple[int, int, int | None, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[3] for x in held), kind).astype(np.int64)
            lengths = [len(x[3]) // np.dtype(kind).itemsize for x in held]
            row = [[held[0][0]], [held[0][1]], [len(ids)], [[x[2] for x in held]], [lengths], [coder.encode(ids)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                n = len(row[3]) // np.dtype(kind).itemsize
                if held and (size + n > BLOCK or held[-1][:2] != (row[0], row[1] - 1)):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += n
        if held:
            yield block()

    encoded.filter("shard >= 0").select("shard", "seq", "doc_id", "ids").mapInArrow(lean(run), BLOCKS).write.option("compression", "none").parquet(f"{where}/blocks")


def write_tokens(docs: DataFrame, path: str, where: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) with the tokenizer file at path and write the file set under where."""
    encoded, width = encode_shards(docs, path, end_id)
    freq = scaled(id_counts(encoded, width))
    write_blocks(encoded, freq, where)
    docs.sparkSession.createDataFrame([(freq.astype("<u4").tobytes(),)], "freq binary").write.parquet(f"{where}/table")


def read_tokens(spark: SparkSession, where: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every document (their crc32 instead if digest) from the file set under where.

    start is the number of ids of all documents before it: shards' sums are added up over shards, blocks' within a shard.
    """
    freq = np.frombuffer(spark.read.parquet(f"{where}/table").first()["freq"], "<u4").astype(np.int64)
    table = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCKS).parquet(f"{where}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("shard", "first_seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_shard"))
    at = at.join(sums, F.col("shard") == F.col("of")).select(F.col("shard").alias("s"), F.col("first_seq").alias("q"), (F.col("shard_start") + F.col("in_shard")).alias("start"))
    joined = blocks.join(at, (F.col("shard") == F.col("s")) & (F.col("first_seq") == F.col("q"))).select("start", "doc_ids", "lengths", "payload")
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.list_(pa.int32()), "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table.value)
        for b in batches:
            for i in range(b.num_rows):
                start, docs, lengths, payload = (b.column(k)[i].as_py() for k in range(4))
                ids = coder.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                values = [zlib.crc32(p.tobytes()) for p in parts] if digest else [p.astype(np.int32) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - np.array(lengths)), pa.array(lengths, pa.int64()), pa.array(values, last[1])],
                    names=["doc_id", "start", "n_tokens", last[0]],
                )

    return joined.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {last[0]} {last[2]}")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write docs and read the file set back: doc_id, start, n_tokens, ids_crc32."""
    where = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, where, end_id)
    return read_tokens(docs.sparkSession, where, digest=True)
