"""Language-model scoring by logistic context mixing of hashed bit predictors (operator 8).

lm_bits holds the predictors: five contexts of a byte, among them bytes across spaces and the word before, each with
counts of what followed it in the training texts; their log odds are combined by weights, of which a gate picks one set,
and the result is refined by a table of observed outcomes. Weights and outcomes are learnt online over all training
texts, each half byte's own occurrence taken out of the counts first; tasks learn side by side, and the weights
are averaged by the half bytes each has seen, the outcomes added up.

Three passes over the texts: count (cells and words), learn, score. Counts are summed as 64-bit integers in each task, then by ranges of
cells. The hashed tables have one row for BYTES_PER_ROW training bytes, up to MOST_ROW_BITS, a bound of a task's memory: beyond it
contexts share rows the more the larger the corpus is, while every occurrence still counts. Word counts of the base
score are exact at any size: the distinct words of runs of texts are gathered by ranges of their hash, and the counts
go back to the runs.

The base score is a smoothed unigram model over lower-cased words and one end token per document.

Defined cases: null text counts as empty (its end is scored); without training texts every bit costs one bit and the
base score is log10(0.5 / 0.5) per token; bits_per_byte is the score's bits by the text's bytes without its end byte, null for
an empty text; repeated rows get a row each; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import lm_bits as L
from tallyforge.llm.common import crc_mod, discard, lean, small_batches, text_of, work_table
from tallyforge.llm.shingles import text_buffer

#: Bytes of text of one run of documents, and of all texts for one range of word hashes.
RUN, PER_BUCKET = 1 << 24, 1 << 27
#: Training bytes for one row of a hashed table; least and most rows of a table, as powers of two.
BYTES_PER_ROW, LEAST_ROW_BITS, MOST_ROW_BITS = 16, 12, 18
#: Ranges of cells in which the tasks' counts are added up.
SLICES = 16


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value."""
    sink = pa.BufferOutputStream()
    names = list(arrays)
    flat = [np.ascontiguousarray(arrays[k]) for k in names]
    head = ";".join(f"{k}:{x.dtype.str}:{len(x)}" for k, x in zip(names, flat, strict=True)).encode()
    sink.write(len(head).to_bytes(4, "little") + head)
    for x in flat:
        sink.write(x.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for field in raw[4 : 4 + n].decode().split(";"):
        name, kind, size = field.split(":")
        out[name] = np.frombuffer(raw, kind, int(size), at)
        at += int(size) * np.dtype(kind).itemsize
    return out


def least(counts: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest unsigned integers that hold them."""
    most = counts.max(initial=0)
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def row_bits_for(train_bytes: int) -> int:
    return min(MOST_ROW_BITS, max(LEAST_ROW_BITS, (train_bytes // BYTES_PER_ROW).bit_length()))


def slices(row_bits: int) -> np.ndarray:
    """Bounds of the ranges of all tables' cells, one after the other."""
    total = 16 * sum(L.row_counts(row_bits))
    return np.linspace(0, total, SLICES + 1).astype(np.int64)


def summed_tables(parts: DataFrame, row_bits: int) -> np.ndarray:
    """Counts of all cells: the tasks' parts (bucket -2 and below, blob) added up by ranges of cells."""
    bounds = slices(row_bits)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        nth = -2 - int(pdf["bucket"].iloc[0])
        total = np.zeros(bounds[nth + 1] - bounds[nth], np.int64)
        for blob in pdf["blob"]:
            total += unpack(blob)["n"].astype(np.int64)
        return pd.DataFrame({"slice": [nth], "blob": [pack(n=least(total))]})

    out = np.zeros(bounds[-1], np.int64)
    for r in parts.select("bucket", "blob").groupBy("bucket").applyInPandas(add, "slice long, blob binary").toLocalIterator():  # parts of a table of fixed size
        out[bounds[r["slice"]] : bounds[r["slice"] + 1]] = unpack(r["blob"])["n"]
    return out


_TABLES: dict[tuple[str, bool], list[np.ndarray]] = {}


def tables_of(model: str, counts: Broadcast, row_bits: int, without_own: bool) -> list[np.ndarray]:
    """The log odds of all tables; a Python worker makes those of a model (a name no other has) once, and holds one set."""
    key = (model, without_own)
    if key not in _TABLES:
        _TABLES.clear()
        flat = unpack(counts.value)["n"]
        ends = np.cumsum([16 * r for r in L.row_counts(row_bits)])
        _TABLES[key] = [L.log_odds(flat[b - 16 * r : b], without_own) for r, b in zip(L.row_counts(row_bits), ends, strict=True)]
    return _TABLES[key]


def fit_mixer(train: DataFrame, model: str, counts: Broadcast, row_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The gates' weights, refined in each task over its training texts and averaged, and what the refining stage adds."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = L.Learner.new()
        for b in batches:
            if b.num_rows:
                learner.learn(tables_of(model, counts, row_bits, True), row_bits, *text_buffer(b.column(0)))
        seen = np.repeat(learner.seen, L.CONTEXTS)
        value = np.concatenate([learner.weights.reshape(-1) * seen, learner.outcomes])
        weight = np.concatenate([seen, np.zeros(len(learner.outcomes))])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(value)), pa.int64()), pa.array(value), pa.array(weight)], names=["k", "v", "n"])

    rows = train.mapInArrow(lean(go), "k long, v double, n double").groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    weights, outcomes = np.full(L.GATES * L.CONTEXTS, L.FIRST), np.zeros(256 * L.POINTS * 2)
    for r in rows.collect():  # one row for each weight and each cell of the refining stage
        k = r["k"]
        if k >= len(weights):
            outcomes[k - len(weights)] = r["v"]
        elif r["n"]:
            weights[k] = r["v"] / r["n"]
    return weights.reshape(L.GATES, L.CONTEXTS), L.corrections(outcomes)


def runs(docs: DataFrame, buckets: int, row_bits: int, fold: int) -> DataFrame:
    """docs (doc_id, text) -> (run, bucket, blob) from one pass over the texts.

    Bucket -1 holds a run's documents, buckets from 0 its distinct words with their training counts, those from -2 down the
    task's counts of the bit predictors' cells by ranges.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    bounds = slices(row_bits)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        counter = L.Counter(row_bits)
        held: list[tuple] = []
        size = 0

        def rows(run: int, numbers: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([run] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["run", "bucket", "blob"])

        def flush() -> pa.RecordBatch:
            nonlocal nth
            run, nth = task << 24 | nth, nth + 1
            ids, known, learnt, length, hashed, n_words = (np.concatenate([h[k] for h in held]) for k in range(1, 7))
            distinct, number = np.unique(hashed, return_inverse=True)
            n = np.bincount(number, weights=np.repeat(learnt, n_words), minlength=len(distinct)).astype(np.int64)
            where = (distinct >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(distinct), np.int64)
            cuts = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where)) if len(where) else np.zeros(1, np.int64)
            numbers = [-1, *where[cuts[:-1]].tolist()]
            blobs = [pack(ids=ids, known=known, learnt=learnt, length=length, text=np.concatenate([h[0] for h in held]))]
            blobs += [pack(word=distinct[a:b], n=least(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return rows(run, numbers, blobs)

        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = text_buffer(b.column(1))
            ids = b.column(0).to_pylist()
            learnt = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 5 != fold for i in ids])
            stream, coded, length = L.padded(data, offsets)
            counts = coded & np.repeat(learnt, length + L.PAD)
            words, ends = [], []
            for s in L.spans(stream, coded, row_bits, counted=counts):
                counter.add(s.cells)
                words.append(s.words)
                ends.append(s.ends)
            held.append((data, np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), learnt, length - 1, *L.word_lists(words, ends, length)))
            size += len(data)
            if size >= RUN:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        counter.flush()
        if counter.most:
            ends = np.cumsum([0, *map(len, counter.tables)])
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                part = np.concatenate([t[max(x - e, 0) : max(y - e, 0)] for t, e in zip(counter.tables, ends, strict=False)])
                yield rows(-1, [-2 - i], [pack(n=least(part))])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(go), "run long, bucket long, blob binary")


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of word hashes, from all runs -> every run's counts of its words; run -1: occurrences and distinct words in training."""
    parts = [unpack(b) for b in pdf["blob"]]
    word, number = np.unique(np.concatenate([p["word"] for p in parts]), return_inverse=True)
    c = np.bincount(number, weights=np.concatenate([p["n"] for p in parts]).astype(np.float64), minlength=len(word)).astype(np.int64)
    bucket = int(pdf["bucket"].iloc[0])
    rows = [(-1, bucket, pack(total=np.array([c.sum(), (c > 0).sum()])))]
    at = 0
    for run, p in zip(pdf["run"], parts, strict=True):
        rows.append((run, bucket, pack(c=least(c[number[at : at + len(p["word"])]]))))
        at += len(p["word"])
    return pd.DataFrame(rows, columns=["run", "bucket", "blob"])


def score(docs: DataFrame, fold: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts whose crc32 of the id as text is fold modulo 5 are not learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    learnt = crc_mod(F.col("doc_id"), 5) != fold
    size = docs.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(learnt, F.octet_length("text"))).alias("train"), F.count(F.when(learnt, 1)).alias("n")).first()
    n_train, train = size["n"], docs.filter(learnt).select(text_of().alias("text"))
    row_bits = row_bits_for(size["train"] or 0)
    buckets = 1 << ((size["all"] or 0) // PER_BUCKET).bit_length() + 2

    table = work_table(runs(docs, buckets, row_bits, fold), "lm_runs")
    words = table.filter("bucket >= 0").groupBy("bucket").applyInPandas(counted, "run long, bucket long, blob binary")
    words = work_table(words, "lm_words")
    total = kinds = 0
    for r in words.filter("run = -1").select("blob").toLocalIterator():  # one row of two numbers for each range of words
        n, k = unpack(r["blob"])["total"]
        total, kinds = total + int(n), kinds + int(k)
    total, kinds = total + n_train, kinds + (n_train > 0)
    base_log = float(np.log10(total + 0.5 * (kinds + 1)))

    model = uuid.uuid4().hex
    counts = spark.sparkContext.broadcast(pack(n=least(summed_tables(table.filter("bucket < -1"), row_bits))))
    mixer = spark.sparkContext.broadcast(fit_mixer(train, model, counts, row_bits))

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        d = unpack(pdf["blob"].iloc[0])
        c = np.concatenate([np.zeros(0, np.int64), *[unpack(b)["c"].astype(np.int64) for b in pdf["blob"].iloc[1:]]])
        offsets = np.concatenate([[0], np.cumsum(d["length"])])
        cost, hashed, n_words = L.costs(tables_of(model, counts, row_bits, False), row_bits, *mixer.value, d["text"], offsets)
        cost /= np.log(10)
        mine = c[np.unique(hashed, return_inverse=True)[1]] if len(hashed) else c[:0]
        upto, some = np.concatenate([[0.0], np.cumsum(np.log10(mine + 0.5))]), np.concatenate([[0], np.cumsum(mine > 0)])
        first = np.concatenate([[0], np.cumsum(n_words)])
        n_tokens = n_words + 1
        ids = pd.array(d["ids"], dtype="Int64")
        ids[~d["known"].astype(bool)] = pd.NA
        bits = pd.array(-cost * np.log2(10) / np.maximum(d["length"], 1), dtype="Float64")
        bits[d["length"] == 0] = pd.NA
        return pd.DataFrame(
            {
                "doc_id": ids, "held_out": d["learnt"] == 0, "n_tokens": n_tokens, "n_known": some[first[1:]] - some[first[:-1]] + (n_train > 0),
                "train_tokens": total, "base_score": upto[first[1:]] - upto[first[:-1]] + np.log10(n_train + 0.5) - n_tokens * base_log,
                "score": cost, "bits_per_byte": bits,
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return table.filter("bucket = -1").unionByName(words.filter("run >= 0")).groupBy("run").applyInPandas(rate, schema)
