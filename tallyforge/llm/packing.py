"""Packing documents into sequences: first-fit decreasing in randomised groups, bins in a tournament tree (operator 13).

A document is its ids by the tokenizers library and an end id. Whole sequences are cut from its front, and what remains
is one item. Items are dealt at random to groups of a few thousand; in each, the largest item first goes to the first
bin that has room, found in a tree whose inner nodes hold the largest room below. Room that is left is then filled from
the emptiest bins, whose items are cut for it, and the last bin is written in parts whose sizes are powers of two, as
these need no padding either. Only items travel, once, and a group is bounded whatever its documents are.

Defined cases: null text counts as empty and gives the end id alone; rows with the same or no doc_id are documents of
their own; the dealing follows the rows as stored, so the same files give the same packing; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm.bpe import read_spec
from tallyforge.llm.common import lean, small_batches, text_of, work_table

LENGTH, END_ID = 1024, 0
#: Documents in a group, on average.
GROUP = 4096
#: Most entries of a worker's cache, and the longest chunk kept in it; words that the library is asked for in one text.
CACHED, CACHED_CHARS, TOGETHER = 1_000_000, 40, 256
#: Chunks of these letters and a run of these marks are looked up as the two: the tokenizer cuts there, too.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)").fullmatch
MARKS = frozenset(".,;:!?*#$%&|")
RUNS = regex.compile(r"(\p{White_Space}{2,})")
CUT = "row long, doc_id long, start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary"


class ByteEncoder:
    """Encodes as the library does with a byte-level tokenizer: each chunk between spaces is encoded once, then looked up.

    A chunk keeps the space or line break before it, as the tokenizer's pieces do. Ids are packed, four bytes each. Any
    other kind of tokenizer is asked for whole texts.
    """

    def __init__(self, spec: str) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        about = json.loads(spec)
        cutter, model = about.get("pre_tokenizer") or {}, about["model"]
        self.by_chunks = (
            cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and not about.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        self.special = [t["content"] for t in about.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.starts = {" ": np.zeros(self.tokenizer.get_vocab_size(), bool), "\n": np.zeros(self.tokenizer.get_vocab_size(), bool)}
        for token, i in vocab.items():  # the letters by which byte-level vocabularies write a space and a line break
            self.starts[" "][i] = token.startswith("\u0120")
            self.starts["\n"][i] = token.startswith("\u010a")
        #: Chunks after a space, or written with their line break; texts as they are.
        self.later: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {"": b""}

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str], before: str) -> dict[str, bytes]:
        """Words of letters alone, each after the same space or line break: asked for together, cut where one starts."""
        found: dict[str, bytes] = {}
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for some, flat in zip(groups, self._asked([before + before.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.starts[before][np.frombuffer(flat, "<u4")]) * 4
            if len(at) != len(some):
                found.update(zip(some, self._asked([before + w for w in some]), strict=True))
                continue
            ends = [*at[1:].tolist(), len(flat)]
            found.update((w, flat[a:b]) for w, a, b in zip(some, at.tolist(), ends, strict=True))
        return found

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """New chunks; simple ones are put together from their word and marks."""
        later, simple, odd, marks = self.later, [], [], set()
        words: dict[str, dict[str, None]] = {" ": {}, "\n": {}}
        after_space = words[" "]
        for chunk in chunks:
            if chunk.isascii():  # most need no pattern
                if chunk.isalpha():
                    after_space[chunk] = None
                    continue
                if chunk[-1:] in MARKS and chunk[:-1].isalpha():
                    after_space[chunk[:-1]] = None
                    simple.append((chunk, chunk[-1]))
                    marks.add(chunk[-1])
                    continue
            broken = chunk[:1] == "\n"
            m = SIMPLE(chunk, 1 if broken else 0)
            if m:
                words["\n" if broken else " "][m[1]] = None
                if m[2]:
                    simple.append((chunk, m[2]))
                    marks.add(m[2])
            else:
                odd.append(chunk)
        found = self._plain([w for w in words[" "] if w not in later], " ")
        found.update(("\n" + w, ids) for w, ids in self._plain([w for w in words["\n"] if "\n" + w not in later], "\n").items())
        found.update(zip(odd, self._asked([c if c[:1] == "\n" else " " + c for c in odd]), strict=True))
        known = self._texts(marks)
        for chunk, mark in simple:
            word = chunk[: -len(mark)]
            found[chunk] = (found[word] if word in found else later[word]) + known[mark]
        return found

    def _texts(self, texts: set[str]) -> dict[str, bytes]:
        new = [t for t in texts if t not in self.whole]
        found = dict(zip(new, self._asked(new), strict=True)) if new else {}
        out = {t: self.whole[t] if t in self.whole else found[t] for t in texts}
        if len(self.whole) < CACHED // 4:
            self.whole.update((k, v) for k, v in found.items() if len(k) <= CACHED_CHARS)
        return out

    def _cut(self, text: str) -> list[str]:
        """The first chunk as it is, then the chunks after a space (without it) or a line break (with it)."""
        return text.replace("\n", " \n").split(" ")

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each whole text, without special tokens added, packed."""
        out: list[bytes | None] = [None] * len(texts)
        jobs: list[tuple[int, list[list[str]]]] = []
        for i, text in enumerate(texts):
            if not self.by_chunks or any(s in text for s in self.special):
                out[i] = self._asked([text])[0]
                continue
            chunks = self._cut(text)
            if "" in chunks[1:] or "\n" in chunks:  # white space meets white space: its run but the last is a piece of its own
                parts, left = [], ""
                cut = RUNS.split(text)
                for k in range(0, len(cut), 2):
                    parts.append(self._cut(left + cut[k]))
                    if k + 1 < len(cut):
                        run, last = cut[k + 1], not cut[k + 2]
                        parts.append([run if last else run[:-1]])
                        left = "" if last else run[-1]
                jobs.append((i, parts))
            else:
                jobs.append((i, [chunks]))
        later = self.later
        heads = [[p.pop(0) for p in parts] for _, parts in jobs]
        new = set().union(*(p for _, parts in jobs for p in parts)).difference(later)
        room = len(later) < CACHED
        found = self._fresh(list(new)) if new else {}
        later.update(found)
        first = self._texts(set().union(*heads))
        for (i, parts), head in zip(jobs, heads, strict=True):
            out[i] = b"".join([x for h, p in zip(head, parts, strict=True) for x in (first[h], b"".join(map(later.__getitem__, p)))])
        for k in found:  # what is too long, or has no room, is not kept beyond these texts
            if not room or len(k) > CACHED_CHARS:
                del later[k]
        return out


_ENCODERS: dict[int, ByteEncoder] = {}


def byte_encoder(spec: str) -> ByteEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteEncoder(spec)
    return _ENCODERS[key]


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> CUT: every document's ids, whole sequences first, then what remains."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    names = [c.split(" ")[0] for c in CUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, end = byte_encoder(spec.value), TaskContext.get().partitionId() << 36, np.array([end_id], "<u4").tobytes()
        for b in batches:
            every = [x + end for x in encoder.encode_packed(b.column(1).to_pylist())]
            sizes = np.array([len(x) // 4 for x in every], np.int64)
            counts = -(-sizes // length)
            of = np.repeat(np.arange(len(every)), counts)
            starts = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * length
            ids = [every[i][4 * s : 4 * (s + length)] for i, s in zip(of.tolist(), starts.tolist(), strict=True)]
            rows = pa.array(np.arange(row, row + len(of)))
            row += len(of)
            yield pa.RecordBatch.from_arrays([rows, b.column(0).take(pa.array(of)), pa.array(starts), pa.array(sizes[of]), pa.array(ids, pa.binary())], names=names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(run), CUT)


class Bins:
    """Rooms of bins in a tournament tree: a node holds the largest room below it, so the first bin with room is found from the top."""

    def __init__(self, count: int, room: int) -> None:
        self.width = 1 << max(0, count - 1).bit_length()
        self.room = [room] * (2 * self.width)

    def first(self, size: int) -> int:
        """The first bin with room for size, which is taken."""
        room, i = self.room, 1
        while i < self.width:
            i *= 2
            if room[i] < size:
                i += 1
        left = room[i] = room[i] - size
        found = i - self.width
        while i > 1:
            i >>= 1
            left = max(room[2 * i], room[2 * i + 1])
            if room[i] == left:
                break
            room[i] = left
        return found


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The items of each bin: sizes must not increase."""
    bins, out = Bins(len(sizes), length), []
    for item, size in enumerate(sizes):
        at = bins.first(size)
        if at == len(out):
            out.append([])
        out[at].append(item)
    return out


Piece = tuple[int, int, int]


def filled(bins: list[list[Piece]], length: int) -> list[list[Piece]]:
    """Pieces (item, from, to) moved and cut from the emptiest bins until the others are full; the last in powers of two."""
    held = [sum(t - f for _, f, t in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-held[k], k))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        full, spare = bins[order[lo]], bins[order[hi]]
        need = length - held[order[lo]]
        while need and spare:
            item, start, stop = spare.pop()
            take = min(need, stop - start)
            full.append((item, stop - take, stop))
            if take < stop - start:
                spare.append((item, start, stop - take))
            need -= take
            held[order[lo]] += take
            held[order[hi]] -= take
        if need:
            hi -= 1
        else:
            lo += 1
    out = [bins[k] for k in order if bins[k] and held[k] == length]
    for k in order:
        if bins[k] and held[k] < length:
            left = bins[k][::-1]
            for bit in range(held[k].bit_length() - 1, -1, -1):
                need, part = held[k] & 1 << bit, []
                while need:
                    item, start, stop = left.pop()
                    take = min(need, stop - start)
                    part.append((item, start, start + take))
                    if take < stop - start:
                        left.append((item, start + take, stop))
                    need -= take
                if part:
                    out.append(part)
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """docs (doc_id, text) -> PIECES: ids (unsigned, four bytes each) of documents in their places in sequences.

    Every id of a document and the end id after them lies in exactly one piece. Sequences have at most length ids, and
    all but those whose size is a power of two have exactly as many.
    """
    cut = work_table(cut_documents(docs, path, length, end_id), "ids")
    size = F.octet_length("ids") / 4
    whole = cut.filter(size == length).select("doc_id", "start", "doc_tokens", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    items = cut.filter(size < length)
    groups = max(1, -(-items.count() // group))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        of, rows = key[0].as_py(), table.sort_by("row").to_pydict()
        sizes = [len(x) // 4 for x in rows["ids"]]
        by_size = sorted(range(len(sizes)), key=lambda k: -sizes[k])
        bins = first_fit_decreasing([sizes[k] for k in by_size], length)
        out: dict[str, list] = {c.split(" ")[0]: [] for c in PIECES.split(", ")}
        for number, pieces in enumerate(filled([[(by_size[k], 0, sizes[by_size[k]]) for k in b] for b in bins], length)):
            offset = 0
            for item, start, stop in pieces:
                values = (rows["doc_id"][item], rows["start"][item] + start, rows["doc_tokens"][item], ((of << 24) + number) * 2 + 1, offset, rows["ids"][item][4 * start : 4 * stop])
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                offset += stop - start
        types = {"doc_id": pa.int64(), "start": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("row", F.lit(13)), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("part").applyInArrow(run, PIECES))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the length and the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
