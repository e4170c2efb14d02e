"""BPE encoding and decoding by speculation and verification (operator 6).

A text is cut into pieces as the tokenizer's pre-tokenizer does. For a piece not met before, greedy longest match
proposes tokens; the byte-pair encoding of a piece is the one token sequence whose neighbours are all compatible, i.e.
whose joint bytes would again be merged to just these two, so one vectorised check of all neighbouring pairs of a batch
accepts or refuses the proposals. Only refused pieces go through exact merging by rank.

Defined cases: null text counts as empty (no tokens); special tokens inside a text become their ids; repeated rows get a
row each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyforge.llm.common import lean, small_batches, text_of

#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Most entries of each cache in a worker; longest text kept in one; longest token that is proposed.
CACHED, CACHED_CHARS, PROPOSED = 300_000, 48, 24
NEVER = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones are themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary given as the tokenizer file's JSON text."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * size
        for letter_form, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in letter_form)
        for content, i in self.special.items():
            self.token[i] = content.encode()
        self.number = [str(i) for i in range(size)]
        self.of_bytes = {self.token[i]: i for i in vocab.values()}
        self.byte_id = [self.of_bytes[bytes([b])] for b in range(256)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merge: dict[int, tuple[int, int]] = {}
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault(x << 32 | y, (rank, made))
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, x, y
        order = sorted(self.merge)
        self.pair_key = np.array(order, np.int64)
        self.pair_rank = np.array([self.merge[k][0] for k in order], np.int64)
        self.find = regex.compile(PIECES).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.longest = min(PROPOSED, max(map(len, self.of_bytes)))
        self.sound = np.zeros(size, bool)  # tokens that their own bytes are merged to
        for i in vocab.values():
            self.sound[i] = self.exact(self.token[i]) == [i]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.first: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        self.refused = self.checked = 0

    def exact(self, piece: bytes) -> list[int]:
        """Merge by rank, leftmost first among equals."""
        ids = [self.byte_id[b] for b in piece]
        merge = self.merge
        if len(ids) <= 40:
            while len(ids) > 1:
                best, at, made = NEVER, -1, -1
                for i in range(len(ids) - 1):
                    m = merge.get(ids[i] << 32 | ids[i + 1])
                    if m is not None and m[0] < best:
                        best, at, made = m[0], i, m[1]
                if at < 0:
                    break
                ids[at : at + 2] = [made]
            return ids
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                m = merge.get(ids[i] << 32 | ids[after[i]])
                if m is not None:
                    heap.append((m[0], i, ids[i], ids[after[i]], m[1])) if not heap else heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def propose(self, piece: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, known, longest = [], 0, len(piece), self.of_bytes, self.longest
        while i < n:
            j = min(n, i + longest)
            t = known.get(piece[i:j])
            while t is None:
                j -= 1
                t = known.get(piece[i:j])
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token pairs: would their joined bytes be merged to the pair again?

        Runs the merges backwards at the seam: of the two tokens there the one made later is undone, and a merge across
        the seam that comes before the undone one (for equal ranks, the left one comes first) would have prevented it.
        """
        ok = self.sound[a] & self.sound[b]
        left, right = a.copy(), b.copy()
        limit, strict = np.full(len(a), NEVER), np.ones(len(a), bool)
        live = np.flatnonzero(ok)
        while len(live):
            x, y = left[live], right[live]
            key = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            across = (rank < limit[live]) | ((rank == limit[live]) & ~strict[live] & (rank < NEVER))
            ok[live[across]] = False
            bx, by = self.born[x], self.born[y]
            go_left = bx > by
            limit[live] = np.where(go_left, bx, by)
            strict[live] = go_left
            left[live] = np.where(go_left, self.right[x], x)
            right[live] = np.where(go_left, y, self.left[y])
            live = live[~across & ((bx >= 0) | (by >= 0))]
        return ok

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The tokens of each piece: proposals, one check of all neighbours, exact merging of what it refuses."""
        raw = [p.encode() for p in pieces]
        proposals = [self.propose(p) for p in raw]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposals)), lengths)
        bad = np.zeros(len(proposals), bool)
        np.logical_or.at(bad, owner[~self.sound[flat]], True)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        bad[owner[inside[~fits[back]]]] = True
        self.checked += len(bad)
        self.refused += int(bad.sum())
        for i in np.flatnonzero(bad):
            proposals[i] = self.exact(raw[i])
        return list(map(tuple, proposals))

    def _learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of pieces that no cache holds; short ones are kept while there is room."""
        new = list(pieces)
        found = dict(zip(new, self.encode_pieces(new), strict=True)) if new else {}
        if len(self.pieces) < CACHED:
            self.pieces.update((k, v) for k, v in found.items() if len(k) <= CACHED_CHARS)
        return found

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Texts are cut at single spaces first: no piece spans the left side of one."""
        jobs: list[list[tuple[str, list[str] | int]]] = []
        for text in texts:
            parts: list[tuple[str, list[str] | int]] = []
            cut = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
            for part in cut:
                if part in self.special:
                    parts.append(("id", self.special[part]))
                elif part and "  " in part:
                    parts.append(("pieces", self.find(part)))
                elif part:
                    parts.append(("chunks", part.split(" ")))
            jobs.append(parts)
        first, later, pieces = self.first, self.later, self.pieces
        new_first = {p[1][0] for parts in jobs for p in parts if p[0] == "chunks"}
        new_first.difference_update(first)
        new_later: set[str] = set()
        for parts in jobs:
            for kind, value in parts:
                if kind == "chunks":
                    new_later.update(value[1:])
        new_later.difference_update(later)
        cut_first = {c: self.find(c) for c in new_first}
        cut_later = {c: self.find(" " + c) for c in new_later}
        wanted = set(chain.from_iterable(chain(cut_first.values(), cut_later.values())))
        for parts in jobs:
            for kind, value in parts:
                if kind == "pieces":
                    wanted.update(value)
        found = self._learn(wanted.difference(pieces))

        def look(piece: str) -> tuple[int, ...]:
            return found[piece] if piece in found else pieces[piece]

        more_first = {c: tuple(chain.from_iterable(map(look, p))) for c, p in cut_first.items()}
        more_later = {c: tuple(chain.from_iterable(map(look, p))) for c, p in cut_later.items()}
        for cache, more in ((first, more_first), (later, more_later)):
            if len(cache) < CACHED:
                cache.update((k, v) for k, v in more.items() if len(k) <= CACHED_CHARS)
        out = []
        for parts in jobs:
            ids: list[int] = []
            for kind, value in parts:
                if kind == "id":
                    ids.append(value)
                elif kind == "pieces":
                    ids.extend(chain.from_iterable(map(look, value)))
                else:
                    head = value[0]
                    ids.extend(more_first[head] if head in more_first else first[head])
                    if len(value) > 1:
                        tail = value[1:]
                        try:
                            ids.extend(chain.from_iterable([later[c] if c in later else more_later[c] for c in tail]))
                        except KeyError as gone:
                            raise RuntimeError("a chunk was not encoded") from gone
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; special tokens stay."""
        token = self.token
        return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The codec of a tokenizer file's text, built once in each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def read_spec(path: str) -> str:
    """The tokenizer file's text; read on the driver and sent along, so executors need no file of their own."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids array<int>."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for b in batches:
            ids = own.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text."""
    spark = encoded.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for b in batches:
            texts = [own.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode without keeping the ids."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        number = own.number
        for b in batches:
            every = own.encode_batch(b.column(1).to_pylist())
            listed = [hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest() for ids in every]
            texts = [hashlib.sha256(own.decode(ids).encode()).hexdigest() for ids in every]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, every)), pa.int64()), pa.array(listed), pa.array(texts)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(run), schema)
