"""Packing against the library's ids, plain first fit, and what every packing must keep."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing as P
from tallyforge.llm.bpe import read_spec
from tallyforge.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
ENCODER = P.ByteEncoder(read_spec(PATH))
SPACES = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　"]


def ids(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*SPACES, " ", " ", "\n", "word", "Wörter", "é%%%", "don't", "'s", "12", "x1", "½", "...", "<|endoftext|>", "ab.cd", "é", "日本", "🙂"]), max_size=12), min_size=1, max_size=6))
def test_ids_are_those_of_the_library(parts):
    texts = ["".join(p) for p in parts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode_packed(texts)] == [ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode_packed(texts)] == [ids(t) for t in texts]


def test_other_tokenizers_are_asked_for_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, theirs = P.ByteEncoder(read_spec(path)), Tokenizer.from_file(path)
    texts = ["Some  words\nhere", "", "Ünd %% so"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_packed(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(32, 40))
def test_tree_finds_the_first_fit(sizes, length):
    sizes = sorted(sizes, reverse=True)
    bins = []
    for item, size in enumerate(sizes):
        for b in bins:
            if sum(sizes[k] for k in b) + size <= length:
                b.append(item)
                break
        else:
            bins.append([item])
    assert P.first_fit_decreasing(sizes, length) == bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 47), min_size=1, max_size=80), st.integers(48, 64))
def test_filling_keeps_every_id_once(sizes, length):
    sizes = sorted(sizes, reverse=True)
    out = P.filled([[(k, 0, sizes[k]) for k in b] for b in P.first_fit_decreasing(sizes, length)], length)
    totals = [sum(t - f for _, f, t in b) for b in out]
    assert all(t == length or t & (t - 1) == 0 for t in totals) and sum(t == length for t in totals) == sum(sizes) // length
    assert sorted((k, x) for b in out for k, f, t in b for x in range(f, t)) == [(k, x) for k, n in enumerate(sizes) for x in range(n)]


def check(rows, texts, length=1024, end=0):
    """rows of pieces with ids against texts, a list of (doc_id, text)."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        n = len(r["ids"]) // 4
        sequences[r["sequence_id"]].append((r["offset"], n))
        by_doc[r["doc_id"]].append((r["start"], n, bytes(r["ids"]), r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*ids(t or ""), end])
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        if len(want[i]) == 1:
            whole = b"".join(x for _, _, x, _ in sorted(parts))
            assert np.frombuffer(whole, "<u4").tolist() == want[i][0] and {n for *_, n in parts} == {len(want[i][0])}
        else:  # rows with the same id: the same ids in all
            assert sum(n for _, n, *_ in parts) == sum(map(len, want[i]))
            assert sorted(x for _, _, p, _ in parts for x in np.frombuffer(p, "<u4").tolist()) == sorted(x for w in want[i] for x in w)


def test_pieces_hold_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(P.pack(docs, PATH, group=40).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_documents(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "no id"), (4, "word and more " * 3000), (5, "x" * 30_000), (6, "  two \n\n"), (7, "é" * 1023)] + [(8, "same row")] * 60
    docs = spark.createDataFrame([(i, t, 1, "p", 2, b"x", 3) for i, t in rows], "doc_id long, text string, row long, part string, start long, ids binary, `a.b` int").repartition(3)
    check(P.pack(docs, PATH, group=8).collect(), rows)
    check(P.pack(docs, PATH, 64, 7, 8).collect(), rows, 64, 7)
    assert P.pack(docs.limit(0), PATH).count() == 0


def test_query_gives_digests_of_the_pieces(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    all_ids = {i: np.array([*ids(t or ""), 0], "<u4") for i, t in texts.items()}
    rows = QUERIES["op13_packing"](spark, sf).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, all_ids.values()))
    for r in rows:
        own = all_ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("name", ["op13_packing"])
def test_reruns_agree(spark, name):
    sf = "/root/testdata/sf0.001"
    assert sorted(QUERIES[name](spark, sf).collect()) == sorted(QUERIES[name](spark, sf).collect())
