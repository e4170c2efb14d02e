"""Codecs against the tokenizers library, exact round trips, and array kernels against brute force."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm.bpe import Codec, read_spec
from tallyforge.llm.exact_dedup import BASES, combine, fingerprints, power
from tallyforge.llm.ngram_jaccard import Bands, bucket_links, most_apart
from tallyforge.llm.rans import Coder, scaled
from tallyforge.llm.token_file import WordEncoder

ALPHABET = list(" \n\t  abcTHE'sre'll123.,!?é  \x1c\x85ñ中文🙂́ΣςİÅß　'd-|*") + ["<|endoftext|>", "  ", "the", "aaaa", "----", "'ve"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, 40))) for _ in range(n)] + ["a" * 500 + "ab" * 300, ""]


def test_byte_codec_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), Codec(read_spec(path))
    for t in texts(800, 1):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_pair_check_is_exact_merging():
    ours = Codec(read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    ok = ours.compatible(a, b)
    assert [bool(x) for x in ok] == [ours.exact(ours.token[i] + ours.token[j]) == [i, j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def test_word_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), WordEncoder(read_spec(path))
    some = texts(800, 2)
    assert ours.encode_batch(some) == [theirs.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=3000), st.integers(1, 64))
def test_rans_round_trip(ids, lanes):
    ids = np.array(ids, np.int64)
    coder = Coder(scaled(np.bincount(ids, minlength=401)))
    payload = coder.encode(ids, lanes)
    assert (coder.decode(payload) == ids).all()
    assert (np.concatenate([coder.decode(payload, k) for k in range(Coder.parts(payload))]) == ids).all()


def test_rans_sees_damage():
    coder = Coder(scaled(np.array([5, 3])))
    payload = bytearray(coder.encode(np.array([0, 1] * 50)))
    payload[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(payload))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000), st.integers(0, 5000))
def test_fingerprints_compose(data, cut):
    cut = min(cut, len(data))
    raw = np.frombuffer(data, np.uint8)
    for base in BASES:
        whole, left, right = (int(fingerprints(x, np.array([0, len(x)]), base)[0]) for x in (raw, raw[:cut], raw[cut:]))
        assert whole == combine(left, right, int(power(base, np.array([len(data) - cut]))[0]))


def test_pigeonhole_loses_no_similar_pair():
    """Every similar pair of random sets meets in a signature that one probes and the other indexes."""
    from tallyforge.llm.shingles import seeded

    rng = np.random.default_rng(5)
    universe, bands, lost = seeded(4000, 9), Bands(500), 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        base = rng.choice(universe, n, replace=False)
        keep = base[rng.random(n) > rng.uniform(0, 0.3)]
        other = np.unique(np.concatenate([keep, rng.choice(universe, int(rng.integers(0, 1 + n // 8)))]))
        x, y = sorted((np.unique(base), other), key=len, reverse=True)
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        assert len(x) + len(y) - 2 * shared <= most_apart(len(x), len(y))
        band = bands.of(len(y))
        hot = rng.integers(0, 2, len(x)) * 100
        probe, flags, complete = bands.entries(x, band, band == bands.of(len(x)), True, hot)
        index, iflags, _ = bands.entries(y, band, True, False, np.zeros(len(y), np.int64))
        meet = set(probe[(flags & 2) > 0].tolist()) & set(index[(iflags & 1) > 0].tolist())
        lost += complete and not meet
    assert not lost


def test_empty_bucket_gives_nothing():
    import zstandard

    blob = zstandard.ZstdCompressor().compress(np.array([0, 0, 2], np.uint32).tobytes())
    a, b, many = bucket_links([blob], 75)
    assert not len(a) and not len(b) and not many


def test_fingerprints_hold_little_beside_the_batch():
    data, offsets = np.arange(1 << 22, dtype=np.uint64).astype(np.uint8), np.array([0, 5, 5, 3_000_000, 1 << 22])
    fingerprints(data[:10], np.array([0, 10]), BASES[0])
    tracemalloc.start()
    whole = fingerprints(data, offsets, BASES[0])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
    assert whole.tolist() == [int(fingerprints(data[a:b], np.array([0, b - a]), BASES[0])[0]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
