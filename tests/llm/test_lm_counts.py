"""The mixing model: counts without limit, a plain scorer byte by byte, and no influence of held-out texts."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import lm_bits as L
from tallyforge.llm.lm_mixing import score
from tallyforge.llm.shingles import text_buffer

M64 = (1 << 64) - 1
SPACES = {9, 10, 11, 12, 13, 32, L.END}


@pytest.mark.parametrize("scale", [1, 100_000, 30_000_000_000])
def test_log_odds_do_not_depend_on_the_amount_of_text(scale):
    counts = np.zeros((1, 16), np.int64)
    counts[0, 3], counts[0, 5] = 90 * scale, 10 * scale
    odds = L.log_odds(counts, False).view(np.int16).reshape(16, 4) * float(L.SCALE)
    # 3 is 0011 and 5 is 0101: they part at the second bit
    assert odds[3, 1] == odds[5, 1] == pytest.approx(math.log(1 / 9), abs=0.01)


def test_task_counts_widen_before_they_overflow():
    counter = L.Counter(12)
    counter.most = (1 << 32) - 5
    counter.tables = [np.full_like(t, (1 << 32) - 6) for t in counter.tables]
    counter.add(np.zeros((L.CONTEXTS, 100), np.int64))
    counter.flush()
    assert all(int(t[0]) == (1 << 32) - 6 + 100 for t in counter.tables)


def finish(h, drop):
    h ^= h >> 29
    h = h * int(L._FINAL) & M64
    return h


def rows_of(history: bytes, row_bits: int):
    """Plain hashes of all contexts after a history that starts with PAD end bytes."""
    past = history[::-1]
    out = []
    for order in L.ORDERS:
        value = sum(past[i] << 8 * i for i in range(order))
        out.append(finish((value + order - 1) * int(L._ORDER_SEEDS[order - 1]) & M64, row_bits))
    cut = max(i for i, c in enumerate(history) if c in SPACES) + 1
    word = history[cut:]

    def total(w):
        return sum(int(L._LETTER[c]) * int(L._STEPS[i & 1023]) for i, c in enumerate(w)) & M64

    before = history[:cut]
    at = max([i for i, c in enumerate(before[:-1]) if c in SPACES], default=-1) + 1
    so_far = (total(word) + len(word) * int(L.GOLDEN)) & M64
    out.append(finish(so_far * int(L._PAIR) & M64, row_bits))
    out.append(finish((so_far ^ (total(before[at:]) * int(L.GOLDEN) & M64)) * int(L._PAIR) & M64, row_bits))
    return history[-1], out, min(len(word), L.PLACES - 1)


def cells_by_hand(text: bytes, row_bits: int):
    """For every half byte its cells, value, place and prefix code."""
    history = bytes([L.END] * L.PAD)
    for byte in text + bytes([L.END]):
        first, hashed, place = rows_of(history, row_bits)
        high, low = byte >> 4, byte & 15
        yield [first * 272 + high, *[(h >> 64 - row_bits) * 16 + high for h in hashed]], high, place, None
        lows = [((h ^ int(L._LOW[high])) * int(L.GOLDEN) & M64) >> 64 - row_bits for h in hashed]
        yield [(first * 17 + 1 + high) * 16 + low, *[x * 16 + low for x in lows]], low, place + L.PLACES, high
        history += bytes([byte])


TEXTS = ["the cat sat on the mat", "The dog, the cat\nand  the mat sat", "", "a", "ünïcode text ünïcode", "x" * 40, " lead and trail ", "the cat sat on the dog"]


@pytest.mark.parametrize("span", [7, 64, 1 << 15])
def test_costs_equal_a_plain_scorer(monkeypatch, span):
    monkeypatch.setattr(L, "SPAN", span)
    row_bits, data = 12, text_buffer(pa.array(TEXTS))
    counter = L.Counter(row_bits)
    stream, coded, _ = L.padded(*data)
    for s in L.spans(stream, coded, row_bits, span):
        counter.add(s.cells)
    counter.flush()
    plain = [np.zeros(16 * r, np.int64) for r in L.row_counts(row_bits)]
    for t in TEXTS:
        for cells, *_ in cells_by_hand(t.encode(), row_bits):
            for k, c in enumerate(cells):
                plain[k][c] += 1
    assert all((a == b).all() for a, b in zip(plain, counter.tables, strict=True))
    learner = L.Learner.new()
    learner.learn([L.log_odds(t, True) for t in plain], row_bits, *data)
    added = L.corrections(learner.outcomes)
    got, words, n_words = L.costs([L.log_odds(t, False) for t in plain], row_bits, learner.weights, added, *data)
    assert n_words.tolist() == [len(t.split()) for t in TEXTS] and len(words) == n_words.sum()
    for t, mine in zip(TEXTS, got, strict=True):
        lost = 0.0
        for cells, value, place, high in cells_by_hand(t.encode(), row_bits):
            odds = np.zeros((L.CONTEXTS, 4))
            for k, c in enumerate(cells):
                n = plain[k][c - value : c - value + 16]
                for b in range(4):
                    block = 16 >> b
                    start = value >> 4 - b << 4 - b
                    n0, n1 = int(n[start : start + block // 2].sum()), int(n[start + block // 2 : start + block].sum())
                    x = round(min(L.LARGEST, max(-L.LARGEST, math.log((n1 + L.SMOOTH) / (n0 + L.SMOOTH)))) / float(L.SCALE))
                    odds[k, b] = x * float(L.SCALE)
            for b in range(4):
                z = float(learner.weights[place] @ odds[:, b])
                prefix = (1 << b | value >> 4 - b) if high is None else (16 + high) << b | value >> 4 - b
                z += added[prefix * L.POINTS + int((min(L.EDGE, max(-L.EDGE, z)) + L.EDGE) * L.PER_UNIT + 0.5)]
                lost += math.log1p(math.exp(-z if value >> 3 - b & 1 else z))
        assert mine == pytest.approx(-lost, rel=2e-5)


def test_held_out_texts_change_no_other_score(spark):
    def rows(word):
        return [(i, f"some {word} text {i}" if zlib.crc32(str(i).encode()) % 5 == 1 else f"other words here {i % 7}") for i in range(60)]

    def scores(word):
        d = spark.createDataFrame(rows(word), "doc_id long, text string").coalesce(2)
        return {r["doc_id"]: (r["base_score"], r["score"]) for r in score(d).collect() if not r["held_out"]}

    a, b = scores("plain"), scores("zebra zebra zebra zebra zebra")
    assert a.keys() == b.keys()
    for i in a:
        assert a[i] == pytest.approx(b[i], rel=1e-9)


def test_order_of_words_matters(spark):
    texts = ["one two three four five six seven"] * 60
    d = spark.createDataFrame([*enumerate(texts), (1000, "seven two five one six four three"), (1001, texts[0])], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in score(d).collect()}
    assert got[1001] > got[1000] + 1
