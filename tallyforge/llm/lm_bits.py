"""The bit predictors of operator 8: contexts, counts, log odds, gated mixing and the refining stage, on batches of bytes.

A text is coded byte by byte, each byte as two half bytes of four bits. A context's row holds how often each of the 16
half bytes followed it in the training texts; the four decisions on the way to a half byte are read off those counts.
Contexts are the last one, three and five bytes, the word so far (A-Z as a-z), and the word so far with the word before it; the
byte contexts run across spaces. The row of a low half byte is that of the context and the high half.

Rows are found by hash (the one-byte context has a row of its own for every case) in tables of a fixed number of rows.
Before each text stand PAD end bytes, so that a text's probabilities do not depend on its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tallyforge.llm.shingles import GOLDEN, _BYTES, _LOWER, mixed, seeded

END, PAD = 0xFF, 6
#: Bytes of context of the byte predictors after the first; the two word predictors follow them.
ORDERS = (3, 5)
CONTEXTS = 1 + len(ORDERS) + 2
#: Rows of the one-byte context: for each byte one for the high half, 16 for the low.
FIRST_ROWS = 256 * 17
#: Weight sets: high or low half, place in the word (the last: that and any further).
PLACES = 8
GATES = 2 * PLACES
#: Refining stage: for each byte's bits so far, cells of the mixed log odds from -EDGE to EDGE; weight of the prior.
EDGE, PER_UNIT, PRIOR = 12, 2, 4.0
POINTS = 2 * EDGE * PER_UNIT + 1
#: Bytes handled at once when counting and scoring, and in one online step; first step size, first weight, smoothing of counts.
SPAN, STEP, RATE, FIRST, SMOOTH = 1 << 15, 1 << 13, 0.05, 0.3, 0.05
PIECE = 1 << 21
#: Log odds are kept as 16-bit integers of this scale, so that a half byte's four take one 64-bit read.
SCALE, LARGEST = np.float32(1 / 2048), 12.0

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32, END]] = True
_STEPS = seeded(1024, 5)
_ORDER_SEEDS = seeded(8, 6)
_LOW = seeded(16, 7)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
#: Letters of words, A-Z as a-z.
_LETTER = _BYTES[_LOWER]
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: The tree node of each of a half byte's four bits, and the bit taken there.
NODE = np.array([[1, 2 | (v >> 3), 4 | (v >> 2), 8 | (v >> 1)] for v in range(16)], np.int64)
BIT = np.array([[v >> 3 & 1, v >> 2 & 1, v >> 1 & 1, v & 1] for v in range(16)], np.int64)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one stream (PAD end bytes, text, end byte), which of its bytes are coded, and how many each text has."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    stream = np.full(len(data) + n * (PAD + 1), END, np.uint8)
    coded = np.zeros(len(stream), bool)
    shift = np.repeat(np.arange(n) * (PAD + 1) + PAD, size)
    at = np.arange(len(data)) + shift
    stream[at] = data
    coded[at] = True
    coded[offsets[1:] + np.arange(n) * (PAD + 1) + PAD] = True
    return stream, coded, size + 1


#: By code (the high half of a byte: 0 to 15; the low: 16 and the byte): the bits so far of each of four bits, and 1 or -1 for bit 0 or 1.
_BYTE = np.arange(256)
PREFIX = np.concatenate([NODE, ((_BYTE[:, None] // 16 + 16) << np.arange(4)) | (NODE[_BYTE % 16] - (1 << np.arange(4)))])
SIGN = (1 - 2 * np.concatenate([BIT, BIT[_BYTE % 16]])).astype(np.float32)


@dataclass
class Span:
    """The half bytes of a span's coded bytes, all high ones and then all low ones, each ordered by place in the word; and the words that end in it."""

    cells: np.ndarray  #: CONTEXTS x halves, cell of the half byte in its context's row
    code: np.ndarray  #: which half byte of which byte
    begin: np.ndarray  #: where the half bytes of each weight set begin
    order: np.ndarray  #: place in the span of each byte
    words: np.ndarray  #: hash of each word that ends in the span
    ends: np.ndarray  #: where in the stream the byte after the word is


def spans(stream: np.ndarray, coded: np.ndarray, row_bits: int, size: int = SPAN, counted: np.ndarray | None = None) -> Iterator[Span]:
    """The stream in spans; the word's state is carried from one to the next, so spans may end anywhere.

    counted: the coded bytes whose half bytes are wanted, all by default; words are those of all coded bytes.
    """
    counted = coded if counted is None else counted
    before = np.concatenate([np.full(PAD, END, np.uint8), stream])
    cum, nth_last, prev_hash = np.uint64(0), -1, np.uint64(0)
    drop, keep = np.uint64(60 - row_bits), np.uint64(~15 & 0xFFFFFFFFFFFFFFFF)
    for a in range(0, len(stream), size):
        seg = stream[a : a + size]
        n = len(seg)
        last = before[a : a + PAD + n]
        past = np.zeros(n, np.uint64)
        contexts: list[np.ndarray] = []
        for k in range(max(ORDERS)):
            past |= last[PAD - 1 - k : PAD - 1 - k + n].astype(np.uint64) << np.uint64(8 * k)
            if k + 1 in ORDERS:
                contexts.append((past + np.uint64(k)) * _ORDER_SEEDS[k])
        # words: a word begins after a gap byte
        start = np.flatnonzero(_GAP[last[PAD - 1 : PAD - 1 + n]])
        lengths = np.diff(np.concatenate([[0], start, [n]]))
        origin = np.concatenate([[-nth_last - 1], start])
        nth = np.arange(n) - np.repeat(origin, lengths)
        upto = np.empty(n + 1, np.uint64)
        upto[0] = 0
        np.cumsum(_LETTER[seg] * _STEPS[nth & 1023], out=upto[1:])
        base = np.concatenate([np.zeros(1, np.uint64) - cum, upto[start]])
        so_far = upto[:-1] - np.repeat(base, lengths) + nth.astype(np.uint64) * GOLDEN
        whole = np.concatenate([upto[start], upto[-1:]]) - base
        prev = np.concatenate([[prev_hash], whole[:-1]])
        contexts += [so_far * _PAIR, (so_far ^ np.repeat(prev * GOLDEN, lengths)) * _PAIR]
        cum, nth_last, prev_hash = whole[-1], int(nth[-1]), prev[-1]

        ends = np.flatnonzero(_GAP[seg] & (nth > 0) & coded[a : a + n])
        place = np.minimum(nth, PLACES - 1).astype(np.uint8)
        place[~counted[a : a + n]] = PLACES
        some = np.argsort(place, kind="stable")
        begin = np.searchsorted(place[some], np.arange(PLACES + 1))
        some = some[: begin[-1]]
        out = Span(np.empty((CONTEXTS, 2, len(some)), np.int64), None, np.concatenate([begin, begin[1:] + begin[-1]]), some, mixed(so_far[ends]), ends + a)
        value = seg[some]
        high, low = (value >> 4).astype(np.uint64), (value & 15).astype(np.uint64)
        first = last[PAD - 1 : PAD - 1 + n][some].astype(np.int64) * 272 + high.view(np.int64)
        out.cells[0, 0] = first
        out.cells[0, 1] = first + (15 * high + low + np.uint64(16)).view(np.int64)
        step = _LOW[value >> 4]
        for k, c in enumerate(contexts, 1):
            c = c[some]
            c ^= c >> np.uint64(29)
            c *= _FINAL
            out.cells[k, 0] = ((c >> drop) & keep) | high
            out.cells[k, 1] = (((c ^ step) * GOLDEN >> drop) & keep) | low
        out.cells = out.cells.reshape(CONTEXTS, -1)
        out.code = np.concatenate([value >> 4, value.astype(np.int64) + 16])
        yield out


def row_counts(row_bits: int) -> list[int]:
    return [FIRST_ROWS] + [1 << row_bits] * (CONTEXTS - 1)


class Counter:
    """Counts of the half bytes after every context, gathered in blocks."""

    def __init__(self, row_bits: int, block: int = 1 << 21) -> None:
        self.block = block
        self.tables = [np.zeros(r * 16, np.uint32) for r in row_counts(row_bits)]
        self.most = 0  # occurrences so far: a task's narrow counts are widened before they could overflow
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, cells: np.ndarray) -> None:
        self.held.append(cells.astype(np.int32))
        self.size += cells.shape[1]
        if self.size >= self.block:
            self.flush()

    def flush(self) -> None:
        self.most += self.size
        if self.most >= 1 << 32 and self.tables[0].dtype == np.uint32:
            self.tables = [t.astype(np.uint64) for t in self.tables]
        for k, t in enumerate(self.tables):
            if self.held:
                t += np.bincount(np.concatenate([h[k] for h in self.held]), minlength=len(t)).astype(t.dtype)
        self.held, self.size = [], 0


def node_counts(counts: np.ndarray) -> np.ndarray:
    """Counts of half bytes (rows x 16) -> counts of the 32 tree places (1: all, 2v and 2v+1: its two sides)."""
    tree = np.zeros((len(counts), 32), np.float32)
    tree[:, 16:] = counts
    for v in range(15, 0, -1):
        tree[:, v] = tree[:, 2 * v] + tree[:, 2 * v + 1]
    return tree


def log_odds(counts: np.ndarray, without_own: bool) -> np.ndarray:
    """For every row and half byte the log odds of its four bits, four 16-bit integers in one 64-bit one.

    without_own takes the half byte's one own occurrence out of the counts, for learning from the counted texts. A bit
    never seen has log odds 0.
    """
    rows = counts.reshape(-1, 16)
    out = np.empty((len(rows), 16, 4), np.int16)
    for a in range(0, len(rows), 1 << 14):
        tree = node_counts(rows[a : a + (1 << 14)])
        for v in range(16):
            for b in range(4):
                n0, n1 = tree[:, 2 * NODE[v, b]], tree[:, 2 * NODE[v, b] + 1]
                if without_own:
                    n0, n1 = np.maximum(n0 - (1 - BIT[v, b]), 0), np.maximum(n1 - BIT[v, b], 0)
                x = np.clip(np.log((n1 + np.float32(SMOOTH)) / (n0 + np.float32(SMOOTH))), -LARGEST, LARGEST) / SCALE
                out[a : a + len(tree), v, b] = np.rint(x).astype(np.int16)
    return out.reshape(-1).view(np.int64)


def inputs(tables: list[np.ndarray], s: Span) -> np.ndarray:
    """Log odds as stored of the span's half bytes (CONTEXTS x four bits each)."""
    n = len(s.code)
    x, row = np.empty((CONTEXTS, 4 * n), np.float32), np.empty(n, np.int64)
    for k in range(CONTEXTS):
        x[k] = tables[k].take(s.cells[k], out=row, mode="clip").view(np.int16)
    return x


def mix(weights: np.ndarray, begin: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The mixed log odds of all bits; weights are for log odds as stored."""
    z = np.empty(x.shape[1], np.float32)
    for g in range(GATES):
        a, b = 4 * begin[g], 4 * begin[g + 1]
        if a < b:
            np.dot(weights[g], x[:, a:b], out=z[a:b])
    return z


def cells_of(z: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Cell of the refining table of every bit."""
    at = np.clip(z, -EDGE, EDGE)
    at *= np.float32(PER_UNIT)
    at += _FIRST_CELL.take(code, axis=0).reshape(-1)
    return at.astype(np.int64)


#: Middle of each prefix's cells, and a half to round by; below 2^24, so exact as a 32-bit float but for its last bits.
_FIRST_CELL = (PREFIX * POINTS + EDGE * PER_UNIT + 0.5).astype(np.float32)


@dataclass
class Learner:
    """Weights (GATES x CONTEXTS) refined online, and the refining stage's outcomes (prefix x cell x bit)."""

    weights: np.ndarray
    energy: np.ndarray
    seen: np.ndarray
    outcomes: np.ndarray

    @classmethod
    def new(cls) -> Learner:
        return cls(np.full((GATES, CONTEXTS), FIRST), np.full((GATES, CONTEXTS), 1e-4), np.zeros(GATES), np.zeros(256 * POINTS * 2, np.int64))

    def learn(self, tables: list[np.ndarray], row_bits: int, data: np.ndarray, offsets: np.ndarray) -> None:
        stream, coded, _ = padded(data, offsets)
        for s in spans(stream, coded, row_bits, STEP):
            if not len(s.code):
                continue
            x, begin, code = inputs(tables, s), s.begin, s.code
            z = mix((self.weights * SCALE).astype(np.float32), begin, x)
            bit = np.float32(0.5) - np.float32(0.5) * SIGN.take(code, axis=0).reshape(-1)
            miss = bit - 1 / (1 + np.exp(-z))
            n = np.diff(begin)
            slope = np.zeros_like(self.weights)
            for g in np.flatnonzero(n):
                a, b = 4 * begin[g], 4 * begin[g + 1]
                slope[g] = np.dot(x[:, a:b], miss[a:b])
            slope *= (SCALE / np.maximum(n, 1))[:, None]
            share = (n / (n + 16.0))[:, None]
            self.energy += slope * slope * share
            self.weights += RATE * share * slope / np.sqrt(self.energy)
            self.seen += n
            self.outcomes += np.bincount(cells_of(z, code) * 2 + bit.astype(np.int64), minlength=len(self.outcomes))


def corrections(outcomes: np.ndarray) -> np.ndarray:
    """What the refining stage adds to the log odds in each cell: half the way to those observed; without outcomes nothing."""
    n = outcomes.reshape(256, POINTS, 2).astype(np.float64)
    middle = np.arange(POINTS) / PER_UNIT - EDGE
    own = 1 / (1 + np.exp(-middle))
    observed = np.log((n[..., 1] + PRIOR * own) / (n[..., 0] + PRIOR * (1 - own)))
    return (0.5 * (observed - middle)).astype(np.float32).reshape(-1)


def costs(tables: list[np.ndarray], row_bits: int, weights: np.ndarray, added: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural-log probability of every text with its end byte; the hashes of all words and how many each text has.

    Texts are taken in pieces of about PIECE bytes, which bounds the memory by that or the longest text.
    """
    weights = (weights * SCALE).astype(np.float32)
    parts, a = [(np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while a < len(offsets) - 1:
        b = min(len(offsets) - 1, max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE))))
        parts.append(_costs(tables, row_bits, weights, added, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        a = b
    total, words, n_words = (np.concatenate(x) for x in zip(*parts, strict=True))
    return total, words, n_words


def _costs(tables: list[np.ndarray], row_bits: int, weights: np.ndarray, added: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stream, coded, size = padded(data, offsets)
    out = np.zeros(len(stream))
    words, ends = [], []
    for a, s in zip(range(0, len(stream), SPAN), spans(stream, coded, row_bits, SPAN), strict=True):
        words.append(s.words)
        ends.append(s.ends)
        if not len(s.code):
            continue
        z = mix(weights, s.begin, inputs(tables, s))
        z += added.take(cells_of(z, s.code))
        z *= SIGN.take(s.code, axis=0).reshape(-1)
        # 1/p of the four bits; odds beyond e^20 are held to it, so that the product stays finite
        lost = np.exp(np.minimum(z, 20, out=z), out=z).reshape(-1, 4)
        lost += 1
        half = np.log(lost[:, 0] * lost[:, 1] * (lost[:, 2] * lost[:, 3]))
        n = len(s.order)
        out[a + s.order] = half[:n].astype(np.float64) + half[n:]
    begin = np.cumsum(size + PAD) - size - PAD
    total = -np.add.reduceat(out, begin) if len(size) else np.zeros(0)
    return total, *word_lists(words, ends, size)


def word_lists(words: list[np.ndarray], ends: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many each text has; size is of the texts with their end bytes."""
    every = np.concatenate([np.zeros(0, np.uint64), *words])
    where = np.concatenate([np.zeros(0, np.int64), *ends])
    bounds = np.concatenate([[0], np.cumsum(size + PAD)])
    return every, np.diff(np.searchsorted(where, bounds))
