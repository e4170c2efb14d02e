"""Static range asymmetric numeral system over numpy lanes: shared frequency table, independent interleaved blocks.

A block's ids are dealt to lanes round robin. Every lane is a 63-bit rANS state that gives and takes 32-bit words, all
lanes stepping together; the words of a step stand in lane order. Blocks need nothing of each other, each carries a crc32
of its payload, and checkpoints (states and word position at given steps) let parts of a block be decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
#: Steps between checkpoints.
CHECKPOINT = 128
#: Fixed values of the payload: mark and header (mark, ids, lanes, steps between checkpoints, words, checkpoints).
MARK = b"TFR1"
HEADER = struct.Struct("<4sIIIII")
_32, _MASK = np.uint64(32), np.uint64((1 << SCALE) - 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 where the count is not 0; the largest takes what rounding leaves."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more different ids than the scale has room for")
    out = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (size / total)).astype(np.int64)), 0)
    left = size - int(out.sum())
    if left > 0:
        out[np.argmax(counts)] += left
    while left < 0:  # take from the largest, and so bend the distribution least
        order = np.argsort(-out, kind="stable")[: max(1, min(-left, len(out) // 8 or 1))]
        order = order[out[order] > 1]
        out[order] -= 1
        left += len(order)
    return out


@dataclass
class Coder:
    """Encoder and decoder for one frequency table."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.f = self.freq.astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(self.freq)])
        self.start = start[:-1].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        """The payload of one block."""
        n = len(ids)
        lanes = max(1, min(lanes, n // 32))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []  # in coding order: words so far, states
        freq, start, at_most, given = self.f[ids], self.start[ids], np.uint64(63 - SCALE), 0
        for step in range(steps - 1, -1, -1):
            lo, hi = step * lanes, min(n, (step + 1) * lanes)
            f, s, x = freq[lo:hi], start[lo:hi], state[: hi - lo]
            out = x >= f << at_most
            if out.any():
                words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                given += len(words[-1])
                x = np.where(out, x >> _32, x)
            q = x // f
            state[: hi - lo] = (q << np.uint64(SCALE)) + (x - q * f) + s
            if step and step % CHECKPOINT == 0:
                marks.append((given, state.copy()))
        flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        # A decoder reads the steps forwards: of the words in coding order, the last step's come first.
        places = [(len(flat) - given, states) for given, states in marks]
        body = [state.tobytes(), flat.tobytes()] + [struct.pack("<I", at) + s.tobytes() for at, s in reversed(places)]
        payload = HEADER.pack(MARK, n, lanes, CHECKPOINT, len(flat), len(places)) + b"".join(body)
        return payload + struct.pack("<I", zlib.crc32(payload))

    def decode(self, payload: bytes, part: int | None = None) -> np.ndarray:
        """The ids of a block, or of its part-th stretch between checkpoints."""
        (crc,) = struct.unpack("<I", payload[-4:])
        if zlib.crc32(payload[:-4]) != crc:
            raise ValueError("the block's checksum does not match")
        mark, n, lanes, every, n_words, n_marks = HEADER.unpack_from(payload)
        if mark != MARK:
            raise ValueError("not a block of this format")
        at = HEADER.size
        state = np.frombuffer(payload, np.uint64, lanes, at).copy()
        words = np.frombuffer(payload, np.uint32, n_words, at + 8 * lanes).astype(np.uint64)
        first, last, place = 0, -(-n // lanes), 0
        if part is not None:
            if part:
                base = at + 8 * lanes + 4 * n_words + (part - 1) * (4 + 8 * lanes)
                (place,) = struct.unpack_from("<I", payload, base)
                state = np.frombuffer(payload, np.uint64, lanes, base + 4).copy()
                first = part * every
            last = min(last, first + every) if part < n_marks else last
        out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        for step in range(first, last):
            lo, hi = step * lanes, min(n, (step + 1) * lanes)
            x = state[: hi - lo]
            low = x & _MASK
            ids = self.slot[low]
            x = self.f[ids] * (x >> np.uint64(SCALE)) + low - self.start[ids]
            short = np.flatnonzero(x < LOW)
            if len(short):
                x[short] = x[short] << _32 | words[place : place + len(short)]
                place += len(short)
            state[: hi - lo] = x
            out[lo - first * lanes : hi - first * lanes] = ids
        return out

    @staticmethod
    def parts(payload: bytes) -> int:
        """How many stretches decode() can be asked for."""
        return HEADER.unpack_from(payload)[5] + 1
