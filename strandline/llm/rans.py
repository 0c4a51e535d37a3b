"""A static range asymmetric numeral system over token ids, in numpy.

A block interleaves lanes: id i belongs to lane i mod lanes. Lanes are 64-bit states that give and
take 32-bit words; one shared table of frequencies that sum to 2^SCALE serves all blocks. A block's
payload holds, besides its words, checkpoints: all lane states and the word position at every
SPAN-th step, so that any stretch of a block can be decoded by itself.
"""

from __future__ import annotations

import struct

import numpy as np

SCALE = 20
SPAN = 64
LANES = 1024
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_HEAD = struct.Struct("<4sIIII")  # magic, ids, lanes, span, words


class Table:
    """Frequencies of 2^SCALE in all for every id below len(counts), each at least 1."""

    def __init__(self, counts: np.ndarray, scale: int = SCALE):
        counts = np.asarray(counts, np.float64)
        if len(counts) > 1 << (scale - 1):
            raise ValueError("the table has too many ids for its scale")
        self.scale, whole, n = scale, 1 << scale, len(counts)
        share = counts / counts.sum() if counts.sum() else np.full(n, 1 / n)
        freq = 1 + np.floor(share * (whole - n)).astype(np.int64)
        freq[int(freq.argmax())] += whole - int(freq.sum())  # what rounding left over
        self.freq = freq.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(n, dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, span: int = SPAN) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    f, c = table.freq[ids], table.below[ids]
    top = np.uint64(63 - table.scale)  # a state at or above f << top gives a word first
    state = np.full(lanes, _LOW)
    chunks: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    marks: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x, ft = state[: b - a], f[a:b]
        full = x >= (ft << top)
        if full.any():
            chunks[t] = x[full].astype(np.uint32)
            x = np.where(full, x >> _WORD, x)
        q = x // ft
        state[: b - a] = (q << np.uint64(table.scale)) + (x - q * ft) + c[a:b]
        if t % span == 0:
            marks.append((t, state.copy()))
    used = np.cumsum([0, *map(len, chunks)])
    words = np.concatenate([np.empty(0, np.uint32), *chunks])
    head = _HEAD.pack(b"rANS", n, lanes, span, len(words))
    marks.reverse()
    places = np.array([used[t] for t, _ in marks], np.uint32)
    return head + places.tobytes() + b"".join(s.tobytes() for _, s in marks) + words.tobytes()


def decode(payload: bytes, table: Table, start: int = 0, end: int | None = None) -> np.ndarray:
    """ids[start:end] of the block, from the checkpoint before start."""
    magic, n, lanes, span, count = _HEAD.unpack_from(payload)
    if magic != b"rANS":
        raise ValueError("not a block of token ids")
    end = n if end is None else min(end, n)
    if start >= end:
        return np.empty(0, np.uint32)
    steps = -(-n // lanes)
    marks = -(-steps // span)
    at = _HEAD.size
    places = np.frombuffer(payload, np.uint32, marks, at)
    at += 4 * marks
    first = start // lanes // span
    state = np.frombuffer(payload, np.uint64, lanes, at + 8 * lanes * first).copy()
    at += 8 * lanes * marks
    words = np.frombuffer(payload, np.uint32, count, at).astype(np.uint64)
    w, mask, scale = int(places[first]), np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    low, last = first * span, -(-end // lanes)
    out = np.empty(min(n, last * lanes) - low * lanes, np.uint32)
    for t in range(low, last):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        x = state[: b - a]
        slot = x & mask
        s = table.symbol[slot]
        x = table.freq[s] * (x >> scale) + slot - table.below[s]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << _WORD) | words[w : w + len(need)]
            w += len(need)
        state[: b - a] = x
        out[a - low * lanes : b - low * lanes] = s
    return out[start - low * lanes : end - low * lanes]
