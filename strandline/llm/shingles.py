"""Hashed word shingles and SuperMinHash signatures of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n, modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]))
    return _powers[:n], _inverse[:n]


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    data: the UTF-8 bytes of all texts one after the other; starts: where each begins, and the end
    of all. Words stand between ASCII white space, A-Z count as a-z. A text of fewer words than
    width is one shingle, one without words has none. A word's hash is a polynomial over its bytes.
    """
    n = len(data)
    texts = len(starts) - 1
    white = np.empty(n + 1, bool)
    white[:n] = _WHITE[data]
    white[n] = True
    head = ~white[:n].copy()
    head[1:] &= white[: n - 1]
    inner = starts[:-1][(starts[:-1] < n) & (np.diff(starts) > 0)]
    head[inner] = ~white[inner]  # a text's first byte begins a word, whatever stands before it
    tail = ~white[:n]
    tail[:-1] &= white[1:n] | False
    ends = inner - 1
    last = np.append(ends[ends >= 0], n - 1) if n else ends
    tail[last] = ~white[last]
    at, to = np.flatnonzero(head), np.flatnonzero(tail) + 1
    with np.errstate(over="ignore"):
        powers, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[data]] * powers[:n], out=sums[1:])
        words = mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64) * _STEP)
        first = np.searchsorted(at, starts)  # of each text's words
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + words[k : len(words) - width + 1 + k] if len(rolled) else rolled
        rolled = mix(rolled + np.uint64(width))
    out = []
    for i in range(texts):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            one = np.sort(rolled[a : b - width + 1])
            if len(one) > 1:
                one = one[np.append(True, one[1:] != one[:-1])]
        elif b > a:
            acc = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    acc = acc * _BASE + w
                one = mix(np.array([acc + np.uint64(b - a)]))
        else:
            one = np.empty(0, np.uint64)
        out.append(one)
    return out


def superminhash(sets: list[np.ndarray], m: int, block: int = 60_000) -> np.ndarray:
    """SuperMinHash signatures: row i holds the m values of set i (infinite for an empty set).

    Every element walks a random permutation of the m slots, and in step j brings j plus a random
    fraction to its slot j. All elements of all sets take a step together; a set leaves when its
    slots all hold values below the steps to come, mostly after one or a few steps.
    """
    sig = np.full((len(sets), m), np.inf)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.flatnonzero(sizes)
    cuts = np.searchsorted(np.cumsum(sizes[order]), np.arange(block, sizes.sum() + block, block), side="left") + 1
    for a, b in zip(np.append(0, cuts[:-1]), cuts):
        own = order[a:b]
        if len(own):
            sig[own] = _signatures([sets[i] for i in own], m)
    return sig


def _signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    sig = np.full(len(sets) * m, np.inf)
    walk = None  # the permutation so far, from the second step on
    for j in range(m):
        with np.errstate(over="ignore"):
            bits = mix(items + np.uint64(j + 1) * _STEP)
        slot = j + ((bits >> np.uint64(40)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        value = j + (bits & np.uint64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)
        if j == 0:
            target = slot
        else:
            rows = np.arange(len(items))
            target = walk[rows, slot].astype(np.int64)
            walk[rows, slot] = walk[:, j]
            walk[:, j] = target
        np.minimum.at(sig, owner * m + target, value)
        live = sig.reshape(-1, m).max(1) > j + 1
        if not live.any():
            break
        stay = live[owner]
        if j == 0:
            items, owner, slot = items[stay], owner[stay], slot[stay]
            walk = np.tile(np.arange(m, dtype=np.uint16), (len(items), 1))
            walk[np.arange(len(items)), slot] = 0
            walk[:, 0] = slot
        elif not stay.all():
            items, owner, walk = items[stay], owner[stay], walk[stay]
    return sig.reshape(-1, m)
