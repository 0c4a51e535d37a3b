"""Byte-level BPE: pre-tokens, exact merges of many words at once, and the lexicon automaton."""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space as the tokenizers library sees it (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokens of the byte-level pre-tokenizer; fixed by the vocabulary's format.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NONE = np.int32(2**31 - 1)


class IntMap:
    """A read-only map from non-negative int64 keys to int32 pairs, looked up by the array."""

    def __init__(self, slots: np.ndarray, values: np.ndarray):
        self.slots, self.values, self.mask = slots, values, len(slots) - 1

    @staticmethod
    def _home(keys: np.ndarray, mask: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> IntMap:
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        slots, out = np.full(size, -1, np.int64), np.zeros((size, 2), np.int32)
        at, left = cls._home(keys, size - 1), np.arange(len(keys))
        while len(left):
            free = slots[at[left]] == -1
            slots[at[left[free]]] = keys[left[free]]  # of rivals for a slot, the last one gets it
            won = slots[at[left]] == keys[left]
            out[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)
        return cls(slots, out)

    def get(self, keys: np.ndarray, missing: tuple[int, int]) -> np.ndarray:
        """Pairs for the keys, of any shape; a negative key is missing."""
        flat = keys.ravel()
        out = np.empty((len(flat), 2), np.int32)
        out[:] = missing
        left = np.flatnonzero(flat >= 0)
        at = self._home(flat[left], self.mask)
        while len(left):
            got = self.slots[at]
            hit = got == flat[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (got != -1)
            left, at = left[go], (at[go] + 1) & self.mask
        return out.reshape(*keys.shape, 2)


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for word, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        for word, i in self.specials.items():
            self.token_bytes[i] = word.encode()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self.pairs = IntMap.build(keys, np.array(list(self.ranks.values()), np.int32))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        return self.pairs.get(np.where((left < 0) | (right < 0), -1, keys), (NONE, -1))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pre-tokens, one after the other: by the merges in their order of rank, the leftmost first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]  # places, sizes, ids
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 64):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(own), 65536):
                self._merge_block(words, own[k : k + 65536], high, done)
            low = high
        for i in np.flatnonzero(lengths > low):
            ids = self._merge_long(words[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        places, own_sizes, flat = (np.concatenate(x) for x in zip(*done))
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[places], starts[places] = own_sizes, np.cumsum(own_sizes) - own_sizes
        return gathered(np.arange(len(words)), starts, sizes, flat)

    def _merge_block(self, words: list[bytes], rows: np.ndarray, width: int, done: list) -> None:
        if not len(rows):
            return
        own = [words[i] for i in rows]
        size = np.fromiter(map(len, own), np.int64, len(own))
        column = np.arange(width)
        inside = column < size[:, None]
        ids = np.full((len(own), width), -1, np.int32)
        ids[inside] = self.first[np.frombuffer(b"".join(own), np.uint8)]
        found = self._rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(own), 0, 2), np.int32)
        rank, new = found[..., 0].copy(), found[..., 1].copy()
        while True:
            at = rank.argmin(1)
            each = np.arange(len(rows))
            live = rank[each, at] != NONE
            if not live.all():
                ended = ids[~live]
                done.append((rows[~live], size[~live], ended[ended >= 0]))
                rows, ids, rank, new, size, at = rows[live], ids[live], rank[live], new[live], size[live], at[live]
                if not len(rows):
                    return
                each = np.arange(len(rows))
            ids[each, at] = new[each, at]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            size -= 1
            pair = np.minimum(column[:-1] + (column[:-1] > at[:, None]), width - 2)
            rank, new = np.take_along_axis(rank, pair, 1), np.take_along_axis(new, pair, 1)
            rank[:, -1], new[:, -1] = NONE, -1
            for p, ok in ((at - 1, at > 0), (at, at < width - 1)):
                e, q = each[ok], p[ok]
                got = self._rank(ids[e, q], ids[e, q + 1])
                rank[e, q], new[e, q] = got[:, 0], got[:, 1]

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.ranks[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary; fixed by the format."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


class Lexicon:
    """A minimal acyclic transducer from words to id sequences.

    States with equal continuations are one state, so common endings are stored once. Each arc
    knows how many words of its state sort before those behind it; their sum along a word's path
    is the word's number, and the number finds its ids. All of it is a few flat arrays in one
    file, which a reader maps into memory.
    """

    FIELDS = ("slots", "values", "final", "starts", "ids")

    @staticmethod
    def write(words: dict[bytes, np.ndarray], path: str) -> None:
        with open(path, "wb") as file:
            file.write(Lexicon.packed(words))

    @staticmethod
    def packed(words: dict[bytes, np.ndarray]) -> bytes:
        names = sorted(w for w in words if w)
        root, states = _minimal(names)
        count = [0] * len(states)
        for s in _after_children(root, states):
            arcs, final = states[s]
            count[s] = final + sum(count[t] for t in arcs.values())
        keys, values = [], []
        for s, (arcs, final) in enumerate(states):
            before = int(final)
            for byte, t in sorted(arcs.items()):
                keys.append(s << 8 | byte)
                values.append((t, before))
                before += count[t]
        table = IntMap.build(np.array(keys, np.int64), np.array(values, np.int32).reshape(-1, 2))
        flat = [np.asarray(words[w], np.int32) for w in names]
        data = {
            "slots": table.slots, "values": table.values, "final": np.array([f for _, f in states], np.uint8),
            "starts": np.cumsum([0, *map(len, flat)]).astype(np.int64), "ids": np.concatenate([np.empty(0, np.int32), *flat]),
        }
        head = {"root": root, "longest": max(map(len, names), default=0), "fields": {}}
        at = 4096
        for k in Lexicon.FIELDS:
            head["fields"][k] = [str(data[k].dtype), list(data[k].shape), at]
            at += -(-data[k].nbytes // 64) * 64
        out = bytearray(at)
        first = json.dumps(head).encode()
        out[: len(first)] = first
        out[len(first) : 4096] = b" " * (4096 - len(first))
        for k in Lexicon.FIELDS:
            place = head["fields"][k][2]
            out[place : place + data[k].nbytes] = data[k].tobytes()
        return bytes(out)

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        head = json.loads(self.map[:4096])
        self.root, self.longest = head["root"], head["longest"]
        part = {k: np.frombuffer(self.map, np.dtype(d), int(np.prod(shape)), at).reshape(shape) for k, (d, shape, at) in head["fields"].items()}
        self.arcs, self.final, self.starts, self.ids = IntMap(part["slots"], part["values"]), part["final"], part["starts"], part["ids"]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon has no such word."""
        ends = np.cumsum([0, *map(len, words)])
        return self.numbers_at(np.frombuffer(b"".join(words), np.uint8), ends[:-1], np.diff(ends))

    def numbers_at(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, lead: bytes = b"") -> np.ndarray:
        """The numbers of the words lead + data[at : at + size]. All words take a byte together; one
        leaves at its end, or where the automaton has no arc for it."""
        out = np.full(len(at), -1, np.int64)
        first, count = self.root, 0
        for byte in lead:
            first, more = self.arcs.get(np.array([first << 8 | byte if first >= 0 else -1]), (-1, 0))[0].tolist()
            count += more
        live = np.flatnonzero((size <= self.longest) & (size + len(lead) > 0)) if first >= 0 else np.empty(0, np.int64)
        state, number, j = np.full(len(live), first, np.int64), np.full(len(live), count, np.int64), 0
        while len(live):
            done = size[live] == j
            if done.any():
                ok = done & (self.final[state] == 1)
                out[live[ok]] = number[ok]
                live, state, number = live[~done], state[~done], number[~done]
            got = self.arcs.get(state << 8 | data[at[live] + j], (-1, 0))
            on = got[:, 0] >= 0
            live, state, number = live[on], got[on, 0].astype(np.int64), number[on] + got[on, 1]
            j += 1
        return out

    def of(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


def _minimal(names: list[bytes]) -> tuple[int, list[tuple[dict[int, int], bool]]]:
    """The minimal automaton of sorted words: a state is frozen once no later word can change it,
    and an equal frozen state takes its place."""
    states: list[tuple[dict[int, int], bool]] = []
    known: dict[tuple, int] = {}

    def frozen(arcs: dict[int, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in known:
            known[key] = len(states)
            states.append((arcs, final))
        return known[key]

    path: list[tuple[dict[int, int], bool]] = [({}, False)]
    last = b""
    for word in [*names, b""]:
        same = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        while len(path) > same + 1:
            arcs, final = path.pop()
            path[-1][0][last[len(path) - 1]] = frozen(arcs, final)
        for _ in word[same:]:
            path.append(({}, False))
        if word:
            path[-1] = (path[-1][0], True)
        last = word
    return frozen(*path[0]), states


def _after_children(root: int, states: list) -> range:
    return range(len(states))  # a state is frozen after the states that it leads to


@functools.lru_cache(2)
def vocabulary_at(path: str) -> Vocabulary:
    """The vocabulary, read once a process."""
    return Vocabulary(path)


def gathered(slots: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[starts : starts + sizes] of the slots, one after the other, and their sizes."""
    own = sizes[slots].astype(np.int32)
    out, at = np.empty(int(own.sum(dtype=np.int64)), flat.dtype), 0
    for k in range(0, len(slots), block):  # what is needed besides the result stays small
        n = own[k : k + block].astype(np.int64)
        ends = np.cumsum(n)
        here = np.repeat(starts[slots[k : k + block]] - (ends - n), n)
        here += np.arange(len(here))
        out[at : at + len(here)] = flat[here]
        at += len(here)
    return own, out


class TextCutter:
    """Texts to ids by their distinct chunks, in Arrow and numpy.

    A pre-token holds a space only at its start, so a text can be cut before every space that stands
    between two other characters; encoding the chunks one by one then encodes the text. Arrow cuts a
    slice of texts there and finds the distinct chunks. These are looked up in the lexicon, if there is
    one; those that it lacks are learned, each once a slice. Nothing is kept from slice to slice. Texts
    with longer runs of white space are cut into pre-tokens as a whole.
    """

    #: SPACE in the syntax of Arrow's regular expressions.
    _SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

    def __init__(self, learn, lexicon: Lexicon | None = None):
        """learn: (an array of distinct chunks less the space in front of each, a list of other strings) ->
        sizes and ids of them all, one after the other."""
        self.learn, self.lexicon = learn, lexicon

    def _known(self, words: pa.StringArray) -> np.ndarray:
        """The lexicon's numbers of the words with a space before them."""
        if self.lexicon is None or not len(words):
            return np.full(len(words), -1, np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        return self.lexicon.numbers_at(np.frombuffer(words.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends), b" ")

    def encode(self, texts: pa.StringArray, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and the end of all). Texts marked odd are left
        without ids; their place is kept."""
        unsafe = pc.match_substring_regex(texts, f" [{self._SPACE}]|[{self._SPACE}] ").to_numpy(zero_copy_only=False).astype(bool)
        odd = np.zeros(len(texts), bool) if odd is None else odd
        plain, slow = np.flatnonzero(~unsafe & ~odd), np.flatnonzero(unsafe & ~odd)
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        ends, pieces = parts.offsets.to_numpy().astype(np.int64), parts.values
        first = np.zeros(len(pieces), bool)
        first[ends[:-1]] = True
        coded = pieces.filter(pa.array(~first)).dictionary_encode()
        heads = pieces.filter(pa.array(first)).to_pylist()
        others = [PRE_TOKEN.findall(t) for t in texts.take(pa.array(slow)).to_pylist()]
        known = self._known(coded.dictionary)
        new = np.flatnonzero(known < 0)
        words = coded.dictionary if len(new) == len(known) else coded.dictionary.take(pa.array(new))
        apart = dict.fromkeys(c for o in others for c in o)
        apart = {c: k for k, c in enumerate(apart, len(new) + len(heads))}
        sizes, flat = self.learn(words, [*heads, *apart])
        starts, n = np.cumsum(sizes) - sizes, len(sizes)
        if self.lexicon is not None:  # one table of what was learned and what the lexicon holds
            starts, sizes = np.concatenate([starts, self.lexicon.starts[:-1] + len(flat)]), np.concatenate([sizes, np.diff(self.lexicon.starts)])
            flat = np.concatenate([flat, self.lexicon.ids])
        at = known + n
        at[new] = np.arange(len(new))
        here = np.empty(len(pieces), np.int32)
        here[~first] = at[coded.indices.to_numpy()]
        here[first] = np.arange(len(new), len(new) + len(heads))
        # the chunks of all texts, in the order of the texts
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[slow] = np.diff(ends), [len(o) for o in others]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        order = here
        if len(slow):
            order = np.empty(bounds[-1], np.int32)
            for group, own in ((plain, here), (slow, np.fromiter((apart[c] for o in others for c in o), np.int32))):
                n = counts[group]
                order[np.repeat(bounds[group] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        own, ids = gathered(order, starts, sizes, flat)
        reached = np.cumsum(own, dtype=np.int64)
        return ids, np.where(bounds > 0, reached[np.maximum(bounds - 1, 0)], 0) if len(reached) else np.zeros(len(bounds), np.int64)


class Encoder:
    """Texts to ids: chunks through the lexicon, the words of all others by exact merges."""

    #: Chunks that are cut into words and merged together.
    RUN = 100_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary = vocabulary
        self.cutter = TextCutter(self._merged, lexicon)

    def _merged(self, words: pa.StringArray, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of chunks, one after the other."""
        got = [self._cut([" " + w for w in words.slice(k, self.RUN).to_pylist()]) for k in range(0, len(words), self.RUN)]
        got.append(self._cut(others))
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _cut(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[c] if c.isalpha() or c[:1] == " " and c[1:].isalpha() else PRE_TOKEN.findall(c) for c in chunks]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        words = [w for p in parts for w in p]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
        slots = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
        sizes, flat = self.vocabulary.merge([w.encode("utf-8", "surrogatepass") for w in distinct])
        sizes, flat = gathered(slots, np.cumsum(sizes) - sizes, sizes, flat)
        return np.diff(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(count)])]), flat

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text begins and the end of all."""
        odd = np.zeros(len(texts), bool)
        for word in self.vocabulary.specials:
            odd |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False).astype(bool)
        ids, bounds = self.cutter.encode(texts, odd)
        return with_odd(ids, bounds, {int(i): self._spelt(texts[int(i)].as_py()) for i in np.flatnonzero(odd)})

    def _spelt(self, text: str) -> np.ndarray:
        """Ids of a text that spells out special tokens."""
        parts = self.vocabulary.split_special.split(text)
        known = self.vocabulary.specials
        own = [np.array([known[x]], np.int32) if x in known else self.cutter.encode(pa.array([x], pa.string()))[0] for x in parts]
        return np.concatenate(own)


def with_odd(ids: np.ndarray, bounds: np.ndarray, odd: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of odd texts into their places."""
    if not odd:
        return ids, bounds
    sizes = np.diff(bounds)
    parts, at = [], 0
    for i, x in sorted(odd.items()):
        parts += [ids[bounds[at] : bounds[i]], x.astype(ids.dtype)]
        sizes[i], at = len(x), i
    parts.append(ids[bounds[at] :])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
