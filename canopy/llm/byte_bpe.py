"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, cached pair merging, decoding.

Pre-tokenisation uses no regular expression. Every codepoint gets a class (letter, digit, space,
other white space, apostrophe, other, the few letters that end contractions), refined by the
codepoints after it. A class is a transition function over a few states; the functions form a small
monoid whose composition is a lookup table, so an associative scan (first inside blocks, for all
blocks at once, then over the blocks) gives the state before every codepoint, and a table on
(state, class) tells where a piece starts. The scan carries its state, so a very long text is
handled in chunks.

Pieces are byte slices. A bounded cache maps a slice to its ids; what it lacks is merged for all
missing slices at once, in numpy: each round merges the lowest-ranked pair of every slice.

Null text counts as empty and has no ids. Ties between equal pairs go to the leftmost pair.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._util import CHUNK_CHARS, as_bytes, groups_of, prepare

# Classes of codepoints, before and after looking ahead.
LETTER, DIGIT, OTHER, QUOTE, SPACE, BLANK, ONE, R_E, V_E, L_L, E, L, R, V, RESET = range(15)
SPACE_LAST, BLANK_LAST = 15, 16  # the last of a run of white space that text follows
N_CLASSES = 17
# States: what the previous codepoint was.
START, IN_LETTER, IN_DIGIT, IN_OTHER, IN_BLANK, AT_SPACE, AT_BLANK, AT_QUOTE, WANT_E, WANT_L, DONE = range(11)
N_STATES = 11
_LETTERS = (LETTER, ONE, R_E, V_E, L_L, E, L, R, V)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this codepoint."""
    glued = state == AT_SPACE  # one space before text belongs to it
    if cls == RESET:
        return START, True
    if cls in (SPACE, BLANK):
        return IN_BLANK, state != IN_BLANK
    if cls == SPACE_LAST:
        return AT_SPACE, True
    if cls == BLANK_LAST:
        return AT_BLANK, True
    if cls in _LETTERS:
        if state == AT_QUOTE and cls == ONE:
            return DONE, False
        if state == AT_QUOTE and cls in (R_E, V_E):
            return WANT_E, False
        if state == AT_QUOTE and cls == L_L:
            return WANT_L, False
        if state in (WANT_E, WANT_L):
            return DONE, False
        return IN_LETTER, state != IN_LETTER and not glued
    if cls == DIGIT:
        return IN_DIGIT, state != IN_DIGIT and not glued
    if cls == QUOTE and state not in (IN_OTHER, AT_QUOTE) and not glued:
        return AT_QUOTE, True
    return IN_OTHER, state not in (IN_OTHER, AT_QUOTE) and not glued


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """function of each class, composition[f, g] (f first), image[f, state], starts[state, class]."""
    of = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(N_CLASSES)]
    found = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(N_STATES)), *of]))}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in of:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    every = list(found)
    if len(every) > 256:
        raise AssertionError("the transition monoid outgrew one byte")
    compose = np.array([[found[tuple(g[x] for x in f)] for g in every] for f in every], np.uint8)
    return np.array([found[f] for f in of], np.uint8), compose, np.array(every, np.uint8), np.array([[_step(s, c)[1] for c in range(N_CLASSES)] for s in range(N_STATES)])


@functools.cache
def _class_table() -> np.ndarray:
    """Class of every codepoint, and of the separator, before looking ahead."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, OTHER, np.uint8)
    out[0x110000] = RESET
    for cls, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        out[[ord(x) for x in regex.findall(pattern, every)]] = cls
    for x, cls in {" ": SPACE, "'": QUOTE, "s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(x)] = cls
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """Flat look-ups: (class, next class) to the refined class and its function, pairs of functions, states."""
    functions, compose, image, starts = _monoid()
    refined = np.zeros(256, np.uint8)
    for now in range(15):
        for then in range(15):
            cls = now
            if now in (SPACE, BLANK) and then not in (SPACE, BLANK, RESET):
                cls = SPACE_LAST if now == SPACE else BLANK_LAST
            refined[now << 4 | then] = {(R, E): R_E, (V, E): V_E, (L, L): L_L}.get((now, then), cls)
    n = len(compose)
    pairs = np.zeros((n, 32), np.uint8)
    pairs[:, :n] = compose
    moved = np.zeros((n, 16), np.uint8)
    moved[:, :N_STATES] = image
    begins = np.zeros((N_STATES, 32), bool)
    begins[:, :N_CLASSES] = starts
    return refined, functions[refined], pairs.ravel(), moved.ravel(), begins.ravel()


def _scan(funcs: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each position, and after the last, by an associative scan of functions."""
    _, _, pairs, moved, _ = _tables()
    n, width = len(funcs), 64
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)  # function 0 is the identity
    padded[:n] = funcs
    block = np.ascontiguousarray(padded.reshape(rows, width).T).astype(np.uint16)
    for j in range(1, width):  # inclusive scan in all blocks at once
        block[j] = pairs[block[j - 1] << 5 | block[j]]
    if rows > 256:
        into, last = _scan(block[-1].astype(np.uint8), state)
    else:
        into, last = np.empty(rows, np.uint8), state
        for i, f in enumerate(block[-1].tolist()):
            into[i] = last
            last = int(moved[f << 4 | last])
    before = np.empty((width, rows), np.uint8)
    before[0] = into
    before[1:] = moved[block[:-1] << 4 | into[None, :]]
    return before.T.reshape(-1)[:n], last


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces start in an array of codepoints; 0x110000 separates texts and stands alone."""
    out, state, size = [], START, CHUNK_CHARS
    refined, functions, _, _, begins = _tables()
    classes = _class_table()
    for at in range(0, len(points), size):
        cls = classes[points[at : at + size + 1]]
        if len(cls) <= size:
            cls = np.append(cls, np.uint8(RESET))
        both = cls[:-1] << 4 | cls[1:]
        before, state = _scan(functions[both], state)
        out.append(np.flatnonzero(begins[before.astype(np.uint16) << 5 | refined[both]]) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def slices_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts (padded), where each piece starts and stops, and pieces in each text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    points[ends] = 0x110000
    cut = piece_starts(points)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) != len(points):
        points[ends] = 0
        wide = (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(wide + np.int8(1), dtype=np.int64)  # after each codepoint
        cut, ends = np.where(cut > 0, offset[cut - 1], 0), offset[ends] - 1
    mark = np.searchsorted(cut, ends)  # a separator is a piece of its own
    keep = np.ones(len(cut), bool)
    keep[mark] = False
    stop = np.append(cut[1:], len(data))
    return data + bytes(16), cut[keep], stop[keep], np.diff(mark, prepend=-1) - 1


def pieces_of(texts: list[str]) -> Iterator[list[bytes]]:
    """The pieces of each text, as UTF-8 slices."""
    for a, b in groups_of(texts):
        data, start, stop, count = slices_of(texts[a:b])
        every = [data[x:y] for x, y in zip(start.tolist(), stop.tolist())]
        at = 0
        for n in count.tolist():
            yield every[at : at + n]
            at += n


class PieceTable:
    """A bounded cache in numpy: pieces of at most 15 bytes, packed in two words, to their ids.

    Keys are compared whole, so a hit is exact. The table starts afresh when it is half full.
    """

    def __init__(self, bits: int = 21) -> None:
        self.bits = bits
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.clear()

    def clear(self) -> None:
        self.low = np.zeros(1 << self.bits, np.uint64)
        self.high = np.zeros(1 << self.bits, np.uint64)  # the top byte holds the length, 0 if free
        self.offset = np.zeros(1 << self.bits, np.int64)
        self.count = np.zeros(1 << self.bits, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0

    def slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self.slot(low, high)
        held = self.high[slot]
        hit = (held == high) & (self.low[slot] == low)
        out = np.where(hit, slot, -1)
        todo = np.flatnonzero(~hit & (held != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.high[slot]
            hit = (held == high[todo]) & (self.low[slot] == low[todo])
            out[todo[hit]] = slot[hit]
            go = ~hit & (held != 0)
            todo, slot = todo[go], slot[go]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add distinct keys that the table lacks."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        offset = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.held += len(low)
        slot, todo = self.slot(low, high), np.arange(len(low))
        owner = np.empty(1 << self.bits, np.int32) if len(low) else None
        while len(todo):
            free = todo[self.high[slot[todo]] == 0]
            owner[slot[free]] = free
            put = free[owner[slot[free]] == free]  # one of those that want a slot
            at = slot[put]
            self.low[at], self.high[at], self.offset[at], self.count[at] = low[put], high[put], offset[put], count[put]
            rest = np.ones(len(low), bool)
            rest[put] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask


#: Keeps the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class ByteBPE:
    """Ids of pieces by merging the adjacent pair of lowest rank until none is known."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 100_000, added: dict[str, int] | None = None) -> None:
        self.added = added or {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, values = [], []
        get = ranks.get
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 17 | b)
                    values.append(i)
        self._table(np.array(keys, np.int64), np.array(values, np.int64))
        self.short = PieceTable()
        self.long: dict[bytes, bytes] = {}
        self.cache_size = cache_size

    @classmethod
    def from_ranks(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    @classmethod
    def from_json(cls, path: str) -> ByteBPE:
        """A vocabulary file of the tokenizers library, whose tokens spell bytes as printable characters. Its added
        tokens, which stand apart from the words around them, count for encode_with_added()."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        spelt = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        added = {x["content"]: x["id"] for x in read["added_tokens"]}
        if any(x[k] for x in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        special = set(added.values())
        return cls({bytes(spelt[c] for c in k): v for k, v in read["model"]["vocab"].items() if v not in special}, added=added)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pairs; slots hold a key, or -1."""
        bits = max(8, int(len(keys) * 3).bit_length())
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, or a large number."""
        key = left << 17 | right
        slot = self._slot(key)
        out = np.full(len(key), 1 << 40, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[slot]
            hit = held == key
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, each as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        long = [i for i, p in enumerate(pieces) if len(p) > 64]
        for i in long:
            out[i] = self._merge_long(pieces[i])
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= 64]
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            for i, ids in zip(part, self._merge_short([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _merge_short(self, pieces: list[bytes]) -> list[bytes]:
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_ids, done_owner = [], []
        none = 1 << 40
        rank = np.full(len(ids), none, np.int64)  # of the pair that starts here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._merged(ids[inner], ids[inner + 1])
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(ids)))
            live = least < none
            if not live.all():
                keep = np.repeat(live, count)
                done_ids.append(ids[~keep])
                done_owner.append(owner[~keep])
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                least, count = least[live], count[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]  # leftmost
            ids[hit] = rank[hit]
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            at = np.cumsum(kept)[hit] - 1
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = none
            pair = touched[touched < len(ids) - 1]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[pair] = self._merged(ids[pair], ids[pair + 1])
        owner, ids = np.concatenate(done_owner), np.concatenate(done_ids)
        order = np.argsort(owner, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        stop = (np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stop], stop)]

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece by a heap over linked parts: n log n."""
        import heapq

        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        known: dict[int, int] = {}

        def rank(a: int, b: int) -> int:
            key = a << 17 | b
            if key not in known:
                known[key] = int(self._merged(np.array([a], np.int64), np.array([b], np.int64))[0])
            return known[key]

        first = self._merged(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r < 1 << 40]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank(r, ids[after[i]])) < 1 << 40:
                    heapq.heappush(heap, (q, i, r, ids[after[i]]))
            if before[i] >= 0 and (q := rank(ids[before[i]], r)) < 1 << 40:
                heapq.heappush(heap, (q, before[i], ids[before[i]], r))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def _known(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset in the pool and number of ids of each piece of at most 15 bytes."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = words[start] & _FIRST[np.minimum(size, 8)]
        high = (words[start + 8] & _FIRST[np.maximum(size - 8, 0)]) | (size.astype(np.uint64) << np.uint64(56))
        found = self.short.find(low, high)
        lack = np.flatnonzero(found < 0)
        if len(lack):
            order = lack[np.lexsort((low[lack], high[lack]))]
            first = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
            new = order[first]
            if self.short.held + len(new) > self.short.mask // 2:
                self.short.clear()
                return self._known(data, start, size) if len(new) < len(start) else self._fresh(data, start, size, low, high, new, lack, found)
            return self._fresh(data, start, size, low, high, new, lack, found)
        return self.short.offset[found], self.short.count[found]

    def _fresh(self, data: bytes, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray, lack: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        merged = self.merge([data[x:y] for x, y in zip(start[new].tolist(), (start[new] + size[new]).tolist())])
        count = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        self.short.put(low[new], high[new], np.frombuffer(b"".join(merged), "<u4"), count)
        found[lack] = self.short.find(low[lack], high[lack])
        return self.short.offset[found], self.short.count[found]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        for a, b in groups_of(texts, min(CHUNK_CHARS, self.short.mask // 4)):
            data, start, stop, pieces = slices_of(texts[a:b])
            size = stop - start
            offset, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            short = size <= 15
            at, every = np.flatnonzero(short), np.flatnonzero(~short)
            extra = []
            for x in range(0, len(at), self.short.mask // 4):  # a very long text has more pieces than the table holds
                part = at[x : x + self.short.mask // 4]
                place, n = self._known(data, start[part], size[part])
                total = int(n.sum())
                extra.append(self.short.pool[np.repeat(place - np.cumsum(n) + n, n) + np.arange(total)])
                offset[part], count[part] = np.cumsum(n) - n + sum(map(len, extra[:-1])), n
            if len(every):
                keys = [data[x:y] for x, y in zip(start[every].tolist(), stop[every].tolist())]
                if len(self.long) > self.cache_size:
                    self.long = {}
                if lacking := list(set(keys).difference(self.long)):
                    self.long.update(zip(lacking, self.merge(lacking)))
                coded = list(map(self.long.__getitem__, keys))
                n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                offset[every], count[every] = np.cumsum(n) - n + sum(map(len, extra)), n
                extra.append(np.frombuffer(b"".join(coded), "<u4"))
            pool = np.concatenate(extra) if extra else np.zeros(0, np.uint32)
            after = np.cumsum(count)
            ids = pool[np.repeat(offset - after + count, count) + np.arange(len(pool))] if len(every) else pool
            data = ids.astype("<u4").tobytes()
            last = np.cumsum(pieces)
            upto = np.where(last > 0, np.append(after, 0)[np.maximum(last - 1, 0)], 0) * 4 if len(start) else last
            for x, y in zip([0, *upto.tolist()], upto.tolist()):
                yield data[x:y]

    def encode_with_added(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as the tokenizers library gives them: a text is cut at added tokens (leftmost first, of
        those that start together the longest), which become their own ids."""
        if not self.added:
            yield from self.encode(texts)
            return
        longest = sorted(self.added, key=len, reverse=True)
        parted = [re.split(f"({'|'.join(map(re.escape, longest))})", x) if any(t in x for t in longest) else [x] for x in texts]
        coded = self.encode([x for parts in parted for x in parts[::2]])
        for parts in parted:
            yield b"".join(np.array([self.added[x]], "<u4").tobytes() if i % 2 else next(coded) for i, x in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each id's token starts in the decoded text, and the total."""
        size = [len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


@functools.cache
def loaded(path: str) -> ByteBPE:
    """One tokenizer, with its cache, for each Python worker."""
    return ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_ranks(path)


def batched(texts: Iterable[bytes]) -> list[str]:
    return [x.decode("utf-8", "replace") for x in texts]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit), offsets (byte offset of each token)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = list(bpe.encode(batched(as_bytes(batch["text"]))))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.binary()), pa.array([bpe.offsets(x)[:-1] for x in ids], pa.list_(pa.int64()))], ["id", "ids", "offsets"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, ids binary, offsets array<bigint>").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids).

    A null text counts as empty (no tokens, digests of nothing); rows with equal ids each get a
    row; other columns of docs, whatever their names, take no part; an empty table gives none.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            count, coded, decoded = [], [], []
            for ids in bpe.encode(batched(as_bytes(batch["text"]))):
                count.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
