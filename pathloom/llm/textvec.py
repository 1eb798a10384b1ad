"""Vectorised text primitives over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes of the lower-cased
text; everything else separates. Tokens are finer: Unicode punctuation, spaces and controls separate
too, and each character of scripts written without blanks is a token of its own, with the marks that
follow it. Words are hashed without a Python loop: with prefix sums
S[i] of (byte+1)*P^i modulo 2^64, a word's polynomial is (S[end]-S[start])*P^-start, since
the odd P has an inverse modulo 2^64.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1_000_000
#: A text that is longer than a chunk is one chunk; what needs much room a byte is made for so many bytes of it at a time.
BLOCK_BYTES = 1 << 20


def latest(name: str, key, make):
    """As shared(), but only the value of the last key is kept."""
    cache = sys.__dict__.setdefault("_pathloom_latest", {})
    if name not in cache or cache[name][0] != key:
        cache.pop(name, None)
        cache[name] = key, make()
    return cache[name][1]


def shared(key, make):
    """A value kept for the life of the Python worker, across tasks."""
    cache = sys.__dict__.setdefault("_pathloom_shared", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(a) : ord(b) + 1] = True
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())

    def make():
        inverse = pow(P, -1, 1 << 64)
        a, b = np.full(size, P, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        a[0] = b[0] = 1
        return np.cumprod(a), np.cumprod(b)

    return shared(("powers", size), make)


def chunks(column, most: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of whole texts, about `most` bytes at a time; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        to = min(max(to, row + 1), len(column))
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each byte span; spans are in order and don't overlap.

    The sums are made BLOCK_BYTES at a time, so that a long text costs no more room than a short one; a span over
    several blocks is the sum of its parts, each at its distance from the span's start."""
    out = np.zeros(len(starts), np.uint64)
    for base in range(0, len(data) if len(starts) else 0, BLOCK_BYTES):
        block = data[base : base + BLOCK_BYTES]
        a, b = np.searchsorted(ends, base, side="right"), np.searchsorted(starts, base + len(block))
        if a == b:
            continue
        up, down = powers(min(len(data), BLOCK_BYTES) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=sums[1:])
        s, e = np.maximum(starts[a:b] - base, 0), np.minimum(ends[a:b] - base, len(block))
        part = (sums[e] - sums[s]) * down[s]
        before = base - int(starts[a])
        if before > 0:
            part[:1] *= np.uint64(pow(P, before, 1 << 64))
        out[a:b] += part
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, row of each word); rows are those of `offsets`."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = shared("word bytes", word_bytes)[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] |= inside[edges]
    closes = np.zeros(len(data) + 1, bool)
    closes[1:] = inside
    closes[:-1] &= ~inside
    cut = edges[(edges > 0)]
    closes[cut] |= inside[cut - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(offsets, starts, side="right") - 1


#: Scripts without blanks between words: radicals to Bopomofo, Han, Yi, Thai and Lao, Myanmar, Khmer, Tai scripts, Balinese, Javanese, kana.
UNSPACED = [
    (0x2E80, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0xA980, 0xA9DF),
]
SEPARATES, IN_WORD, ALONE, MARK, MARK_ALONE = range(5)


def character_classes() -> np.ndarray:
    """The class of each code point: marks join what is before them; soft hyphens and joiners stand inside words."""
    import unicodedata

    table = np.full(0x110000, IN_WORD, np.uint8)
    for a, b in UNSPACED:
        table[a : b + 1] = ALONE
    table[[0xFF9E, 0xFF9F]] = MARK_ALONE
    for c in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)):
        kind = unicodedata.category(chr(c))
        if kind[0] == "M":
            table[c] = MARK_ALONE if table[c] == ALONE else MARK
        elif kind[0] in "PZ" or kind in ("Cc", "Cf") and c not in (0xAD, 0x200C, 0x200D):
            table[c] = SEPARATES
    return table


def byte_kinds(data: np.ndarray) -> np.ndarray | None:
    """The class of each byte's character; None where all are ASCII."""
    if not (data >= 0xC0).any():
        return None
    of = shared("word bytes", word_bytes)[data].astype(np.uint8)
    classes = shared("character classes", character_classes)
    for base in range(0, len(data), BLOCK_BYTES):
        lead = base + np.flatnonzero(data[base : base + BLOCK_BYTES] >= 0xC0)
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
        found = classes[code]
        for k in range(4):
            more = size > k
            of[lead[more] + k] = found[more]
    return of


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, row of each token), as words() but by characters."""
    of = byte_kinds(data)
    if of is None:
        return words(data, offsets)
    inside = of != SEPARATES
    before = np.concatenate([[np.uint8(SEPARATES)], of[:-1]])
    opens = inside & ((before == SEPARATES) | (of == ALONE) | (of == IN_WORD) & ((before == ALONE) | (before == MARK_ALONE)))
    opens &= (data & 0xC0) != 0x80
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    opens[edges] |= inside[edges]
    # a token ends before a separator or where the next one opens
    closes = np.zeros(len(data) + 1, bool)
    closes[1:] = inside
    closes[:-1] &= ~inside | opens
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(offsets, starts, side="right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, n: int):
    """(first word, hash) of every run of n words inside one row."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(last, np.uint64)
    for j in range(n):
        out = out * np.uint64(P) + hashes[j : j + last]
    first = np.flatnonzero(rows[:last] == rows[n - 1 :])
    return first, mix(out[first])


def lower(column):
    return pc.utf8_lower(column)


class HashTable:
    """64-bit hashes to int32, open addressing, whole arrays at a time; -1 for what isn't in it."""

    def __init__(self, size: int = 1 << 12):
        self.keys, self.values, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def _home(self, keys):
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = np.maximum(keys, np.uint64(1))
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        last = len(self.keys) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in the table."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            size = 1 << int(4 * (self.n + len(keys))).bit_length()
            self.keys, self.values, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
            self._put(k, v)
        self._put(np.maximum(keys, np.uint64(1)), np.asarray(values, np.int32))

    def _put(self, keys, values):
        self.n += len(keys)
        at, last = self._home(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & last
