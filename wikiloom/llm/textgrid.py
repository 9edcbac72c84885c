"""Vectorised text scanning for Arrow batches: whole texts as one code point array, words and pre-tokens as hashes.

A batch of texts is laid end to end; hashes of any stretch come from one prefix sum, so that a worker spends a few
nanoseconds a character and holds a few arrays of bounded size, however long or many the texts are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, BOUNDARY = range(5)
#: Code points that one numpy pass takes together; a single longer text is taken whole.
GRID_CHARS = 400_000
#: Stretches are hashed by two polynomials modulo this prime. Modulo a power of two, strings of the Thue-Morse kind meet
#: whatever the base is.
PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_812_433_253 % PRIME)
_powers = [np.ones(1, np.uint32) for _ in range(2 * len(_BASES))]

# The White_Space property of Unicode.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, not yet least: below 2 ** 34 for any x, below 2 ** 32 for x below 2 ** 60."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _least(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.minimum(x, x - np.uint64(PRIME))  # what would be negative is a great number


def powers(n: int) -> list[np.ndarray]:
    """For each base its powers base ** i, and then base ** -i, modulo PRIME for i < n."""
    for k, base in enumerate((*_BASES, *(pow(b, -1, PRIME) for b in _BASES))):
        while len(_powers[k]) < n:
            have = _powers[k].astype(np.uint64)
            _powers[k] = np.concatenate([have, _least(have * np.uint64(pow(base, len(have), PRIME)))]).astype(np.uint32)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads each bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix(units: np.ndarray) -> np.ndarray:
    """Prefix sums, one row a base, from which span_hashes() takes the hash of any stretch of units below 2 ** 30."""
    n = len(units)
    out = np.empty((len(_BASES), n + 1), np.uint64)
    out[:, 0] = 0
    power = powers(n + 1)
    for a in range(0, n, 1 << 14):  # pieces that stay in the cache
        plus = units[a : a + (1 << 14)].astype(np.uint64)
        plus += np.uint64(1)
        for k, sums in enumerate(out):
            terms = plus * power[k][a : a + len(plus)]
            high = terms >> np.uint64(31)
            terms &= np.uint64(PRIME)
            terms += high
            np.cumsum(terms, out=terms)
            np.add(terms, sums[a], out=sums[a + 1 : a + 1 + len(plus)])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[start:end], equal for equal stretches at any place; the length is part of the hash."""
    out = np.empty(len(start), np.uint64)
    inverse = powers(sums.shape[1])[len(_BASES) :]
    for a in range(0, len(start), 1 << 14):
        i, j = start[a : a + (1 << 14)], end[a : a + (1 << 14)]
        h = (j - i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row, back, shift in zip(sums, inverse, (0, 31), strict=True):
            h += _least(_folded(row[j] - row[i]) * back[i]) << np.uint64(shift)
        out[a : a + len(i)] = mix(h)
    return out


@cache
def classes() -> np.ndarray:
    """For each code point its class, plus 8 where versions of Unicode disagree and only the library should decide."""
    out = np.zeros(0x110000, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LN":
            out[i] = LETTER if kind[0] == "L" else NUMBER
        if kind != old(chr(i)):
            out[i] |= 8
    out[WHITE_SPACE] = SPACE
    # also: separators that libraries treat differently, and letters whose lower case depends on the place or is two letters
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0x130, 0x3A3]] |= 8
    return out


@cache
def lower() -> np.ndarray:
    """For each code point its lower case, where that is one code point."""
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)], np.uint32)


def slabs(texts: list[str], limit: int = GRID_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `limit` code points."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Grid:
    """Texts end to end, one boundary after each: code points, their classes and each text's end."""

    def __init__(self, texts: list[str], fold: bool = False):
        """fold: take the code points in lower case."""
        self.joined = "\x00".join([*texts, ""])
        self.cp = np.frombuffer(self.joined.encode("utf-32-le", "replace"), np.uint32)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        self.cls = classes()[self.cp]
        if fold:
            self.cp = lower()[self.cp]
        self.cls[self.ends] = BOUNDARY

    def doubtful(self) -> np.ndarray:
        """For each text: whether it holds a code point that versions of Unicode class differently."""
        at = np.flatnonzero(self.cls & 8)
        out = np.zeros(len(self.ends), bool)
        out[np.searchsorted(self.ends, at)] = True
        return out

    def _contractions(self, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a pre-token are pre-tokens of their own."""
        cp, cls = self.cp, self.cls
        at = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (cls[1:] == LETTER))
        at = at[(cls[at] == OTHER)]
        if not len(at):
            return
        one, two = cp[at + 1], cp[np.minimum(at + 2, len(cp) - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True

    def byte_level(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of byte-level BPE: runs of letters, numbers or others with one space
        before them, contractions, and white space."""
        cp, cls = self.cp, self.cls & 7
        start = np.ones(len(cp), bool)
        start[1:] = cls[1:] != cls[:-1]
        start[self.ends] = True
        begin = np.flatnonzero(start[1:] & (cls[1:] < SPACE) & (cls[:-1] == SPACE)) + 1
        start[begin - 1] = True
        start[begin[cp[begin - 1] == 0x20]] = False
        self._contractions(start)
        return self._spans(start, cls != BOUNDARY)

    def word_level(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of the word BPE: runs of letters or others, single numbers, contractions."""
        cls = self.cls & 7
        start = np.ones(len(cls), bool)
        start[1:] = cls[1:] != cls[:-1]
        start |= (cls == NUMBER) | (cls == BOUNDARY)
        self._contractions(start)
        return self._spans(start, cls < SPACE)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of letters."""
        cls = self.cls & 7
        start = np.ones(len(cls), bool)
        start[1:] = cls[1:] != cls[:-1]
        return self._spans(start, cls == LETTER)

    def _spans(self, start: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(start))
        keep = wanted[at]
        return at[keep], end[keep]


class Known:
    """A table of fixed size from hashes to small values; what it has lost by a clash is worked out again."""

    def __init__(self, bits: int = 20, dtype=np.int64):
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, dtype)

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        slot = h & self.mask
        self.key[slot] = h
        self.value[slot] = value
        lost = self.key[slot] != h  # two new hashes in one slot: key and value must be of the same one
        if lost.any():
            self.value[slot[~lost]] = value[~lost]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where they are known."""
        slot = h & self.mask
        return self.value[slot], self.key[slot] == h

    def clear(self) -> None:
        self.key[:] = 0


def byte_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the texts with A-Z in lower case; starts and ends of each text's words."""
    data = [t.encode("utf-8", "replace").lower() for t in texts]
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    text_ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    hashes = span_hashes(prefix(raw), start, end)
    last = np.searchsorted(start, text_ends)
    return hashes, np.concatenate([[0], last[:-1]]).astype(np.int64), last
