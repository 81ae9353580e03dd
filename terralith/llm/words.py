"""Splitting texts into the words of byte-level BPE, for many texts at once.

Follows the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` by array
operations on code points instead of a backtracking matcher.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space outside the ASCII range and the controls (fixed values: Unicode White_Space).
_SPACES = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    found = np.full(0x110000, OTHER, np.uint8)
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    found[major == ord("L")] = LETTER
    found[major == ord("N")] = NUMBER
    found[_SPACES] = SPACE
    return found


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of ``points``, equal for equal slices wherever they lie.

    Some unequal slices of 1024 and more points have equal hashes for any base, because the
    modulus is a power of two: the caller must compare the slices themselves.
    """
    up, down = _powers(1 << max(4, int(len(points)).bit_length()))
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@cache
def _prime_powers(p: int, base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` modulo the prime ``p`` and of its inverse, 2**bits of each."""
    found = []
    for b in (base, pow(base, -1, p)):
        powers = np.ones(1, np.uint64)
        for i in range(bits):
            powers = np.concatenate([powers, powers * np.uint64(pow(b, 1 << i, p)) % np.uint64(p)])
        found.append(powers)
    return found[0], found[1]


def word_digests(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices from polynomials modulo two primes of 31 bits.

    Two unequal slices of n points share both polynomials for n * n of the about 2**62 pairs of
    bases at most, whatever their pattern.
    """
    bits = max(4, int(len(points)).bit_length())
    out = (ends - starts).astype(np.uint64)
    for p, base in ((2147483647, 1103515245), (2147483629, 1664525117)):
        up, down = _prime_powers(p, base, bits)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)] % np.uint64(p), out=prefix[1:])
        out = mix(out + (prefix[ends] - prefix[starts]) % np.uint64(p) * down[starts] % np.uint64(p))
    return out


def split(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of all words in the concatenated texts; every code point is in one word.

    ``points``: code points; ``doc_starts``: where each non-empty text begins (the first is 0).
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    edge = first[:n].copy()
    edge[1:] |= cls[1:] != cls[:-1]
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    kind = cls[runs]
    blank = points == 32
    start = np.zeros(n, bool)
    # a white-space run that something follows gives up its last character
    space = kind == SPACE
    start[runs[space]] = True
    inner = space & ~first[ends]
    start[ends[inner] - 1] = True
    # that character joins the next word if it is a blank
    solid = ~space
    at = runs[solid]
    begins = first[:n][at] | ~blank[np.maximum(at - 1, 0)]
    start[at[begins]] = True
    # contractions: a lone apostrophe at a word's start takes the letters that follow it
    lone = np.flatnonzero((kind == OTHER) & (ends - runs == 1) & (points[runs] == 39))
    lone = lone[lone + 1 < len(runs)]
    lone = lone[start[runs[lone]] & (kind[lone + 1] == LETTER) & ~first[:n][runs[lone + 1]]]
    if len(lone):
        a, b = runs[lone + 1], ends[lone + 1]
        c1 = points[a]
        c2 = np.where(b - a > 1, points[np.minimum(a + 1, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        hit = one | two
        a, b, k = a[hit], b[hit], np.where(one[hit], 1, 2)
        start[a] = False
        rest = a + k < b
        start[(a + k)[rest]] = True
    return np.flatnonzero(start)


class Batch:
    """Words of a list of texts: distinct words and the place of each occurrence."""

    def __init__(self, texts: list[str]):
        flat = "".join(texts)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.starts = split(points, offsets[:-1][sizes > 0])
        self.ends = np.append(self.starts[1:], len(points)) if len(self.starts) else self.starts
        self.hashes = slice_hashes(points, self.starts, self.ends)
        #: word places: text i has the words bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self._flat, self.points = flat, points

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, place of the first word with each code); words are compared whole."""
        import pandas as pd

        codes, uniques = pd.factorize(self.hashes)
        if not self._same(codes, _firsts(codes, len(uniques))):
            codes, uniques = pd.factorize(np.array([self.word(i) for i in range(len(codes))], object))
        return codes, _firsts(codes, len(uniques))

    def _same(self, codes: np.ndarray, place: np.ndarray) -> bool:
        """Whether every word equals the first word with its code, code point by code point."""
        if not len(codes):
            return True
        sizes = self.ends - self.starts
        first = place[codes]
        if not np.array_equal(sizes, sizes[first]):
            return False
        other = np.arange(len(self.points)) + np.repeat(self.starts[first] - self.starts, sizes)
        return np.array_equal(self.points, self.points[other])

    def word(self, i: int) -> str:
        return self._flat[self.starts[i] : self.ends[i]]


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    place = np.empty(n, np.int64)
    place[codes[::-1]] = np.arange(len(codes))[::-1]
    return place


#: Characters of texts that are split into words at once.
PIECE = 1 << 19
#: Before white space that follows a letter, digit or underscore a word ends in any case.
_END = re.compile(r"(?<=\w)(?=[ \n])")


def pieces(text: str, limit: int = PIECE):
    """A long text in pieces of ``limit`` characters and more, cut where words end."""
    at = 0
    while len(text) - at > limit and (cut := _END.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def chunks(texts: list[str], limit: int = PIECE):
    """Consecutive slices of ``texts`` of about ``limit`` characters (one text at least)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


class Ragged:
    """Growing list of integer arrays in one flat array, gathered by index."""

    def __init__(self, dtype):
        self.flat, self.offset, self.size = np.empty(1024, dtype), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n, self.used = 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.empty(max(n, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        m, k = len(flat), len(sizes)
        self.flat = self._room(self.flat, self.used + m)
        self.offset, self.size = self._room(self.offset, self.n + k), self._room(self.size, self.n + k)
        self.flat[self.used : self.used + m] = flat
        self.offset[self.n : self.n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + k] = sizes
        self.used, self.n = self.used + m, self.n + k

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arrays of ``which`` in a row, their sizes)."""
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offset[which] - ends + sizes, sizes)
        return self.flat[shift + np.arange(len(shift))], sizes


class Dictionary:
    """Numbers for the distinct words that one task has met, up to a bound on its memory.

    Words are looked up by hash and compared with the word that has it, code point by code point
    and all at once; a word whose hash another one has is kept by itself.
    """

    LIMIT = 1 << 18
    CHARS = 1 << 23

    def __init__(self):
        self.numbers: dict[int, int] = {}
        self.others: dict[str, int] = {}
        self._held = Ragged(np.uint32)

    def full(self) -> bool:
        return self._held.n >= self.LIMIT or self._held.used >= self.CHARS

    def number(self, batch: Batch) -> tuple[np.ndarray, list[str]]:
        """(number of each word of the batch, the words that are new, in order of number)."""
        codes, place = batch.distinct()
        known, hashes = self.numbers, batch.hashes[place].tolist()
        get = known.get
        found = np.array([get(h, -1) for h in hashes], np.int64)
        met = np.flatnonzero(found >= 0)
        met = met[~self._equal(batch, place[met], found[met])]
        fresh, new = [], []
        for i in np.append(np.flatnonzero(found < 0), met).tolist():
            word, h = batch.word(place[i]), hashes[i]
            at = self.others.get(word)
            if at is None:
                at = self._held.n + len(fresh)
                fresh.append(word)
                new.append(i)
                if h in known:
                    self.others[word] = at
                else:
                    known[h] = at
            found[i] = at
        if new:
            starts, sizes = batch.starts[place[new]], (batch.ends - batch.starts)[place[new]]
            self._held.extend(batch.points[_spread(starts, sizes)], sizes)
        return found[codes], fresh

    def _equal(self, batch: Batch, place: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether each word of the batch is the held word with its number."""
        sizes = (batch.ends - batch.starts)[place]
        same = sizes == self._held.size[numbers]
        at = np.flatnonzero(same)
        if len(at):
            differ = batch.points[_spread(batch.starts[place[at]], sizes[at])] != self._held.gather(numbers[at])[0]
            if differ.any():
                same[at[np.add.reduceat(differ, np.cumsum(sizes[at]) - sizes[at]) > 0]] = False
        return same


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of slices, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
