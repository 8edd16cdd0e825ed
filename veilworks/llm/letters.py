"""Texts as arrays of code points: their words, and hashes of words and of parts of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: An odd number, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEPARATOR = ord("_")
#: Code points that are looked at together; a word that is longer stays whole.
BLOCK = 1 << 18
#: Letters above this code point have no other case here.
CASED = 0x20000


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """For each code point its lower-case letter, where that is one code point; the separator if it is no letter."""
    every = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    out = np.where(every, np.arange(0x110000, dtype=np.uint32), SEPARATOR).astype(np.uint32)
    for c in np.flatnonzero(every[:CASED]).tolist():
        if len(low := chr(c).lower()) == 1 and low.isalpha():
            out[c] = ord(low)
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Letters:
    """Words of the given texts in order: where each starts and ends, and which text it is from."""

    def __init__(self, texts: list[str]):
        joined = "\n" + "\n".join(texts) + "\n"
        self.codes = lowered()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        up, self.down = _powers(1 << max(19, len(self.codes).bit_length()))
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)], out=self.sums[1:])
        letter = np.concatenate([self.codes != SEPARATOR])
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.text_starts = firsts[:-1]
        self.text = np.searchsorted(firsts, self.starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each run of code points [start, end), the same wherever the run lies."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n code points of the given words, each with a separator before and after; and the places in `words` they belong to."""
        counts = np.maximum(self.ends[words] - self.starts[words] + 3 - n, 0)
        owner = np.repeat(np.arange(len(words)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[words] - 1, counts)
        return self.hashes(at, at + n), owner


def hash_of(run: str) -> int:
    """The same number for one string of lower-case letters and separators."""
    return int(sum((ord(c) + 1) * pow(int(BASE), i, 1 << 64) for i, c in enumerate(run)) % (1 << 64))


class Table:
    """Hash -> row number, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys, self.rows = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        rows, slot = np.arange(len(keys)), self._slot(keys)
        while len(rows):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.rows[slot[put]] = keys[rows[put]], rows[put]
            left = np.ones(len(rows), bool)
            left[put] = False
            rows, slot = rows[left], (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * BASE >> np.uint64(24)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1; 0 is no key."""
        out = np.full(len(keys), -1, np.int32)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = (held == keys[at]) & (held != 0)
            out[at[hit]] = self.rows[slot[hit]]
            on = ~hit & (held != 0)
            at, slot = at[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """Which text each part is of, and the parts, by about `size` code points at a time. Long texts are cut between words."""
    whose, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and (text[end].isalpha() and text[end - 1].isalpha()):
                end += 1
            if held and held + end - at > size:
                yield whose, parts
                whose, parts, held = [], [], 0
            whose.append(i)
            parts.append(text[at:end])
            held += end - at
            at = end
    if parts:
        yield whose, parts
