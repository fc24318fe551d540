"""Words and hashes of many texts at once, as array operations: helpers for the Arrow functions of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15
POINTS = 0x110000
SPACE, WORD, OTHER = 0, 1, 2


class Tokens(NamedTuple):
    doc: np.ndarray  #: index of the text
    hash: np.ndarray  #: of the lower-case token
    kind: np.ndarray  #: WORD or OTHER


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point whether it is space, part of a word (letter or digit) or something else."""
    out = np.full(POINTS, OTHER, np.uint8)
    for p in range(POINTS):
        c = chr(p)
        if c.isalnum():
            out[p] = WORD
        elif c.isspace():
            out[p] = SPACE
    return out


@lru_cache(maxsize=1)
def lower() -> np.ndarray:
    """Each code point in lower case, where that is a single one."""
    out = np.arange(POINTS, dtype=np.uint32)
    for p in range(POINTS):
        c = chr(p).lower()
        if len(c) == 1:
            out[p] = ord(c)
    return out


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Each letter in lower case; 0 for code points that are no letters."""
    small = lower()
    return np.where([chr(p).isalpha() for p in range(POINTS)], small, 0).astype(np.uint32)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i under n."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(sizes: Sequence[int], chars: int = 1 << 19, docs: int = 256) -> Iterator[slice]:
    """Runs of texts with about so many characters and at most so many texts; a longer text is a run of its own."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and (total + n > chars or k - begin >= docs):
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def tokens(texts: Sequence[str]) -> Tokens:
    """Words and runs of other marks of the texts, in order."""
    chars = code_points("\n".join(texts))
    if not len(chars):
        return Tokens(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    kind = kinds()[chars]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(chars)]))
    kept = kind[start] != SPACE
    start, end = start[kept], end[kept]
    up, down = powers(len(chars))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower()[chars] + np.uint64(1)) * down[: len(chars)], dtype=np.uint64)))
    value = mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)))
    return Tokens(np.searchsorted(begin, start, "right") - 1, value, kind[start])


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n tokens in a row within a text, and their texts."""
    if len(hashes) < n:
        return hashes[:0], doc[:0]
    value = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        value = mix(value * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k])
    whole = doc[: len(value)] == doc[n - 1 :]
    return value[whole], doc[: len(value)][whole]
