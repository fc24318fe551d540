"""Words of UTF-8 texts as array operations on their bytes: where they begin and end, and a 64-bit hash of each."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

from voxframe.llm.text import BASE, mix, powers

#: Bytes hashed at once; a longer word is hashed by itself.
BLOCK = (1 << 18) - 2
WORD, SPACE, BREAK = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


class Words(NamedTuple):
    start: np.ndarray  #: first byte
    end: np.ndarray  #: byte after the last
    hash: np.ndarray  #: of the folded bytes, never 0
    breaks: np.ndarray  #: BREAK bytes before the word


def kinds(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """WORD, SPACE or BREAK for each byte."""
    out = np.zeros(256, np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


def _ends(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin and end."""
    step = np.diff(mark.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words(data: bytes, kind: np.ndarray, fold: np.ndarray = SAME, seed: int = 0) -> Words:
    """The words of data, hashed as `fold` makes their bytes. Works in blocks that end between words, so memory beside the result is bounded."""
    buf = np.frombuffer(data, np.uint8)
    found: list[Words] = []
    begin = before = 0
    while begin < len(buf):
        block = buf[begin : begin + BLOCK]
        sort = kind[block]
        if begin + len(block) < len(buf) and sort[-1] == WORD:
            gaps = np.flatnonzero(sort)
            if not len(gaps):
                stop = begin + len(block)
                while stop < len(buf) and kind[buf[stop]] == WORD:
                    rest = np.flatnonzero(kind[buf[stop : stop + BLOCK]])
                    stop = stop + int(rest[0]) if len(rest) else min(len(buf), stop + BLOCK)
                digest = hashlib.blake2b(fold[buf[begin:stop]].tobytes(), digest_size=8, key=str(seed).encode()).digest()
                found.append(Words(np.array([begin]), np.array([stop]), np.frombuffer(digest, np.uint64) | np.uint64(1), np.array([before])))
                begin = stop
                continue
            block, sort = block[: gaps[-1] + 1], sort[: gaps[-1] + 1]
        start, end = _ends(sort == WORD)
        up, down = powers(len(block) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((fold[block].astype(np.uint64) + np.uint64(seed * 2 + 1)) * down[: len(block)], dtype=np.uint64)))
        value = mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64) * np.uint64(BASE)) | np.uint64(1)
        passed = np.cumsum(sort == BREAK)
        found.append(Words(start + begin, end + begin, value, before + passed[start] if len(start) else start))
        before += int(passed[-1])
        begin += len(block)
    if not found:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none)
    return found[0] if len(found) == 1 else Words(*[np.concatenate(x) for x in zip(*found, strict=True)])
