"""Token ids of many texts at once with a word-level byte-pair vocabulary file (lower case, word ends, white space dropped).

Texts of plain Latin letters are handled with array operations: words are found and hashed together, each distinct word is
merged once, and its ids are copied to its occurrences. Any other text, any with a word of more than 64 letters, and any that
holds the string of a special token, goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from voxframe.llm.text import POINTS, code_points, lower, mix, powers

SPACE, LETTER, NUMBER, MARK, FOREIGN = range(5)
TABLE_BITS = 18
LAST_LATIN = 0x17F
#: Letters of a word up to which words are merged together; merging takes a round a letter.
LONG_WORD = 64


class Vocabulary(NamedTuple):
    tokenizer: object
    special: tuple[str, ...]  #: lower-case strings of the file's own tokens, which the library looks for in texts
    symbol: np.ndarray  #: id of each byte inside a word
    final: np.ndarray  #: id of each byte at a word's end
    key: np.ndarray  #: hash table of mergeable pairs, -1 where empty
    rank: np.ndarray
    merged: np.ndarray


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key.astype(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    special = tuple({t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()})
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    # The visible stand-in of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    char = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + k) for k, b in enumerate(hidden)}
    end = model["end_of_word_suffix"]
    symbol, final = (np.array([ids[char[b] + s] for b in range(256)], np.int64) for s in ("", end))
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
    table, rank, merged = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, 1 << 30, np.int64), np.zeros(1 << TABLE_BITS, np.int64)
    for r, (k, at, (a, b)) in enumerate(zip(keys.tolist(), _slot(keys).tolist(), pairs, strict=True)):
        while table[at] >= 0 and table[at] != k:
            at = at + 1 & (1 << TABLE_BITS) - 1
        if table[at] < 0:
            table[at], rank[at], merged[at] = k, r, ids[a + b]
    return Vocabulary(tokenizer, special, symbol, final, table, rank, merged)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point; FOREIGN ones (and the apostrophe, which starts suffixes) are left to the library."""
    out = np.full(POINTS, FOREIGN, np.uint8)
    for p in range(LAST_LATIN + 1):
        c = chr(p)
        if c in " \t\n\r":
            out[p] = SPACE
        elif 33 <= p <= 126 and c != "'":
            out[p] = NUMBER if c.isdigit() else LETTER if c.isalpha() else MARK
        elif p >= 0xC0 and unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c.lower()):
            out[p] = LETTER
    return out


def _merge(symbols: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair merging of all words together: each round merges, in every word, the leftmost pair of the lowest rank."""
    done_symbols, done_words = [], []
    while len(symbols):
        key = np.append(symbols[:-1] << 16 | symbols[1:], 0)
        inside = np.append(word[1:] == word[:-1], False)
        at = _slot(key)
        rank, fresh = np.full(len(key), 1 << 30, np.int64), np.zeros(len(key), np.int64)
        open_ = np.flatnonzero(inside)
        while len(open_):
            here = v.key[at[open_]]
            hit = open_[here == key[open_]]
            rank[hit], fresh[hit] = v.rank[at[hit]], v.merged[at[hit]]
            open_ = open_[(here != key[open_]) & (here >= 0)]
            at[open_] = at[open_] + 1 & (1 << TABLE_BITS) - 1
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.minimum.reduceat(rank << 24 | np.arange(len(rank)) - np.repeat(first, np.diff(np.append(first, len(rank)))), first)
        active = best >> 24 < 1 << 30
        going = np.repeat(active, np.diff(np.append(first, len(rank))))
        if not active.all():
            done_symbols.append(symbols[~going])
            done_words.append(word[~going])
        left = (first + (best & (1 << 24) - 1))[active]
        symbols[left] = fresh[left]
        going[left + 1] = False
        symbols, word = symbols[going], word[going]
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... for size[0] places, then the same from begin[1], and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def encode(texts: Sequence[str], path: str) -> list[np.ndarray]:
    """The ids of each text (uint32) as the library gives them: none added, strings of special tokens in a text are these tokens."""
    v = vocabulary(path)
    out = [np.zeros(0, np.uint32)] * len(texts)
    chars = code_points("\n".join(texts))
    kind = kinds()[chars]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    if not len(chars):
        return out
    owner = lambda at: np.searchsorted(begin, at, "right") - 1
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) + 1
    start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(chars)]))
    kept = kind[start] != SPACE
    start, end = start[kept], end[kept]
    named = [k for k, t in enumerate(texts) if any(x in t.lower() for x in v.special)]
    foreign = np.unique(np.concatenate((owner(np.flatnonzero(kind == FOREIGN)), owner(start[end - start > LONG_WORD]), named))).astype(np.int64)
    if len(foreign):
        for k, e in zip(foreign, v.tokenizer.encode_batch_fast([texts[k] for k in foreign], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        own = ~np.isin(owner(start), foreign)
        start, end = start[own], end[own]
    if not len(start):
        return out
    small = lower()[chars]
    up, down = powers(len(chars))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((small + np.uint64(1)) * down[: len(chars)], dtype=np.uint64)))
    _, first, which = np.unique(mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64)), return_index=True, return_inverse=True)
    size = (end - start)[first]
    letters, word = small[_spread(start[first], size)].astype(np.int64), np.repeat(np.arange(len(first)), size)
    wide = letters >= 128
    byte = np.repeat(letters, 1 + wide)
    place = np.cumsum(1 + wide) - (1 + wide)
    byte[place[wide]] = 0xC0 | letters[wide] >> 6
    byte[place[wide] + 1] = 0x80 | letters[wide] & 63
    word = np.repeat(word, 1 + wide)
    last = np.append(word[1:] != word[:-1], True)
    symbols, word = _merge(np.where(last, v.final[byte], v.symbol[byte]), word, v)
    many = np.bincount(word, minlength=len(first))
    many, base = many[which], (np.cumsum(many) - many)[which]
    ids = symbols[_spread(base, many)].astype(np.uint32)
    doc = np.searchsorted(begin, start, "right") - 1
    ends = np.cumsum(np.bincount(doc, many, minlength=len(texts)).astype(np.int64))
    plain = np.ones(len(texts), bool)
    plain[foreign] = False
    for k in np.flatnonzero(plain):
        out[k] = ids[ends[k - 1] if k else 0 : ends[k]]
    return out
