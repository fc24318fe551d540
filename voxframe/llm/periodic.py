"""Periodic runs of words within documents: recursive frequency splitting, then a scan of the surviving segments by lag."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.bytewords import kinds, words
from voxframe.llm.text import slices

SPACES = kinds(b" \t\n\v\f\r")
#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags up to which all words are compared; beyond, each lag's multiples come first.
DENSE = 8
SLICE = 1 << 21

Run = tuple[int, int, int]
RUNS = "array<struct<start:long,length:long,period:long>>"


def segments(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the stretches of words in which qualifying runs can lie.

    Each word of a run occurs at least four times in it. So words rarer than that within a document split it, words rarer
    within the parts split these, and so on until nothing changes; only parts that lost a word are looked at again.
    """
    pos, part, kept = np.arange(len(code)), doc, []
    size = int(code.max(initial=0)) + 1
    while len(pos):
        key = part * size + code[pos]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        counts = np.diff(first, append=len(pos))
        rare = np.empty(len(pos), bool)
        rare[order] = np.repeat(counts < LEAST_PERIODS, counts)
        split = np.bincount(part, rare)[part] > 0
        kept.append(pos[~split])
        going = split & ~rare
        pos, part = pos[going], part[going]
        if not len(pos):
            break
        part = np.cumsum(np.concatenate(([0], (np.diff(pos) != 1) | (np.diff(part) != 0))))
        enough = np.bincount(part) >= LEAST_WORDS
        pos, part = pos[enough[part]], (np.cumsum(enough) - 1)[part[enough[part]]]
    pos = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
    if not len(pos):
        return pos, pos
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(pos) != 1) | (np.diff(doc[pos]) != 0))))
    length = np.diff(begin, append=len(pos))
    return pos[begin][length >= LEAST_WORDS], length[length >= LEAST_WORDS]


def find_runs(code: np.ndarray, doc: np.ndarray) -> list[Run]:
    """(first word, length, period) of every qualifying run of the words `code`, none across documents.

    Periods are tried in order. A run of period q holds at least 3q words equal to the one q later, thus three multiples of
    q in a row: only words at multiples of q are compared, n/q of them, n log n for all lags. What lies wholly in a run of a
    smaller period has that period (by the theorem of Fine and Wilf) and is no run of this one.
    """
    start, length = segments(code, doc)
    if not len(start):
        return []
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    at = np.concatenate(([0], np.cumsum(length)))
    owner = np.repeat(np.arange(len(length)), length)
    text = code[np.arange(at[-1]) - np.repeat(at[:-1] - start, length)]
    reach = np.zeros(at[-1] + 1, np.int64)  # the furthest end of a run found so far that holds the word
    found: list[Run] = []

    def put(s: int, e: int, q: int) -> None:
        if reach[s] < e:
            np.maximum(reach[s:e], e, out=reach[s:e])
            k = owner[s]
            found.append((int(start[k] + s - at[k]), e - s, q))

    for q in range(1, int(length[0]) // LEAST_PERIODS + 1):
        total = at[np.searchsorted(-length, -max(LEAST_WORDS, LEAST_PERIODS * q), "right")]
        a, own = text[:total], owner[:total]
        if q <= DENSE:
            same = (a[:-q] == a[q:]) & (own[:-q] == own[q:])
            step = np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            long = e - s >= max(LEAST_WORDS, LEAST_PERIODS * q) - q
            for x, y in zip(s[long].tolist(), e[long].tolist(), strict=True):
                put(x, y + q, q)
            continue
        b = a[::q]
        same = b[:-1] == b[1:]
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(hit):
            continue
        p = hit * q
        p = p[(own[p] == own[p + 3 * q]) & (reach[p] <= p + 3 * q)]
        for t in (q // 2, q // 3, 2 * q - 1, q + q // 3):
            p = p[a[p + t] == a[p + q + t]]
        seen, last, breaks = 0, -1, None
        for x in p.tolist():
            if x < seen:
                continue
            lo, hi = int(at[own[x]]), int(at[own[x] + 1])
            if lo != last:
                last, breaks = lo, np.flatnonzero(a[lo : hi - q] != a[lo + q : hi])
            k = int(np.searchsorted(breaks, x - lo))
            s, e = lo + (int(breaks[k - 1]) + 1 if k else 0), lo + int(breaks[k]) if k < len(breaks) else hi - q
            seen = e + 1
            if e - s >= (LEAST_PERIODS - 1) * q:
                put(s, e + q, q)
    return found


def document_runs(texts: list[bytes]) -> list[list[Run]]:
    """Each text's runs by start, then period. Words are told apart by hash; runs are held against the words themselves, and should two words share a hash, all is done again with exact numbers."""
    data = b"\n".join(texts)
    w = words(data, SPACES)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)))
    doc = np.searchsorted(begin, w.start, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    code = np.unique(w.hash, return_inverse=True)[1]
    runs = find_runs(code, doc)
    bounds = list(zip(w.start.tolist(), w.end.tolist(), strict=True)) if runs else []
    text = lambda i: data[bounds[i][0] : bounds[i][1]]
    if any(text(i) != text(i + q) for s, n, q in runs for i in range(s, s + n - q)):
        numbers: dict[bytes, int] = {}
        runs = find_runs(np.array([numbers.setdefault(data[s:e], len(numbers)) for s, e in bounds]), doc)
    out: list[list[Run]] = [[] for _ in texts]
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        d = int(doc[s])
        out[d].append((s - int(first[d]), n, q))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(text: bytes, runs: list[Run]) -> bytes:
    """The text's words, joined by one space, without those that any run holds after its first period."""
    found = text.split()
    if runs:
        gone = np.zeros(len(found) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        found = [found[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(found)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), strongest, collapsed: each document's periodic runs of words and its text without their repetitions.

    Words are separated by blanks and the control characters 9 to 13. A run is a stretch of words with smallest period q, at
    least max(6, 4q) long, that no neighbouring word extends; `strongest` is that of the greatest length / period (null
    without runs). A null text is an empty one, with no words. Rows are independent: repeated rows give repeated results, null
    ids stay null, an empty table gives an empty one, more columns are left out. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for part in slices([len(t) for t in texts], SLICE, 1 << 16):
                own = texts[part]
                runs = document_runs(own)
                keys = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part], pa.array([len(t.split()) for t in own], pa.int64()), pa.array([[dict(zip(keys, r, strict=True)) for r in rs] for rs in runs], pa.list_(pa.struct([(k, pa.int64()) for k in keys]))),
                        pa.array([(lambda b: dict(zip(keys, b, strict=True)) if b else None)(strongest(rs)) for rs in runs], pa.struct([(k, pa.int64()) for k in keys])), pa.array([collapse(t, rs) for t, rs in zip(own, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs {RUNS}, strongest struct<start:long,length:long,period:long>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document of ten, by its id's check sum, gets its words from some place on repeated with a period that grows with its length; others (and rows without id) stay as they are."""

    def planted(doc_id: int | None, text: bytes | None) -> bytes | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not text:
            return text
        w, g = text.split(), h // 10
        if not w:
            return text
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return b" ".join(w[:a] + [w[a + i % p] for i in range(len(w) - a)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [planted(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def run_report(docs: DataFrame) -> DataFrame:
    """periodic_runs over with_planted_runs, as numbers and digests."""
    out = periodic_runs(with_planted_runs(docs))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
