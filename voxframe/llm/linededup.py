"""Removal of lines that many documents share: hashes dealt by range, sorted by document within, read once as a stream; the result is a bitmap of kept lines for each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import Scratch, cut

STRIPPED = b" \t\n\v\f\r"
#: Code points from which on a line counts, and documents from which on it is repeated.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Stands for a null doc_id in the order of documents.
NO_ID = -(1 << 63)
ENTRY = "h1 long, h2 long, doc_id long, text_key long, lines array<int>, n_lines int"


def _entries(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h1", "h2", "doc_id", "text_key", "lines", "n_lines")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32())

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        rows: list[tuple] = []
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                rows.append((None, None, doc, key, None, len(lines)))
                places: dict[bytes, list[int]] = {}
                for k, line in enumerate(lines):
                    if len(line) >= chars and len(s := line.strip(STRIPPED)) >= chars and (s.isascii() or len(s.decode()) >= chars):
                        places.setdefault(s.lower(), []).append(k)  # bytes.lower changes A-Z only
                for s, at in places.items():
                    h = np.frombuffer(xxhash.xxh3_128_digest(s), np.int64)
                    rows.append((int(h[0]), int(h[1]), doc, key, at, None))
                if len(rows) >= 1 << 14:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return run


def _stream(least: int):
    """Reads entries in the order (h1, h2, doc_id downwards, text_key): for each line's run those after its first document, once it is known to have enough documents.

    Only the rows of a run's first few documents wait for that; what follows is decided as it comes. The run that a partition
    begins with may have begun in the one before: its rows come out undecided. The one that it ends with may go on in the
    next: its rows, or marks of its first documents where it is decided already, come out undecided too.
    """
    names = ["h1", "h2", "doc_id", "text_key", "lines", "decided"]

    def told(t: pa.Table, decided: bool) -> list[pa.RecordBatch]:
        return t.append_column("decided", pa.array(np.full(t.num_rows, decided))).select(names).to_batches() if t.num_rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        first, before = True, None
        held: list[pa.Table] = []  # rows of the current run that wait
        heads: list[int] = []  # its first documents

        def feed(t: pa.Table, docs: np.ndarray) -> list[pa.RecordBatch]:
            fresh = docs[np.concatenate(([not heads or docs[0] != last], np.diff(docs) != 0))]
            heads.extend(fresh[: least - len(heads)].tolist())
            if first:
                return told(t, False)
            held.append(t)
            if len(heads) < least:
                return []
            rows = pa.concat_tables(held)
            held.clear()
            return told(rows.filter(pa.array(rows["doc_id"].to_numpy() != heads[0])), True)

        last, schema = 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            schema = t.schema
            columns = np.stack([t[c].to_numpy() for c in ("h1", "h2", "doc_id", "text_key")])
            fresh = np.concatenate(([before is None or bool((columns[:, 0] != before).any())], (np.diff(columns, axis=1) != 0).any(axis=0)))
            before = columns[:, -1].copy()
            if not fresh.all():
                t, columns = t.filter(pa.array(fresh)), columns[:, fresh]
            if not t.num_rows:
                continue
            h1, h2, docs, _ = columns
            begin = np.flatnonzero(np.concatenate(([True], (np.diff(h1) != 0) | (np.diff(h2) != 0))))
            end = np.append(begin[1:], len(h1))
            if key is not None and key != (h1[0], h2[0]):
                first = False
                held.clear()
                heads.clear()
            yield from feed(t.slice(0, end[0]), docs[: end[0]])
            if len(begin) > 1:
                first = False
                held.clear()
                heads.clear()
                a, b = begin[1], begin[-1]
                if b > a:  # runs that lie in this batch
                    own = docs[a:b]
                    start = begin[1:-1] - a
                    starts = np.zeros(b - a, bool)
                    starts[start] = True
                    new = starts | np.concatenate(([True], np.diff(own) != 0))
                    size = np.diff(np.append(start, b - a))
                    lost = np.repeat(np.add.reduceat(new.astype(np.int64), start) >= least, size) & (own != np.repeat(own[start], size))
                    yield from told(t.slice(a, b - a).filter(pa.array(lost)), True)
                yield from feed(t.slice(b), docs[b:])
            key, last = (h1[-1], h2[-1]), int(docs[-1])
        if key is not None and not first:
            for rows in held:
                yield from told(rows, False)
            if not held:
                marks = {"h1": [int(key[0])] * len(heads), "h2": [int(key[1])] * len(heads), "doc_id": heads}
                yield from told(pa.table([pa.array(marks.get(f.name, [None] * len(heads)), f.type) for f in schema], schema=schema), False)

    return run


def repeated_lines(docs: DataFrame, scratch: Scratch, chars: int = LEAST_CHARS, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, lines: the lines that each document loses; and doc_id, text_key, n_lines of every document."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    entries = scratch.cut(own.mapInArrow(_entries(chars), ENTRY))
    sizes = entries.filter("n_lines IS NOT NULL").select("doc_id", "text_key", "n_lines")
    lines = entries.filter("h1 IS NOT NULL").select("h1", "h2", "doc_id", "text_key", "lines")
    order = ["h1", "h2", F.desc("doc_id"), "text_key"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = scratch.cut(dealt.mapInArrow(_stream(least), "h1 long, h2 long, doc_id long, text_key long, lines array<int>, decided boolean"))
    # Only runs at the ends of partitions, two for each: few enough to broadcast, whatever the input.
    open_ = seen.filter("NOT decided")
    runs = open_.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).filter(F.col("n") >= least)
    late = open_.filter("lines IS NOT NULL").join(F.broadcast(runs), ["h1", "h2"]).filter(F.col("doc_id") < F.col("top"))
    lost = seen.filter("decided").select("doc_id", "text_key", "lines").unionByName(late.select("doc_id", "text_key", "lines"))
    return lost, sizes


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, lost in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for at in lost:
                keep[at] = False
            rows.append((int(n - keep.sum()), zlib.compress(np.packbits(keep).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([int(x) for x in batch.column(2).to_pylist()], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])


def unpack(keep: bytes, n: int) -> np.ndarray:
    """The flags of a bitmap of n lines."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, chars: int = LEAST_CHARS, least: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_key, n_lines, n_dropped, keep: for each document a compressed bitmap (zlib over packed bits) of the lines that stay; no text is moved.

    A line's key is the line without blanks and control characters 9 to 13 at its ends, A-Z in lower case. Keys of at least
    `chars` code points that at least `least` documents hold lose all their lines but those of the largest doc_id. Documents
    are told apart by doc_id; a null one (written as -2^63 here) is the smallest. Rows that share a doc_id count as one
    document, and each text of it has a bitmap of its own (text_key is its xxhash64), rows equal in both share one. A null or
    empty text is one empty line. An empty table gives an empty one; more columns are left out.

    Only hashes, ids and line numbers are shuffled. Ranges cut by (hash, document) spread a line that a third of all
    documents hold over many tasks; each task reads its rows once and keeps those of a line's first documents at most.
    """
    with Scratch(docs.sparkSession) as scratch:
        lost, sizes = repeated_lines(docs, scratch, chars, least)
        both = sizes.select("doc_id", "text_key", "n_lines", F.lit(None).cast("array<int>").alias("lines")).unionByName(lost.select("doc_id", "text_key", F.lit(None).cast("int").alias("n_lines"), "lines"))
        per = both.groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("lines").alias("lost"))
        return cut(per.mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and `kept`, the text of the lines that their bitmaps keep."""
    key = {"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__text": F.xxhash64("text")}
    own = docs.drop("n_lines", "n_dropped", "keep", "kept").withColumns(key)
    joined = own.join(bitmaps.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), "n_lines", "n_dropped", "keep"), ["__doc", "__text"]).drop("__doc", "__text")
    names = [*joined.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(names)}
            texts = []
            for text, n, gone, keep in zip(get["text"].cast(pa.binary()).to_pylist(), get["n_lines"].to_pylist(), get["n_dropped"].to_pylist(), get["keep"].to_pylist(), strict=True):
                text = text or b""
                texts.append(b"\n".join([x for x, k in zip(text.split(b"\n"), unpack(keep, n).tolist(), strict=True) if k]) if gone else text)
            yield pa.RecordBatch.from_arrays([*[get[n] for n in names if n != "keep"], pa.array(texts, pa.binary()).cast(pa.string())], names=[*[n for n in names if n != "keep"], "kept"])

    schema = ", ".join(f"`{n}` {t}" for n, t in joined.dtypes if n != "keep")
    return joined.mapInArrow(run, f"{schema}, kept string")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of each document."""
    narrow = docs.select("doc_id", "text")
    return kept_lines(narrow, keep_bitmaps(narrow)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.top AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
