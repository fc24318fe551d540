"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import cut
from voxframe.llm.text import slices
from voxframe.llm.tokenize import encode

CAPACITY = 4096
END = 1
ROWS_PER_GROUP = 200_000


class Segment(NamedTuple):
    """Documents rank_from to rank_to (without it) of one length: `each` to a bin, from bin `bin_from` on, behind `offset` tokens."""

    length: int
    rank_from: int
    rank_to: int
    bin_from: int
    each: int
    offset: int


class OpenBins:
    """A segment tree over remaining capacities; its leaves hold runs (first bin, number) of bins with that capacity left."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, left: int) -> None:
        node, self.some[self.leaves + left] = self.leaves + left, bool(self.runs[left])
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, left: int, first: int, many: int) -> None:
        if many and left:
            self.runs[left].append((first, many))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that an open bin has."""
        node = self.leaves + least
        while not self.some[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.some[2 * node])
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Segment], int]:
    """Where each document goes if all are taken longest first and put into the tightest open bin; and the number of bins.

    Documents of a length are alike and so are bins with as much room, so those that best fit would treat alike move
    together: a bin that is the tightest stays so until it has no room for the length. The number of segments follows the
    number of lengths, not of documents.
    """
    bins, segments, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = bins.take(room)
            each = room // length
            full = min(many, left // each)
            if full:
                segments.append(Segment(length, rank, rank + full * each, first, each, capacity - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            part = left if full < many and left < each else 0
            if part:
                segments.append(Segment(length, rank, rank + part, first + full, part, capacity - room))
                bins.add(room - part * length, first + full, 1)
                rank, left, full = rank + part, 0, full + 1
            bins.add(room, first + full, many - full)
    return segments, opened


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces: its ids and the end id, cut only if longer than capacity."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in slices([len(t) for t in texts], 1 << 21, 4096):
                rows = []
                for key, ids in zip(keys[s], encode(texts[s], tokenizer), strict=True):
                    whole = np.append(ids, np.uint32(END)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return slim.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with `length`, 1 to capacity) with `sequence_id` and `offset`: best-fit-decreasing over the whole table.

    The driver sees one count per length, at most `capacity` of them. A piece's place follows from its rank among those of
    its length; a frequent length is ranked in several groups. Pieces that repeat a key are told apart arbitrarily. An
    empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments, _ = best_fit_decreasing(counts, capacity)
    spark = pieces.sparkSession
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([s._asdict() for s in segments])), "array<struct<length:long,rank_from:long,rank_to:long,bin_from:long,each:long,offset:long>>")))
    groups = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"length": k, "groups": -(-n // ROWS_PER_GROUP)} for k, n in counts.items()])), "array<struct<length:long,groups:int>>")))
    grouped = pieces.join(F.broadcast(groups), "length").withColumn("__group", F.pmod(F.xxhash64(*key), F.col("groups")).cast("int")).drop("groups")
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grouped.groupBy("length", "__group").agg(F.count("*").alias("n")).select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__group").orderBy(*key)
    ranked = grouped.withColumn("__rank", F.row_number().over(within) - 1).join(sizes, ["length", "__group"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(table.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")))
    at = F.col("__rank") - F.col("rank_from")
    return placed.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], (F.col("bin_from") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("offset") + at % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequences and places; null text counts as empty and takes its end id's place only."""
    return pack_lengths(cut(tokenized_pieces(docs, tokenizer, capacity)), ["doc_id", "piece", "ids_crc32"], capacity)
