"""Phrases whose words occur together more often than their parts would by chance: best-first branch and bound over prefixes and suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.llm.bytewords import LOWER, kinds, words
from voxframe.llm.common import Scratch, cut
from voxframe.llm.text import BASE, mix, slices

KIND = kinds(b" \t", b".,;:!?\n\v\f\r")
UNKNOWN = "und"
LONGEST, LEAST, BEST = 5, 100, 2000
#: Texts read at once, in bytes; words of an encoded row, unless a piece is longer, and those counted together. Spark hands
#: 10,000 rows to a Python worker at once, so rows are small: some 10 MB at once.
SLICE, ROW, GROUP = 1 << 20, 1 << 7, 1 << 18
#: Rows of counts that a Python worker hands back at once.
HANDED = 1 << 15
#: Texts taken from a batch at once, and distinct words that a task holds before it hands their counts on.
ROWS, HELD = 1 << 9, 1 << 17
#: Share of all word occurrences that the first frontier's words have; each later one's has four times as many.
SHARE = 1 / 4
#: Bits of a filter for each key, and bits at most (16 MB); a fuller filter lets more through, which costs time and changes nothing.
BITS_PER_KEY, MOST_BITS = 32, 1 << 27


def lang_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def rows_of(ids: np.ndarray) -> list[bytes]:
    """The ids in rows of about ROW words that end at breaks (zeros, which are left out at the ends)."""
    zeros = np.flatnonzero(ids == 0)
    ends = zeros[np.unique(np.searchsorted(zeros, np.arange(ROW, len(ids), ROW)).clip(max=max(len(zeros) - 1, 0)))] if len(zeros) else zeros
    return [row.tobytes() for row in (ids[a:b] for a, b in zip([0, *(ends + 1)], [*ends, len(ids)], strict=True)) if len(row)]


def _handed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of HANDED rows."""
    return (batch.slice(k, HANDED) for k in range(0, batch.num_rows, HANDED))


def _encode(seed: int):
    """Texts as rows of word hashes (0: a break that no phrase crosses) and rows of word counts."""
    names = ["lang", "ids", "word", "h", "c"]

    def encoded(lang: str, ids: list[bytes]) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(ids, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

    def counted(held: dict[tuple[str, bytes], list[int]]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held]), pa.nulls(n, pa.binary()), pa.array([k[1] for k in held], pa.binary()).cast(pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for part in slices([len(t) for t in texts], SLICE, 1 << 16):
                    data = b"\n".join(texts[part])
                    w = words(data, KIND, LOWER, seed)
                    if not len(w.start):
                        continue
                    gap = np.flatnonzero(np.diff(w.breaks)) + 1
                    ids = np.insert(w.hash, gap, 0)
                    yield encoded(lang, rows_of(ids))
                    value, at, n = np.unique(w.hash, return_index=True, return_counts=True)
                    lower = data.lower()
                    for h, s, e, c in zip(value.view(np.int64).tolist(), w.start[at].tolist(), w.end[at].tolist(), n.tolist(), strict=True):
                        entry = held.setdefault((lang, lower[s:e]), [h, 0])
                        entry[1] += c
                    if len(held) > HELD:
                        yield from _handed(counted(held))
                        held = {}
        if held:
            yield from _handed(counted(held))

    return run


def _chain(ids: np.ndarray, m: int, salt: int) -> np.ndarray:
    """A hash of each m ids in a row."""
    n = max(0, len(ids) - m + 1)
    value = np.full(n, salt, np.uint64)
    for k in range(m):
        value = mix(value * np.uint64(BASE) + ids[k : k + n])
    return value


class Filter:
    """A fixed number of bits, at most MOST_BITS, in which the keys put in are set, and few others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.last = bits, np.uint64(len(bits) * 64 - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.last
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def make_filter(grams: DataFrame, n: int) -> Filter:
    """Of n rows (lang, p): the bits of their hashes, put together by tasks and groups; at most MOST_BITS come to the driver."""
    size = min(MOST_BITS, max(1 << 12, 1 << (n * BITS_PER_KEY).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            m = np.diff(lists.offsets.to_numpy())
            flat, first = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()[:-1]
            salt = {x: lang_salt(x) for x in set(batch.column(0).to_pylist())}
            value = np.array([salt[x] for x in batch.column(0).to_pylist()], np.uint64)
            for k in range(int(m.max(initial=0))):
                own = m > k
                value[own] = mix(value[own] * np.uint64(BASE) + flat[first[own] + k])
            at = value & np.uint64(size - 1)
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    bits = np.zeros(size // 64, np.uint64)
    got = grams.select("lang", "p").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return Filter(bits)


def _grouped(encoded: DataFrame, work, schema: str) -> DataFrame:
    """work(lang, ids) over the encoded rows, some of a language at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytearray] = {}
        for batch in batches:
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = held.setdefault(lang, bytearray())  # a copy, so that no batch is kept by a row of it
                rows += ids.as_buffer()
                rows += bytes(8)
                if len(rows) > 8 * GROUP:
                    yield from work(lang, np.frombuffer(held.pop(lang), np.uint64))
        for lang, rows in held.items():
            yield from work(lang, np.frombuffer(rows, np.uint64))

    return encoded.mapInArrow(run, schema)


def _pairs(ids: np.ndarray, salt: int, frequent: Filter, open_: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words follow each other of which one is open, and for each word whether it is open."""
    one = _chain(ids, 1, salt)
    opened = open_.holds(one) & (ids != 0)
    at = np.flatnonzero(opened)
    near = np.zeros(len(ids), bool)
    near[at] = near[at[at > 0] - 1] = True
    at = np.flatnonzero(near[:-1])
    for k in (0, 1):
        at = at[opened[at + k] | ((ids[at + k] != 0) & frequent.holds(one[at + k]))]
    return at, opened


def _counted(lang: str, ids: np.ndarray, at: np.ndarray, m: int, salt: int) -> Iterator[pa.RecordBatch]:
    """How often each phrase of the m words from the places `at` on occurs there."""
    if not len(at):
        return
    key = np.full(len(at), salt, np.uint64)
    for k in range(m):
        key = mix(key * np.uint64(BASE) + ids[at + k])
    order = np.argsort(key)
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    for k in range(m):  # equal keys of different words stay apart
        same &= ids[at[1:] + k] == ids[at[:-1] + k]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    columns = [pa.array(ids[at[first] + k].view(np.int64)) for k in range(m)]
    name = pa.DictionaryArray.from_arrays(np.zeros(len(first), np.int32), [lang]).cast(pa.string())
    yield from _handed(pa.RecordBatch.from_arrays([name, *columns, pa.array(np.diff(np.append(first, len(at))).astype(np.int64))], names=["lang", *[f"w{k}" for k in range(m)], "c"]))


def _summed(encoded: DataFrame, work, m: int) -> DataFrame:
    names = [f"w{k}" for k in range(m)]
    parts = _grouped(encoded, work, ", ".join(["lang string", *[f"{w} long" for w in names], "c long"]))
    return parts.groupBy("lang", *names).agg(F.sum("c").alias("f")).select("lang", F.array(*names).alias("p"), "f")


def count_pairs(encoded: DataFrame, frequent: Filter, open_: Filter) -> DataFrame:
    """lang, p (two word hashes), f of the pairs of frequent words of which one is open."""

    def work(lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        salt = lang_salt(lang)
        yield from _counted(lang, ids, _pairs(ids, salt, frequent, open_)[0], 2, salt)

    return _summed(encoded, work, 2)


def stretches(encoded: DataFrame, frequent: Filter, open_: Filter, pairs: Filter, longest: int) -> DataFrame:
    """The encoded rows without what no phrase of three words or more can hold: left are `longest` words from each frequent pair that begins with an open word on, and as many up to each that ends with one."""

    def work(lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        salt = lang_salt(lang)
        at, opened = _pairs(ids, salt, frequent, open_)
        at = at[pairs.holds(_chain(ids, 2, salt)[at])]
        edge = np.zeros(len(ids) + 1, np.int64)
        for starts in (at[opened[at]], np.maximum(at[opened[at + 1]] + 2 - longest, 0)):
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(starts + longest, len(ids)), -1)
        kept = np.cumsum(edge[:-1]) > 0
        if kept.any():
            some = np.where(kept, ids, 0)[kept | np.concatenate(([False], kept[:-1]))]
            rows = rows_of(some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(rows, pa.binary())], names=["lang", "ids"])

    return _grouped(encoded, work, "lang string, ids binary")


def count_grams(encoded: DataFrame, m: int, open_: Filter, shorter: Filter) -> DataFrame:
    """lang, p (m word hashes), f of the phrases that begin or end with an open word and may be frequent: those that begin with one are so without their last word, those that end with one without their first."""

    def work(lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(ids) - m + 1
        if n <= 0:
            return
        salt = lang_salt(lang)
        opened = open_.holds(_chain(ids, 1, salt)) & (ids != 0)
        whole = opened[:n] | opened[m - 1 :]
        for k in range(m):
            whole &= ids[k : k + n] != 0
        at, known = np.flatnonzero(whole), shorter.holds(_chain(ids, m - 1, salt))
        yield from _counted(lang, ids, at[(~opened[at] | known[at]) & (~opened[at + m - 1] | known[at + 1])], m, salt)

    return _summed(encoded, work, m)


def _scores(grams: DataFrame, one: DataFrame, state: DataFrame) -> DataFrame:
    """lang, p, a, l, r, n, score of the phrases of two words or more that begin and end with an open word and lie in no longer one of the same count.

    grams: lang, p, f of phrases of 1 to 5 words; one: lang, w, f, word, limit of the words. A cut's parts are looked up by
    joins; a phrase x has at most f(x) / 100 frequent extensions, so no key of these joins has more rows than that.
    """
    long = grams.filter(F.size("p") > 1)
    opened = one.filter(F.col("f") <= F.col("limit")).select("lang", "w")
    ends = long.withColumns({"a_": F.element_at("p", 1), "b_": F.element_at("p", -1)})
    both = ends.join(opened.withColumnRenamed("w", "a_"), ["lang", "a_"], "left_semi").join(opened.withColumnRenamed("w", "b_"), ["lang", "b_"], "left_semi").select("lang", "p", "f")
    # What lies in a longer phrase of the same count: the longer one less its first or last word suffices.
    longer = long.filter(F.size("p") > 2)
    inner = longer.select("lang", F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "f")
    alive = both.join(inner, ["lang", "p", "f"], "left_anti")
    cuts = alive.select("lang", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    parts = cuts.select("lang", "p", "a", "k", F.expr("slice(p, 1, k)").alias("left"), F.expr("slice(p, k + 1, size(p) - k)").alias("right"))
    got = parts.join(grams.select("lang", F.col("p").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(grams.select("lang", F.col("p").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    priced = got.join(state.select("lang", "n"), "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), "down": big("l") * big("r")}).withColumn("score", F.expr("up div down"))
    best = priced.groupBy("lang", "p").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "p", "b.a", "b.l", "b.r", "b.n", "b.score")


def _winners(scored: DataFrame, most: int) -> DataFrame:
    """The `most` best of each language and all that tie with the last of them.

    Scores are first counted in 64 ranges for each factor of 2, so that only what may be among the best is ranked: a language's
    phrases never come together in one task.
    """
    size = F.floor(F.log2(F.col("score") + 1) * 64).alias("size")
    counts = scored.groupBy("lang", size).agg(F.count("*").alias("c"))
    above = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut_ = above.filter(F.col("before") < most).groupBy("lang").agg(F.min("size").alias("least"))
    near = scored.join(cut_, "lang").filter(F.floor(F.log2(F.col("score") + 1) * 64) >= F.col("least")).drop("least")
    # Within the last range the exact score counts: distinct scores and how many phrases have each.
    each = near.groupBy("lang", "score").agg(F.count("*").alias("c"))
    run = each.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = run.filter(F.col("before") < most).groupBy("lang").agg(F.min("score").alias("last"))
    return near.join(last, "lang").filter(F.col("score") >= F.col("last")).drop("last")


def phrase_collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, longest: int = LONGEST, share: float = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` collocations of 2 to `longest` words that occur at least `least` times.

    Texts are lower-cased (A-Z), cut at .,;:!? and the control characters 10 to 13 into pieces, these at blanks and tabs into
    words. a is a phrase's count, n that of all words of the language; cutting the phrase in two gives l and r, the counts of
    the parts, and the score floor(1000 a n / (l r)); the lowest cut counts, the first of equal ones. Phrases within a longer
    candidate of the same count are left out. Ranks go by score and count downwards, then by phrase in byte order. A null
    lang is `und`; null texts are empty; repeated rows count each; an empty table gives an empty one; more columns are left out.

    A part of a phrase occurs at least as often as the phrase, so no phrase that begins or ends with the word w scores more
    than 1000 n / f(w). The frontier opens each language's rarest words first: phrases grow from them word by word while they
    stay frequent (prefixes to the right, suffixes to the left), and the best are scored. A language is settled once its
    2000th surviving score is above the bound of every word not open yet; if it has that many but is not, the frontier is set
    to exactly those words whose bound reaches that score; if it has fewer, the frontier takes in four times the occurrences.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    with Scratch(spark) as scratch:
        for seed in range(8):  # word hashes of 64 bits are checked to be distinct; the first seed does, but for one corpus in millions
            raw = scratch.cut(own.mapInArrow(_encode(seed), "lang string, ids binary, word string, h long, c long"))
            vocabulary = raw.filter("word IS NOT NULL").groupBy("lang", F.col("h").alias("w"), "word").agg(F.sum("c").alias("f"))
            vocabulary = scratch.cut(vocabulary.withColumn("size", F.floor(F.log2("f"))))
            if not vocabulary.groupBy("lang", "w").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
                break
        encoded = raw.filter("ids IS NOT NULL").select("lang", "ids")
        sizes = vocabulary.groupBy("lang", "size").agg(F.sum("f").alias("c"), F.max("f").alias("f"))
        totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
        words_ = scratch.cut(vocabulary.filter(F.col("f") >= least).select("lang", "w", "f", "word"))
        n_words = words_.count()
        frequent = make_filter(words_.select("lang", F.array("w").alias("p")), n_words)
        state = scratch.cut(_limits(sizes, totals, F.lit(share)))
        done: list[DataFrame] = []
        while n_words:
            one = words_.join(state.select("lang", "limit"), "lang")
            opened = one.filter(F.col("f") <= F.col("limit")).select("lang", F.array("w").alias("p"))
            going = encoded.join(F.broadcast(state.select("lang")), "lang", "left_semi") if done else encoded
            open_, rows, levels = make_filter(opened, n_words), going, [words_.select("lang", F.array("w").alias("p"), "f")]
            for m in range(2, longest + 1):
                counts = count_pairs(rows, frequent, open_) if m == 2 else count_grams(rows, m, open_, shorter)
                level = scratch.cut(counts.filter(F.col("f") >= least))
                size = level.count()
                levels.append(level)
                if not size or m == longest:
                    break
                shorter = make_filter(level, size)
                if m == 2:
                    rows = scratch.cut(stretches(going, frequent, open_, shorter, longest))
            grams = levels[0]
            for level in levels[1:]:
                grams = grams.unionByName(level)
            scored = scratch.cut(_scores(grams, one, state))
            top = scratch.cut(_winners(scored, best))
            got = top.groupBy("lang").agg(F.count("*").alias("found"), F.min("score").alias("last"))
            closed = one.filter(F.col("f") > F.col("limit")).groupBy("lang").agg(F.min("f").alias("next"))
            now = state.join(closed, "lang", "left").join(got, "lang", "left").withColumn("found", F.coalesce("found", F.lit(0)))
            full = F.col("found") >= best
            # f(w) opens every word whose bound, floor(1000 n / f), reaches the last score.
            bound = F.expr("cast(1000 as decimal(4,0)) * cast(n as decimal(19,0)) div next")
            settled = F.col("next").isNull() | (full & (bound < F.col("last")))
            now = scratch.cut(now.withColumn("settled", settled).withColumn("full", full))
            ended = now.filter("settled").select("lang")
            done.append(cut(top.join(F.broadcast(ended), "lang", "left_semi")))
            if not now.filter("NOT settled").limit(1).count():
                break
            exact = F.expr("cast(1000 as decimal(4,0)) * cast(n as decimal(19,0)) div last")
            wider = _limits(sizes, totals, F.lit(1.0) * F.col("share") * 4, now.filter("NOT settled").select("lang", "share"))
            state = scratch.cut(now.filter("NOT settled").select("lang", F.when(F.col("full"), exact).alias("exact")).join(wider, "lang").withColumn("limit", F.coalesce("exact", F.greatest("limit", F.lit(0)))).drop("exact"))
        found = done[0] if done else spark.createDataFrame([], "lang string, p array<long>, a long, l long, r long, n long, score long")
        for more in done[1:]:
            found = found.unionByName(more)
        place = found.select("*", F.posexplode("p").alias("at", "w"))
        text = place.join(words_.select("lang", "w", "word"), ["lang", "w"]).groupBy("lang", "p", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = text.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
        return cut(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _limits(sizes: DataFrame, totals: DataFrame, share, only: DataFrame | None = None) -> DataFrame:
    """lang, n, share, limit: the least count, among the largest of each power of 2, up to which words make up the share of all occurrences."""
    own = totals if only is None else totals.join(only, "lang")
    asked = own.withColumn("share", F.least(share, F.lit(1.0)))
    below = sizes.withColumn("upto", F.sum("c").over(Window.partitionBy("lang").orderBy("size")))
    return below.join(asked, "lang").filter(F.col("upto") >= F.col("share") * F.col("n")).groupBy("lang", "n", "share").agg(F.min("f").alias("limit"))


ORACLE_SQL = rf"""
WITH t AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
g AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS p FROM s, range(1, {LONGEST + 1}) a(m), unnest(range(1, len(w) - m + 2)) b(i)),
c AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
d AS (SELECT DISTINCT lang, m - 1 AS m, unnest([list_slice(p, 1, m - 1), list_slice(p, 2, m)]) AS p, f FROM c WHERE m > 2),
x AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN n USING (lang) CROSS JOIN range(1, {LONGEST}) b(k)
 JOIN c l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, k) JOIN c r ON r.lang = c.lang AND r.p = list_slice(c.p, k + 1, c.m) WHERE k < c.m AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.p = c.p AND d.f = c.f)),
b AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score FROM b)
SELECT * FROM o WHERE rank <= {BEST}
"""
