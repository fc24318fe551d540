"""Near-duplicate classes by BagMinHash signatures over word shingles, banding and exact multiset verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import Scratch, cut
from voxframe.llm.text import WORD, grams, mix, slices, tokens

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6  # a pair at similarity 0.8 shares no band once in 16,000 pairs
SLOTS = BANDS * ROWS
LOOK_BACK = 32  # shingles before one that tell whether its pair was made already; farther ones cost a repeated pair
CLASS = 1.05  # sizes in a class differ by less than this factor
HOT = 1000


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text index, hash and count of each distinct shingle, ordered by text and hash; words per text; and a digest of its word sequence.

    Texts of fewer than five words have one shingle of all their words; texts without words have none and the digest of the
    text itself.
    """
    t = tokens(texts)
    word = t.kind == WORD
    doc, value = t.doc[word], t.hash[word]
    words = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(words)
    long = np.repeat(words >= SHINGLE, words)
    gram, owner = grams(value[long], doc[long], SHINGLE)
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    few = [mix(np.array([int(value[ends[k] - words[k] : ends[k]] @ np.arange(3, 3 + words[k], dtype=np.uint64)) & (1 << 64) - 1], np.uint64))[0] for k in short]
    gram, owner = np.concatenate((gram, np.array(few, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])))) if len(gram) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(gram)))
    digests = [hashlib.blake2b(value[e - n : e].tobytes() if n else t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for e, n, t in zip(ends, words, texts, strict=True)]
    return owner[first], gram[first], count, words, digests


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """docs x slots signatures; two bags agree in a slot with the probability of their weighted Jaccard similarity.

    An element's weights 1, 2, ... fall into blocks [0,1), [1,2), [2,4), [4,8), ...; each block has its own Poisson process of
    points with a time, a slot and a weight level, hashed from element and block. A bag sees the points under its weight, and
    a slot keeps the earliest. Points come in order of time, so a process ends once it is later than the bag's worst slot.
    """
    blocks = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(element)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    size = np.maximum(low, 1)
    seed, doc, cover = mix(element[at] + block.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owner[at], weight[at] - low
    best = np.full(docs * slots, np.inf)
    time, drawn, many = np.zeros(len(at)), 0, 1
    alive = np.arange(len(at))
    while len(alive):
        step = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64)
        random = mix(seed[alive, None] + step * np.uint64(0x9E3779B97F4A7C15))
        wait = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (slots * size[alive])[:, None]
        wait[:, 0] += time[alive]
        when = np.cumsum(wait, axis=1)
        other = mix(random ^ np.uint64(0xA0761D6478BD642F))
        slot = ((other >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        level = (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size[alive, None]
        seen = level < cover[alive, None]
        np.minimum.at(best, (doc[alive, None] * slots + slot)[seen], when[seen])
        time[alive] = when[:, -1]
        worst = best.reshape(docs, slots).max(axis=1)
        alive = alive[time[alive] <= worst[doc[alive]]]
        drawn, many = drawn + many, min(64, many * 2)
    return best.reshape(docs, slots).view(np.uint64)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per document and band, different from band to band."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, text -> doc_id, text_key, content (digest of the words), bands."""
    for batch in it:
        texts = batch.column(2).to_pylist()
        for s in slices([len(t) for t in texts]):
            owner, element, count, words, digests = shingles(texts[s])
            keys = band_keys(bag_minhash(owner, element, count, s.stop - s.start))
            bands = [k if n else [] for k, n in zip(keys, words, strict=True)]
            n = s.stop - s.start
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, n), batch.column(1).slice(s.start, n), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "content", "bands"])


def bag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, text -> content, elements (sorted shingle hashes) and counts, as bytes."""
    for batch in it:
        texts = batch.column(1).to_pylist()
        for s in slices([len(t) for t in texts]):
            owner, element, count, _, _ = shingles(texts[s])
            ends = np.searchsorted(owner, np.arange(s.stop - s.start + 1))
            parts = [(element[a:b].tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.start, len(parts)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["content", "elements", "counts"])


def weighted_jaccard(a: bytes, a_counts: bytes, b: bytes, b_counts: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n, m = np.frombuffer(a_counts, np.int32), np.frombuffer(b_counts, np.int32)
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    shared = np.minimum(n[same], m[at[same]]).sum()
    return float(shared / (n.sum() + m.sum() - shared))


def similar(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b with both bags, those at or over the similarity."""
    for batch in it:
        rows = batch.to_pydict()
        good = [weighted_jaccard(*x) >= SIMILARITY - 1e-12 for x in zip(rows["ea"], rows["ca"], rows["eb"], rows["cb"], strict=True)]
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    left, right = bags.select(F.col("content").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca")), bags.select(F.col("content").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "ca", "eb", "cb").mapInArrow(similar, "a binary, b binary")


def with_key(rows: DataFrame, per_key: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with the written table per_key: one row a key, with `n`, its number of rows, which is dropped.

    Keys of more than HOT rows and more than a HOT-th of the `total` rows are hot. There are fewer than HOT of them whatever
    the input, so they are broadcast and their rows stay where they are; all other keys are joined by shuffle.
    """
    most = max(HOT, total // HOT)
    hot = per_key.filter(F.col("n") > most).drop("n")
    if hot.isEmpty():
        return rows.join(per_key.drop("n"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(F.col("n") <= most).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's connected component, by large-star and small-star rounds until only stars are left.

    Every step is a written table, deleted at the end; nothing of it reaches the driver. Edges never grow in number. Stars
    around a hot node are grouped by partial minima and joined where they are, never collected.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        total = 2 * now.count()

        def star(e: DataFrame, larger: bool) -> DataFrame:
            both = e.union(e.select("b", "a")) if larger else e
            least = scratch.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
            moved = with_key(both, least, "a", total)
            out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
            return scratch.cut(out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

        while True:
            # Done when every node has one edge, to a node without one: each component is a star around its smallest node. One job tells.
            ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
            nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
            if not nodes.agg(F.bool_or((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)))).first()[0]:
                break
            now = star(star(now, True), False)
        return cut(now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()))


def occurrences(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, label, elements, counts -> content, label, size and a row per occurrence of a shingle."""
    for batch in it:
        for content, label, elements, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x, n = np.frombuffer(elements, np.uint64), np.frombuffer(counts, np.int32)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = mix(np.repeat(x, n) + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([content] * len(rows), pa.binary()), pa.array([label] * len(rows), pa.binary()), pa.array(np.full(len(rows), len(rows), np.int64)), pa.array(rows)], ["content", "label", "size", "shingle"])


def across(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """Pairs a, b of nodes (content, label) with different labels that may be similar: an exact prefix filter.

    Two bags of sizes p and q at similarity t share at least o = t / (1 + t) (p + q) shingles, so with shingles in one order
    the first p - o + 1 of one meet the first q - o + 1 of the other. Rare shingles come first; o is taken for the smallest
    size of the partner's size class. What many nodes share stands behind, so groups that are alike but not similar make
    few pairs. A pair is made at its first common shingle; further ones are known by the shingles just before them. Nothing
    before the first one is shared, so what follows it bounds the overlap, and pairs that can't reach o are not made; at
    later common shingles that bound is no reason to keep or lose a pair.
    """
    rows = cut(bags.join(nodes, "content").select("content", "label", "elements", "counts").mapInArrow(occurrences, "content binary, label binary, size long, shingle long"))
    common = cut(rows.groupBy("shingle").agg(F.count("*").alias("n"), F.count("*").alias("df"), F.min("label").alias("p"), F.max("label").alias("q")))
    order = Window.partitionBy("content").orderBy("df", "shingle")
    least = lambda other: F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("size") + other) - 1e-6)
    widest = F.col("size") - F.ceil(F.lit(SIMILARITY) * F.col("size") - 1e-6) + 1
    first = with_key(rows, common, "shingle", rows.count()).withColumn("at", F.row_number().over(order)).filter((F.col("at") <= widest) & (F.col("p") != F.col("q")))
    first = first.withColumn("before", F.collect_list("shingle").over(Window.partitionBy("content").orderBy("at").rowsBetween(-LOOK_BACK, -1)))
    own = F.floor(F.ln("size") / np.log(CLASS) + 1e-9).cast("int")
    reach = int(np.ceil(np.log(1 / SIMILARITY) / np.log(CLASS)))
    met = first.withColumn("own", own).withColumn("theirs", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    smallest = F.greatest(F.pow(F.lit(CLASS), F.col("theirs")) * (1 - 1e-9), F.lit(SIMILARITY) * F.col("size"))
    met = cut(met.filter(F.col("at") <= F.col("size") - least(smallest) + 1).select("shingle", "content", "label", "own", "theirs", "before", "size", "at"))
    small = met.filter("own <= theirs").select("shingle", F.col("own").alias("low"), F.col("theirs").alias("high"), F.col("content").alias("a"), F.col("label").alias("la"), F.col("before").alias("ba"), F.col("size").alias("na"), (F.col("size") - F.col("at")).alias("ra"))
    large = met.filter("own >= theirs").select("shingle", F.col("theirs").alias("low"), F.col("own").alias("high"), F.col("content").alias("b"), F.col("label").alias("lb"), F.col("before").alias("bb"), F.col("size").alias("nb"), (F.col("size") - F.col("at")).alias("rb"))
    enough = (1 + F.least("ra", "rb") >= F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("na") + F.col("nb")) - 1e-6)) & (F.least("na", "nb") >= F.lit(SIMILARITY) * F.greatest("na", "nb") - 1e-6)
    return small.join(large, ["shingle", "low", "high"]).filter(enough).filter("la <> lb AND (low < high OR a < b) AND NOT arrays_overlap(ba, bb)").select("a", "b")


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("text_key")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key (md5 of the text), class_id (smallest doc_id of the class) and class_text_key (that document's).

    Documents are one class if they are linked by texts with the same words or at least 0.8 weighted Jaccard similarity of
    their five-word shingle bags, directly or through others. Null texts count as empty; all empty texts are one class, and
    texts without words are alike only if equal. Null doc_ids sort first and stay null. Repeated rows give repeated rows.
    An empty table gives an empty one. Only doc_id and text are used.

    Rows with the same words are one node from the start, so a group of copies costs one signature row after the first
    aggregation. In a band, every node is compared with the smallest and the largest one; where a band then still holds several components,
    the pairs of its nodes across components are decided by an exact prefix join. That leaves no pair of a band undecided, and
    no step makes all pairs of a group.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = cut(slim.mapInArrow(sign, "doc_id long, text_key binary, content binary, bands array<long>"))
    nodes = cut(signed.groupBy("content").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands")))
    banded = nodes.select("content", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.min("content").alias("least"), F.max("content").alias("most"), F.count("*").alias("n")).filter("least <> most"))
    crowded = cut(with_key(banded, shared, "band", BANDS * nodes.count()).select("band", "content", "least", "most"))
    first = cut(crowded.select(F.explode(F.array("least", "most")).alias("a"), F.col("content").alias("b")).filter("a <> b").distinct())
    wanted = nodes.join(crowded.select("content").distinct(), "content", "left_semi").select("content", "rep.doc_id", "rep.text_key")
    texts = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["doc_id"]) & (slim["text_key"] == wanted["text_key"])).select("content", "text")
    bags = cut(texts.mapInArrow(bag, "content binary, elements binary, counts binary").dropDuplicates(["content"]))
    stars = cut(verified(first, bags))
    linked = components(stars)
    labelled = crowded.join(linked, crowded["content"] == linked["node"], "left").select("band", "content", F.coalesce("label", "content").alias("label"))
    mixed = cut(labelled.groupBy("band").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count("*").alias("n")).filter("p <> q").select("band", "n"))
    undecided = cut(with_key(labelled, mixed, "band", crowded.count()).select("content", "label").distinct())
    if not undecided.isEmpty():
        late = cut(verified(across(undecided, bags).distinct(), bags))
        if not late.isEmpty():
            # Components so far are single nodes now, named by their labels.
            left, right = undecided.select(F.col("content").alias("a"), F.col("label").alias("la")), undecided.select(F.col("content").alias("b"), F.col("label").alias("lb"))
            joined = components(late.join(left, "a").join(right, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
            named = joined.select(F.col("node").alias("label"), F.col("label").alias("into"))
            moved = linked.join(named, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
            linked = moved.unionByName(joined.join(linked, "node", "left_anti"))

    classed = cut(nodes.join(linked, nodes["content"] == linked["node"], "left").select("content", "rep", "label"))
    several, alone = classed.filter("label IS NOT NULL"), classed.filter("label IS NULL")
    heads = cut(several.groupBy("label").agg(F.min("rep").alias("head"), F.count("*").alias("n")))
    headed = with_key(several, heads, "label", several.count()).select("content", "head").union(alone.select("content", "rep"))
    by_content = headed.select("content", F.col("head.doc_id").alias("class_id"), F.col("head.text_key").alias("class_text_key"))
    return signed.select("doc_id", "text_key", "content").join(by_content, "content").select("doc_id", "text_key", "class_id", "class_text_key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one whose doc_id is the class's. Of repeated rows one stays."""
    heads = near_duplicate_classes(docs).select("class_id", "class_text_key").distinct()
    keyed = docs.withColumn("__key", text_key())
    kept = keyed.join(heads, keyed["doc_id"].cast("long").eqNullSafe(heads["class_id"]) & (keyed["__key"] == heads["class_text_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")
