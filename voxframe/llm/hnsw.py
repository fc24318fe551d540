"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat neighbour arrays; shard results are merged."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import cut

SHARD_ROWS = 16_384
MAX_CELLS = 4096
BLOCK_ROWS = 8192
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 256
#: Nodes put into the graph, and nodes of a beam expanded, at once.
BATCH, STEP = 1024, 4
#: Flags of visited nodes that a search holds at once.
FLAGS = 1 << 26
SEED = 5


class Graph(NamedTuple):
    layers: list[np.ndarray]  #: per layer nodes x links neighbours, -1 where there is none; layer 0 has twice as many
    level: np.ndarray  #: highest layer of each node
    entry: int  #: a node of the highest layer


def beam(unit: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-first walks of many queries in step from their start nodes: the `width` nearest nodes found (-1 where there are fewer), their distances, and the number of distances taken."""
    q, step = len(queries), min(STEP, width)
    nodes, away, fresh = np.full((q, width), -1, np.int64), np.full((q, width), np.inf, np.float32), np.zeros((q, width), bool)
    nodes[:, 0], away[:, 0], fresh[:, 0] = start, 1 - np.einsum("qd,qd->q", unit[start], queries), True
    seen = np.zeros((q, len(unit)), bool)
    seen[np.arange(q), start] = True
    going, looked = np.arange(q), q
    while len(going):
        todo = np.where(fresh[going], away[going], np.inf)
        pick = np.argpartition(todo, step - 1, axis=1)[:, :step]
        open_ = np.isfinite(np.take_along_axis(todo, pick, 1))
        alive = open_.any(axis=1)
        going, pick, open_ = going[alive], pick[alive], open_[alive]
        if not len(going):
            break
        fresh[going[:, None], pick] = False
        found = []
        for c in range(step):
            near = links[nodes[going, pick[:, c]]].astype(np.int64)
            new = (near >= 0) & open_[:, c, None] & ~seen[going[:, None], near]
            row, column = np.nonzero(new)
            seen[going[row], near[row, column]] = True
            found.append(np.where(new, near, -1))
        near = np.concatenate(found, axis=1)
        row, column = np.nonzero(near >= 0)
        distance = np.full(near.shape, np.inf, np.float32)
        distance[row, column] = 1 - np.einsum("md,md->m", unit[near[row, column]], queries[going[row]])
        looked += len(row)
        all_nodes, all_away, all_fresh = np.hstack((nodes[going], near)), np.hstack((away[going], distance)), np.hstack((fresh[going], near >= 0))
        kept = np.argpartition(all_away, width - 1, axis=1)[:, :width]
        nodes[going], away[going], fresh[going] = (np.take_along_axis(x, kept, 1) for x in (all_nodes, all_away, all_fresh))
    order = np.argsort(away, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(away, order, 1), looked


def diverse(unit: np.ndarray, nodes: np.ndarray, away: np.ndarray, most: int) -> np.ndarray:
    """Per row up to `most` of its nodes (nearest first, -1 for none), leaving out those nearer to a chosen one; the nearest of these fill up."""
    out = []
    for a in range(0, len(nodes), BATCH):
        ids, d = nodes[a : a + BATCH], away[a : a + BATCH]
        vectors = unit[ids]
        between = 1 - vectors @ vectors.transpose(0, 2, 1)
        least, chosen, taken = np.full(ids.shape, np.inf, np.float32), np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            good = (d[:, k] < least[:, k]) & (taken < most) & (ids[:, k] >= 0)
            chosen[:, k] = good
            taken += good
            np.minimum(least, np.where(good[:, None], between[:, k], np.inf), out=least)
        order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        out.append(np.take_along_axis(ids, order, 1))
    return np.concatenate(out)


def connect(unit: np.ndarray, table: np.ndarray, new: np.ndarray, nodes: np.ndarray, away: np.ndarray, links: int, width: int) -> None:
    """Links the new nodes of a layer in both directions to diverse ones of the found nodes and of each other."""
    peers = 1 - unit[new] @ unit[new].T
    np.fill_diagonal(peers, np.inf)
    few = min(width, len(new))
    near = np.argpartition(peers, few - 1, axis=1)[:, :few]
    near_away = np.take_along_axis(peers, near, 1)
    all_nodes, all_away = np.hstack((nodes, np.where(np.isfinite(near_away), new[near], -1))), np.hstack((away, near_away)).astype(np.float32)
    order = np.argsort(all_away, axis=1, kind="stable")[:, :width]
    chosen = diverse(unit, np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_away, order, 1), links)
    table[new[:, None], np.arange(chosen.shape[1])] = chosen
    # The other direction: each chosen node's row with its new neighbours, the most diverse of them if there are too many.
    row, column = np.nonzero(chosen >= 0)
    source, target = new[row], chosen[row, column]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    owners, first, many = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(owners), table.shape[1] + int(many.max(initial=0))), -1, np.int64)
    wide[:, : table.shape[1]] = table[owners]
    wide[np.repeat(np.arange(len(owners)), many), table.shape[1] + np.arange(len(target)) - np.repeat(first, many)] = source
    for a in range(0, len(owners), BATCH):
        ids, own = wide[a : a + BATCH], owners[a : a + BATCH]
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # two new nodes may have chosen each other
        d = np.where(ids < 0, np.inf, 1 - np.einsum("qmd,qd->qm", unit[ids], unit[own])).astype(np.float32)
        order = np.argsort(d, axis=1, kind="stable")
        table[own] = diverse(unit, np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1), table.shape[1])


def build_graph(unit: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """Nodes are put in by batches, never more at once than are there, each linked to diverse near nodes of every layer it belongs to."""
    n = len(unit)
    level = np.floor(-np.log(1.0 - np.random.default_rng(SEED).random(n)) / np.log(links)).astype(np.int64)
    layers = [np.full((n, links if k else 2 * links), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
    entry, at = 0, 1
    while at < n:
        batch = np.arange(at, min(n, at + min(BATCH, at)))
        start, top = np.full(len(batch), entry), int(level[entry])
        for layer in range(max(top, int(level[batch].max())), -1, -1):
            members = level[batch] >= layer
            nodes, away = np.full((len(batch), 1), -1, np.int64), np.full((len(batch), 1), np.inf, np.float32)
            if layer <= top:
                nodes, away, _ = beam(unit, layers[layer], unit[batch], start, width if layer == 0 else links)
                start = nodes[:, 0]
            if members.any():
                connect(unit, layers[layer], batch[members], nodes[members], away[members], links, width)
        high = int(level[batch].argmax())
        if level[batch[high]] > top:
            entry = int(batch[high])
        at = int(batch[-1]) + 1
    return Graph(layers, level, entry)


def search_graph(unit: np.ndarray, graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """queries x width nodes, nearest first, -1 for none; and the number of distances taken."""
    out, looked, many = [], 0, max(1, FLAGS // max(1, len(unit)))
    for a in range(0, len(queries), many):
        part = queries[a : a + many]
        start = np.full(len(part), graph.entry)
        for layer in range(int(graph.level[graph.entry]), 0, -1):
            nodes, _, n = beam(unit, graph.layers[layer], part, start, STEP)
            start, looked = nodes[:, 0], looked + n
        nodes, _, n = beam(unit, graph.layers[0], part, start, width)
        out.append(nodes)
        looked += n
    return np.concatenate(out), looked


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the power of two of their largest component first, so that extreme values neither vanish nor overflow."""
    # The exponent of the largest component is taken out, which is exact: vectors of powers of two apart are one and the same.
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, not zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_pivots(rows: DataFrame, pivots: dict[int, np.ndarray], most: int) -> DataFrame:
    """rows with `cells`, the places of the `most` pivots nearest to v among those of its dimension; just [0] where it has none."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            cells = np.empty(len(part), object)
            for dim, at in part.groupby("dim").indices.items():
                if dim not in pivots:
                    cells[at] = [np.zeros(1, np.int32)] * len(at)
                    continue
                own = units(np.array(part["v"].iloc[at].tolist(), np.float64)) @ pivots[dim].T
                few = min(most, own.shape[1])
                best = np.argpartition(-own, few - 1, axis=1)[:, :few].astype(np.int32)
                for k, row in zip(at, best, strict=True):
                    cells[k] = row
            yield part.assign(cells=cells)

    return rows.mapInPandas(batches, f"{rows._jdf.schema().toDDL()}, cells array<int>")


def nearest(vectors: DataFrame, wanted: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, probes: int | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `wanted` the k nearest other rows by cosine, ties to the smaller key.

    Equal vectors are one node that knows its k+1 smallest keys, which is enough for any answer: a hot group of copies
    neither fills a shard nor hides its ties. Vectors null, zero, or with null or non-finite components take no part;
    vectors are compared with those of their own dimension. Rows with a null key are left out, rows that repeat a key are
    one candidate each by vector, and never their own neighbour. Fewer candidates give fewer ranks, an empty table none.

    Nodes are dealt to shards by hash, a query is searched in every shard and the results are merged: recall is that of a
    single shard's graph at any size, and work for a query grows with the number of shards. Where vectors cluster, a caller
    may choose `probes`: every node is then in the cell of its nearest pivot (a sample by hash of one node in `shard_rows`, at
    most `max_cells`), and a query is searched in the shards of that many cells. Shards and blocks of queries are bounded by
    parameters.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), wanted.alias("wanted")).filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    smallest = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v", "dim").dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    nodes = cut(few.groupBy("v", "dim").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    pivots = {}
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        cells = min(max_cells, -(-r["n"] // shard_rows))
        if probes and cells > 1:
            sample = nodes.filter(F.col("dim") == r["dim"]).select("v").orderBy(F.xxhash64("v"), "v").limit(cells).collect()
            pivots[r["dim"]] = units(np.array([x["v"] for x in sample], np.float64))
    placed = cut(nearest_pivots(nodes, pivots, 1).withColumn("cell", F.col("cells")[0]).drop("cells"))
    queries = rows.filter("wanted").select("id", "v", "dim").dropDuplicates(["id", "v"])
    queries = cut(nearest_pivots(queries, pivots, probes or 1).withColumn("cell", F.explode("cells")).drop("cells"))
    # A row for each cell, at most max_cells of each dimension.
    parts = F.ceil(F.col("count") / (1.5 * shard_rows)).cast("int")
    sizes = placed.groupBy("dim", "cell").count().select("dim", "cell", parts.alias("parts"))
    blocks = queries.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        original = np.array(part["v"].tolist(), np.float64)
        order = np.lexsort(original.T[::-1])
        original = original[order]
        # In random order, so that neighbours in value don't come in one batch.
        shuffled = np.random.default_rng(SEED).permutation(len(original))
        original = original[shuffled]
        ids = [np.asarray(x, np.int64) for x in part["ids"].iloc[order[shuffled]]]
        g = build_graph(units(original).astype(np.float32))
        flat = np.concatenate([layer[g.level >= k].ravel() for k, layer in enumerate(g.layers)])
        return pd.DataFrame({
            "dim": part["dim"].iloc[:1].to_numpy(), "cell": part["cell"].iloc[:1].to_numpy(), "part": part["part"].iloc[:1].to_numpy(), "vectors": [original.tobytes()], "ids": [np.concatenate(ids).tobytes()],
            "ends": [np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes()], "levels": [g.level.astype(np.int8).tobytes()], "neighbours": [flat.tobytes()], "entry": [g.entry],
        })

    sharded = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    index = cut(sharded.groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, vectors binary, ids binary, ends binary, levels binary, neighbours binary, entry long"))
    # Shards and queries meet by shard and block of queries: a shard is copied once for every 8192 queries that probe its cell.
    copies = index.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = queries.join(F.broadcast(blocks), ["dim", "cell"]).join(F.broadcast(sizes), ["dim", "cell"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "cell", "part", "block", "id", "v")

    def search(shard: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(shard) and len(part):
            r = shard.iloc[0]
            exact = units(np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]))
            ids, ends, level = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ends"], np.int64), np.frombuffer(r["levels"], np.int8)
            flat, layers, at = np.frombuffer(r["neighbours"], np.int32), [], 0
            for layer in range(int(level.max()) + 1):
                own, wide = np.flatnonzero(level >= layer), LINKS if layer else 2 * LINKS
                links = np.full((len(level), wide), -1, np.int32)
                links[own] = flat[at : at + len(own) * wide].reshape(-1, wide)
                layers.append(links)
                at += len(own) * wide
            wanted = units(np.array(part["v"].tolist(), np.float64))
            near, _ = search_graph(exact.astype(np.float32), Graph(layers, level, int(r["entry"])), wanted.astype(np.float32), SEARCH_WIDTH)
            for q_id, q, found in zip(part["id"].tolist(), wanted, near, strict=True):
                found = found[found >= 0]
                scores = np.clip((exact[found] * q).sum(axis=1), -1.0, 1.0)
                best = np.argsort(-scores, kind="stable")
                # Of nodes as near as the k-th all count: their keys decide.
                last = scores[best[min(k, len(best) - 1)]]
                hits = {(-s, int(i)) for s, n in zip(scores.tolist(), found, strict=True) if s >= last for i in ids[ends[n - 1] if n else 0 : ends[n]] if i != q_id}
                out += [(q_id, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ["dim", "cell", "part", "block"]
    pairs = copies.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
