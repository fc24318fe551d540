"""Work on blocks of a grid: cubic tiles with a halo for neighbourhoods, tiles for regions, slabs for distances.

A block is one group of a shuffle and as large as its side says, whatever the volume; inside it the work is array operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("subject", "x", "y", "z")
#: Bytes of feature vectors that leave a task at once.
CHUNK = 1 << 24
Offset = tuple[int, int, int]


def tile_side(r: Sequence[int]) -> int:
    """Side of a tile for radius r: at least four radii, so that the halo of a cubic neighbourhood at most about triples what is shuffled."""
    return max(16, 4 * max(r))


def with_halo(df: DataFrame, r: Offset, side: int) -> DataFrame:
    """df's rows for every tile (tx, ty, tz) whose neighbourhoods of radii r reach them. Places count from 0."""
    for a, k in zip("xyz", r, strict=True):
        low, high = F.greatest(F.floor((F.col(a) - k) / side), F.lit(0)), F.floor((F.col(a) + k) / side)
        df = df.withColumn(f"t{a}", F.explode(F.sequence(low, high)) if k else F.floor(F.col(a) / side))
    return df


def _nullable(kind: pa.DataType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def _table(parts: list[pa.RecordBatch]) -> pa.Table:
    """Rows as one table; subjects may be structs, whose fields come out nullable as Spark expects them."""
    t = pa.Table.from_batches(parts).combine_chunks()
    return t.cast(pa.schema([pa.field(f.name, _nullable(f.type)) for f in t.schema]))


def by_blocks(df: DataFrame, keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(rows, number of each row's block) over whole blocks, the rows that are equal in the keys: as many at once as an Arrow batch ends, one at least.

    Blocks are dealt by a 64-bit hash of the keys and sorted by it and all keys but the first.
    """
    marks = ["__block", *keys[1:]]
    dealt = df.withColumn("__block", F.xxhash64(*keys)).repartition("__block").sortWithinPartitions(*marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = _table(held)
            new = np.zeros(t.num_rows, bool)
            for m in marks:
                new[1:] |= np.diff(t[m].to_numpy()) != 0
            yield from work(t, np.cumsum(new))

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = (held or [batch])[-1]
            last = whole.num_rows - 1
            differs = np.zeros(batch.num_rows, bool)
            for m in marks:
                c = batch.column(m).to_numpy()
                differs |= np.diff(c, prepend=whole.column(m)[last].as_py() if held else c[0]) != 0
            edge = np.flatnonzero(differs)
            if len(edge):
                if edge[-1]:
                    held.append(batch.slice(0, edge[-1]))
                yield from done()
                held = [batch.slice(edge[-1])]
            else:
                held.append(batch)
        if held:
            yield from done()

    return dealt.mapInArrow(run, schema)


def receptive_field(df: DataFrame, channels: Sequence[str], r: Offset, wanted: str | None = None, mask: str | None = None, side: int | None = None) -> DataFrame:
    """subject, x, y, z and `features`, the zero-padded neighbourhood of each voxel: channels first, then x, y, z offsets.

    With `wanted`, a 0/1 column, only its voxels get a vector (all others still lend their values). With `mask`, a 0/1
    column, `undefined` counts the places of the neighbourhood that are masked out or outside. Nulls count as 0.

    The grid is cut into equal tiles; a voxel goes to each tile within the radius, so its values are shuffled about
    (1 + 2r / side)^3 times, not (2r + 1)^3 times, and vectors are made after the shuffle, for wanted voxels only.
    """
    side = side or tile_side(r)
    names = [*channels, *([mask] if mask else [])]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(names)]
    own = F.lit(True) if wanted is None else F.coalesce(F.col(wanted).cast("int") == 1, F.lit(False))
    rows = with_halo(df.select(*KEY, own.alias("wanted"), *values), r, side)
    window = tuple(2 * k + 1 for k in r)
    size = math.prod(window)

    def work(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.stack([t[a].to_numpy() - t[f"t{a}"].to_numpy() * side for a in "xyz"])
        place = tuple(at[k] + r[k] for k in range(3))
        box = np.zeros((block[-1] + 1, len(names), *[max(1, int(min(side, at[k].max() + 1))) + 2 * r[k] for k in range(3)]))
        box[block, :, *place] = np.stack([t[f"v{i}"].to_numpy() for i in range(len(names))], axis=1)
        centre = np.flatnonzero(t["wanted"].to_numpy(zero_copy_only=False) & (at >= 0).all(axis=0) & (at < side).all(axis=0))
        view = np.lib.stride_tricks.sliding_window_view(box, window, axis=(2, 3, 4))
        step = max(1, CHUNK // (8 * size * len(names)))
        for k in range(0, len(centre), step):
            part = centre[k : k + step]
            found = view[block[part], :, at[0, part], at[1, part], at[2, part]].reshape(len(part), len(names), size)
            vectors = np.ascontiguousarray(found[:, : len(channels)]).reshape(-1)
            ends = np.arange(0, len(vectors) + 1, size * len(channels), dtype=np.int32)
            own = t.select(KEY).take(pa.array(part)).combine_chunks()
            out = [*[own[c].chunk(0) for c in KEY], pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors))]
            if mask:
                out.append(pa.array((size - found[:, -1].sum(axis=1)).round().astype(np.int64)))
            yield pa.RecordBatch.from_arrays(out, names=[*KEY, "features", *(["undefined"] if mask else [])])

    kinds = dict(df.select(*KEY).dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in KEY], "features array<double>", *(["undefined long"] if mask else [])])
    return by_blocks(rows, ("subject", "tx", "ty", "tz"), work, schema)


# ------------------------------------------------------------------ regions


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with links a - b, the smallest node of each one's component: roots hook onto smaller roots, then all paths are halved until they are flat."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def _labels(block: np.ndarray, at: np.ndarray, code: np.ndarray, offsets: Sequence[Offset]) -> np.ndarray:
    """For voxels in the order of block, x, y, z the first one of each one's region; linked are those of a block that an offset parts and whose codes are the same."""
    number = np.full((block[-1] + 1, *(at.max(axis=1) + 1)) if len(block) else (0, 0, 0, 0), -1)
    number[(block, *at)] = np.arange(len(block))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for o in offsets:
        near = (slice(None), *[slice(max(0, -k), n - max(0, k)) for k, n in zip(o, number.shape[1:], strict=True)])
        far = (slice(None), *[slice(max(0, k), n - max(0, -k)) for k, n in zip(o, number.shape[1:], strict=True)])
        a, b = number[near].ravel(), number[far].ravel()
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        same = code[a] == code[b]
        ends.append((a[same], b[same]))
    return connect(len(block), *[np.concatenate(x) for x in zip(*ends, strict=True)])


def local_regions(df: DataFrame, value: str, linked: str | None, offsets: Sequence[Offset], side: int) -> DataFrame:
    """df's subject, x, y, z and value with `root`: the smallest voxel (x, y, z in turn) of the part of its region that lies in its tile, and `n`, the part's voxels.

    Voxels of a subject are linked if one of the offsets leads from one to the other and they have the same value (nulls
    are alike). Rows where the boolean column `linked` is not true belong to no region: their root and n are null.
    """
    rows = df.select(*KEY, F.col(value).alias("v"), (F.lit(True) if linked is None else F.coalesce(F.col(linked), F.lit(False))).alias("linked"))
    for a in "xyz":
        rows = rows.withColumn(f"t{a}", F.floor(F.col(a) / side))

    def work(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.stack([t[a].to_numpy() for a in "xyz"])
        at = place - np.stack([t[f"t{a}"].to_numpy() for a in "xyz"]) * side
        on = np.flatnonzero(t["linked"].to_numpy(zero_copy_only=False))
        on = on[np.lexsort((*at[::-1, on], block[on]))]
        code = t["v"].chunk(0).take(pa.array(on)).dictionary_encode(null_encoding="encode").indices.to_numpy()
        label = _labels(block[on], at[:, on], code, offsets)
        root = np.zeros((3, t.num_rows), place.dtype)
        root[:, on] = place[:, on[label]]
        none = np.ones(t.num_rows, bool)
        none[on] = False
        n = np.zeros(t.num_rows, np.int64)
        n[on] = np.bincount(label, minlength=len(on))[label]
        kinds = [t.schema.field(a).type for a in "xyz"]
        struct = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(root, kinds, strict=True)], names=["x", "y", "z"], mask=pa.array(none))
        yield from pa.table([*[t[c] for c in KEY], t["v"], struct, pa.array(n, mask=none)], names=[*KEY, "v", "root", "n"]).to_batches()

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*KEY, "v")], f"root struct<x:{kinds['x']},y:{kinds['y']},z:{kinds['z']}>", "n long"])
    return by_blocks(rows, ("subject", "tx", "ty", "tz"), work, schema)


def ball(a: np.ndarray, largest: bool) -> np.ndarray:
    """Volumes a[i] of flags dilated or eroded with a voxel and its six neighbours; outside is off."""
    out = a.copy()
    for k in (1, 2, 3):
        near, far = [slice(None)] * 4, [slice(None)] * 4
        near[k], far[k] = slice(None, -1), slice(1, None)
        low, high = tuple(near), tuple(far)
        if largest:
            out[low] |= a[high]
            out[high] |= a[low]
        else:
            out[low] &= a[high]
            out[high] &= a[low]
            for end in (0, -1):
                edge = [slice(None)] * 4
                edge[k] = end
                out[tuple(edge)] = False
    return out


#: How far closing and opening by the ball look.
REACH = 4


def smoothed_parts(df: DataFrame, names: Sequence[str], carry: Sequence[str], offsets: Sequence[Offset], side: int) -> DataFrame:
    """Of each 0/1 column, closed and opened by the six-neighbour ball, the voxels that are on, as local_regions gives them: subject (subject and name of the column), x, y, z, v (1), root, n, and the columns to carry.

    All columns go in one shuffle as bits of a number, to each tile within reach; what is off goes no further.
    """
    bits = F.lit(0).cast("long")
    for i, c in enumerate(names):
        bits = bits.bitwiseOR(F.when(F.col(c) == 1, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    rows = with_halo(df.select(*KEY, bits.alias("bits"), *carry), (REACH,) * 3, side)
    kinds = dict(rows.dtypes)

    def work(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.stack([t[a].to_numpy() for a in "xyz"])
        at = place - np.stack([t[f"t{a}"].to_numpy() for a in "xyz"]) * side
        own, wide = ((at >= 0) & (at < side)).all(axis=0), at + REACH
        there = np.zeros((block[-1] + 1, *(wide.max(axis=1) + 1)), bool)
        there[(block, *wide)] = True
        given = t["bits"].to_numpy()
        for i, name in enumerate(names):
            m = np.zeros(there.shape, bool)
            m[(block, *wide)] = (given >> i) & 1 == 1
            for largest in (True, False, False, True):
                m = ball(m, largest) & there
            on = np.flatnonzero(m[(block, *wide)] & own)
            if not len(on):
                continue
            on = on[np.lexsort((*at[::-1, on], block[on]))]
            label = _labels(block[on], at[:, on], np.zeros(len(on), np.int8), offsets)
            first = place[:, on[label]]
            taken = t.select([*KEY, *carry]).take(pa.array(on)).combine_chunks()
            column = lambda c: taken[c].chunk(0)  # noqa: B023, E731
            volume = pa.StructArray.from_arrays([column("subject"), pa.array([name] * len(on))], names=["subject", "name"])
            root = pa.StructArray.from_arrays([pa.array(x, t.schema.field(a).type) for x, a in zip(first, "xyz", strict=True)], names=["x", "y", "z"])
            sizes = np.bincount(label, minlength=len(on))[label].astype(np.int64)
            yield from pa.table([volume, *map(column, "xyz"), pa.array(np.ones(len(on), np.int32)), root, pa.array(sizes), *map(column, carry)], names=[*KEY, "v", "root", "n", *carry]).to_batches()

    schema = ", ".join([f"subject struct<subject:{kinds['subject']},name:string>", *[f"{a} {kinds[a]}" for a in "xyz"], "v int", f"root struct<x:{kinds['x']},y:{kinds['y']},z:{kinds['z']}>", "n long", *[f"`{c}` {kinds[c]}" for c in carry]])
    return by_blocks(rows, ("subject", "tx", "ty", "tz"), work, schema)


def joined_regions(links: DataFrame) -> DataFrame:
    """subject, root, region: of links subject, a, b between parts of regions, the smallest part that each is connected with. A group holds the links of one volume."""
    kinds = dict(links.dtypes)

    def work(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        struct = t.schema.field("a").type
        ends = [np.stack([block, *[t[c].chunk(0).field(k).to_numpy() for k in range(3)]], axis=1) for c in "ab"]
        nodes, first, index = np.unique(np.concatenate(ends), axis=0, return_index=True, return_inverse=True)  # in the order of (x, y, z)
        index = index.ravel()
        label = connect(len(nodes), index[: t.num_rows], index[t.num_rows :])
        make = lambda p: pa.StructArray.from_arrays([pa.array(p[:, k + 1], struct.field(k).type) for k in range(3)], names=["x", "y", "z"])
        subject = t["subject"].take(pa.array(first % t.num_rows))
        yield from pa.table([subject, make(nodes), make(nodes[label])], names=["subject", "root", "region"]).to_batches()

    return by_blocks(links, ("subject",), work, f"subject {kinds['subject']}, root {kinds['a']}, region {kinds['a']}")


# ------------------------------------------------------------------ distances


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """For each row of f the least f[v] + (p - v)^2 over v at each place p (infinite entries take no part): the lower envelope of its parabolas, linear in the row's length, all rows in step."""
    lines, n = f.shape
    v, z, k = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf), np.full(lines, -1)
    for q in range(n):
        todo = np.flatnonzero(np.isfinite(f[:, q]))
        while len(todo):
            top = np.maximum(k[todo], 0)
            last = v[todo, top]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(k[todo] < 0, -np.inf, (f[todo, q] + q * q - f[todo, last] - last * last) / (2.0 * (q - last)))
            pop = (k[todo] >= 0) & (s <= z[todo, top])
            k[todo[pop]] -= 1
            put = todo[~pop]
            k[put] += 1
            v[put, k[put]], z[put, k[put]], z[put, k[put] + 1] = q, s[~pop], np.inf
            todo = todo[pop]
    out, j, some = np.full((lines, n), np.inf), np.zeros(lines, np.int64), np.flatnonzero(k >= 0)
    for p in range(n):
        late = some[z[some, j[some] + 1] < p]
        while len(late):
            j[late] += 1
            late = late[z[late, j[late] + 1] < p]
        near = v[some, j[some]]
        out[some, p] = f[some, near] + (p - near) ** 2
    return out


def _pass(df: DataFrame, outs: Sequence[str], axes: Sequence[str], slab: str, side: int) -> DataFrame:
    """df with the columns `outs` (infinite: no point) passed along the axes, in slabs of the remaining axis."""
    names = df.columns

    def work(t: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff(block, prepend=-1))
        places = [t[a].to_numpy() for a in "xyz"]
        at = [p - np.minimum.reduceat(p, first)[block] for p in places]
        index, shape = (block, *at), (block[-1] + 1, *[int(p.max()) + 1 for p in at])
        for out in outs:
            box = np.full(shape, np.inf)
            box[index] = t[out].to_numpy()
            for a in axes:
                k = "xyz".index(a) + 1
                moved = np.moveaxis(box, k, 3)
                box = np.moveaxis(lower_envelope(moved.reshape(-1, moved.shape[3])).reshape(moved.shape), 3, k)
            t = t.set_column(t.schema.get_field_index(out), out, pa.array(box[index]))
        yield from t.select(names).to_batches()

    return by_blocks(df.withColumn("__slab", F.floor(F.col(slab) / side)), ("subject", "__slab"), work, ", ".join(f"`{n}` {k}" for n, k in df.dtypes))


def squared_distances(df: DataFrame, targets: dict[str, str], side: int = 8) -> DataFrame:
    """df with a column for each of targets (new column: 0/1 column): the squared distance to the subject's nearest voxel that has 1 there, null if it has none.

    Two shuffles: slabs of x hold whole planes, in which z and y are passed, slabs of y hold whole x lines. Every pass is
    linear in a line's length and no row carries more than its own value.
    """
    own = [c for c in df.columns if c not in targets]
    rows = df.select(*own, *[F.when(F.col(c) == 1, 0.0).otherwise(F.lit(float("inf"))).alias(out) for out, c in targets.items()])
    rows = _pass(_pass(rows, list(targets), "zy", "x", side), list(targets), "x", "y", side)
    return rows.select(*own, *[F.when(F.col(out) < float("inf"), F.col(out).cast("long")).alias(out) for out in targets])
