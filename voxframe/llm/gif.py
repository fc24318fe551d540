"""Media columns: GIF streams decoded into timed frames with colour-histogram columns, and the writer that stores samples as GIF.

LZW strings are substrings of the output before them, so a code stream is decoded with array operations: the length of each
code's string and the place it repeats follow by pointer jumping, a few rounds per dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CODES = 4096
WIDTH, ROWS = 64, 1024
FRAME_BYTES = WIDTH * ROWS
BINS = 8
#: Pixels of a canvas or frame beyond which a stream counts as corrupt: a header of ten bytes could ask for 17 GB.
MAX_PIXELS = 1 << 24
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@lru_cache(maxsize=32)
def _widths(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the i-th code after a clear code, and their running sum: the decoder's table is one entry behind the encoder's."""
    width = np.minimum(12, np.floor(np.log2(first - 1 + np.arange(n))).astype(np.int64) + 1)
    return width, np.cumsum(width)


# ------------------------------------------------------------------ writing


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples (at least one), with a clear code whenever the table is full."""
    codes, table, following = [], {}, 258
    find, put, prefix = table.get, codes.append, data[0]
    for byte in data[1:]:
        code = find(key := prefix << 8 | byte)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = byte
        table[key] = following
        following += 1
        if following == MAX_CODES:
            put(256)
            table.clear()
            following = 258
    put(prefix)
    put(257)
    body = np.asarray(codes, np.uint16)
    cycle = _widths(258, MAX_CODES - 258 + 1)[0]
    width = np.concatenate(([9], np.resize(cycle, len(body))))
    bits = np.unpackbits(np.concatenate(([256], body)).astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[:, :12][np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def gif_from_samples(samples: bytes, delay_cs: int = 10) -> bytes:
    """A grey GIF whose frames, 64 pixels wide and at most 1024 high, hold the samples in order; their number must be a positive multiple of 64."""
    if not samples or len(samples) % WIDTH:
        raise ValueError("samples must be a positive multiple of 64 bytes")
    parts = [samples[i : i + FRAME_BYTES] for i in range(0, len(samples), FRAME_BYTES)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), GREY]
    for part in parts:
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay_cs, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


# ------------------------------------------------------------------ reading


def _codes(data: np.ndarray, at: int, first: int) -> tuple[np.ndarray, int, int]:
    """Codes from bit `at` up to the next clear or end code; that code (-1 if the data ends); the bit after it."""
    left = (len(data) - 3) * 8 - at
    n = 1024
    while True:
        width, ends = _widths(first, n)
        inside = int(np.searchsorted(ends, left, "right"))
        begin = at + ends[:inside] - width[:inside]
        byte = begin >> 3
        word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
        code = word >> (begin & 7) & (1 << width[:inside]) - 1
        stop = np.flatnonzero((code == first - 2) | (code == first - 1))
        if len(stop):
            k = int(stop[0])
            return code[:k], int(code[k]), int(at + ends[k])
        if inside < n:
            return code, -1, at + left
        n *= 4


def _expand(code: np.ndarray, first: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    n = len(code)
    literal, own = code < first, np.arange(n)
    if literal.all():
        return code.astype(np.uint8)
    of = np.where(literal, own, code - first)
    if not literal[0] or (of > own - ~literal).any():
        raise ValueError("a code is used before it is defined")
    length, up = (~literal).astype(np.int64), of
    while (more := length[up] * (up != own)).any():
        length, up = length + more, up[up]
    length = length + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    source = np.repeat((start[of] - start).astype(np.int32), length) + np.arange(total, dtype=np.int32)
    value = np.zeros(total, np.uint8)
    value[start[literal]] = code[literal]
    while not np.array_equal(further := source[source], source):
        source = further
    return value[source]


def lzw_decode(data: bytes, min_code_size: int, wanted: int) -> np.ndarray:
    """`wanted` samples of a code stream; ValueError if the stream is corrupt or too short."""
    if not 1 <= min_code_size <= 8:
        raise ValueError("unusable LZW code size")
    first = (1 << min_code_size) + 2
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    parts, have, at = [], 0, 0
    while have < wanted:
        code, stop, at = _codes(padded, at, first)
        if len(code):
            parts.append(_expand(code, first))
            have += len(parts[-1])
        if stop in (-1, first - 1):
            break
    if have < wanted:
        raise ValueError(f"{have} of {wanted} samples")
    return np.concatenate(parts)[:wanted]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (size := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def gif_frames(data: bytes) -> Iterator[dict]:
    """Each frame: place, timing, its own samples (palette indices in row order) and the RGBA canvas after it is drawn.

    Disposal 2 clears the frame's rectangle before the next one, 3 restores what was there; a transparent index leaves the
    canvas as it is. ValueError or IndexError if the stream is corrupt.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > MAX_PIXELS:
        raise ValueError(f"canvas of {width} x {height} pixels")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal = delay = index = clock = 0
    clear = None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, through = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear = packed >> 2 & 7, through if packed & 1 else None
            _, at = _sub_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if w * h > MAX_PIXELS:
            raise ValueError(f"frame of {w} x {h} pixels")
        palette = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, size, w * h).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        seen = samples[: box.shape[0], : box.shape[1]]
        colours = palette[seen if len(palette) == 256 else np.minimum(seen, len(palette) - 1)]
        if clear is None:
            box[..., :3], box[..., 3] = colours, 255
        else:
            drawn = seen != clear
            box[drawn, :3], box[drawn, 3] = colours[drawn], 255
        yield {"frame": index, "left": left, "top": top, "width": w, "height": h, "start_ms": clock, "delay_ms": 10 * delay, "disposal": disposal, "samples": samples.tobytes(), "canvas": canvas}
        clock, index = clock + 10 * delay, index + 1
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear = 0, 0, None


def histograms(canvas: np.ndarray) -> dict[str, list[int]]:
    """Eight equal bins of each colour over the opaque pixels."""
    solid = canvas[..., 3] > 0
    flat = canvas.reshape(-1, 4) if solid.all() else canvas[solid]
    return {f"hist_{c}": np.bincount(flat[:, k] >> 5, minlength=BINS).tolist() for k, c in enumerate("rgb")}


FRAME_SCHEMA = "frame int, left int, top int, width int, height int, start_ms long, delay_ms int, disposal int, n_opaque long, hist_r array<long>, hist_g array<long>, hist_b array<long>, samples binary, error string"


def decode_frames(df: DataFrame, media: str, key: str) -> DataFrame:
    """One row per frame of each GIF in column `media`, with the column `key` as `media_key`; other columns are left out.

    Null or empty media give no row. A corrupt stream, or one of more than 2^24 pixels, gives the frames before the fault
    and one row whose `error` says what is wrong. Repeated rows are decoded each for itself.
    """
    names = [x.strip().split(" ")[0] for x in FRAME_SCHEMA.split(",")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key_value, data in zip(batch.column(0).slice(0), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for f in gif_frames(data):
                        canvas = f.pop("canvas")
                        rows.append(f | histograms(canvas) | {"n_opaque": int((canvas[..., 3] > 0).sum()), "error": None})
                except (ValueError, IndexError, struct.error) as e:
                    rows.append(dict.fromkeys(names) | {"error": str(e) or "truncated"})
                if rows:
                    keys = pa.array([key_value.as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[n] for r in rows], types[n]) for n in names]], ["media_key", *names])

    types = {n: pa.int32() for n in names} | {n: pa.int64() for n in ("start_ms", "n_opaque")} | {n: pa.list_(pa.int64()) for n in ("hist_r", "hist_g", "hist_b")} | {"samples": pa.binary(), "error": pa.string()}
    source = df.select(F.col(key).alias("media_key"), F.col(media).cast("binary").alias("media")).filter(F.length("media") > 0)
    return source.mapInArrow(batches, f"media_key {source.schema[0].dataType.simpleString()}, {FRAME_SCHEMA}")


def store_text(text: str | None) -> dict:
    """The text's padded bytes as GIF, read back from it, and the features of its frames; null counts as empty."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
    media = gif_from_samples(payload)
    samples, spans, bins = [], 0, np.zeros(BINS, np.int64)
    for f in gif_frames(media):
        samples.append(f["samples"])
        bins += histograms(f["canvas"][: f["height"]])["hist_r"]
        spans += f["delay_ms"]
    back = b"".join(samples)
    return {
        "n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={len(samples)};ms={spans};grey={','.join(map(str, bins))}", "hist_grey": bins.tolist(),
    }


STORE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hist_grey array<long>"


def store_documents(docs: DataFrame) -> DataFrame:
    """Each document's text stored losslessly as GIF and read back: digests, sizes and colour histograms per row of docs.

    Null text counts as empty, an empty text is one row of 64 zero samples, long texts fill several frames. Needs the
    columns doc_id and text; others are left out. Equal texts give equal values.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [{"doc_id": d} | store_text(t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    text, number = pa.string(), pa.int64()
    kinds = {"string": text, "long": number, "array<long>": pa.list_(number)}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in STORE_SCHEMA.split(","))])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, STORE_SCHEMA)
