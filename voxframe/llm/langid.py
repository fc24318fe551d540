"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.text import code_points, letters, slices

DIMENSIONS = 1024
SEED = 20
PIECE = 1 << 20
#: Distinct trigrams whose vectors are made together.
BLOCK = 8192
#: Symbols up to which a batch's trigrams are counted in a table rather than sorted.
SMALL = 160


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, the same wherever it is made; 0 stands for the space between words."""
    rows = [np.random.Generator(np.random.Philox(key=[SEED, int(p)])).integers(0, 2, dimensions, np.int8) for p in points]
    return np.array(rows, np.int8).reshape(-1, dimensions) * 2 - 1


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters in lower case with one 0 before, between and after words, and each symbol's text."""
    chars = letters()[code_points("".join(f"\n{t}\n" for t in texts))]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    kept = (chars > 0) | first | np.concatenate(([False], chars[:-1] > 0))
    return chars[kept], doc[kept]


def long_symbols(text: str) -> Iterator[np.ndarray]:
    """symbols() of one text in pieces of bounded size; each begins with the last two symbols of the one before, so that no trigram is lost, added or counted twice."""
    tail = np.zeros(1, np.uint32)
    for i in range(0, len(text) + 1, PIECE):
        chars = letters()[code_points(text[i : i + PIECE] + ("\n" if i + PIECE > len(text) else ""))]
        before = np.concatenate((tail[-1:], chars[:-1]))
        whole = np.concatenate((tail, chars[(chars > 0) | (before > 0)]))
        yield whole
        tail = whole[-2:]


def bundle(chars: np.ndarray, doc: np.ndarray, group_of: np.ndarray, groups: int, dimensions: int) -> np.ndarray:
    """Per group of texts the sum of its trigram vectors: each binds (multiplies) its letters' vectors, rotated by their place.

    chars are symbols in order, doc is each symbol's text, group_of each text's group. Distinct trigrams are bound in
    blocks of at most BLOCK, so memory doesn't grow with their number.
    """
    out = np.zeros((groups, dimensions))
    points, code = _coded(chars)
    n = len(points)
    whole = doc[:-2] == doc[2:]
    codes, owner = ((code[:-2] * n + code[1:-1]) * n + code[2:])[whole], group_of[doc[:-2][whole]]
    if n <= SMALL:
        place = np.zeros(n**3, np.int64)
        place[codes] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        column = place[codes]
    else:
        used, column = np.unique(codes, return_inverse=True)
    if len(used) > BLOCK:
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        ends = np.searchsorted(column, np.arange(0, len(used) + BLOCK, BLOCK))
    else:
        ends = np.array([0, len(column)])
    base = letter_vectors(points, dimensions)
    second, first = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        part = used[k * BLOCK : (k + 1) * BLOCK]
        vectors = first[part // (n * n)] * second[part // n % n] * base[part % n]
        counts = np.bincount(owner[a:b] * len(part) + column[a:b] - k * BLOCK, minlength=groups * len(part)).reshape(groups, len(part))
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out


def _coded(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by a table over code points."""
    found = np.zeros(int(chars.max(initial=0)) + 1, np.int64)
    found[chars] = 1
    points = np.flatnonzero(found)
    found[points] = np.arange(len(points))
    return points, found[chars]


def bundles(texts: list[str], groups_of: list[int], groups: int, dimensions: int) -> np.ndarray:
    """The bundles of groups of texts, each text given with its group; texts of any length."""
    group_of = np.asarray(groups_of, np.int64)
    if len(texts) == 1 and len(texts[0]) > PIECE:
        return sum(bundle(chars, np.zeros(len(chars), np.int64), group_of, groups, dimensions) for chars in long_symbols(texts[0]))
    return bundle(*symbols(texts), group_of, groups, dimensions)


def profiles(texts: list[str], dimensions: int) -> np.ndarray:
    """Each text's bundle."""
    out = np.zeros((len(texts), dimensions))
    for s in slices([len(t) for t in texts]):
        out[s] = bundles(texts[s], list(range(s.stop - s.start)), s.stop - s.start, dimensions)
    return out


def fit_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype per language: the bundle of all trigrams of its texts. labelled: text, lang; nulls in either are left out.

    Every task adds up its texts per language and Spark adds up the tasks; the driver gets languages x dimensions numbers.
    """

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in slices([len(t) for t in texts]):
                langs = sorted(set(names[s]))
                index = {x: k for k, x in enumerate(langs)}
                for name, row in zip(langs, bundles(texts[s], [index[x] for x in names[s]], len(langs), dimensions), strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "dimension": np.arange(dimensions, dtype=np.int32), "value": row})

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(sums, "lang string, dimension int, value double")
    summed = rows.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dimension", "value"))).alias("v"))
    return {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in sorted(summed.collect(), key=lambda r: r["lang"])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """docs' `doc_id` and `held_out` with lang_pred and score, the cosine with the nearest prototype (0 to 1; ties go to the first name).

    Null texts, texts without a letter and a model without prototypes give `und` and 0. Longer texts are read in pieces,
    with the same result as in one.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1.0) for n in names]).reshape(len(names), dimensions)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for s in slices([len(t or "") for t in texts]):
                known = [k for k in range(s.start, s.stop) if texts[k] and any(map(str.isalpha, texts[k]))]
                if not known or not names:
                    continue
                vectors = profiles([texts[k] for k in known], dimensions)
                cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
                best = cosines.argmax(axis=1)
                scores[known] = np.clip(cosines[np.arange(len(known)), best], 0, 1)
                for k, b in zip(known, best, strict=True):
                    langs[k] = names[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_languages(docs: DataFrame) -> DataFrame:
    """Every document's predicted language; prototypes are learned from the three quarters of doc_ids that are not held out."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", "lang")
    return identify(marked, fit_prototypes(marked.filter(~F.col("held_out"))))
