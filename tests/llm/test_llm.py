"""The ten operators: brute force, exact round trips, held-out accuracy, and empty, null, tied, repeated and clashing inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import gif, hnsw, langid, mixing, neardup, packing, pii, quality, sharding, tokenize, warc
from voxframe.llm.queries import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog and then " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "One small text about nothing much at all today.", "en", "a", 10), (1, "One small text about nothing much at all today.", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n", "fr", "b", 4),
        (5, LONG, "en", "a", len(LONG)), (6, LONG, "en", "b", len(LONG)), (None, "Without id.", None, "b", 3), (7, "%%% ### !!", "de", "a", 9), (8, "日本語のテキスト 🎉", "ja", "b", 9), (9, "12 34", "en", None, 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"shard": F.lit("x"), "slot": F.lit(-1), "copy": F.lit("x"), "log_weight": F.lit("x"), "n_entities": F.lit("x"), "sequence_id": F.lit("x"), "length": F.lit("x"), "bucket": F.lit(1), "content": F.lit("c")})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def empty(df):
    return df.filter("false")


# ------------------------------------------------------------------ language id


def test_language_held_out_accuracy(documents):
    got = langid.document_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(got) == documents.count() and (out.lang == out.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_language_vector_is_the_sum_of_bound_rotated_letters():
    text = "Ab, c"
    v = {c: langid.letter_vectors(np.array([ord(c) if c != " " else 0]), 64)[0].astype(int) for c in "abc "}
    seq = " ab c "
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(seq, seq[1:], seq[2:], strict=False))
    assert np.array_equal(langid.profiles([text], 64)[0], want)


def test_languages_against_a_plain_version(documents):
    """The whole query again with one vector for each trigram."""
    rows = documents.select("doc_id", "text", "lang").collect()

    def profile(text: str) -> np.ndarray:
        seq = " " + " ".join("".join(c if c.isalpha() else " " for c in text).split()) + " "
        seq = "".join(c.lower() if len(c.lower()) == 1 else c for c in seq)
        count, out = Counter(zip(seq, seq[1:], seq[2:], strict=False)), np.zeros(langid.DIMENSIONS)
        for (a, b, c), n in count.items():
            out += n * (np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c))
        return out

    vectors: dict[str, np.ndarray] = {}

    def vector(c: str) -> np.ndarray:
        if c not in vectors:
            vectors[c] = langid.letter_vectors(np.array([0 if c == " " else ord(c)]), langid.DIMENSIONS)[0].astype(int)
        return vectors[c]

    profiles = {r["doc_id"]: profile(r["text"] or "") for r in rows}
    model: dict[str, np.ndarray] = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            model[r["lang"]] = model.get(r["lang"], 0) + profiles[r["doc_id"]]
    got = {r["doc_id"]: r for r in langid.document_languages(documents).collect()}
    for r in rows:
        p, g = profiles[r["doc_id"]], got[r["doc_id"]]
        if not any(map(str.isalpha, r["text"] or "")):
            assert g["lang_pred"] == "und" and g["score"] == 0
            continue
        cosine = {x: float(p @ m) / np.linalg.norm(p) / np.linalg.norm(m) for x, m in model.items()}
        assert abs(cosine[g["lang_pred"]] - max(cosine.values())) < 1e-9 and abs(g["score"] - min(1, max(0, max(cosine.values())))) < 1e-6


def test_long_texts_are_read_in_pieces_with_the_same_result(monkeypatch):
    text = "Ab, cd efg ... hi  jk " * 50
    whole = langid.profiles([text, "x"], 64)
    monkeypatch.setattr(langid, "BLOCK", 5)
    monkeypatch.setattr(langid, "SMALL", 0)
    assert np.array_equal(langid.profiles([text, "x"], 64), whole)
    for piece in (7, 10, 22, 1099, 1100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(langid.profiles([text], 64)[0], whole[0])


def test_language_odd_rows(odd, spark):
    got = {(r["doc_id"]): r["lang_pred"] for r in langid.document_languages(odd).collect()}
    assert [got[k] for k in (2, 3, 4, 7, 9)] == ["und"] * 5 and got[5] == got[6]
    assert langid.document_languages(empty(odd)).count() == 0
    assert {r["lang_pred"] for r in langid.document_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ------------------------------------------------------------------ GIF


@pytest.mark.parametrize("n", [64, 640, 64 * 1500])
@pytest.mark.parametrize("kind", ["zero", "random", "text"])
def test_gif_round_trip(n, kind):
    data = {"zero": bytes(n), "random": random.Random(n).randbytes(n), "text": (LONG.encode() * 2)[:n]}[kind]
    assert b"".join(f["samples"] for f in gif.gif_frames(gif.gif_from_samples(data))) == data


def slow_lzw(data: bytes, size: int) -> bytes:
    """A plain decoder, one code at a time."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, out, at, table, width, before = 1 << size, b"", 0, [], size + 1, None
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            out, before = out + entry, entry
    return out


def test_lzw_against_plain_decoder():
    for seed in range(20):
        rng = random.Random(seed)
        data = bytes(rng.choice(b"ab\xff") for _ in range(rng.choice([1, 2, 700, 9000])))
        assert slow_lzw(gif.lzw_encode(data), 8) == data == gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes()


def test_gif_disposal_transparency_and_timing(spark):
    red, blue = b"\xff\x00\x00", b"\x00\x00\xff"

    def frame(samples: bytes, left: int, w: int, disposal: int, through: int | None, delay: int) -> bytes:
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (through is not None)]) + delay.to_bytes(2, "little") + bytes([through or 0, 0])
        place = b"\x2c" + left.to_bytes(2, "little") + b"\0\0" + w.to_bytes(2, "little") + b"\x01\0\0"
        return control + place + b"\x08" + gif._blocks(gif.lzw_encode(samples))

    head = b"GIF89a" + (3).to_bytes(2, "little") + (1).to_bytes(2, "little") + b"\x80\0\0" + red + blue
    data = head + frame(b"\0\0\0", 0, 3, 1, None, 5) + frame(b"\1\0", 1, 2, 3, 0, 7) + frame(b"\1", 0, 1, 2, None, 9) + frame(b"\1", 2, 1, 0, None, 1) + b";"
    canvas = [f["canvas"].copy() for f in gif.gif_frames(data)]
    colour = lambda c: ["".join("RB"[int(p[2] > 0)] if p[3] else "-" for p in c[0])][0]
    assert [colour(c) for c in canvas] == ["RRR", "RBR", "BRR", "-RB"]
    df = spark.createDataFrame([(1, data), (2, b"nonsense"), (3, None), (4, data[:60])], "k long, m binary")
    got = gif.decode_frames(df, "m", "k").collect()
    first = [r for r in got if r["media_key"] == 1]
    assert [(r["start_ms"], r["delay_ms"]) for r in first] == [(0, 50), (50, 70), (120, 90), (210, 10)]
    assert first[0]["hist_r"] == [0] * 7 + [3] and first[3]["n_opaque"] == 2
    assert {r["media_key"] for r in got if r["error"]} == {2, 4}
    hostile = spark.createDataFrame([(1, b"GIF89a\xff\xff\xff\xff\x80\0\0" + bytes(6) + b";")], "k long, m binary")
    assert "pixels" in gif.decode_frames(hostile, "m", "k").first()["error"]


def test_gif_store(odd, documents):
    for df in (odd, documents):
        texts = defaultdict(set)
        for r in gif.store_documents(df).join(df.select(F.col("doc_id"), F.col("text")).distinct(), "doc_id").collect():
            raw = (r["text"] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            texts[raw].add((r["media_sha256"], r["feature"]))
        assert all(len(v) == 1 for v in texts.values())
    assert gif.store_documents(odd).count() == odd.count() and gif.store_documents(empty(odd)).count() == 0


# ------------------------------------------------------------------ WARC


def test_revisits_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["http://www.a.org/x?b=2&a=1&utm_source=q#f", "https://A.org:443/x/?a=1&b=2", "b.org", None]), rng.randrange(40), rng.random() < 0.3, rng.choice(["e1", "e2", None]), rng.choice(["d1", None]), f"h{i}", {"etag": "e", "content-type": "t", "date": str(i)}) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id long, url string, s long, is_full boolean, etag string, last_modified string, digest string, headers map<string,string>").withColumn("ts", F.timestamp_seconds("s")).drop("s").withColumn("status", F.lit("clash"))
    canon = lambda u: None if u is None else "b.org" if u == "b.org" else "a.org/x?a=1&b=2"
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert len(got) == sum(not r[3] for r in rows)
    for i, url, s, full, etag, modified, _, headers in rows:
        if full:
            continue
        earlier = [r for r in rows if r[3] and canon(r[1]) == canon(url) and canon(url) is not None and r[2] < s]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            want = "no_earlier_response"
        elif etag and best[4]:
            want = "resolved" if etag == best[4] else "validator_mismatch"
        elif modified and best[5]:
            want = "resolved"
        else:
            want = "no_validator"
        assert got[i]["status"] == want and got[i]["canonical_url"] == canon(url)
        if want == "resolved":
            assert got[i]["refers_to"] == best[0] and got[i]["merged_headers"] == {"content-type": "t", "etag": "e", "date": headers["date"]}
    assert warc.resolve_revisits(empty(df)).count() == 0


# ------------------------------------------------------------------ sharding


def test_communication_matrix_is_hypergeometric():
    sizes, draws = [5, 7, 8], []
    for seed in range(3000):
        m = sharding.communication_matrix(sizes, 3, seed)
        assert [sum(r) for r in m] == sizes and sorted(map(sum, zip(*m, strict=True))) == [6, 7, 7]
        draws.append(m[0][0])
    count = Counter(draws)
    from math import comb

    for k in range(6):
        p = comb(5, k) * comb(15, 7 - k) / comb(20, 7)
        assert abs(count[k] / 3000 - p) < 5 * (p * (1 - p) / 3000) ** 0.5 + 1e-3


def test_shards(odd, documents):
    for df in (odd, documents):
        got = sharding.shard_documents(df).toPandas()
        n = df.count()
        assert len(got) == n and got.groupby("shard").size().reindex(range(40), fill_value=0).between(n // 40, n // 40 + 1).all()
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
        again = sharding.shard_documents(df.repartition(7)).toPandas()
        assert sorted(map(tuple, got[["doc_id", "shard", "slot"]].fillna(-1).values)) == sorted(map(tuple, again[["doc_id", "shard", "slot"]].fillna(-1).values))
    assert sharding.shard_documents(empty(odd)).count() == 0
    whole = sharding.hypergeometric_shards(odd, ["doc_id"], 3)
    assert whole.count() == odd.count() and whole.filter("shard NOT IN (0, 1, 2)").count() == 0 and "text" in whole.columns


# ------------------------------------------------------------------ packing


def test_tokens_equal_the_library(documents):
    texts = [r["text"] for r in documents.collect()] + ["", " ", "Don't we'll 123 <|endoftext|> héllo Ünï", "ﬁ İ ſ", "aaaaaaaa abababab !!!!!!! ...", "abcdefgh" * 20_000, "a " + "-" * 5000 + " b", "日本語", "ŉ x² \x85 a\xa0b", LONG]
    v = tokenize.vocabulary(default_tokenizer())
    texts += ["a <|startoftext|> b", "<|endoftext|>", "<|STARTOFTEXT|>", "plain"]
    for got, want in zip(tokenize.encode(texts, default_tokenizer()), v.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_best_fit_against_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.choice([10, 17, 64, 100])
        counts = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}
        bins: list[int] = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [(r, i) for i, r in enumerate(bins) if r >= length]
            if fits:
                bins[min(fits)[1]] -= length
            else:
                bins.append(cap - length)
        segments, n = packing.best_fit_decreasing(counts, cap)
        left, ranks = [cap] * n, Counter()
        for s in segments:
            assert ranks[s.length] == s.rank_from
            ranks[s.length] = s.rank_to
            for r in range(s.rank_to - s.rank_from):
                b = s.bin_from + r // s.each
                assert cap - left[b] == s.offset + r % s.each * s.length
                left[b] -= s.length
        assert ranks == Counter(counts) and sorted(left) == sorted(bins)


def test_packing(odd, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    named = odd.filter("doc_id = 1").withColumn("text", F.explode(F.array(*map(F.lit, ["a <|startoftext|> b", "x<|endoftext|>y", "<|STARTOFTEXT|>", "<|startoftext| >"]))))
    for df in (odd.unionByName(named.withColumn("doc_id", F.monotonically_increasing_id() + 100)), documents):
        got = packing.pack_documents(df, default_tokenizer()).toPandas()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = ids[start : start + 4096]
                want[-1 if r["doc_id"] is None else r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())] += 1
        assert Counter(zip(got.doc_id.fillna(-1), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
        placed = got.sort_values(["sequence_id", "offset"])
        assert ((placed.groupby("sequence_id").length.cumsum() - placed.length) == placed.offset).all()
        assert placed.groupby("sequence_id").length.sum().max() <= 4096
    assert packing.pack_documents(empty(odd), default_tokenizer()).count() == 0


# ------------------------------------------------------------------ nearest neighbours


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16))
    v[100:140] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, []), (2250, [1.0, 2.0]), (None, [1.0] * 16), (0, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = hnsw.nearest(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), shard_rows=400).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s.round(12)))[:5]
        hit += len(set(best) & set(g.vec_id))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, s[g.vec_id], atol=1e-12) and q not in set(g.vec_id)
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 50)) and hit / (5 * 30) >= 0.9
    assert got[got.query_id == 50].sort_values("rank").vec_id.tolist() == [100, 101, 102, 103, 104]
    assert hnsw.nearest(empty(df), F.lit(True)).count() == 0


def test_probed_cells_reach_most_neighbours(spark):
    """Clustered vectors in many cells, of which a query sees eight."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(60, 12))[rng.integers(0, 60, 6000)] * 3 + rng.normal(size=(6000, 12))).round(6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=150, probes=8).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit[::50] @ unit.T
    s[np.arange(120), np.arange(0, 6000, 50)] = -9
    hit = sum(len(set(np.argsort(-s[q // 50])[:5]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit / 600 >= 0.9


def recall(df, got) -> float:
    part = df.toPandas()
    v = hnsw.units(np.array(part.embedding.tolist(), float))
    ids, hit = part.vec_id.to_numpy(), 0
    asked = np.flatnonzero(ids % 50 == 0)
    for q in asked:
        s = v @ v[q]
        s[q] = -9
        hit += len(set(ids[np.argsort(-s)[:5]]) & set(got[got.query_id == ids[q]].vec_id))
    return hit / (5 * len(asked))


def test_recall_over_the_given_vectors_and_in_many_shards(spark):
    """The whole of the table, and random vectors of 64 dimensions in twelve shards, all of which a query sees."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    assert recall(given, hnsw.nearest(given, F.col("vec_id") % 50 == 0).toPandas()) >= 0.9
    v = np.random.default_rng(8).normal(size=(9000, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    assert recall(df, hnsw.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=500).toPandas()) >= 0.9


def test_work_for_a_query_grows_slower_than_the_shard():
    rng, looked = np.random.default_rng(4), []
    for n in (1000, 8000):
        unit = hnsw.units(rng.normal(size=(n, 32))).astype(np.float32)
        q = hnsw.units(rng.normal(size=(50, 32))).astype(np.float32)
        near, total = hnsw.search_graph(unit, hnsw.build_graph(unit), q, 64)
        looked.append(total / 50)
        assert sum(len(set(np.argsort(-(unit @ x))[:5]) & set(r[:5])) for x, r in zip(q, near, strict=True)) / 250 >= 0.85
    assert looked[1] < 3 * looked[0] and looked[1] < 8000 / 4


def test_repeated_rows_leave_room_for_other_keys(spark):
    rows = [(1, [1.0, 2.0])] * 10 + [(2, [1.0, 2.0]), (3, [2.0, 1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).toPandas().sort_values(["query_id", "rank"])
    assert {q: g.vec_id.tolist() for q, g in got.groupby("query_id")} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


# ------------------------------------------------------------------ mixing


def test_mixing(odd, documents):
    got = mixing.poisson_mix(documents, weights={"src0": 3.0, "src1": 1.0}, total=4000.0).toPandas()
    n = got.groupby("source").size()
    assert set(n.index) == {"src0", "src1"} and abs(n["src0"] - 3000) < 300 and abs(n["src1"] - 1000) < 180
    assert sorted(got.shuffle_key) != list(got.doc_id)
    copies = got.groupby("doc_id").copy
    assert (copies.max() == copies.size()).all()
    some = mixing.poisson_mix(odd, temperature=1.0, total=500.0)
    assert 350 < some.count() < 650 and some.filter("source IS NULL").count() > 0
    assert mixing.poisson_mix(empty(odd)).count() == 0


def test_poisson_inversion(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).first()["c"]
    total, p = 0.0, np.exp(-2.5)
    for k, c in enumerate(cdf[:20]):
        total += p
        assert c == pytest.approx(total)
        p *= 2.5 / (k + 1)


# ------------------------------------------------------------------ personal data


def test_surrogates(spark):
    text = 'Call +1 (452) 555-7764 or 452-555-7764, mail Ann.B@x.org and ann.b@X.ORG, ip 97.51.17.173, card 4539578763621486, ssn 123-45-6789, token = "04dbebab91ab85687d33eeaa". Mr. John SMITH and Mrs Smith, Госпожа Иванова. Apache License, Version 2.0.'
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "Nothing here, 3 apples.")], "doc_id long, text string").withColumn("n_entities", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = got[1]["text"]
    assert got[2]["text"] == new and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "Nothing here, 3 apples."
    for secret in ("452", "7764", "Ann", "ann.b", "97.51.17.173", "4539578763621486", "123-45", "04dbebab91ab85687d33eeaa", "John", "SMITH", "Smith", "Иванова"):
        assert secret not in new
    import re

    m = re.fullmatch(r'Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), mail (\S+@\S+) and (\S+@\S+), ip (\d+\.\d+\.\d+\.\d+), card (\d{16}), ssn \d{3}-\d{2}-\d{4}, token = "([0-9a-f]{24})"\. Mr\. ([A-Z][a-z]+) ([A-Z]+) and Mrs ([A-Z][a-z]+), Госпожа ([А-Я][а-я]+)\. Apache License, Version 2\.0\.', new)
    assert m and m.groups()[:3] == m.groups()[3:6] and m[7] == m[8] and m[13].lower() == m[14].lower()
    digits = [int(c) for c in m[10]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert pii.pseudonymise(empty(df), "k").count() == 0


def test_a_phone_ends_where_another_entity_begins(spark):
    import re

    texts = ["+1 (826) 555-4081 190.137.223.204", "+1 (843) 555-7672 170.106.47.218", "826-555-4081", "+1 826 555 4081 42 apples", "+44 20 7946 0958 190.137.223.204", "+44 20 7946 0958 7301@mail.org", "+44 20 7946 0958 123-45-6789", "+44 20 7946 0958 4539 5787 6362 1486", "+49 1512 345 67890", "+49 (0)1512 345 67890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = [out[i]["text"] for i in range(len(texts))]
    assert [out[i]["n_entities"] for i in range(len(texts))] == [2, 2, 1, 1, 2, 2, 2, 2, 1, 1]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+", new[0]) and "555-408" not in new[0] and ".223." not in new[0]
    assert "555-767" not in new[1] and ".47." not in new[1]
    phone = re.sub(r"\D", "", new[2])
    assert re.sub(r"\D", "", new[0][: len("+1 (826) 555-4081")])[1:] == phone and new[3].endswith(" 42 apples") and re.sub(r"\D", "", new[3][:15])[1:] == phone
    assert len({n[:16] for n in new[4:8]}) == 1 and new[4].startswith("+44 ") and not any(x in n for n in new[4:8] for x in ("7946", "0958", "7301@", "123-45", "4539"))
    assert new[8].startswith("+49 ") and "1512" not in new[8] and re.sub(r"\D", "", new[8])[2:] == re.sub(r"\D", "", new[9])[3:] and new[9].startswith("+49 (0)")


def test_digit_surrogates_are_a_permutation(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = {r[0] for r in d.select(pii._digits("k", F.lit("s"), F.col("d"))).collect()}
    assert len(out) == 1000 and all(len(x) == 3 for x in out)


def outcome(spark, entities, key):
    """kind, value, attempt, stand-in of every entity."""
    again = pii.attempts_needed(entities, key)
    named = entities.withColumn("id", pii.identity(key, F.col("kind"), F.col("value")))
    tried = named.join(again, ["kind", "id"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return tried.select("kind", "value", "attempt", pii._stand_in(key, F.struct("kind", "value"), F.col("attempt")).alias("to")).collect()


def test_collisions_are_resolved(spark):
    values = [("secret", f"{v:08x}"[:3]) for v in range(0, 1 << 31, 1 << 22)] + [("phone", f"{v:04d}") for v in range(0, 10_000, 3)]
    got = outcome(spark, spark.createDataFrame(sorted(set(values)), "kind string, value string"), "k")
    assert any(r["attempt"] for r in got) and len({(r["kind"], r["to"]) for r in got}) == len(got) and not {(r["kind"], r["to"]) for r in got} & set(values)


def test_a_full_number_space_is_permuted_without_fixed_points(spark):
    got = outcome(spark, spark.createDataFrame([("phone", f"{v:03d}") for v in range(1000)], "kind string, value string"), "k")
    assert sorted(r["to"] for r in got) == sorted(r["value"] for r in got) and all(r["to"] != r["value"] for r in got)


def test_distinctness_and_coreference_of_all_entities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    entities = pii.entity_table(docs)
    got = outcome(spark, entities, "k")
    real = {(r["kind"], r["value"]) for r in got}
    assert len(got) == len(real) > 50 and len({(r["kind"], r["to"]) for r in got}) == len(got) and not {(r["kind"], r["to"]) for r in got} & real
    # Every entity's stand-in stands in every text that held the entity, and no card or secret is left.
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    for r in got:
        if r["kind"] in ("card", "secret", "email"):
            holders = [d for d, t in text.items() if t and r["value"] in t.lower()]
            assert holders and all(r["value"] not in out[d].lower() and r["to"] in out[d] for d in holders)


def test_tables_on_the_way_hold_no_value(spark, tmp_path, monkeypatch):
    from voxframe.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(shared, "remove", lambda spark, folder: None)
    df = spark.createDataFrame([(1, "mail ann.b@x.org and password = 5555aaaabbbb"), (2, "call 123-456-7890")], "doc_id long, text string")
    pii.pseudonymise(df, "k").collect()
    written = [p.read_bytes() for p in tmp_path.rglob("*.parquet")]
    assert written and not any(v in b for b in written for v in (b"ann.b", b"5555aaaabbbb", b"1234567890"))
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_more_kinds_of_entities(spark):
    import re

    texts = [
        "v6 2001:db8::1 or 2001:0DB8:0:0:0:0:0:1.", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "not DE89 3704 0044 0532 0130 01", "card 4539578763621486 but not 4539578763621487 nor 9907815762804490", "my name is Bob Stone. Anna Stone left.",
        "Time 10:30:45 and ratio 1:2.", "xx private mark mail a@b.org",
    ]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [out[i]["n_entities"] for i in range(7)] == [2, 2, 0, 1, 2, 0, 1]
    a, b = re.fullmatch(r"v6 ([0-9a-f:]{39}) or ([0-9A-F:]{39})\.", out[0]["text"]).groups()
    assert a == b.lower()
    for iban in re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", out[1]["text"]).groups():
        s = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert out[2]["text"] == texts[2] and out[5]["text"] == texts[5] and out[6]["text"].startswith("xx private")
    assert re.search(r"card 4\d{15} but not 4539578763621487 nor 9907815762804490", out[3]["text"]) and "8763621486" not in out[3]["text"]
    names = re.fullmatch(r"my name is (\w+) (\w+)\. (\w+) (\w+) left\.", out[4]["text"]).groups()
    assert names[1] == names[3] and names[2].endswith(tuple(pii.ENDINGS["latin"]["f"])) and not {"Bob", "Stone", "Anna"} & set(names)


def test_million_character_texts(spark):
    k = 1_000_000
    texts = ["x@" + "a." * 8000 + "com", "1" * k, "a" * k + " bob@x.org", "+1 " * (k // 3), "token = " + "a" * k, "1.1." * (k // 4), "a:" * (k // 2), "x@x." * (k // 4), "DE12 " * (k // 5), "A" * (k // 2) + "'" * (k // 2), "Mr" * (k // 2)]
    got = {r["doc_id"]: r["n_entities"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0]


# ------------------------------------------------------------------ quality


def test_quality(documents, odd, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r["doc_id"] for r in quality.resample(documents, labels).collect()}
    y = labels.toPandas()
    good, bad = y[y.quality == 1], y[y.quality == 0]
    assert good.doc_id.isin(kept).mean() > 0.95 and bad.doc_id.isin(kept).mean() < 0.1
    few = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"] for r in quality.resample(odd, few).collect()}
    assert 1 in got and not got & {2, 3, 4, 7}
    assert quality.resample(empty(odd), few).count() == 0 and quality.resample(odd, empty(few)).count() == 7


def test_a_repeated_document_is_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"words of {i}") for i in range(12) for _ in range(50 if i < 6 else 1)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    seen, best = [], quality.best_threshold
    monkeypatch.setattr(quality, "best_threshold", lambda score, good: seen.append(len(good)) or best(score, good))
    quality.fit(docs, labels)
    assert seen == [quality.labelled_sample(labels, 99).filter("__out").count()] and 0 < seen[0] < 12


def test_log_weight_against_plain_sums():
    texts = ["a b, c a b", "x"]
    bucket, doc = quality.buckets_of(texts, 1 << 16)
    assert Counter(doc.tolist()) == {0: 6 + 5, 1: 1} and len(set(bucket[doc == 0].tolist())) == 4 + 4


def test_resampling_against_a_plain_version(documents, spark):
    """The whole query again with plain Python counts: the same weights, noise and number of documents."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = documents.select("doc_id", "text", quality.unit_hash(quality.SEED, F.col("doc_id")).alias("u")).collect()
    sample = {r["__id"]: (r["__y"], r["__out"]) for r in quality.labelled_sample(labels, quality.MAX_LABELLED).collect()}
    raw, target = Counter(), Counter()
    grams = {r["doc_id"]: Counter(quality.buckets_of([r["text"] or ""], quality.BUCKETS)[0].tolist()) for r in rows}
    for d, c in grams.items():
        raw.update(c)
        if sample.get(d) == (1, False):
            target.update(c)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: np.log((target[b] + quality.SMOOTHING) / (n * share + quality.SMOOTHING)) for b, n in raw.items()}
    weight = {d: sum(n * ratio[b] for b, n in c.items()) for d, c in grams.items()}
    out = sorted((weight[d], y) for d, (y, held) in sample.items() if held and d in weight)
    cut = max(range(len(out) - 1), key=lambda i: (round(sum(y != 1 for _, y in out[: i + 1]) / sum(y != 1 for _, y in out) - sum(y == 1 for _, y in out[: i + 1]) / sum(y == 1 for _, y in out), 12), out[i + 1][0] - out[i][0]))
    threshold = (out[cut][0] + out[cut + 1][0]) / 2
    usable = [r for r in rows if r["text"] and any(c.isalnum() for c in r["text"])]
    key = {r["doc_id"]: weight[r["doc_id"]] - np.log(-np.log(max(r["u"], 2.0**-53))) for r in usable}
    k = sum(weight[r["doc_id"]] >= threshold for r in usable)
    want = set(sorted(key, key=key.get)[-k:])
    got = quality.resample(documents, labels).collect()
    assert {r["doc_id"] for r in got} == want and all(abs(r["log_weight"] - weight[r["doc_id"]]) < 1e-6 for r in got)
    assert quality.resample(documents, labels, k=7).count() == 7


# ------------------------------------------------------------------ near duplicates


def plain_classes(rows: list[tuple]) -> list:
    """Class ids by comparing all pairs."""

    def bag(text: str) -> Counter:
        words = [w for w in __import__("re").findall(r"\w+", text.lower().replace("_", " "))]
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])

    bags = [bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or shared and shared / sum((bags[i] | bags[j]).values()) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, low[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(0, None), (1, ""), (2, "%%%"), (3, "###"), (4, "One two."), (5, "one TWO!"), (6, "one two three")]
    for i in range(7, 160):
        words = base[:]
        for _ in range(rng.randrange(8)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"y{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) + " " + " ".join(base[:40])) for i in range(160, 220)] + [rows[10], rows[11]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"content": F.lit(1), "band": F.lit("b")})
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicate_classes(df).collect())
    assert got == plain_classes(rows)
    kept = sorted(r["doc_id"] for r in neardup.deduplicate(df).collect())
    assert kept == sorted({c for _, c in got})
    assert neardup.near_duplicate_classes(empty(df)).count() == 0


def test_classes_of_a_given_table_against_all_pairs(spark):
    """No link of the table is lost: every pair that shares a shingle is compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    owner, gram, count, _, digests = neardup.shingles([t or "" for _, t in rows])
    bags = [dict(zip(gram[owner == k].tolist(), count[owner == k].tolist(), strict=True)) for k in range(len(rows))]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, b in enumerate(bags):
        shared = Counter()
        for g, n in b.items():
            for j in holders[g]:
                shared[j] += min(n, bags[j][g])
            holders[g].append(k)
        for j, n in shared.items():
            if n / (sum(b.values()) + sum(bags[j].values()) - n) >= 0.8 - 1e-12:
                parent[find(k)] = find(j)
    first: dict[bytes, int] = {}
    for k, d in enumerate(digests):
        parent[find(k)] = find(first.setdefault(d, k))
    low: dict[int, int] = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), d), d)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_classes(docs).collect()}
    assert got == {d: low[find(k)] for k, (d, _) in enumerate(rows)}


def test_prefix_join_of_families_around_the_limit(spark):
    """All pairs at 0.8 or more are made, though most texts of a family are just under it and share what sets them apart; pairs far below are not made."""
    rng = random.Random(7)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for _ in range(30):
            words = base[:]
            for at in rng.sample(range(0, 200, 8), rng.randrange(3, 9)):
                words[at] = f"x{at}"
            texts.append(" ".join(words[: rng.randrange(170, 201)]))
    owner, gram, count, _, digests = neardup.shingles(texts)
    bags = [(gram[owner == k].tobytes(), count[owner == k].astype(np.int32).tobytes()) for k in range(len(texts))]
    table = spark.createDataFrame([(bytearray(d), bytearray(e), bytearray(c)) for d, (e, c) in zip(digests, bags, strict=True)], "content binary, elements binary, counts binary")
    made = neardup.across(table.select("content", F.col("content").alias("label")), table).distinct()
    pairs = lambda df: {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in df.collect()}
    alike = {frozenset((digests[i], digests[j])): neardup.weighted_jaccard(*bags[i], *bags[j]) for i in range(len(texts)) for j in range(i) if digests[i] != digests[j]}
    want = {p for p, t in alike.items() if t >= 0.8}
    got = pairs(made)
    assert want <= got and pairs(neardup.verified(made, table)) == want
    assert len(want) < len(got) < len([p for p, t in alike.items() if t > 0.5])


def test_components_and_joins_of_hot_keys(spark, monkeypatch):
    """A hub of 200 edges, a chain and loose pairs, with keys hot from five rows: hot and other keys give the rows of a plain join, components the smallest node."""
    monkeypatch.setattr(neardup, "HOT", 5)
    edges = [(0, k) for k in range(100, 300)] + [(k, k + 1) for k in range(300, 330)] + [(299, 300), (7, 8), (8, 7), (9, 9), (400, 401), (401, 402), (402, 400)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    df = spark.createDataFrame([(b"%03d" % x, b"%03d" % y) for x, y in edges], "a binary, b binary")
    got = {int(bytes(r["node"])): int(bytes(r["label"])) for r in neardup.components(df).collect()}
    assert got == {x: y for x, y in label.items() if x != 9}
    counted = neardup.cut(df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    joined = neardup.with_key(df, counted, "a", df.count())
    assert joined.columns == ["a", "b", "m"] and sorted(joined.collect()) == sorted(df.join(counted.drop("n"), "a").collect())
    assert joined.count() == len(edges) and "BroadcastExchange" in joined._jdf.queryExecution().toString()
    assert neardup.components(df.filter("false")).count() == 0


def test_near_duplicates_odd_rows(odd):
    got = neardup.near_duplicate_classes(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[5] == by[6] == 5 and by[2] == by[3] == 2 and by[7] == 7
    assert neardup.deduplicate(odd).filter("doc_id = 1").count() == 1


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 9, 300)
    b = np.where(rng.random(300) < 0.3, rng.integers(1, 9, 300), a)
    element = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    owner = np.repeat([0, 1], 300)
    s = neardup.bag_minhash(owner, np.concatenate((element, element)), np.concatenate((a, b)), 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - truth) < 0.03
