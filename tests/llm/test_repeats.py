"""Periodic runs, shared lines and collocations: brute force over whole tables, hand-made cases, odd inputs, hot keys."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxframe.llm import bytewords, collocations, linededup, periodic
from voxframe.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = "eine sehr lange Zeile mit vielen Wörtern darin, immer wieder\n" * 3000
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (2, None, None), (3, "", "en"), (4, " \n\t\n", None), (None, "x " * 50, None), (5, long, "de"), (6, long, "de"), (7, "日本 " * 9, "ja"), (8, "word", None)]
    names = ("runs", "start", "strongest", "n_words", "keep", "kept", "n_lines", "n_dropped", "text_key", "h1", "lines", "rank", "phrase", "a", "p", "f", "w")
    return frame(spark, rows).withColumns({n: F.lit("x") for n in names})


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ words of bytes


def test_words_in_blocks_are_the_words(monkeypatch):
    data = "Ab cde\t\nfg. héllo,, x".encode() * 40
    kind = bytewords.kinds(b" \t", b".,\n")
    whole = bytewords.words(data, kind, bytewords.LOWER)
    want = [m.span() for m in re.finditer(rb"[^ \t.,\n]+", data)]
    assert list(zip(whole.start, whole.end, strict=True)) == want
    by_text = defaultdict(set)
    for (s, e), h in zip(want, whole.hash, strict=True):
        by_text[data[s:e].lower()].add(int(h))
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    for block in (16, 50, 333):
        monkeypatch.setattr(bytewords, "BLOCK", block)
        part = bytewords.words(data, kind, bytewords.LOWER)
        assert all(np.array_equal(a, b) for a, b in zip(part, whole, strict=True))
    monkeypatch.setattr(bytewords, "BLOCK", 8)
    long = bytewords.words(b"x" * 30 + b" y." + b"x" * 30 + b",X" + b"x" * 29, kind, bytewords.LOWER)
    assert list(zip(long.start, long.end, strict=True)) == [(0, 30), (31, 32), (33, 63), (64, 94)] and len(set(long.hash.tolist())) == 2
    assert long.breaks.tolist() == [0, 0, 1, 2] and not len(bytewords.words(b"", kind).start)


# ------------------------------------------------------------------ periodic runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items() if not any(s2 <= s and s + n <= s2 + n2 and q2 < q for (s2, n2), q2 in out.items()))


def plain_report(doc_id: int | None, text: str | None) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words_against_all_lags():
    rng = random.Random(5)
    for trial in range(400):
        n, size = rng.randint(0, 90), rng.choice((1, 2, 3, 8, 40))
        w = [rng.randrange(size) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            p, k = rng.randint(1, 14), rng.randint(0, max(0, n - 1))
            for i in range(k, min(n, k + p * rng.randint(3, 6) + rng.randint(0, p))):
                w[i] = w[i - p] if i - p >= k else w[i]
        texts = [" ".join(f"w{x}" for x in part).encode() for part in (w, [], w[: n // 2], w)]
        got = periodic.document_runs(texts)
        assert got == [plain_runs(w), [], plain_runs(w[: n // 2]), plain_runs(w)], (trial, w)


def test_runs_over_the_whole_table(documents):
    got = {r["doc_id"]: tuple(r) for r in periodic.run_report(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows) and {r["doc_id"]: plain_report(r["doc_id"], r["text"]) for r in rows} == got
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    honest = periodic.words
    monkeypatch.setattr(periodic, "words", lambda data, kind: honest(data, kind)._replace(hash=np.ones(len(honest(data, kind).hash), np.uint64)))
    assert periodic.document_runs([b"a b a b a b a b a c", b"a b c d e f g"]) == [[(0, 9, 2)], []]


def test_long_runs_take_few_steps():
    """A period of thousands of words and 200,000 equal words: both would be far too slow word by word and lag by lag."""
    block = [f"w{i}" for i in range(5000)]
    assert periodic.document_runs([" ".join(block * 5).encode()]) == [[(0, 25000, 5000)]]
    assert periodic.document_runs([b"x " * 200_000]) == [[(0, 200_000, 1)]]


def test_runs_give_spans_and_text(spark):
    got = periodic.periodic_runs(frame(spark, [(1, "go  a b a b a b a b a stop", "en")])).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 9, 2)] and tuple(got["strongest"]) == (1, 9, 2) and got["collapsed"] == "go a b stop" and got["n_words"] == 11


def test_runs_odd_rows(odd):
    rows = periodic.run_report(odd).collect()
    want = sorted(map(str, (plain_report(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if r["doc_id"] not in (5, 6))))
    assert sorted(str(tuple(r)) for r in rows if r["doc_id"] not in (5, 6)) == want and len(rows) == 10
    assert {tuple(x) for r in periodic.periodic_runs(odd).filter("doc_id IN (5, 6)").collect() for x in r["runs"]} == {(0, 30000, 10)}
    assert periodic.run_report(odd.filter("false")).count() == 0


# ------------------------------------------------------------------ shared lines


def plain_lines(rows: list[tuple[int | None, str | None]], chars: int = 40, least: int = 5) -> list[tuple]:
    strip = " \t\n\v\f\r"
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    of, order = defaultdict(set), lambda d: linededup.NO_ID if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(low(line)) >= chars:
                of[low(line)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(of.get(low(x), ())) < least or max(of[low(x)]) == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines_over_the_whole_table(spark, documents):
    got = told(linededup.line_report(documents))
    assert got == plain_lines([tuple(r) for r in documents.select("doc_id", "text").collect()]) and sum(r[2] for r in got) > 30
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    assert got == sorted(duck.execute(ORACLE_SQL["op12_line_dedup"]).fetchall(), key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_lines_that_span_partitions(spark, parts, monkeypatch):
    """One line in two thirds of all documents, over many ranges; small Arrow batches."""
    rng = random.Random(3)
    hot = "The same line that very many documents hold, again and again."
    pool = [f"{i} is a line of at least forty code points, or so" for i in range(40)]
    rows = [(i, "\n".join([*([hot, hot.upper() + "  "] if i % 3 else []), *rng.sample(pool, rng.randint(0, 4)), "short"]), "en") for i in range(600)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, (str(parts), "7", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        assert told(linededup.line_report(frame(spark, rows))) == plain_lines([r[:2] for r in rows])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_bitmaps(spark):
    line = "x" * 40
    rows = [(i, f"{line}\nown {i}\n{line}", "en") for i in range(5)]
    got = {r["doc_id"]: r for r in linededup.keep_bitmaps(frame(spark, rows)).collect()}
    assert linededup.unpack(got[0]["keep"], 3).tolist() == [False, True, False] and linededup.unpack(got[4]["keep"], 3).all() and got[0]["n_dropped"] == 2
    assert all(r["n_dropped"] == 0 for r in linededup.keep_bitmaps(frame(spark, rows[:4])).collect())
    assert {r["n_dropped"] for r in linededup.keep_bitmaps(frame(spark, rows[:4]), least=2).collect()} == {0, 2}


def test_lines_odd_rows(odd, spark):
    narrow = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert told(linededup.line_report(odd)) == plain_lines(narrow)
    more = frame(spark, [(i, narrow[6][1] if i else None, "x") for i in range(6)] + [(5, "z" * 50 + "\n" + narrow[6][1], "x"), (None, narrow[6][1], None), (None, narrow[6][1], None)])
    assert told(linededup.line_report(more)) == plain_lines([tuple(r) for r in more.select("doc_id", "text").collect()])
    assert linededup.line_report(odd.filter("false")).count() == 0
    kept = linededup.kept_lines(odd, linededup.keep_bitmaps(odd))
    assert kept.count() == 10 and "kept" in kept.columns


# ------------------------------------------------------------------ collocations


def plain_phrases(rows: list[tuple[str | None, str | None]], least: int, best: int) -> list[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    counts[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        within = {(q, v) for p, v in c.items() if len(p) > 2 and v >= least for q in (p[:-1], p[1:])}
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and (p, a) not in within:
                score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "share"), [(5, 2000, 1 / 64), (20, 100, 1.0), (3, 300, 1 / 256)])
def test_collocations_over_the_whole_table(documents, least, best, share):
    got = sorted(tuple(r) for r in collocations.phrase_collocations(documents, least, best, share=share).collect())
    assert got and got == plain_phrases([tuple(r) for r in documents.select("lang", "text").collect()], least, best)


def test_collocations_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = QUERIES["op13_phrase_collocations"](spark, DIR)
    want = duck.execute(ORACLE_SQL["op13_phrase_collocations"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_collocations_of_repeated_words_and_ties(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 9]) + rng.choice(("", "", "", ",", ".", "\n")) for _ in range(300)), rng.choice(("en", "fr", None))) for i in range(30)]
    rows += [(99, "one two three four five six. " * 40, "fr"), (100, "ja ja ja ja ja ja ja " * 60, "de")]
    want = plain_phrases([(lang, t) for _, t, lang in rows], 10, 25)
    for row, group in ((1 << 18, 1 << 20), (16, 64)):
        monkeypatch.setattr(collocations, "ROW", row)
        monkeypatch.setattr(collocations, "GROUP", group)
        assert sorted(tuple(r) for r in collocations.phrase_collocations(frame(spark, rows), 10, 25, share=1 / 100).collect()) == want


def test_collocation_scores_pass_64_bits(spark):
    one = spark.createDataFrame([("x", 1, 4 * 10**9, "a", 10**18), ("x", 2, 3 * 10**9, "b", 10**18)], "lang string, w long, f long, word string, limit long")
    grams = spark.createDataFrame([("x", [1], 4 * 10**9), ("x", [2], 3 * 10**9), ("x", [1, 2], 10**9 + 7)], "lang string, p array<long>, f long")
    state = spark.createDataFrame([("x", 10**13 + 1)], "lang string, n long")
    assert collocations._scores(grams, one, state).first()["score"] == 1000 * (10**9 + 7) * (10**13 + 1) // (12 * 10**18)


def test_collocations_odd_rows(odd):
    got = sorted(tuple(r) for r in collocations.phrase_collocations(odd, 5, 50).collect())
    assert got == plain_phrases([tuple(r) for r in odd.select("lang", "text").collect()], 5, 50) and got
    assert collocations.phrase_collocations(odd.filter("false")).count() == 0
    assert collocations.phrase_collocations(odd.filter("text IS NULL")).count() == 0


def test_collocations_pass_small_batches(spark):
    """Whatever lies in a partition, Spark holds some 10 MB of encoded rows for a worker at once, and gets counts in small parts."""
    text = F.repeat(F.lit("".join(f"w{i % 97}" + (", " if i % 7 == 0 else " ") for i in range(1000))), 4000)
    encoded = spark.range(1, numPartitions=1).select(F.lit("en"), text).mapInArrow(collocations._encode(0), "lang string, ids binary, word string, h long, c long").filter("ids IS NOT NULL").select("lang", "ids")

    def sizes(batches):
        for b in batches:
            ids = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "words": [sum(np.count_nonzero(x) for x in ids)]})

    got = encoded.mapInArrow(sizes, "size long, words long").collect()
    assert sum(r["words"] for r in got) == 4_000_000 and max(r["size"] for r in got) < 16 << 20
    ids = np.arange(1, 200_001, dtype=np.uint64)
    parts = list(collocations._counted("en", ids, np.arange(199_999), 2, 7))
    assert max(p.num_rows for p in parts) <= 1 << 16
    assert sorted(x for p in parts for x in zip(*[c.to_pylist() for c in p.columns[1:]], strict=True)) == [(i, i + 1, 1) for i in range(1, 200_000)]
    vocabulary = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"w{i}" for i in range(200_000))]})
    parts = list(collocations._encode(0)(iter([vocabulary])))
    assert max(p.num_rows for p in parts) <= 1 << 16 and sum(len(set(p.column(2).drop_null().to_pylist())) for p in parts) == 200_000
