"""Resolution of not-modified revisit records: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that update the stored response's; content headers describe a body it doesn't have.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICES = 64
DROPPED_PARAMS = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, www., m. or default port; path without fragment and last slash; the remaining parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(DROPPED_PARAMS)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit record with the full response it stands for.

    records: record_id, url, ts, is_full, etag, last_modified, digest, headers (map of lower-case names); more columns are
    left out. "Earlier" is a smaller ts; of several responses at the latest such ts the largest record_id counts. A revisit
    with no earlier response gets status `no_earlier_response`; one whose ETag (or, where either has none, Last-Modified)
    differs gets `validator_mismatch` (ETags are compared weakly, without W/ in front); without a validator in common it gets `no_validator`; these carry no merged headers.
    Others are `resolved`: the response's headers with the permitted ones of the revisit on top. Records without URL or ts
    find no response. Repeated revisit rows give repeated results; an empty table an empty one.

    A URL may hold a third of all records: the join runs in (URL, time slice) groups, and each slice takes over the last
    response of the slices before it, of which one row a slice is kept.
    """
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce("is_full", F.lit(False)).alias("is_full"), "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    )
    bounds = slim.agg(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), [i / SLICES for i in range(1, SLICES)], 2000).alias("b")).first()["b"] or []
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array(F.lit(0.0))
    full = F.when(F.col("is_full") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # Records without URL or ts meet nothing and are dealt by id.
    nowhere = F.pmod(F.xxhash64("record_id"), F.lit(4 * SLICES)).cast("int") + SLICES
    slice_ = F.when(F.col("ts").isNull() | F.col("canonical_url").isNull(), nowhere).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("ts").cast("timestamp").cast("double"))))
    sliced = slim.withColumn("slice", slice_).withColumn("full", full)
    key = F.struct("ts", "record_id")
    last = sliced.groupBy("canonical_url", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), key)).alias("latest"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical_url", "slice", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    # Revisits sort before responses of the same instant, so that only strictly earlier ones are seen.
    inside = Window.partitionBy("canonical_url", "slice").orderBy("ts", "is_full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sliced.withColumn("near", F.last("full", ignorenulls=True).over(inside)).filter(~F.col("is_full"))
    joined = seen.join(carried, ["canonical_url", "slice"], "left").withColumn("of", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("near", "carried")))
    etag = lambda c: F.regexp_replace(c, "^W/", "")
    by_etag, by_date = F.col("etag").isNotNull() & F.col("of.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("of.last_modified").isNotNull()
    status = (
        F.when(F.col("of").isNull(), "no_earlier_response")
        .when(by_etag, F.when(etag(F.col("etag")) == etag(F.col("of.etag")), "resolved").otherwise("validator_mismatch"))
        .when(by_date, F.when(F.col("last_modified") == F.col("of.last_modified"), "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    own = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("of.headers", lambda k, _: ~F.map_contains_key(own, k))
    ok = F.col("status") == "resolved"
    return joined.withColumn("status", status).select(
        "record_id", "canonical_url", "ts", "status", F.when(ok, F.col("of.record_id")).alias("refers_to"), F.when(ok, F.col("of.ts")).alias("refers_to_ts"), F.when(ok, F.col("of.digest")).alias("payload_digest"), F.when(ok, F.map_concat(kept, own)).alias("merged_headers")
    )


#: Days between crawl rounds, and rounds after the first.
ROUND_DAYS, ROUNDS = 30, 3
#: Seconds by which pages of one URL are visited apart, so that a URL of many pages is spread over a round.
PAGE_STEP = 7919


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl that visits every page in four rounds.

    The first visit of most pages is a full response (one in 17 was missed); later ones answer not-modified unless the page
    changed (one in five, in round 2). Some answers carry only a date, one in eleven an ETag of another version.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 7), 16, 10).cast("long")
    rounds = pages.select("page_id", "url", h.alias("h"), F.md5(F.coalesce("html", F.lit(""))).alias("md5"), F.length("html").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS))).alias("round"))
    changed = (F.col("h") % 5 == 0) & (F.col("round") >= 2)
    version = F.when(changed, F.md5(F.concat(F.col("md5"), F.lit("/2")))).otherwise(F.col("md5"))
    full = ((F.col("round") == 0) & (F.col("h") % 17 != 0)) | ((F.col("round") == 2) & (F.col("h") % 5 == 0))
    seconds = F.lit(1704067200) + F.col("round") * (ROUND_DAYS * 86400) + (F.col("h") + F.coalesce(F.col("page_id"), F.lit(0)) * PAGE_STEP) % (ROUND_DAYS * 86400)
    etag = F.when(F.col("h") % 3 == 0, F.lit(None)).when(~full & (F.col("h") % 11 == 0), F.lit("stale")).otherwise(F.substring("version", 1, 16))
    base = rounds.withColumns({"version": version, "is_full": full, "seconds": seconds})
    modified = F.concat(F.lit("round "), F.when(changed, 2).otherwise(0).cast("string"))
    captures = base.withColumn("etag", etag).withColumn("last_modified", F.when(F.col("h") % 7 != 0, modified))
    headers = F.map_filter(
        F.create_map(
            F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("round") * 60).cast("string")), F.lit("content-length"), F.when(F.col("is_full"), F.col("n")).otherwise(F.lit(0)).cast("string"),
            F.lit("content-type"), F.when(F.col("is_full"), F.lit("text/html")), F.lit("date"), F.col("seconds").cast("string"), F.lit("etag"), F.col("etag"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return captures.select(
        (F.col("page_id") * 4 + F.col("round")).alias("record_id"), "url", F.timestamp_seconds("seconds").alias("ts"), "is_full", "etag", "last_modified", F.when(F.col("is_full"), F.col("version")).alias("digest"), headers.alias("headers")
    )


def revisit_report(pages: DataFrame) -> DataFrame:
    """resolve_revisits over page_captures, with headers as sorted lines and times as seconds."""
    out = resolve_revisits(page_captures(pages))
    lines = F.array_join(F.transform(F.array_sort(F.map_keys("merged_headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("merged_headers", k))), "\n")
    return out.select("record_id", "canonical_url", F.unix_seconds("ts").alias("ts"), "status", "refers_to", F.unix_seconds("refers_to_ts").alias("refers_to_ts"), "payload_digest", lines.alias("merged_headers"))


_PARAMS = "list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '" + DROPPED_PARAMS + "')))"
ORACLE_SQL = rf"""
WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest, ('0x' || substr(md5(coalesce(url, '')), 1, 7))::BIGINT AS h, md5(coalesce(html, '')) AS m, length(html) AS n FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string({_PARAMS}, '&') ELSE '' END AS canonical_url FROM b),
r AS (SELECT *, h % 5 = 0 AND round >= 2 AS changed, (round = 0 AND h % 17 <> 0) OR (round = 2 AND h % 5 = 0) AS is_full, 1704067200 + round * {ROUND_DAYS * 86400} + (h + page_id * {PAGE_STEP}) % {ROUND_DAYS * 86400} AS ts FROM k, range({ROUNDS + 1}) t(round)),
v AS (SELECT *, CASE WHEN changed THEN md5(m || '/2') ELSE m END AS version FROM r),
c AS (SELECT page_id * 4 + round AS record_id, canonical_url, ts, round, n, is_full, version, CASE WHEN h % 3 = 0 THEN NULL WHEN NOT is_full AND h % 11 = 0 THEN 'stale' ELSE substr(version, 1, 16) END AS etag, CASE WHEN h % 7 <> 0 THEN 'round ' || CASE WHEN changed THEN 2 ELSE 0 END END AS modified FROM v),
j AS (SELECT a.record_id, arg_max(f.record_id, (f.ts, f.record_id)) AS of FROM c a JOIN c f ON f.is_full AND f.canonical_url = a.canonical_url AND f.ts < a.ts WHERE NOT a.is_full GROUP BY 1),
s AS (SELECT a.*, f.record_id AS f_id, f.ts AS f_ts, f.version AS f_version, f.n AS f_n, f.etag AS f_etag, CASE WHEN f.record_id IS NULL THEN 'no_earlier_response' WHEN a.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN a.etag = f.etag THEN 'resolved' ELSE 'validator_mismatch' END
 WHEN a.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN a.modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS status FROM c a LEFT JOIN j USING (record_id) LEFT JOIN c f ON f.record_id = j.of WHERE NOT a.is_full)
SELECT record_id, canonical_url, ts, status, CASE WHEN status = 'resolved' THEN f_id END AS refers_to, CASE WHEN status = 'resolved' THEN f_ts END AS refers_to_ts, CASE WHEN status = 'resolved' THEN f_version END AS payload_digest,
CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=' || (round * 60), 'content-length: ' || f_n, 'content-type: text/html', 'date: ' || ts, 'etag: ' || coalesce(etag, f_etag)) END AS merged_headers FROM s
"""
