"""Not-modified revisits resolved to the responses that they confirm.

A revisit record says that a page has not changed since an earlier capture. It
is resolved by an as-of join: the latest full response of the same canonical URL
that is earlier than the revisit. The validators must agree, and only headers that
a not-modified answer may update are taken from the revisit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Header fields that a 304 answer may update (RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, n_bytes long, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slashes, sorted query.

    Scheme, fragment and utm_ parameters don't count. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\d*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))
    )
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, base_id, verdict, digest, n_bytes, headers.

    records has the columns of RECORD; others are ignored. verdict is
    - no_base: no earlier response of that URL (or url or time is null);
    - resolved: the first validator that the revisit carries, of ETag (compared
      weakly), Last-Modified and payload digest, agrees with the response's;
    - mismatch: it doesn't agree, or the response lacks it;
    - unverified: the revisit carries none.
    digest, n_bytes and headers are the response's, headers updated by the
    PERMITTED ones of the revisit (names in lower case); they are null unless
    resolved. Of responses at one time the largest record_id is the latest; a
    response at the revisit's own time is not earlier. Repeated revisits give a
    row each. Rows with a null kind are ignored.

    Rows are dealt out by ranges of (URL, time), so that a URL with a third of all
    rows is spread over many tasks. Each task finds the base within its range;
    the last response of each range, one row per URL and range, is carried on to
    the ranges that follow.
    """
    spark = records.sparkSession
    url = canonical_url(F.col("url"))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.coalesce(url, F.lit("")).alias("key"),
        (F.col("kind") == "response").alias("full"),
        (F.col("url").isNotNull() & F.col("at").isNotNull()).alias("usable"),
        *[c.split()[0] for c in RECORD.split(", ") if c.split()[0] not in ("url", "kind")],
    )
    order = ["at", "full", "record_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written out: the ranges must be the same for all that follows
    rows = checkpoint(rows.repartitionByRange(n, "key", *order).withColumn("block", F.spark_partition_id()))
    base = F.when(F.col("full") & F.col("usable"), F.struct("record_id", "etag", "last_modified", "digest", "n_bytes", "headers"))
    rows = rows.withColumn("base", base)

    ends = rows.filter("base is not null").groupBy("key", "block").agg(F.max_by("base", F.struct(*order)).alias("end"))
    spans = rows.groupBy("key", "block").agg(F.count("*").alias("n")).join(ends, ["key", "block"], "left")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "block", F.last("end", ignorenulls=True).over(before).alias("carried")).filter("carried is not null")

    own = Window.partitionBy("block", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("own", F.last("base", ignorenulls=True).over(own)).filter("not full")
    found = found.join(carried, ["key", "block"], "left")
    b = F.when(F.col("usable"), F.coalesce("own", "carried"))
    found = found.withColumn("b", b)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agrees = (
        F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("b.etag")))
        .when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("b.last_modified"))
        .when(F.col("digest").isNotNull(), F.col("digest") == F.col("b.digest"))
    )
    carries = F.coalesce("etag", "last_modified", "digest").isNotNull()
    verdict = (
        F.when(F.col("b").isNull(), "no_base")
        .when(~carries, "unverified")
        .when(F.coalesce(agrees, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    found = found.withColumn("verdict", verdict)
    low = lambda m: F.map_from_entries(  # noqa: E731  the last of names that differ in case only counts
        F.transform(
            F.array_distinct(F.transform(F.map_keys(m), F.lower)),
            lambda k: F.struct(k, F.element_at(F.map_values(F.map_filter(m, lambda x, _: F.lower(x) == k)), -1)),
        )
    )
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    new = F.map_filter(low(F.coalesce("headers", none)), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(low(F.coalesce("b.headers", none)), lambda k, _: ~F.array_contains(F.map_keys(F.col("new")), k))
    found = found.withColumn("new", new).withColumn("old", old)
    ok = F.col("verdict") == "resolved"
    return found.select(
        "record_id",
        F.when(F.col("usable") | (F.col("key") != ""), F.col("key")).alias("canonical_url"),
        F.col("b.record_id").alias("base_id"),
        "verdict",
        F.when(ok, F.col("b.digest")).alias("digest"),
        F.when(ok, F.col("b.n_bytes")).alias("n_bytes"),
        F.when(ok, F.map_concat("old", "new")).alias("headers"),
    )


def capture_records(pages: DataFrame) -> DataFrame:
    """Records as a crawler would have written them for a table of pages.

    Each page is fetched at a time of its own, in order of page_id: first a
    revisit, which claims that what is there now was there at the capture
    before (right only for copies); then the full response; then a revisit that
    confirms it, with a weak ETag and a few headers.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    p = pages.select("page_id", "url", tag.alias("tag"), F.md5(F.coalesce("html", F.lit(""))).alias("md5"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    date = lambda i: F.concat(F.lit("t"), (F.col("page_id") * 3 + i).cast("string"))
    pair = lambda k, v: (F.lit(k), v)

    def record(i: int, kind: str, etag: Column, headers: list[tuple[Column, Column]]) -> Column:
        return F.struct(
            (F.col("page_id") * 3 + i).alias("record_id"),
            F.col("url").alias("url"),
            (F.col("page_id") * 3 + i).alias("at"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"),
            F.col("md5").alias("digest"),
            (F.col("n") if kind == "response" else F.lit(0).cast("long")).alias("n_bytes"),
            F.create_map(*[x for kv in headers for x in kv]).alias("headers"),
        )

    revisit = lambda i: [pair("Date", date(i)), pair("Cache-Control", F.lit("max-age=60")), pair("Content-Length", F.lit("0"))]
    full = [pair("Date", date(1)), pair("ETag", F.col("tag")), pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.col("n").cast("string"))]
    records = F.array(
        record(0, "revisit", F.col("tag"), revisit(0)),
        record(1, "response", F.col("tag"), full),
        record(2, "revisit", F.concat(F.lit("W/"), F.col("tag")), revisit(2)),
    )
    return p.select(F.inline(records))
