"""Not-modified captures resolved to the response that they confirm.

Method: an as-of join by canonical URL, in DataFrame operations alone. Each not-modified capture takes
the latest earlier full response of its URL; the validators of both are checked, and the headers that
a 304 may update are merged into those of the response. Only keys, times, validators and headers
move; payloads stay where they are and can be joined by record id.

A URL that holds a large share of all captures is dealt by time: within a time bucket the latest response
is found by a window, and what a bucket inherits from earlier ones comes from a summary with one row
for each URL and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Captures that time buckets are made for.
BUCKET_SECONDS = 4096


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, ``www.`` or ``m.``; the path without trailing slash or index page; the query in order
    without tracking parameters; no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """The map with keys in lower case; of keys that become equal the first by its bytes stays. Null is empty."""
    empty = F.create_map().cast("map<string,string>")
    one = lambda e: F.create_map(F.lower(e["key"]), e["value"])
    return F.coalesce(F.aggregate(F.array_sort(F.map_entries(headers)), empty, lambda m, e: F.when(F.map_contains_key(m, F.lower(e["key"])), m).otherwise(F.map_concat(m, one(e)))), empty)


def resolve_revisits(captures: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``record_id, url_key, at, refers_to, status, headers``, one row for each not-modified capture.

    ``captures (record_id long, url string, at long, http_status int, etag string, last_modified string,
    headers map<string,string>)``; ``at`` in seconds. ``refers_to`` is the record of the latest response with status 200
    that is strictly earlier for the same canonical URL, the greater record id on ties. ``status``:
    ``resolved`` if a validator that both have agrees (the ETag, weak ones without their mark, before the
    date), ``unchecked`` if they share none, ``mismatch`` if the first they share differs, ``orphan`` if
    there is no earlier response. ``headers`` are the response's with the permitted ones of the capture
    over them, for ``resolved`` and ``unchecked``; else null. Captures with a null URL or time are orphans.
    Repeated rows are resolved each; payloads, however long, are not read. Other columns are ignored. An empty
    table gives an empty result.
    """
    base = captures.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long").alias("at"), "http_status", "etag", "last_modified", "headers")
    usable = base.where("url_key is not null and at is not null").withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    response = F.struct("at", "record_id", "etag", "last_modified", "headers")
    full = F.when(F.col("http_status") == 200, response)

    # what each (URL, bucket) inherits: the latest response of an earlier bucket
    order = F.struct("at", "record_id")
    last = usable.where("http_status = 200").groupBy("url_key", "bucket").agg(F.max_by(response, order).alias("own"))
    buckets = usable.select("url_key", "bucket").distinct().join(last, ["url_key", "bucket"], "left")
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = buckets.select(F.col("url_key").alias("k"), F.col("bucket").alias("b"), F.last("own", ignorenulls=True).over(earlier).alias("before"))

    # captures at one time don't see each other: the frame ends one second before
    inside = Window.partitionBy("url_key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(full, F.when(F.col("http_status") == 200, order)).over(inside)
    seen = usable.withColumn("latest", latest).where("http_status = 304")
    joined = seen.join(inherited, (F.col("url_key") == F.col("k")) & (F.col("bucket") == F.col("b")), "left")
    found = joined.withColumn("response", F.coalesce("latest", "before")).select("record_id", "url_key", "at", "etag", "last_modified", "headers", "response")
    lost = base.where("http_status = 304 and (url_key is null or at is null)").select("record_id", "url_key", "at", "etag", "last_modified", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response"))

    rows = found.unionByName(lost)

    def strong(c: Column) -> Column:
        return F.regexp_replace(c, "^W/", "")

    agree = F.coalesce(strong(F.col("etag")) == strong(F.col("response.etag")), F.col("last_modified") == F.col("response.last_modified"))
    status = F.when(F.col("response").isNull(), "orphan").when(agree, "resolved").when(agree.isNull(), "unchecked").otherwise("mismatch")
    update = F.map_filter(lower_keys(F.col("headers")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(lower_keys(F.col("response.headers")), lambda k, v: ~F.map_contains_key(update, k))
    rows = rows.withColumn("status", status)
    return rows.select("record_id", "url_key", "at", F.when(F.col("status").isin("resolved", "unchecked", "mismatch"), F.col("response.record_id")).alias("refers_to"), "status", F.when(F.col("status").isin("resolved", "unchecked"), F.map_concat(kept, update)).alias("headers"))
