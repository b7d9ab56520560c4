"""Not-modified revisits resolved to the response they stand for.

A revisit record says that a page had not changed since an earlier capture; its body is missing.
An as-of join by canonical URL finds the latest full response captured before it. The revisit is
resolved when the validators of both agree, and the headers a 304 answer may update are merged
into the stored ones.

The join is a window over (URL, stretch of time) with what the stretches before carry in, so a
URL with a third of all captures is spread over as many tasks as its captures fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPTURES_PER_STRETCH = 50_000
# Fields that a 304 answer carries for updating a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires",
             "last-modified", "vary")
# Query parameters that follow visitors and do not name content.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid|sid)(=|$)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes,
    query without tracking parameters and sorted; scheme and fragment left out. Null for null."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)),
                                             "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", ""),
                            "/index[.]html?$", "")
    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(url, _URL, 3), "&"),
        lambda part: (part != "") & ~part.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query))
                    .otherwise(F.lit("")))


def captures_from_pages(pages: DataFrame) -> DataFrame:
    """Capture records made of ``pages``: a full response and a later revisit for every page.

    The response of page p is captured at second 600 p. The revisit follows 60 to 86,459 seconds
    later and carries, by p modulo 5: the strong entity tag, its weak form, only the date of last
    change, a tag that no longer fits, or only the digest of the body. Null pages count as empty.
    """
    page = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    changed = (page * 600 - 3600).cast("string")
    then, later = page * 600, page * 600 + 60 + F.pmod(page * 7919, F.lit(86_400))
    kind = F.pmod(page, F.lit(5))
    sent_tag = F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag)).when(
        kind == 3, F.lit('"gone"'))
    body = F.coalesce(F.octet_length("html"), F.lit(0))

    def headers(*pairs: tuple[str, Column]) -> Column:
        every = F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])
        return F.map_filter(every, lambda _, value: value.isNotNull())

    full = F.struct(
        (page * 2).alias("capture_id"), F.lit(True).alias("is_full"), then.alias("ts"),
        headers(("date", then.cast("string")), ("etag", tag), ("last-modified", changed),
                ("cache-control", F.lit("max-age=60")), ("content-type", F.lit("text/html")),
                ("content-length", body.cast("string"))).alias("headers"),
        digest.alias("digest"), body.cast("long").alias("length"))
    revisit = F.struct(
        (page * 2 + 1).alias("capture_id"), F.lit(False).alias("is_full"), later.alias("ts"),
        headers(("date", later.cast("string")), ("etag", sent_tag),
                ("last-modified", F.when(kind == 2, changed)),
                ("cache-control", F.lit("max-age=120")), ("connection", F.lit("close")),
                ("content-length", F.lit("0"))).alias("headers"),
        F.when(kind == 4, digest).alias("digest"), F.lit(0).cast("long").alias("length"))
    return pages.select("page_id", "url", F.explode(F.array(full, revisit)).alias("c")).select(
        "page_id", "url", "c.*")


def _agreement(full: Column, revisit_headers: Column, revisit_digest: Column) -> Column:
    """Whether the strongest validator both records have agrees; null without a common one."""
    def weak(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    tags = weak(full["headers"]["etag"]) == weak(revisit_headers["etag"])
    dates = full["headers"]["last-modified"] == revisit_headers["last-modified"]
    return F.coalesce(tags, dates, full["digest"] == revisit_digest)


def resolve(captures: DataFrame, captures_per_stretch: int = CAPTURES_PER_STRETCH) -> DataFrame:
    """One row per revisit: what it refers to, why not if it does not, and its headers.

    ``captures`` needs capture_id, url, is_full, ts, headers (a map with lower-case names),
    digest and length; other columns are not read. ``status`` is ``resolved``,
    ``no_earlier_response``, ``validator_mismatch``, ``no_validator`` or ``no_url``. Earlier means
    a smaller ``ts``; of responses at the same time the one with the greater id is taken. Without
    a time a capture is neither found nor resolved. Repeated rows give repeated results; null
    headers count as none; an empty table gives an empty one.
    """
    rows = captures.select(
        "capture_id", "url", F.coalesce("is_full", F.lit(False)).alias("is_full"), "ts",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "digest", "length", canonical_url(F.col("url")).alias("canonical_url"))
    extent = rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"),
                      F.max("ts").alias("high")).first()
    stretches = max(1, -(-extent["n"] // captures_per_stretch))
    low = extent["low"] or 0
    span = max(1, -(-((extent["high"] or 0) - low + 1) // stretches))
    rows = rows.withColumn("_stretch", F.floor((F.col("ts") - low) / span))
    response = F.when(F.col("is_full") & F.col("ts").isNotNull(), F.struct(
        "capture_id", "ts", "headers", "digest", "length"))

    keys = ["canonical_url", "_stretch"]
    # At the same second revisits stand before responses: those are not earlier.
    within = Window.partitionBy(*keys).orderBy("ts", "is_full", "capture_id").rowsBetween(
        Window.unboundedPreceding, -1)
    last_of_stretch = rows.where(F.col("is_full") & F.col("canonical_url").isNotNull()).groupBy(
        *keys).agg(F.max_by(response, F.struct("ts", "capture_id")).alias("_last"))
    by_stretch = rows.where(~F.col("is_full")).select(*keys).distinct().join(
        last_of_stretch, keys, "full")
    carried = by_stretch.select(*keys, F.last("_last", ignorenulls=True).over(
        Window.partitionBy("canonical_url").orderBy("_stretch").rowsBetween(
            Window.unboundedPreceding, -1)).alias("_carried")).where("_carried is not null")
    found = rows.withColumn("_near", F.last(response, ignorenulls=True).over(within)).where(
        ~F.col("is_full")).join(carried, keys, "left").withColumn(
        "_full", F.coalesce("_near", "_carried"))

    agree = _agreement(F.col("_full"), F.col("headers"), F.col("digest"))
    status = (
        F.when(F.col("canonical_url").isNull(), "no_url")
        .when(F.col("_full").isNull() | F.col("ts").isNull(), "no_earlier_response")
        .when(agree.isNull(), "no_validator")
        .when(agree, "resolved").otherwise("validator_mismatch"))
    update = F.map_filter("headers", lambda name, _: name.isin(*PERMITTED))
    merged = F.map_concat(
        F.map_filter(F.col("_full.headers"),
                     lambda name, _: ~F.array_contains(F.map_keys(update), name)), update)
    resolved = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "capture_id", "url", "canonical_url", "ts", "status",
        F.when(resolved, F.col("_full.capture_id")).alias("refers_to"),
        F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("_full.digest")).alias("payload_digest"),
        F.when(resolved, F.col("_full.length")).alias("payload_length"))


def with_payload(resolved: DataFrame, bodies: DataFrame, body_col: str = "html") -> DataFrame:
    """Add the body of the response referred to; ``bodies`` has capture_id and ``body_col``."""
    found = bodies.select(F.col("capture_id").alias("refers_to"), F.col(body_col).alias("payload"))
    return resolved.join(found, "refers_to", "left")


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in order of name."""
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
