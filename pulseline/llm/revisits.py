"""Not-modified revisits resolved to the response that they stand for.

A revisit record says that a page had not changed. It is joined, by canonical URL, to
the latest full response captured earlier; the validators decide whether that response
is the one meant, and the revisit becomes a full record again: the response's payload,
its headers updated by those that a not-modified answer may carry.

The as-of join sorts inside (URL, time slice) only. What crosses slices is the last
response of each earlier slice, one row per URL and slice, so a URL with any share of
the records is spread over as many tasks as it has slices. Slices are as many as the
records need at ``SLICE_ROWS`` each. Payloads take no part in it: they are joined by
record id at the end, once per resolved revisit.

Input: record_id, url, captured_at (long), kind ('response' or 'revisit'), headers
(map<string,string>), digest, and ``payload``. Result: one row per revisit, with
canonical_url, refers_to (the response's record_id, if resolved), outcome, headers and
payload. Outcomes: 'etag', 'last-modified', 'digest' (the validator that matched, tried
in that order; the first that the revisit carries decides), 'changed' (it differs),
'unverified' (the revisit carries none) and 'no earlier response'.

Defined results: records without URL or time are never a target, and as revisits find
no response. Equal times are not earlier; among responses of one time the largest
record_id counts, and a response with null record_id is none. Header names are
compared in lower case; of repeated names the last in the order of (name, value) stays.
Repeated revisits give repeated rows, repeated responses count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise

SLICE_ROWS = 1 << 13
# Connection-specific fields, and content fields that describe the stored payload.
NOT_PERMITTED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
    "content-encoding", "content-length", "content-range", "content-type",
)
SESSION_PARAMETERS = "(utm_[^=]*|phpsessid|jsessionid|sid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, ``www.``, default port, fragment, session and campaign
    parameters and a trailing slash; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^([^@]*@)?(www[0-9]*\\.)?", "")
    host = F.regexp_replace(host, ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{SESSION_PARAMETERS}(=|$)"))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(kept), "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Entries (k, v) with lower-case names, sorted, one per name."""
    entries = F.sort_array(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    rest = F.slice(entries, F.lit(2), F.size(entries))
    last = F.filter(F.zip_with(entries, rest, lambda a, b: F.struct(a["k"].alias("k"), a["v"].alias("v"), b["k"].alias("n"))),
                    lambda e: e["n"].isNull() | (e["n"] != e["k"]))
    return F.coalesce(F.transform(last, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))),
                      F.array().cast("array<struct<k:string,v:string>>"))


def _field(entries: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(entries, lambda e: e["k"] == name), lambda e: e["v"]), F.lit(0))


def merged_headers(stored: Column, update: Column) -> Column:
    """Sorted entries of the stored response, replaced or extended by the permitted ones
    of the not-modified answer."""
    allowed = F.filter(update, lambda e: ~e["k"].isin(*NOT_PERMITTED))
    kept = F.filter(stored, lambda e: ~F.exists(allowed, lambda a: a["k"] == e["k"]))
    return F.sort_array(F.concat(kept, allowed))


def latest_earlier(records: DataFrame) -> DataFrame:
    """``records`` (url_key, at, record_id, is_response, ...) with ``found``: record_id of
    the latest response with the same key and a smaller ``at``."""
    span = records.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    slices = max(1, -(-span[0] // SLICE_ROWS))
    width = max(1, -(-((span[2] or 0) - (span[1] or 0) + 1) // slices))
    sliced = records.withColumn("slice", F.floor((F.col("at") - F.lit(span[1] or 0)) / F.lit(float(width))).cast("long"))
    response = F.when(F.col("is_response") & F.col("record_id").isNotNull(), F.struct("at", "record_id"))
    along = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (sliced.groupBy("url_key", "slice").agg(F.max(response).alias("own"))
              .select(F.col("url_key").alias("k"), F.col("slice").alias("s"), F.max("own").over(along).alias("carried")))
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.max(response).over(inside))
    joined = near.join(before, (F.col("url_key") == F.col("k")) & (F.col("slice") == F.col("s")), "left")
    return joined.withColumn("found", F.coalesce("near", "carried")["record_id"]).drop("slice", "near", "k", "s", "carried")


def resolve(records: DataFrame) -> DataFrame:
    usable = F.col("url").isNotNull() & F.col("captured_at").isNotNull()
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.when(usable, canonical_url(F.col("url"))).alias("url_key"),
        F.when(usable, F.col("captured_at").cast("long")).alias("at"), (F.col("kind") == "response").alias("is_response"),
        (F.col("kind") == "revisit").alias("is_revisit"), lower_names(F.col("headers")).alias("entries"), F.col("digest").cast("string").alias("digest"))
    slim = materialise(rows.where("is_response or is_revisit"), "records")
    asof = latest_earlier(slim.where("url_key is not null").select("url_key", "at", "record_id", "is_response", "is_revisit", "entries", "digest"))
    placed = asof.where("is_revisit").drop("is_response", "is_revisit").unionByName(
        slim.where("is_revisit and url_key is null").select("url_key", "at", "record_id", "entries", "digest", F.lit(None).cast("long").alias("found")))
    targets = (slim.where("is_response and record_id is not null and url_key is not null")
               .select(F.col("record_id").alias("found"), F.col("entries").alias("stored"), F.col("digest").alias("stored_digest")).dropDuplicates(["found"]))

    def tag(entries: Column) -> Column:
        return F.regexp_replace(_field(entries, "etag"), "^W/", "")

    def verdict(mine: Column, theirs: Column, name: str) -> Column:
        return F.when(mine == theirs, F.lit(name)).otherwise(F.lit("changed"))

    judged = placed.join(targets, "found", "left").withColumn("outcome", F.when(
        F.col("found").isNull(), F.lit("no earlier response"))
        .when(_field(F.col("entries"), "etag").isNotNull(), verdict(tag(F.col("entries")), tag(F.col("stored")), "etag"))
        .when(_field(F.col("entries"), "last-modified").isNotNull(),
              verdict(_field(F.col("entries"), "last-modified"), _field(F.col("stored"), "last-modified"), "last-modified"))
        .when(F.col("digest").isNotNull(), verdict(F.col("digest"), F.col("stored_digest"), "digest"))
        .otherwise(F.lit("unverified")))
    resolved = F.col("outcome").isin("etag", "last-modified", "digest")
    final = judged.select(
        "record_id", F.col("url_key").alias("canonical_url"), F.when(resolved, F.col("found")).alias("refers_to"), "outcome",
        F.when(resolved, merged_headers(F.col("stored"), F.col("entries"))).alias("entries"))
    payloads = (records.where("kind = 'response' and record_id is not null and url is not null and captured_at is not null")
                .select(F.col("record_id").cast("long").alias("refers_to"), F.col("payload").cast("string").alias("payload")).dropDuplicates(["refers_to"]))
    return final.join(payloads, "refers_to", "left").select(
        "record_id", "canonical_url", "refers_to", "outcome",
        F.when(F.col("entries").isNotNull(), F.map_from_entries("entries")).alias("headers"), "payload")
