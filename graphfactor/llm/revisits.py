"""WARC revisit records for "304 Not Modified", resolved to the response that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof

#: Fields that a 304 response may bring in place of the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Fixed value: end of the profile's address for "304 Not Modified", in any version of the format.
PROFILE = "/revisit/server-not-modified"
#: Seconds of a bucket of the as-of join.
BUCKET = 4096


def canonical_url(url: Column) -> Column:
    """One form of the URLs of a page: no fragment, scheme or default port, host in lower case without "www.",
    query parameters in order and without utm_ ones, no slash at the end. Null and blank give null."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(u != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Resolve revisits to the latest earlier full response of their canonical URL.

    records: record_id (long), url, fetched (long, seconds), kind ("response" or "revisit"), etag, last_modified,
    headers (map of lower-case names), body, and, where there are such columns, profile and refers_to (the revisit's
    WARC-Profile and WARC-Refers-To-Target-URI); other columns are not read. Returns one row per revisit: record_id,
    url (canonical, of refers_to if that is given), fetched, response_id, outcome, headers, body.

    Validators: where both records have an etag, these must be equal (a leading W/ is not heeded); else where both
    have last_modified, those must; without a common one nothing is proved. outcome is "other profile" (the profile is
    given and isn't that of "304 Not Modified"), "resolved", "no earlier response", "validators differ" or "no
    validator"; only "resolved" has headers and body. Headers are the response's, with PERMITTED ones of the revisit in
    their place. Responses of the same second as the revisit are not earlier; of responses of one second the largest
    by record_id, etag, last_modified and a hash of headers and body counts, whatever their order. Revisits with null url
    or time find nothing; responses with null url or time are never found; repeated revisits each get a row; other
    kinds are not read.
    """
    for column in ("profile", "refers_to"):
        if column not in records.columns:
            records = records.withColumn(column, F.lit(None).cast("string"))
    t = F.col("fetched").cast("long").alias("t")
    # a response is known by its content, as ids may be repeated or null
    parts = [*map(F.col, ("record_id", "etag", "last_modified", "body")), F.array_sort(F.map_entries("headers"))]
    content = F.xxhash64(*(x.isNull() for x in parts), F.coalesce(F.size("headers"), F.lit(-1)), *parts).alias("content")
    asked = records.where("kind = 'revisit'").select(canonical_url(F.coalesce("refers_to", "url")).alias("key"), t, F.struct("record_id", "etag", "last_modified", "headers", "profile").alias("row"))
    # bodies stay out of the as-of join and come by content afterwards
    given = records.where("kind = 'response'").select(canonical_url(F.col("url")).alias("key"), t, F.struct("record_id", "etag", "last_modified", content).alias("row"))
    found = asof.latest(asked, given, bucket, inclusive=False)
    strong = lambda x: F.regexp_replace(x, "^W/", "")
    mine, theirs = strong(F.col("row.etag")), strong(F.col("found.etag"))
    same = F.coalesce(mine == theirs, F.col("row.last_modified") == F.col("found.last_modified"))
    other = ~F.lower("row.profile").endswith(PROFILE)
    outcome = F.when(other, "other profile").when(F.col("found").isNull(), "no earlier response").when(same, "resolved").when(~same, "validators differ").otherwise("no validator")
    found = found.select("key", "t", "row", F.when(~F.coalesce(other, F.lit(False)), F.col("found")).alias("found"), outcome.alias("outcome"))
    stored = records.where("kind = 'response'").select(content, F.col("headers").alias("stored"), "body").dropDuplicates(["content"])
    # revisits that prove nothing meet nothing, and are spread by a key of their own
    proved = F.col("outcome") == "resolved"
    found = found.withColumn("proved", proved).withColumn("wanted", F.when(proved, F.col("found.content")).otherwise(F.xxhash64("row.record_id", "key", "t")))
    joined = found.join(stored.withColumn("stored_too", F.lit(True)), (F.col("wanted") == F.col("content")) & (F.col("proved") == F.col("stored_too")), "left")
    nothing = F.expr("cast(map() as map<string,string>)")
    new = F.map_filter(F.coalesce("row.headers", nothing), lambda k, _: k.isin(*PERMITTED))
    rest = F.map_filter(F.coalesce("stored", nothing), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    headers = F.when(proved, F.map_concat(rest, new))
    return joined.select(F.col("row.record_id").alias("record_id"), F.col("key").alias("url"), F.col("t").alias("fetched"), F.col("found.record_id").alias("response_id"), "outcome", headers.alias("headers"), "body")
