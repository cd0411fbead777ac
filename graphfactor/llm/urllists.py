"""URL filters: every capture against the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import asof

#: Seconds of a bucket of the as-of join.
BUCKET = 4096


def intervals(entries: DataFrame) -> DataFrame:
    """entries: domain, action ("block", "allow", or "remove"), listed (long). Returns domain, action, valid_from,
    valid_to: an entry holds until the next one of its domain (null: still), and "remove" only ends the one before.

    Domains are in lower case without dots at their ends. Of entries of one domain and second the least action
    counts. Entries with null in any column are left out; repeated entries count once.
    """
    domain = F.regexp_replace(F.lower(F.trim("domain")), "^[.]+|[.]+$", "")
    one = entries.where("domain is not null and action is not null and listed is not null").groupBy(domain.alias("domain"), F.col("listed").cast("long").alias("valid_from")).agg(F.min("action").alias("action"))
    until = F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))
    return one.select("domain", "action", "valid_from", until.alias("valid_to")).where("action <> 'remove' and domain <> ''")


def evaluate(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Judge every capture by the entries active when it was fetched.

    captures: capture_id (long), url, fetched (long); other columns are not read. An entry names a domain and all
    hosts under it; of the active ones that fit, the longest domain decides. Returns one row per row of captures:
    capture_id, host, fetched, domain and action and valid_from (of the deciding entry, else null), blocked.

    A null url, host or time fits no entry. Repeated captures each get their row.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim("url"), "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)), "[.]+$", "")
    base = captures.select("capture_id", F.when(host != "", host).alias("host"), F.col("fetched").cast("long").alias("t"))
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    active = intervals(entries)
    # hosts that no listed domain covers need no as-of join; each distinct host is looked up once
    hosts = base.where("host is not null").select("host").distinct().select("host", F.explode(suffixes).alias("key"))
    covered = hosts.join(active.select(F.col("domain").alias("key")).distinct(), "key", "left_semi")
    asked = base.where("t is not null").select("host", "t").distinct().join(covered, "host").select("key", "t", F.struct("host").alias("row"))
    given = active.select(F.col("domain").alias("key"), F.col("valid_from").alias("t"), F.struct("domain", "action", "valid_from", "valid_to").alias("row"))
    found = asof.latest(asked, given, bucket, inclusive=True).where("found.valid_to is null or t < found.valid_to").where("found is not null")
    best = found.groupBy(F.col("row.host").alias("at_host"), F.col("t").alias("at")).agg(F.max(F.struct(F.length("found.domain").alias("n"), "found")).alias("best"))
    joined = base.join(best, (F.col("host") == F.col("at_host")) & (F.col("t") == F.col("at")), "left")
    entry = F.col("best.found")
    return joined.select("capture_id", "host", F.col("t").alias("fetched"), entry["domain"].alias("domain"), entry["action"].alias("action"), entry["valid_from"].alias("valid_from"), F.coalesce(entry["action"] == "block", F.lit(False)).alias("blocked"))
