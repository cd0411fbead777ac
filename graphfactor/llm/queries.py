"""One query for each operator of this package, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import decontaminate, gif, licenses, mixing, neardup, quality, revisits, scratch, substring, tokens, urllists
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup(_table(spark, sf_dir, "documents"), window=35)
    return scratch.few(cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts, base = F.col("places.start"), F.array_sort(F.array_distinct("places.label"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made from the whole table pages: a response of each page, and a later conditional request for it.

    By the first digit of the page's md5 the request is answered with a weak validator (0), comes before the
    response (1), has an outdated validator (2), has only a date (3), is a revisit of another profile (4), or was made
    of another address and refers to the page's (5); else it has the same validator.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", F.md5(F.coalesce("html", F.lit(""))).alias("h")).withColumn("d", F.substring("h", 1, 1))
    tag = F.concat(F.lit('"'), "h", F.lit('"'))
    when = (F.col("page_id") * 10).alias("fetched")
    head = lambda *x: F.create_map(*[F.lit(y) if i % 2 == 0 else y for i, y in enumerate(x)])
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", when, F.lit("response").alias("kind"), tag.alias("etag"), F.col("page_id").cast("string").alias("last_modified"), head("content-type", F.lit("text/html"), "date", (F.col("page_id") * 10).cast("string"), "etag", tag, "server", F.lit("s")).alias("headers"), F.col("html").alias("body"))
    later = F.col("page_id") * 10 + F.when(F.col("d") == "1", -5).otherwise(100_003)
    seen = F.when(F.col("d") == "0", F.concat(F.lit("W/"), tag)).when(F.col("d") == "2", F.lit('"old"')).when(F.col("d") == "3", F.lit(None)).otherwise(tag)
    profile = F.concat(F.lit("http://netpreserve.org/warc/1.1/revisit/"), F.when(F.col("d") == "4", "identical-payload-digest").otherwise("server-not-modified"))
    elsewhere = F.when((F.col("d") == "5") & F.col("url").isNotNull(), F.concat(F.lit("http://mirror.invalid/"), "page_id")).otherwise(F.col("url")).alias("url")
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), elsewhere, later.alias("fetched"), F.lit("revisit").alias("kind"), seen.alias("etag"), F.col("page_id").cast("string").alias("last_modified"), head("cache-control", F.lit("max-age=60"), "content-type", F.lit("none"), "date", later.cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"), profile.alias("profile"), F.when(F.col("d") == "5", F.col("url")).alias("refers_to"))
    response = response.withColumn("profile", F.lit(None).cast("string")).withColumn("refers_to", F.lit(None).cast("string"))
    return response.union(revisit)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(warc_records(spark, sf_dir))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url", "fetched", "response_id", "outcome", headers.alias("headers"), F.md5("body").alias("body_md5"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)"


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list made from the hosts of the whole table pages: each is blocked at a time drawn from its md5 and
    later allowed (md5 begins with a letter) or removed; the domain of its last two labels is blocked from 40000 on."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    hosts = _table(spark, sf_dir, "pages").select(host.alias("host")).where("host <> ''").distinct().withColumn("h", F.md5("host"))
    number = lambda at: F.conv(F.substring("h", at, 4), 16, 10).cast("long")
    first = hosts.select(F.col("host").alias("domain"), F.lit("block").alias("action"), (number(1) % 20_000).alias("listed"))
    then = hosts.select("host", F.when(F.substring("h", 1, 1) >= "a", "allow").otherwise("remove"), number(1) % 20_000 + number(5) % 30_000 + 1)
    wide = hosts.select(F.concat_ws(".", F.slice(F.split("host", "[.]"), -2, 2)), F.lit("block"), F.lit(40_000).cast("long")).where(F.size(F.split("host", "[.]")) >= 2).distinct()
    return first.union(then).union(wide)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", (F.col("page_id") * 97 % 65_536).alias("fetched"))
    return urllists.evaluate(captures, url_list(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch.few(neardup.groups(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokens.store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.read(spark, path, with_ids=False)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = gif.store(_table(spark, sf_dir, "documents").withColumnRenamed("text", "payload"))
    several = F.unhex(F.array_join(F.transform("frames.pixels", F.hex), ""))
    read = gif.frames(stored).withColumn("payload", F.when(F.size("frames") == 1, F.col("frames")[0]["pixels"]).otherwise(several))
    colours = F.expr("aggregate(frames, transform(sequence(1, 64), x -> 0L), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))")
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(";ms="), F.expr("aggregate(frames, 0, (a, f) -> a + f.delay_ms)"), F.lit(";colours="), F.array_join(colours, ","))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_license_scan,
        op3_warc_revisits,
        op4_quality,
        op5_url_filter,
        op6_mixing,
        op7_decontamination,
        op8_minhash_near_dedup,
        op9_token_files,
        op10_gif_media,
    )
}
