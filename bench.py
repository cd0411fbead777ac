"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and factoring of seven-level chains; prints one JSON line.

round trip all values differ. In a chain every type occurs once, so nothing is compared; trees therefore hold lists at
each level (a galaxy of 4 planets of 4 countries each of 2 cities, most of which are alike), and are factored with lists of
each root. Throughput is the best of two runs after a warm-up run, of 10^3 to 10^6 roots in one job. The value is the sum over the
headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
warnings.simplefilter("ignore")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from graphfactor import queries  # noqa: E402
from graphfactor.operators.denormalize import denormalize  # noqa: E402
from graphfactor.operators.normalize import normalize  # noqa: E402
from graphfactor.plans.catalog import TypeCatalog  # noqa: E402
from graphfactor.plans.config import GraphConfig  # noqa: E402

HEADLINE = (
    "part_list_per_order", "part_list_by_groups", "collection_indices", "two_paths_one_list", "deep_nesting_7", "denormalize_roundtrip", "denormalize_set",
    "global_scope_list", "shared_entry_fan_in", "dedup_statistics", "tree_self_cycle", "four_hop_cycle", "container_json",
)
LEVELS = (("MainGalaxy", "Galaxy"), ("MainSystem", "SolarSystem"), ("MainPlanet", "Planet"), ("MainContinent", "Continent"), ("MainCountry", "Country"), ("Capital", "City"))


def chains(spark: SparkSession, n: int, shared: bool) -> DataFrame:
    own = F.col("id").cast("string")
    place = F.when(F.col("id") % 100 == 0, own).otherwise("shared") if shared else own
    value = F.struct(F.concat(F.lit("City"), place).alias("Name"), F.lit(700_000).alias("Population"))
    for field, kind in reversed(LEVELS):
        above = {"City": "Country", "Country": "Continent"}.get(kind)
        name = F.concat(F.lit(above or kind), place if above else own)
        value = F.struct(name.alias("Name"), value.alias(field, metadata={"entity": kind}))
    return spark.range(n).select("id", value["Name"].alias("Name"), value[LEVELS[0][0]].alias(LEVELS[0][0], metadata={"entity": LEVELS[0][1]}))


def trees(spark: SparkSession, n: int) -> DataFrame:
    """Roots with 4 planets, 16 countries and 32 cities, of which each root has 2, 6 and 9 different ones."""
    city = lambda i: F.struct(F.concat(F.lit("City"), (i % 3).cast("string")).alias("Name"), (i * 1000).alias("Population"))
    several = lambda k, of: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of)
    country = lambda p, c: F.struct(F.concat(F.lit("Country"), (c % 3).cast("string"), F.lit("-"), p.cast("string")).alias("Name"), several(2, lambda i: city(i + c % 3 + p)).alias("Cities"))
    planet = lambda p: F.struct(F.concat(F.lit("Planet"), (p % 2).cast("string")).alias("Name"), several(4, lambda c: country(p % 2, c)).alias("Countries"))
    df = spark.range(n)
    kinds = df.select("id", several(4, planet).alias("Planets"))
    return kinds.select("id", F.col("Planets").alias("Planets", metadata={"entity": "Planet"}))


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, rates = {}, {}
    for name in HEADLINE:
        build = queries.QUERIES[name]
        run(build(spark, sf))
        start = time.perf_counter()
        run(build(spark, sf))
        times[name] = round(time.perf_counter() - start, 3)

    def factored(df: DataFrame, scope: str = "root"):
        config = GraphConfig(TypeCatalog.from_schema("Universe", df.schema))
        config.normalize_graph("Universe")
        return normalize(df, config, "id", scope=scope)

    def timed(label: str, n: int, df: DataFrame, warm: int = 1, runs: int = 2) -> None:
        for _ in range(warm):
            run(df)
        taken = min(run(df) for _ in range(runs))
        times[f"{label}_{n}"], rates[f"{label}_{n}"] = round(taken, 3), round(n / taken)

    for n in (1_000, 10_000, 100_000, 1_000_000):
        timed("normalize", n, factored(chains(spark, n, True)).rows)
        timed("roundtrip", n, denormalize(factored(chains(spark, n, False))))
    for n in (1_000,):
        timed("trees", n, factored(trees(spark, n)).rows)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times[x] for x in HEADLINE), 3), "unit": "sec", "queries": times, "roots_per_sec": rates, "cpus": int(cpus), "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
