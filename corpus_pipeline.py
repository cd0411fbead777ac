"""From raw documents to token files: quality, near-duplicates, benchmark passages, mixing weights, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfactor.llm import decontaminate, mixing, neardup, quality, scratch, tokens
from graphfactor.shipping import ship

#: Documents that score less are left out.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, carry=True).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates: shingles of five words, similarity 0.8.

    All rows of a doc_id are one document; of rows that are equal in all columns one stays. Rows without doc_id can't
    be named in a group and stay.
    """
    kept = neardup.groups(docs, shingle=5, num=80, den=100).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").distinct().select(*docs.columns)
    return scratch.few(stay.union(docs.where("doc_id is null")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item (or of all of a shorter item)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, copies as rows."""
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files in the shared folder, read back: one row per copy with its place and checksum."""
    import public_tokenizers

    path = tokens.store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.read(spark, path, with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token files", token_stage),
]

#: The stages have no SQL form: a fitted model and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{i + 1}")
    return docs
