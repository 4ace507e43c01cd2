"""Corpus pipeline: stages that each apply one training-data operator to what the stage before kept.

1. language: documents go in which no language is found, of whose words none has a third of the mass, or whose words the
   learned languages don't know; where no document has a label, no language can be learned, and all documents stay;
2. near duplicates: of each group linked over five-word shingles at a similarity of 0.8, the smallest doc_id stays;
3. decontamination: documents that hold ten consecutive words of a benchmark item (or a shorter item whole) go;
4. secrets: the found spans are masked in the text, and n_chars counts the new text;
5. mixing: the mixed shards, a row for each drawn block of words with its shard and place.

Stages decide by row, also where ids repeat or are null: such rows are told apart by their texts, and of rows that repeat id
and text the second stage keeps one. Columns of any name and type pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import decontaminate, language, mixing, near_dedup, secret_scan

#: The share of a document's words that its language must have, and that of its letters in words that were learned.
LEAST_SHARE, LEAST_KNOWN = 1 / 3, 0.2


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    field = language.train(docs, fold != 1)
    if field is None:
        return docs
    named = language.identify(docs, field, whole=True)
    # a small sample knows few words of its own languages
    known = min(LEAST_KNOWN, field.usual / 2)
    kept = named.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE) & (F.col("known") >= known))
    return kept.drop("lang_pred", "score", "known").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark).where("contaminated")
    gone = found.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).distinct()
    # the row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("doc_"), F.xxhash64("text").alias("hash_"))
    rows = rows.join(gone, F.col("doc_").eqNullSafe(F.col("id_")) & (F.col("hash_") == F.col("h_")), "left_anti")
    return rows.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.shards_of(docs)


STAGES = [
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: The stages' models and draws aren't stated in SQL; the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
