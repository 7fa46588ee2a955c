"""The corpus pipeline: five stages, each written as Parquet in the shared folder and read by the next.

1. language_id: documents whose language cannot be told go: no text, no letters, a posterior below one half, or n-grams far
   from any language learned (noise, unknown languages; short texts get the benefit of the doubt).
2. exact_dedup: of equal texts (A-Z lower-cased) the largest doc_id stays.
3. near_dedup: of each component of near duplicates the smallest doc_id stays.
4. mixing: each document is taken as often as the mix of its source to its target weight says.
5. bpe: each text is encoded; the result has a row per document taken.

An empty table, or one of which nothing is left, gives no rows. Null and empty texts go in stage 1. Of equal rows, doc_id
included, stage 2 leaves what ``exact_dedup`` says. Very long texts pass whole. Other columns stay in stages 1 to 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import bpe, exact_dedup, langid, minhash, mixing
from proofline.llm.common import saved


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(docs)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix), ("bpe", encode),
]
#: Stages 1, 4 and 5 cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
