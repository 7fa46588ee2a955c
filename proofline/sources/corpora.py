"""Corpus manifests, labels and thresholds as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "struct<corpus_id:string,language:string,algorithm_family:string,repo_url:string,commit_sha:string,file_path:string,"
    "file_sha256:string,line_start:int,line_end:int,positive:boolean,label:string,operation:string>"
)
CASE = "struct<id:string,language:string,type:string,family:string,path:string>"
LABEL = "struct<algorithm:string,usage:string,category:string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Corpus cases; a case without a valid type or a path stops the job."""
    rows = spark.read.schema(f"cases array<{CASE}>").json(path, multiLine=True).select(F.explode("cases").alias("c"))
    valid = F.coalesce(F.col("c.type").isin("positive", "negative") & F.col("c.path").isNotNull(), F.lit(False))
    message = F.concat(F.lit("invalid corpus case "), F.coalesce("c.id", F.lit("unknown")))
    case_id = F.when(valid, F.col("c.id")).otherwise(F.raise_error(message).cast("string"))
    return rows.select(case_id.alias("case_id"), "c.language", "c.type", F.coalesce("c.family", F.lit("unknown")).alias("family"), "c.path")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Expected algorithms with the label file they came from; its stem is the case's source path."""
    rows = spark.read.schema(f"file string, expected_assets array<{LABEL}>").json(path, multiLine=True)
    stem = F.regexp_replace(F.input_file_name(), r"\.expected\.json$", "")
    return rows.select(stem.alias("stem"), "file", F.explode("expected_assets").alias("a")).select("stem", "file", "a.*")


def read_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """Gate minimums by metric name: a settings file of a few entries, read on the driver."""
    gate = "struct<minimum:double,description:string>"
    row = spark.read.schema(f"gates map<string,{gate}>").json(path, multiLine=True).first()
    return {name: g["minimum"] for name, g in (row["gates"] or {}).items() if g["minimum"] is not None} if row else {}


def read_entries(spark: SparkSession, *paths: str) -> DataFrame:
    rows = spark.read.schema(f"total_entries long, entries array<{ENTRY}>").json(list(paths), multiLine=True)
    return rows.select(F.explode("entries").alias("e")).select("e.*")


def write_by_language(entries: DataFrame, path: str) -> None:
    """One folder of JSON lines per language."""
    entries.write.mode("overwrite").partitionBy("language").json(path)


def drift(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Languages whose stored rows differ from the manifest, with the number of rows on each side only."""
    columns = entries.columns
    left = entries.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    right = stored.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    both = left.select("*", F.lit(1).alias("side")).unionByName(right.select("*", F.lit(-1).alias("side")))
    net = both.groupBy(*columns).agg(F.sum(F.col("n") * F.col("side")).alias("net")).where("net <> 0")
    return net.groupBy("language").agg(
        F.sum(F.greatest("net", F.lit(0))).alias("only_manifest"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_stored")
    )
