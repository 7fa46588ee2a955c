"""Ground-truth documents with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import valid_json

ASSET = "struct<component:string,algorithm:string,usage:string,key_size:int,line:int,file:string,confidence:double>"
TRUTH = (
    f"evaluation_version int, assets array<{ASSET}>, alias_pairs array<struct<algorithms:array<string>,same_family:boolean>>, "
    "cert_expectations array<struct<component:string,key_size:int,not_before:string,not_after:string>>, "
    "blind_spots array<struct<component:string,algorithm:string,reason:string>>"
)
LISTS = ("alias_pairs", "cert_expectations", "blind_spots")


def read_truth(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per ground-truth file: path, length, text (null if larger than ``max_bytes``, if given)."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "utf-8")
    return raw.select("path", "length", (text if max_bytes is None else F.when(F.col("length") <= max_bytes, text)).alias("text"))


def _kind(raw: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant"))


def check_truth(documents: DataFrame, max_bytes: int | None = None, max_assets: int | None = None) -> DataFrame:
    """Adds ``truth`` (parsed), ``available`` and ``message`` (null when the document is valid).

    Documents beyond the limits are rejected, if limits are given."""
    raw = F.try_parse_json("text")
    parsed = documents.withColumns({"_raw": raw, "_keys": F.json_object_keys("text")}).withColumn(
        "truth", F.from_json("text", TRUTH)
    )
    assets = F.col("truth.assets")

    def blank(field: str) -> Column:
        return F.exists(assets, lambda a: F.coalesce(F.trim(a[field]), F.lit("")) == "")

    def not_list(name: str) -> Column:
        present = F.coalesce(F.array_contains("_keys", name), F.lit(False))
        return present & ~F.coalesce(_kind(F.col("_raw"), name).startswith("ARRAY"), F.lit(False))

    problem = (
        F.when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "oversized ground truth")
        .when(~valid_json("text"), "ground truth is not valid JSON")
        .when(F.col("_keys").isNull(), "ground truth is not a JSON object")
        .when(~F.array_contains("_keys", "assets") | not_list("assets"), "missing or invalid 'assets' list")
        .when(F.lit(False) if max_assets is None else F.size(assets) > max_assets, f"ground truth exceeds {max_assets or 0:,} assets")
        .when(F.exists(assets, lambda a: a.isNull()), "asset entry is not an object")
        .when(blank("component"), "asset missing valid 'component'")
        .when(blank("algorithm"), "asset missing valid 'algorithm'")
    )
    for name in LISTS:
        problem = problem.when(not_list(name), f"'{name}' must be a list")
    return parsed.withColumn("message", problem).withColumn("available", F.col("message").isNull()).drop("_raw", "_keys")


def truth_assets(checked: DataFrame) -> DataFrame:
    return checked.where("available").select("path", F.posexplode("truth.assets").alias("truth_id", "a")).select(
        "path", "truth_id", "a.component", "a.algorithm", F.coalesce("a.usage", F.lit("unknown")).alias("usage_raw"),
        "a.key_size", "a.line", F.coalesce("a.file", F.lit("")).alias("file"),
    )


def truth_aliases(checked: DataFrame) -> DataFrame:
    pairs = checked.where("available").select("path", F.posexplode("truth.alias_pairs").alias("position", "p"))
    return pairs.select("path", "position", "p.algorithms")


def truth_certificates(checked: DataFrame) -> DataFrame:
    return checked.where("available").select(F.explode("truth.cert_expectations").alias("c")).select("c.*")


def evaluation_version(checked: DataFrame) -> DataFrame:
    return checked.select("path", F.coalesce("truth.evaluation_version", F.lit(1)).alias("evaluation_version"))
