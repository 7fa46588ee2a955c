"""Calibration parameters and labelled records on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline import catalogs as C

PARAMS = (
    "version string, band_thresholds map<string,array<double>>, brier_score double, ece double, "
    "last_calibrated string, sample_count long"
)
RECORD = "confidence double, outcome int, algorithm string, source string, evidence_kind string, band string, context_hash string"


def default_params(spark: SparkSession) -> DataFrame:
    bands = {name: [low, high] for name, low, high in C.BANDS}
    return spark.createDataFrame([("1.0.0", bands, None, None, "", 0)], PARAMS)


def save_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMS).json(path)


def bands_of(params: DataFrame) -> list[tuple[str, float, float]]:
    """Band ranges of the one parameter row, highest first, for use in band expressions."""
    row = params.first()
    ranges = [(name, *bounds) for name, bounds in row["band_thresholds"].items()]
    return sorted(ranges, key=lambda b: (b[1], b[2]), reverse=True)


def save_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)
