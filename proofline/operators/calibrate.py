"""Calibration of confidence against labelled outcomes.

Records have: confidence, outcome (0/1), algorithm, source, evidence_kind, band, context_hash.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import scoring as S

RECORD_KEY = ["context_hash", "algorithm", "source"]
BAND_NAMES = [b[0] for b in C.BANDS]


def brier(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.pow(F.col("confidence") - F.col("outcome"), F.lit(2))).alias("brier_score")
    )


def edge_bin(score: Column | str, bins: int) -> Column:
    """Uniform bin by its lower edge ``i / bins``; the last bin also holds 1.0. Null outside [0, 1]."""
    score = F.col(score) if isinstance(score, str) else score
    edges = [i / bins for i in range(bins + 1)]
    choice = F.when((score < 0) | (score > 1), F.lit(None).cast("int"))
    for index in range(bins - 1):
        choice = choice.when(score < F.lit(edges[index + 1]), index)
    return choice.otherwise(bins - 1)


def scaled_bin(score: Column | str, bins: int) -> Column:
    """Bin by the whole part of ``score * bins``, the last bin closed."""
    score = F.col(score) if isinstance(score, str) else score
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def expected_calibration_error(frame: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Weighted mean gap between accuracy and confidence per bin; two small aggregations."""
    binned = frame.groupBy(*by, edge_bin("confidence", bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_c"), F.sum("outcome").alias("_o")
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_o") / F.col("_n") - F.col("_c") / F.col("_n")) * F.col("_n"))
    return binned.groupBy(*by).agg(
        F.sum("_n").alias("count"), (F.sum(F.coalesce(gap, F.lit(0.0))) / F.sum("_n")).alias("ece")
    )


def reliability(frame: DataFrame, bins: int = 10) -> DataFrame:
    """One row per bin with its edges, mean confidence, mean accuracy and count; empty bins are null."""
    binned = frame.groupBy(scaled_bin("confidence", bins).alias("bin")).agg(
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.round(F.avg("outcome"), 4).alias("mean_accuracy"), F.count(F.lit(1)).alias("_n"),
    )
    scale = frame.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("bin_low"), ((F.col("id") + 1) / bins).alias("bin_high")
    )
    return scale.join(binned, "bin", "left").withColumn("sample_count", F.coalesce("_n", F.lit(0))).drop("_n")


def metrics(frame: DataFrame) -> DataFrame:
    """Brier, ECE, accuracy and count overall and for every band (zero rows for empty bands).

    One pass: band x bin cells hold every sum the metrics need, and all later steps see those cells only.
    """
    cells = frame.groupBy("band", edge_bin("confidence", 10).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("confidence").alias("_c"), F.sum("outcome").alias("_o"),
        F.sum(F.pow(F.col("confidence") - F.col("outcome"), F.lit(2))).alias("_sq"),
    )
    both = cells.withColumn("slice", F.explode(F.array(F.lit("overall"), F.col("band"))))
    per_bin = both.groupBy("slice", "_bin").agg(*[F.sum(c).alias(c) for c in ("_n", "_c", "_o", "_sq")])
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_o") - F.col("_c"))).otherwise(F.lit(0.0))
    found = per_bin.groupBy("slice").agg(
        F.sum("_n").alias("count"), F.round(F.sum("_sq") / F.sum("_n"), 6).alias("brier_score"),
        F.round(F.sum(gap) / F.sum("_n"), 6).alias("ece"), F.round(F.sum("_o") / F.sum("_n"), 4).alias("accuracy"),
    )
    slices = frame.sparkSession.createDataFrame([(s,) for s in ["overall", *BAND_NAMES]], "slice string")
    return slices.join(found, "slice", "full").withColumn("count", F.coalesce("count", F.lit(0)))


def drift(frame: DataFrame, baseline_brier: float, threshold: float = C.DRIFT_THRESHOLD,
          minimum: int = C.DRIFT_MINIMUM_COUNT) -> DataFrame:
    """Bands with enough records against the baseline Brier score, and the overall status."""
    checks = metrics(frame).where((F.col("slice") != "overall") & (F.col("count") >= minimum))
    delta = F.col("brier_score") - F.lit(float(baseline_brier))
    rows = checks.select(
        F.col("slice").alias("band"), F.round(F.lit(float(baseline_brier)), 4).alias("baseline_brier"),
        F.round("brier_score", 4).alias("actual_brier"), F.round(delta, 4).alias("delta"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(F.abs(delta) <= threshold, "OK").otherwise("DRIFT").alias("status"), "count",
    )
    # At most one row per band, so the unpartitioned window is bounded.
    any_drift = F.max(F.col("status") == "DRIFT").over(Window.partitionBy())
    return rows.withColumn("overall_status", F.when(any_drift, "DRIFT_DETECTED").otherwise("OK"))


def new_records(existing: DataFrame, arriving: DataFrame, order: Sequence[str]) -> DataFrame:
    """Arriving records whose key is not stored yet; the first in ``order`` per key.

    First-wins is an aggregate with map-side combining, not a window, so a hot key stays cheap.
    """
    columns = arriving.columns
    first = arriving.groupBy(*RECORD_KEY).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_record")
    ).select(*[F.col(f"_record.{c}").alias(c) for c in columns])
    return first.join(existing.select(*RECORD_KEY), RECORD_KEY, "left_anti")


def add_records(existing: DataFrame, arriving: DataFrame, order: Sequence[str]) -> DataFrame:
    return existing.unionByName(new_records(existing, arriving, order), allowMissingColumns=True)


def records_from_findings(found: DataFrame, outcome: Column | Callable[[], Column] | None = None) -> DataFrame:
    """Labelled records from scored findings; ``outcome`` is any boolean or 0/1 Column."""
    label = F.col("confirmed_use") if outcome is None else outcome() if callable(outcome) else outcome
    context = F.concat_ws(":", F.coalesce("location", F.lit("")), F.coalesce("operation_anchor", F.lit("")))
    return found.select(
        F.col("confidence").cast("double").alias("confidence"), label.cast("int").alias("outcome"), "algorithm",
        F.coalesce(F.try_element_at("sources", F.lit(1)), F.lit("")).alias("source"), "evidence_kind",
        S.band("confidence").alias("band"), F.substring(F.sha2(context, 256), 1, 16).alias("context_hash"), "finding_id",
    )


def versioned(frame: DataFrame, version: str, bands: Sequence[tuple[str, float, float]] = C.BANDS) -> DataFrame:
    named = frame.withColumn("band", S.band("confidence", bands))
    return named.withColumns({"label": S.band_label("band"), "calibration_version": F.lit(version)})


def band_distribution(frame: DataFrame) -> DataFrame:
    """Records and share per band, zero-filled."""
    counts = frame.groupBy(S.band("confidence").alias("band")).agg(F.count(F.lit(1)).alias("_n"))
    names = frame.sparkSession.createDataFrame([(b,) for b in BAND_NAMES], "band string")
    # Four rows.
    total = F.sum("count").over(Window.partitionBy())
    filled = names.join(counts, "band", "left").select("band", F.coalesce("_n", F.lit(0)).alias("count"))
    return filled.withColumn("percent", F.round(F.try_divide(F.col("count") * 100.0, total), 1))


def with_cutoff_band(frame: DataFrame, cutoffs: Mapping[str, float]) -> DataFrame:
    return frame.withColumn("band", S.band_by_cutoff("confidence", cutoffs))
