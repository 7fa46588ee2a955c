"""Queries over calibration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import scoring as S
from proofline.operators import calibrate
from proofline.plans.correlation import scored
from proofline.plans.registry import query
from proofline.plans.views import Tables
from proofline.session import ensure_checkpoint_dir
from proofline.sources import calibration as store

BAND = "CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' WHEN confidence >= 0.4 THEN 'LOW' ELSE 'UNCERTAIN' END"
BANDED = f"(SELECT *, {BAND} AS band, least(CAST(floor(confidence * 10) AS INT), 9) AS bin FROM v_pred)"
EDGE = "list_max(list_filter(range(10), lambda i: confidence >= i / 10.0::DOUBLE))"


def banded(t: Tables) -> DataFrame:
    return t.view("v_pred").withColumn("band", S.band("confidence"))


@query("k01_bands", f"SELECT doc_id, {BAND} AS band FROM v_pred")
def k01(t: Tables) -> DataFrame:
    return banded(t).select("doc_id", "band")


@query("k02_cutoff_bands", """
SELECT doc_id, CASE WHEN confidence >= 0.9 THEN 'strong' WHEN confidence >= 0.5 THEN 'fair' WHEN confidence >= 0.1 THEN 'weak' ELSE 'UNCERTAIN' END AS band FROM v_pred""")
def k02(t: Tables) -> DataFrame:
    return calibrate.with_cutoff_band(t.view("v_pred"), {"weak": 0.1, "strong": 0.9, "fair": 0.5}).select("doc_id", "band")


@query("s17_calibration_store", f"""
SELECT doc_id % 7 AS context_hash, {BAND} AS band, 2 * count(*) AS records, 2 * sum(outcome)::BIGINT AS positives FROM v_pred GROUP BY ALL""")
def s17(t: Tables) -> DataFrame:
    """Records appended twice to a store, with the bands of stored parameters, and read back."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/calibration-{uuid.uuid4().hex}"
    store.save_params(store.default_params(t.spark), f"{folder}/params")
    bands = store.bands_of(store.load_params(t.spark, f"{folder}/params"))
    records = t.view("v_pred").select(
        "confidence", F.col("outcome").cast("int").alias("outcome"), "algorithm", F.lit("rule").alias("source"), F.lit("observed_operation").alias("evidence_kind"),
        S.band("confidence", bands).alias("band"), (F.col("doc_id") % 7).cast("string").alias("context_hash"),
    )
    for _ in range(2):
        store.save_records(records, f"{folder}/records")
    found = store.load_records(t.spark, f"{folder}/records").groupBy(F.col("context_hash").cast("long").alias("context_hash"), "band")
    return found.agg(F.count(F.lit(1)).alias("records"), F.sum("outcome").alias("positives"))


@query("k03_brier", "SELECT algorithm, count(*) AS count, round(avg((confidence - outcome) * (confidence - outcome)), 6) AS brier_score FROM v_pred GROUP BY algorithm")
def k03(t: Tables) -> DataFrame:
    return calibrate.brier(t.view("v_pred"), ["algorithm"]).withColumn("brier_score", F.round("brier_score", 6))


@query("k04_ece", f"""
SELECT CAST(sum(n) AS BIGINT) AS count, round(sum(abs(o / n - c / n) * n) / sum(n), 6) AS ece FROM
 (SELECT {EDGE} AS bin, count(*) AS n, sum(confidence) AS c, sum(outcome) AS o FROM v_pred GROUP BY 1)""")
def k04(t: Tables) -> DataFrame:
    return calibrate.expected_calibration_error(t.view("v_pred")).withColumn("ece", F.round("ece", 6))


@query("k05_reliability", f"""
SELECT CAST(i AS INT) AS bin, i / 20.0::DOUBLE AS bin_low, (i + 1) / 20.0::DOUBLE AS bin_high, mean_confidence, mean_accuracy, coalesce(n, 0) AS sample_count FROM range(20) r(i) LEFT JOIN
 (SELECT least(CAST(floor(confidence * 20) AS INT), 19) AS bin, round(avg(confidence), 4) AS mean_confidence, round(avg(outcome), 4) AS mean_accuracy, count(*) AS n FROM v_pred GROUP BY 1) b ON r.i = b.bin""")
def k05(t: Tables) -> DataFrame:
    return calibrate.reliability(t.view("v_pred"), 20)


METRICS = f"""
SELECT slice, coalesce(CAST(sum(n) AS BIGINT), 0) AS count, round(sum(sq) / sum(n), 6) AS brier_score, round(sum(abs(o - c)) / sum(n), 6) AS ece, round(sum(o) / sum(n), 4) AS accuracy
FROM (VALUES ('overall'), ('HIGH'), ('MEDIUM'), ('LOW'), ('UNCERTAIN')) s(slice) LEFT JOIN
 (SELECT band, {EDGE} AS bin, count(*) AS n, sum(confidence) AS c, sum(outcome) AS o, sum((confidence - outcome) * (confidence - outcome)) AS sq FROM {BANDED} GROUP BY 1, 2
  UNION ALL SELECT 'overall', {EDGE} AS bin, count(*), sum(confidence), sum(outcome), sum((confidence - outcome) * (confidence - outcome)) FROM {BANDED} GROUP BY 1, 2) b ON s.slice = b.band
GROUP BY slice"""


@query("k06_metrics", METRICS)
def k06(t: Tables) -> DataFrame:
    return calibrate.metrics(banded(t))


@query("k07_drift", f"""
SELECT slice AS band, round(0.180592, 4)::DOUBLE AS baseline_brier, round(brier_score, 4) AS actual_brier, round(brier_score - 0.180592, 4) AS delta, 0.05::DOUBLE AS threshold,
       CASE WHEN abs(brier_score - 0.180592) <= 0.05 THEN 'OK' ELSE 'DRIFT' END AS status, count, CASE WHEN bool_or(abs(brier_score - 0.180592) > 0.05) OVER () THEN 'DRIFT_DETECTED' ELSE 'OK' END AS overall_status
FROM ({METRICS}) m WHERE slice <> 'overall' AND count >= 10""")
def k07(t: Tables) -> DataFrame:
    return calibrate.drift(banded(t), C.BASELINE_PARAMS["brier_score"])


@query("k08_new_records", """
SELECT doc_id, confidence, outcome, algorithm, source, context_hash FROM
 (SELECT *, row_number() OVER (PARTITION BY context_hash, algorithm, source ORDER BY doc_id) AS n FROM v_pred p WHERE outcome = 1
   AND NOT EXISTS (SELECT 1 FROM v_pred e WHERE e.outcome = 0 AND e.context_hash = p.context_hash AND e.algorithm = p.algorithm AND e.source = p.source)) WHERE n = 1""")
def k08(t: Tables) -> DataFrame:
    """Records with outcome 0 are stored already; those with outcome 1 arrive."""
    rows = t.view("v_pred")
    return calibrate.new_records(rows.where("outcome = 0"), rows.where("outcome = 1"), ["doc_id"])


@query("k09_records_from_findings", f"""
SELECT finding_id, confidence, CAST(confirmed_use AS INT) AS outcome, algorithm, split_part(sources, ',', 1) AS source, evidence_kind, {BAND} AS band,
       substr(sha256(concat(location, ':', operation_anchor)), 1, 16) AS context_hash FROM v_scored""")
def k09(t: Tables) -> DataFrame:
    return calibrate.records_from_findings(scored(t))


@query("k10_versioned_confidence", f"""
SELECT doc_id, {BAND} AS band, CASE {BAND} WHEN 'HIGH' THEN 'High Confidence' WHEN 'MEDIUM' THEN 'Medium Confidence' WHEN 'LOW' THEN 'Low Confidence' ELSE 'Uncertain' END AS label, '1.0.0' AS calibration_version FROM v_pred""")
def k10(t: Tables) -> DataFrame:
    return calibrate.versioned(t.view("v_pred"), C.BASELINE_PARAMS["version"]).select("doc_id", "band", "label", "calibration_version")


@query("k11_band_distribution", f"""
SELECT s.band, coalesce(n, 0) AS count, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM v_pred), 1) AS percent
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNCERTAIN')) s(band) LEFT JOIN (SELECT band, count(*) AS n FROM {BANDED} GROUP BY band) b ON s.band = b.band""")
def k11(t: Tables) -> DataFrame:
    return calibrate.band_distribution(t.view("v_pred"))
