"""Stores and exports of findings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.operators import report
from proofline.session import written
from proofline.sources import files
from proofline.sources.collect import Scan


def stored_version(spark: SparkSession, path: str, scan_job_id: int) -> int:
    """Result version of one stored scan, 0 when it is not stored. Reads that partition's footer column only."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise
    row = stored.where(F.col("scan_job_id") == scan_job_id).agg(F.max("result_version").alias("v")).first()
    return row["v"] or 0


def persist_findings(findings: DataFrame, path: str, scan_job_id: int, result_version: int = 1) -> bool:
    """Write one scan's findings; an equal or newer stored version is left as it is. Returns whether it wrote.

    Only the scan's own partition is replaced, so a repeated job gives the same table.
    """
    spark = findings.sparkSession
    if stored_version(spark, path, scan_job_id) >= result_version:
        return False
    rows = findings.withColumns({"scan_job_id": F.lit(scan_job_id), "result_version": F.lit(result_version)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_job_id").parquet(path)
    return True


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_job_id").parquet(path)


def persist_scan(scan: Scan, findings: DataFrame, folder: str, scan_job_id: int, result_version: int = 1,
                 profile: str = "source", duration_ms: int = 0) -> bool:
    """Write the whole result of one scan below ``folder``: failures, the job row (status, coverage, collector counts, blind
    spots, totals), and last the findings, which mark the version as complete. Returns whether it wrote.

    A repeated or older version changes nothing; an interrupted one is written again.
    """
    spark = findings.sparkSession
    if stored_version(spark, f"{folder}/findings", scan_job_id) >= result_version:
        return False
    marks = {"scan_job_id": F.lit(scan_job_id), "result_version": F.lit(result_version)}
    found = written(findings, "findings")
    failed = written(scan.failures, "failed")
    _replace(files.failures(failed).withColumns(marks), f"{folder}/failures")
    totals = found.agg(F.count(F.lit(1)).alias("assets_found"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"))
    metrics = files.blind_spots(files.coverage(scan.scoped, failed), profile, duration_ms)
    # Three rows, one each.
    one = [part.withColumn("_one", F.lit(1)) for part in (metrics, files.collector_stats(scan.evidence), totals)]
    job = one[0].join(one[1], "_one").join(one[2], "_one").drop("_one").withColumns({
        **marks, "status": F.lit("completed"), "duration_ms": F.lit(duration_ms).cast("long"),
    })
    _replace(job, f"{folder}/jobs")
    return persist_findings(found, f"{folder}/findings", scan_job_id, result_version)


def stored(spark: SparkSession, folder: str, table: str, scan_job_id: int) -> DataFrame:
    """Rows of one scan from ``findings``, ``failures`` or ``jobs``; only that scan's partition is read."""
    return spark.read.parquet(f"{folder}/{table}").where(F.col("scan_job_id") == scan_job_id)


def job_rollup(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with the number of findings and their mean confidence (0 when there are none)."""
    counts = findings.groupBy(F.col("scan_job_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.round(F.avg("confidence"), 4).alias("_c")
    )
    return jobs.drop("assets_found", "avg_confidence").join(counts, "id", "left").withColumns({
        "assets_found": F.coalesce("_n", F.lit(0)), "avg_confidence": F.coalesce("_c", F.lit(0.0)),
    }).drop("_n", "_c")


def write_evidence_json(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("overwrite").json(path)


def asset_rows(findings: DataFrame, id_column: str = "finding_id") -> DataFrame:
    return findings.withColumn("id", F.col(id_column)).select(*C.ASSET_CSV_COLUMNS)


def bill_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.col("algorithm").alias("name"), F.lit("library").alias("type"), "location", "category", "confidence"
    )


def risk_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        "algorithm", "location", F.col("priority_score").alias("score"), F.col("priority_label").alias("level"),
        F.when(F.col("hybrid_recommended"), "yes").otherwise("no").alias("hybrid"),
        F.col("pqc_candidate").alias("recommendation"), F.concat_ws("; ", "risk_reasons").alias("reasons"),
    )


def write_assets_csv(findings: DataFrame, path: str, mode: str = "priority") -> None:
    asset_rows(findings.orderBy(*report.sort_order(mode))).write.mode("overwrite").option("header", "true").csv(path)


def write_bill_csv(findings: DataFrame, path: str) -> None:
    bill_rows(findings.orderBy(*report.bill_order())).write.mode("overwrite").option("header", "true").csv(path)


def write_risk_csv(findings: DataFrame, path: str) -> None:
    risk_rows(findings.orderBy(*report.rank_order())).write.mode("overwrite").option("header", "true").csv(path)


def write_risk_text(findings: DataFrame, path: str) -> None:
    """The ranked report as text: a range sort keeps the files in rank order."""
    lines = report.report_lines(findings)
    lines.orderBy("rank").select("line").write.mode("overwrite").text(path)


def write_bill(findings: DataFrame, path: str) -> None:
    """Bill components as JSON lines."""
    report.bill_documents(report.bill_components(findings)).write.mode("overwrite").text(path)
