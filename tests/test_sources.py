"""Scope, limits, ground truth, corpora, stores and exports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from proofline.functions import paths
from proofline.sources import corpora, files, sinks, truth


def test_limits_fail_closed(spark):
    rows = spark.range(11)
    assert files.require_at_most(rows, 11, "evidence count") is rows
    with pytest.raises(ValueError, match="limit of 10"):
        files.require_at_most(rows, 10, "evidence count")
    with pytest.raises(Exception, match="limit of 10"):
        files.limit_guard(rows.groupBy().count(), 10, "evidence count").collect()


def test_relative_paths(spark):
    cases = {"/r/a b/c%.py": "a b/c%25.py", "/r/x:y/~z": "x%3Ay/~z", "/r/../q": None, "/other/a": None, "/r//a": None, "/r/é*.py": "%C3%A9%2A.py"}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.relative_path("path", F.lit("/r")).alias("r"))
    assert {r["path"]: r["r"] for r in rows.collect()} == cases


def test_safe_failure_path(spark):
    cases = {"a/b.py": True, "/a": False, "a/../b": False, "a\\b": False, "c:d": False, "": False, "a\x01": False, "a..b/c": True}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.safe_failure_path("path").alias("s"))
    assert {r["path"]: r["s"] for r in rows.collect()} == cases


def test_display_paths(spark):
    cases = {"/a/b/c/d": ("…/b/c/d", "d"), "C:\\x\\y\\z\\w": ("…/y/z/w", "w"), "a/b/c/d": ("a/b/c/d", "d"), "/a/b": ("/a/b", "b"), "": ("—", "Current repository")}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.display_path("p").alias("d"), paths.repository_name("p").alias("n"))
    assert {r["p"]: (r["d"], r["n"]) for r in rows.collect()} == cases


def test_blind_spots(spark):
    metrics = spark.createDataFrame([(0, 0)], "in_scope_files long, failed_files long")
    spots = files.blind_spots(metrics, "environment", 5000, 512).first()["blind_spots"]
    assert len(spots) == 9 and spots[6] == "No supported files were found; coverage is not established"
    assert spots[7].startswith("Scan duration capped at 5s") and spots[8].startswith("Memory budget of 512 MB")


def test_ground_truth_checks(spark):
    good = {"evaluation_version": 2, "assets": [{"component": "a", "algorithm": "RSA", "key_size": 2048}],
            "alias_pairs": [{"algorithms": ["RSA", "RSA-2048"]}], "cert_expectations": [{"component": "c", "key_size": 1}]}
    documents = {
        "good": json.dumps(good), "list": "[1]", "broken": "{", "trailing": '{"assets": []}}', "two": '{"assets": []}, {}', "none": "{}", "noassets": '{"assets": 3}', "blank": '{"assets": [{"component": " ", "algorithm": "x"}]}',
        "lists": '{"assets": [], "blind_spots": {}}', "missing": '{"assets": [{"component": "x"}]}',
    }
    rows = spark.createDataFrame([(k, len(v), v) for k, v in documents.items()] + [("big", 3 * 1024 * 1024, None)], "path string, length long, text string")
    checked = truth.check_truth(rows, max_bytes=2 * 1024 * 1024, max_assets=10_000)
    messages = {r["path"]: r["message"] for r in checked.collect()}
    assert messages == {
        "good": None, "list": "ground truth is not a JSON object", "broken": "ground truth is not valid JSON",
        "trailing": "ground truth is not valid JSON", "two": "ground truth is not valid JSON", "none": "missing or invalid 'assets' list",
        "noassets": "missing or invalid 'assets' list", "blank": "asset missing valid 'component'", "lists": "'blind_spots' must be a list",
        "missing": "asset missing valid 'algorithm'", "big": "oversized ground truth"}
    assert [(r["component"], r["key_size"], r["usage_raw"]) for r in truth.truth_assets(checked).collect()] == [("a", 2048, "unknown")]
    assert truth.truth_aliases(checked).first()["algorithms"] == ["RSA", "RSA-2048"]
    assert truth.truth_certificates(checked).count() == 1
    assert {r["path"]: r["message"] for r in truth.check_truth(rows).collect()}["big"] == "ground truth is not valid JSON"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"id": "1", "language": "go", "type": "positive", "path": "a.go"}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"cases": [{"id": "2", "language": "go", "type": "maybe", "path": "a.go"}]}))
    (tmp_path / "a.expected.json").write_text(json.dumps({"file": "a.go", "expected_assets": [{"algorithm": "AES"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"gates": {"micro_recall": {"minimum": 0.9}, "note": {"description": "x"}}}))
    assert corpora.read_cases(spark, str(tmp_path / "m.json")).first()["family"] == "unknown"
    with pytest.raises(Exception, match="invalid corpus case 2"):
        corpora.read_cases(spark, str(tmp_path / "bad.json")).collect()
    label = corpora.read_labels(spark, str(tmp_path / "a.expected.json")).first()
    assert label["algorithm"] == "AES" and label["stem"].endswith("/a")
    assert corpora.read_thresholds(spark, str(tmp_path / "t.json")) == {"micro_recall": 0.9}


def test_manifest_split_and_drift(spark, tmp_path):
    entries = spark.createDataFrame([("1", "go"), ("2", "go"), ("3", "c")], "corpus_id string, language string")
    corpora.write_by_language(entries, str(tmp_path / "out"))
    stored = spark.read.json(str(tmp_path / "out"))
    assert corpora.drift(entries, stored).count() == 0
    changed = corpora.drift(entries.unionByName(entries.limit(1)), stored.where("corpus_id <> '3'"))
    assert {r["language"]: (r["only_manifest"], r["only_stored"]) for r in changed.collect()} == {"go": (1, 0), "c": (1, 0)}


def test_checksums(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    manifest = rows.select("path", F.upper(F.sha2("content", 256)).alias("sha256")).unionByName(
        spark.createDataFrame([("c", "00")], "path string, sha256 string"))
    wrong = rows.withColumn("content", F.when(F.col("path") == "b", "z").otherwise(F.col("content")))
    assert {r["path"]: r["status"] for r in files.verify_checksums(wrong, manifest).collect()} == {"a": "ok", "b": "mismatch", "c": "missing"}


def test_persistence_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "findings")
    one, two = spark.range(3).withColumnRenamed("id", "n"), spark.range(5).withColumnRenamed("id", "n")
    assert sinks.persist_findings(one, target, 7, 1) and sinks.persist_findings(one, target, 8, 1)
    assert not sinks.persist_findings(two, target, 7, 1)
    assert spark.read.parquet(target).count() == 6
    assert sinks.persist_findings(two, target, 7, 2)
    counts = {r["scan_job_id"]: r["count"] for r in spark.read.parquet(target).groupBy("scan_job_id").count().collect()}
    assert counts == {7: 5, 8: 3}


def test_exports(spark, tmp_path):
    found = spark.createDataFrame([("b", "RSA", "x.py", 50, "HIGH", "tls", "line:1", "advice", True, ["r1", "r2"], 0.9, "encryption"),
                                   ("a", "AES", "y.py", 80, "CRITICAL", "tls", "line:2", "advice", False, ["r1"], 0.7, "encryption")],
                                  "finding_id string, algorithm string, location string, priority_score int, priority_label string, usage string, operation_anchor string, "
                                  "pqc_candidate string, hybrid_recommended boolean, risk_reasons array<string>, confidence double, category string")
    sinks.write_risk_text(found, str(tmp_path / "t"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == ["P1 | CRITICAL 80/100 | AES (tls) | y.py | line:2 | advice", "P2 | HIGH 50/100 | RSA (tls) | x.py | line:1 | advice"]
    sinks.write_risk_csv(found, str(tmp_path / "c"))
    row = spark.read.option("header", True).csv(str(tmp_path / "c")).where("algorithm = 'RSA'").first()
    assert (row["hybrid"], row["reasons"]) == ("yes", "r1; r2")
    sinks.write_bill_csv(found, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == ["name", "type", "location", "category", "confidence"]
    sinks.write_bill(found, str(tmp_path / "d"))
    documents = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert {d["bom-ref"] for d in documents} == {"inventory:asset:a", "inventory:asset:b"}
    sinks.write_evidence_json(found, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
