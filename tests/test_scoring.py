"""Confidence, risk boundaries, advice, context and what-if scenarios."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofline.functions import scoring as S
from proofline.operators import score

CONTEXT = (
    "algorithm string, usage string, evidence_kind string, business_criticality string, data_sensitivity string, "
    "data_lifetime_years int, migration_time_years int, threat_horizon_years int, exposure string, migration_effort string"
)
BASE = ("RSA", "tls", "observed_operation", "medium", "medium", 10, 3, 15, "internal", "medium")
NAMES = [p.split()[0] for p in CONTEXT.split(", ")]


def assess(spark, **changes):
    row = {**dict(zip(NAMES, BASE)), **changes}
    return score.assess(spark.createDataFrame([tuple(row[n] for n in NAMES)], CONTEXT)).first()


@pytest.mark.parametrize("changes, points, label", [
    (dict(business_criticality="low", data_sensitivity="low", exposure="isolated"), 24, "LOW"),
    (dict(business_criticality="low", data_sensitivity="low", migration_effort="low"), 25, "MEDIUM"),
    (dict(data_lifetime_years=12, business_criticality="low", data_sensitivity="low", exposure="isolated", migration_effort="medium"), 49, "MEDIUM"),
    (dict(data_lifetime_years=12, business_criticality="low", data_sensitivity="low", exposure="internal", migration_effort="low"), 50, "HIGH"),
    (dict(data_lifetime_years=12, business_criticality="critical", data_sensitivity="critical", exposure="isolated", migration_effort="high"), 75, "CRITICAL"),
    (dict(data_lifetime_years=12, business_criticality="critical", data_sensitivity="critical", exposure="internet", migration_effort="critical"), 85, "CRITICAL"),
    (dict(), 35, "MEDIUM"),
    (dict(algorithm="AES"), 20, "LOW"),
    (dict(evidence_kind="declared_capability"), 28, "MEDIUM"),
    (dict(evidence_kind="unknown"), 30, "MEDIUM"),
])
def test_priority_boundaries(spark, changes, points, label):
    result = assess(spark, **changes)
    assert (result["priority_score"], result["priority_label"]) == (points, label)


@pytest.mark.parametrize("algorithm, usage, effort, text, hybrid", [
    ("RSA", "signature", "medium", "Evaluate ML-DSA", False), ("RSA", "encryption", "high", "Evaluate ML-KEM", True),
    ("RSA-2048", "encryption", "high", "Assess algorithm", False), ("AES", "encryption", "high", "Retain symmetric", False),
    ("SHA-1", "hashing", "low", "Replace deprecated", False), ("SHA-512", "hashing", "low", "Use SHA-256", False),
    ("ML-KEM", "key_establishment", "high", "Already aligned", False), ("RSA", "unknown", "high", "Assess algorithm", False),
])
def test_recommendation(spark, algorithm, usage, effort, text, hybrid):
    result = assess(spark, algorithm=algorithm, usage=usage, migration_effort=effort)
    assert result["pqc_candidate"].startswith(text) and result["hybrid_recommended"] is hybrid


def test_vulnerable_flag_strips_numbers_only(spark):
    names = {"RSA-2048": True, "RSA_4096x": True, "ECDSA-P256": False, "DH-1024": True, "Ed25519": False}
    rows = spark.createDataFrame([(n,) for n in names], "a string").select("a", S.quantum_vulnerable("a").alias("v"))
    assert {r["a"]: r["v"] for r in rows.collect()} == names


def test_confidence(spark):
    rows = spark.createDataFrame([
        (1, ["observed_operation"], False), (2, ["observed_operation"], True), (3, ["observed_operation", "declared_capability", "observed_operation"], False),
        (4, ["observed_operation", "configured_protocol", "declared_capability", "artifact_metadata", "x"], False), (5, [], False), (6, ["ast"], False),
    ], "id int, kinds array<string>, conflict boolean")
    result = {r["id"]: r["c"] for r in rows.select("id", S.confidence("kinds", "conflict").alias("c")).collect()}
    assert result == {1: 0.9, 2: 0.7, 3: 0.855, 4: 0.84, 5: 0.0, 6: 0.3}
    single = rows.where("size(kinds) = 1").select(
        F.try_element_at("kinds", F.lit(1)).alias("k"), "conflict", S.confidence("kinds", "conflict").alias("c"), S.confidence_reasons("kinds", "conflict").alias("r"))
    for r in single.select("c", "r", S.confidence_of_kind("k", "conflict").alias("c1"), S.reasons_of_kind("k", "conflict").alias("r1")).collect():
        assert (r["c"], r["r"]) == (r["c1"], r["r1"])


def test_context_keeps_supplied_values_and_records_provenance(spark):
    found = spark.createDataFrame([("a",), ("b",)], "component string")
    context = spark.createDataFrame([("a", "internet", None)], "component string, exposure string, data_lifetime_years int")
    rows = {r["component"]: r for r in score.with_context(found, context).collect()}
    assert rows["a"]["exposure"] == "internet" and rows["b"]["exposure"] == "internal" and rows["a"]["data_lifetime_years"] == 10
    assert rows["a"]["risk_context_provenance"]["data_lifetime_years"] == "user-provided"
    assert rows["a"]["risk_context_provenance"]["migration_effort"] == "policy-default"
    assert set(rows["b"]["risk_context_provenance"].values()) == {"policy-default"}


def test_mosca_scenarios(spark):
    row = spark.createDataFrame([(10, 2, 15)], "data_lifetime_years int, migration_time_years int, threat_horizon_years int")
    result = {r["scenario"]: (r["scenario_migration_years"], r["gap"], r["overlaps"]) for r in score.mosca_scenarios(row).collect()}
    assert result == {"conservative": (4, -1, False), "baseline": (2, -3, False), "aggressive": (1, -4, False)}


def test_update_checks(spark):
    rows = spark.createDataFrame([(1, "critical", 100, "isolated"), (2, "urgent", 101, "public"), (3, None, None, None)],
                                 "id int, business_criticality string, data_lifetime_years int, exposure string")
    errors = {r["id"]: r["errors"] for r in score.validate_updates(rows).collect()}
    assert errors == {1: [], 2: ["business_criticality", "data_lifetime_years", "exposure"], 3: []}


def test_bands(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.39, 0.4, 0.6, 0.85, 2.0)], "v double")
    named = rows.select(S.band("v").alias("b"), S.band_by_cutoff("v", {"low": 0.2, "top": 0.8}).alias("c")).collect()
    assert [r["b"] for r in named] == ["UNCERTAIN", "UNCERTAIN", "LOW", "MEDIUM", "HIGH", "HIGH"]
    assert [r["c"] for r in named] == ["UNCERTAIN", "low", "low", "low", "top", "top"]


def test_repeated_context_rows_do_not_multiply_findings(spark):
    found = spark.createDataFrame([("f1", "a"), ("f2", "b")], "finding_id string, component string")
    context = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "low")], "component string, exposure string")
    from proofline.operators import score as scoring

    assert sorted((r["finding_id"], r["exposure"]) for r in scoring.with_context(found, context).collect()) == [("f1", "low"), ("f2", "low")]


@pytest.mark.parametrize("kind, quality, confirmed, capability", [
    ("observed_operation", "artifact_metadata", True, False), (None, "configured_protocol", True, False), ("", "Declared_Capability", False, True),
    (None, "high", False, False), (None, None, False, False), ("", "", False, False), ("declared_capability", None, False, True),
])
def test_quality_stands_in_for_a_missing_kind(spark, kind, quality, confirmed, capability):
    row = spark.createDataFrame([(kind, quality)], "kind string, quality string").select(
        S.confirmed_use(S.known_kind("kind", "quality")).alias("used"), S.capability_only(S.known_kind("kind", "quality")).alias("capable")).first()
    assert (row["used"], row["capable"]) == (confirmed, capability)
