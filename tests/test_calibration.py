"""Calibration metrics, de-duplication, drift and stores."""

from __future__ import annotations

from proofline.operators import calibrate
from proofline.sources import calibration as store

RECORD = "confidence double, outcome int, algorithm string, source string, evidence_kind string, band string, context_hash string, n int"


def rows(spark, *items):
    return spark.createDataFrame([(c, o, "RSA", "ast", "observed_operation", b, h, i) for i, (c, o, b, h) in enumerate(items)], RECORD)


def test_first_record_per_key_wins(spark):
    empty = rows(spark).limit(0)
    arriving = rows(spark, (0.9, 1, "HIGH", "abc"), (0.1, 0, "LOW", "abc"), (0.5, 1, "LOW", "def"))
    added = calibrate.new_records(empty, arriving, ["n"])
    assert sorted((r["context_hash"], r["confidence"]) for r in added.collect()) == [("abc", 0.9), ("def", 0.5)]
    assert calibrate.new_records(added, arriving, ["n"]).count() == 0
    assert calibrate.add_records(added, arriving, ["n"]).count() == 2


def test_drift_needs_ten_records(spark):
    few = rows(spark, (0.95, 0, "HIGH", "a"))
    assert calibrate.drift(few, 0.5).count() == 0
    many = rows(spark, *[(0.95, 0, "HIGH", str(i)) for i in range(30)])
    check = calibrate.drift(many, 0.5).first()
    assert (check["status"], check["overall_status"], check["count"], check["actual_brier"]) == ("DRIFT", "DRIFT_DETECTED", 30, 0.9025)


def test_bin_edges(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.3, 0.7, 0.99, 1.0)], "v double")
    bins = frame.select(calibrate.edge_bin("v", 10).alias("e"), calibrate.scaled_bin("v", 10).alias("s")).collect()
    assert [r["e"] for r in bins] == [0, 1, 3, 7, 9, 9]
    # 0.7 * 10 is 7.000000000000001 or 7.0, never below 7
    assert [r["s"] for r in bins] == [0, 1, 3, 7, 9, 9]


def test_metrics_match_direct_computation(spark):
    data = [((i * 37 % 100) / 100, i % 3 % 2, "HIGH" if i % 2 else "LOW", str(i)) for i in range(200)]
    result = {r["slice"]: r for r in calibrate.metrics(rows(spark, *data)).collect()}
    brier = sum((c - o) ** 2 for c, o, _, _ in data) / len(data)
    ece = 0.0
    for i in range(10):
        inside = [(c, o) for c, o, _, _ in data if i / 10 <= c and (c < (i + 1) / 10 or (i == 9 and c <= 1))]
        if inside:
            ece += abs(sum(o for _, o in inside) - sum(c for c, _ in inside)) / len(data)
    assert result["overall"]["brier_score"] == round(brier, 6) and result["overall"]["ece"] == round(ece, 6)
    assert result["MEDIUM"]["count"] == 0 and result["MEDIUM"]["brier_score"] is None


def test_parameters_and_records_survive_a_round_trip(spark, tmp_path):
    store.save_params(store.default_params(spark), str(tmp_path / "params"))
    loaded = store.load_params(spark, str(tmp_path / "params"))
    assert store.bands_of(loaded) == [("HIGH", 0.85, 1.0), ("MEDIUM", 0.6, 0.85), ("LOW", 0.4, 0.6), ("UNCERTAIN", 0.0, 0.4)]
    store.save_records(rows(spark, (0.9, 1, "HIGH", "abc")).drop("n"), str(tmp_path / "records"))
    assert store.load_records(spark, str(tmp_path / "records")).count() == 1
