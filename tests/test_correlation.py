"""Operation boundaries, conflicts, suppression and span ambiguity on literal records."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import correlate, correlate_spans, joins

SCHEMA = (
    "algorithm string, category string, source string, location string, confidence double, evidence_kind string, "
    "usage_raw string, operation_id string, key_size int, line_start int, column_start int, library string, operation_name string"
)


def record(**changes):
    base = {
        "algorithm": "RSA", "category": "encryption", "source": "rule", "location": "test-repo/app/a.py", "confidence": 0.82,
        "evidence_kind": "observed_operation", "usage_raw": "unknown", "operation_id": "op", "key_size": None,
        "line_start": None, "column_start": None, "library": None, "operation_name": None,
    }
    return {**base, **changes}


def frame(spark, records):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], SCHEMA)


def found(spark, *records):
    return [r.asDict(recursive=True) for r in correlate.findings(frame(spark, records)).collect()]


def test_dependency_is_suppressed_when_code_is_observed(spark):
    dependency = record(algorithm="ML-KEM", source="dep", location="test-repo/app/requirements.txt", usage_raw="key_exchange",
                        evidence_kind="declared_capability", operation_id=None)
    assert [f["algorithm"] for f in found(spark, record(usage_raw="encryption"), dependency)] == ["RSA"]
    assert [f["algorithm"] for f in found(spark, dependency)] == ["ML-KEM"]


def test_algorithm_disagreement_at_one_span_is_a_conflict(spark):
    first = record(operation_id=None, line_start=10, column_start=4)
    result = found(spark, first, {**first, "algorithm": "AES"})
    assert len(result) == 2 and all(f["conflict"] for f in result)
    assert {f["conflicting_operation"] for f in result} == {"line:10:column:4"}


def test_operation_ids_are_scoped_to_files(spark):
    other = record(algorithm="AES", location="test-repo/app/b.py")
    assert not any(f["conflict"] for f in found(spark, record(), other))


def test_distinct_usages_stay_apart(spark):
    result = found(spark, *[record(usage_raw=u) for u in ("signature", "encryption", "key_exchange", "other")])
    assert {f["usage"] for f in result} == {"signature", "encryption", "key_establishment", "unknown"}
    assert len({f["finding_id"] for f in result}) == 4


def test_conflicting_key_sizes_are_kept_and_not_chosen(spark):
    records = [record(usage_raw="sign", key_size=2048), record(usage_raw="verify", key_size=4096)]
    result = found(spark, *records)
    assert len(result) == 1 and result[0]["key_size"] is None and result[0]["conflict"]
    values = correlate.context_conflicts(frame(spark, records)).collect()
    assert sorted((v["field"], v["value"]) for v in values) == [("key_size", "2048"), ("key_size", "4096")]


def test_key_size_zero_is_a_conflict(spark):
    result = found(spark, record(key_size=0))[0]
    assert result["conflict"] and result["key_size"] is None and result["conflict_fields"] == ["key_size"]


def test_agreeing_sources_combine(spark):
    result = found(spark, record(), record(source="ast", confidence=0.9))
    assert len(result) == 1 and result[0]["sources"] == ["ast", "rule"]
    assert result[0]["confidence_by_source"] == {"ast": 0.9, "rule": 0.82}


def test_equal_records_count_once(spark):
    keyed = correlate.with_keys(frame(spark, [record(), record(), record(library="openssl")]))
    assert sorted(r["copies"] for r in correlate.evidence_records(keyed).collect()) == [1, 2]


def test_unlocated_records_stay_separate(spark):
    unlocated = [record(operation_id=None, library=lib) for lib in ("a", "b")]
    assert len(found(spark, *unlocated)) == 2


def test_unregistered_collector_stops_the_job(spark):
    with pytest.raises(Exception, match="unregistered collector"):
        found(spark, record(source="guess"))


def test_every_order_gives_the_same_findings(spark):
    records = [record(usage_raw="signature", key_size=2048), record(key_size=4096), record(usage_raw="signature", key_size=3072)]
    baseline = sorted(found(spark, *records), key=repr)
    for order in itertools.permutations(records):
        assert sorted(found(spark, *order), key=repr) == baseline


def test_component_rules(spark):
    from proofline.functions import paths

    cases = {
        "x/apps/shop/a.py": "shop", "repositories/one/services/two/a.py": "one", "lib/deep/a.py": "deep", "a.py": "repository-root",
        "x/./apps//shop/../pay/a.py": "pay", "apps": "repository-root",
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", paths.component(paths.normalise("path")).alias("c"))
    assert {r["path"]: r["c"] for r in rows.collect()} == cases


def test_large_lookup_uses_salted_join_with_equal_result(spark):
    left = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("row"))
    right = spark.createDataFrame([(1,), (3,)], "k long")
    for how in ("left_anti", "left_semi"):
        small = joins.lookup_join(left, right, ["k"], how, "row")
        salted = joins.lookup_join(left, right, ["k"], how, "row", salts=4)
        assert "_salt" in salted._jdf.queryExecution().toString()
        assert sorted(small.collect()) == sorted(salted.select(*small.columns).collect())


def test_distant_kinds_are_ambiguous(spark):
    records = [
        record(source="ast", confidence=0.9, line_start=10, operation_id=None),
        record(source="rule", confidence=0.9, line_start=80, operation_id=None, evidence_kind="configured_protocol"),
    ]
    result = correlate_spans.findings(frame(spark, records)).collect()
    assert [(r["ambiguous_matches"], r["confidence"]) for r in result] == [(1, 0.8), (1, 0.8)]
    spans = correlate_spans.with_spans(frame(spark, records))
    target = result[0]["finding_id"]
    listed = correlate_spans.ambiguous_candidates(correlate_spans.findings(frame(spark, records)), spans, [target]).collect()
    assert len(listed) == 1 and listed[0]["candidate_evidence_kind"] != result[0]["evidence_kind"]


def test_cross_kind_links_and_note(spark):
    base = record(algorithm="ECDSA", category="signature", location="services/signing.py", line_start=17, column_start=6,
                  confidence=0.85, usage_raw="sign", operation_name="sign_payload")
    records = [base, {**base, "source": "ast", "evidence_kind": "configured_protocol"}]
    result = sorted(correlate_spans.findings(frame(spark, records)).collect(), key=lambda r: r["evidence_kind"])
    assert [r["cross_kind_links"] for r in result] == [["observed_operation"], ["configured_protocol"]]
    assert {r["moved_line_note"] for r in result} == {"[line=17;algo=ECDSA;col=6;ctx=op:sign_payload]"}


def test_span_anchor_buckets(spark):
    from proofline.functions import evidence as E

    rows = spark.createDataFrame([(1,), (3,), (4,), (None,)], "line int").select(E.span_anchor(F.lit("a.py"), "line", F.lit(2)).alias("a"))
    assert [r["a"] for r in rows.collect()] == ["a.py:L1:C2", "a.py:L1:C2", "a.py:L4:C2", "a.py:unknown"]


def test_ambiguity_counts_match_brute_force(spark):
    chance = random.Random(5)
    records = [
        record(location=f"f{chance.randrange(3)}.py", algorithm=chance.choice(["RSA", "AES"]), operation_id=None,
               line_start=chance.choice([None, *range(1, 40)]), evidence_kind=chance.choice(["observed_operation", "configured_protocol", "unknown"]))
        for _ in range(150)
    ]
    expected: dict = {}
    for i, one in enumerate(records):
        for j, two in enumerate(records):
            if i == j or one["location"] != two["location"] or one["algorithm"] != two["algorithm"] or one["evidence_kind"] == two["evidence_kind"]:
                continue
            known = one["line_start"] is not None and two["line_start"] is not None
            if not (known and abs(one["line_start"] - two["line_start"]) <= 5):
                key = (one["location"], one["algorithm"], one["evidence_kind"], one["line_start"])
                expected[key] = expected.get(key, 0) + 1
    grouped = correlate_spans.with_ambiguity(correlate_spans.group_spans(correlate_spans.with_spans(frame(spark, records))))
    actual = {
        (r["location"], r["algorithm"], r["evidence_kind"], r["line_start"]): r["ambiguous_matches"]
        for r in grouped.where("ambiguous_matches > 0").collect()
    }
    assert actual == expected
