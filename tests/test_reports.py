"""Search, pages, graph limits, attention list, bills and table checks."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from proofline.operators import report

FOUND = (
    "finding_id string, algorithm string, category string, location string, library string, protocol string, usage string, priority_score int, "
    "priority_label string, quantum_vulnerable boolean, conflict boolean, confidence double, sources array<string>, operation_anchor string"
)


def rows(spark, count=30, sources=("ast", "rule")):
    chance = random.Random(3)
    data = []
    for i in range(count):
        score = chance.randrange(100)
        label = "CRITICAL" if score >= 75 else "HIGH" if score >= 50 else "MEDIUM" if score >= 25 else "LOW"
        data.append((f"{i:04d}", chance.choice(["RSA", "AES_x", "100%"]), "encryption", f"src/f{i}.py", None, "", "tls", score, label, score % 2 == 0, False,
                     score / 100, list(sources), "line:1"))
    return spark.createDataFrame(data, FOUND), data


def test_search_escapes_wildcards_for_assets_only(spark):
    found, data = rows(spark)
    assert report.filter_assets(found, "%").count() == sum(d[1] == "100%" for d in data)
    assert report.filter_assets(found, " s_x ").count() == sum("s_x" in d[1].lower() for d in data)
    assert report.search_report(found, "%").count() == len(data)
    assert report.search_report(found, "r_a").count() == sum(d[1] == "RSA" for d in data)
    assert report.filter_assets(found, "  ").count() == len(data)


def test_attention_list(spark):
    found, data = rows(spark, 80)
    order = sorted(data, key=lambda d: (-d[7], tuple(-ord(c) for c in d[0])))
    lists = [[d for d in order if d[8] == "CRITICAL"][:10], [d for d in order if d[8] == "HIGH"][:10], [d for d in order if d[9]][:10]]
    merged = list({d[0]: d for part in lists for d in part}.values())
    expected = [d[0] for d in sorted(merged, key=lambda d: -d[7])][:10]
    assert [r["finding_id"] for r in report.attention_list(found).collect()] == expected


def graph_by_hand(data, assets, nodes, edges):
    kept, placed, links, reasons = sorted(data)[:assets], 0, 0, []
    shown = 0
    if len(data) > assets:
        reasons.append("asset_limit")
    for row in kept:
        if placed >= nodes:
            reasons += ["node_limit"] * ("node_limit" not in reasons)
            break
        placed, shown, seen = placed + 1, shown + 1, set()
        for source in row[12]:
            if source.upper() in seen:
                continue
            seen.add(source.upper())
            full_nodes, full_edges = placed >= nodes, links >= edges
            if full_nodes and "node_limit" not in reasons:
                reasons.append("node_limit")
            if full_edges and "edge_limit" not in reasons:
                reasons.append("edge_limit")
            if not (full_nodes or full_edges):
                placed, links = placed + 1, links + 1
    return shown, placed, links, sorted(reasons)


def test_graph_limits(spark):
    for sources, tried in (
        (("ast", "rule"), ((200, 15, 500), (10, 21, 9))), (("ast", "AST", "rule", "dep"), ((200, 500, 7), (5, 15, 10))), ((), ((200, 9, 6),)),
    ):
        found, data = rows(spark, 20, sources)
        found = found.cache()
        for limits in tried:
            node_rows, edge_rows, truncation = report.evidence_graph(found, None, "finding_id", *limits)
            row = truncation.first()
            expected = graph_by_hand(data, *limits)
            assert (row["returned_assets"], row["returned_nodes"], row["returned_edges"], sorted(row["reasons"])) == expected, (sources, limits)
            if limits == (10, 21, 9):
                assert node_rows.count() == expected[1] and edge_rows.count() == expected[2]
    only = report.evidence_graph(found, "0003")[0].collect()
    assert [r["id"] for r in only] == ["asset:0003"]


def test_bill_serial_number_is_a_name_based_uuid(spark):
    job = spark.createDataFrame([(42, "/srv/x", 99.5)], "id long, repo_path string, coverage_pct double")
    header = report.bill_header(job).first()
    assert header["serialNumber"] == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'inventory:scan:42')}"
    assert header["metadata"]["properties"][2]["value"] == "99.5"


def test_bill_drops_empty_values(spark):
    found, _ = rows(spark, 1)
    names = [p["name"] for p in report.bill_components(found).first()["properties"]]
    assert "inventory:library" not in names and "inventory:evidence:sources" in names and "inventory:location" in names


def test_schema_check(spark):
    found, _ = rows(spark, 1)
    errors = report.schema_errors(found.withColumn("priority_score", F.lit("x")), {"priority_score": "int", "exposure": "string", "usage": "string"})
    assert errors == ["priority_score: expected int, got string", "exposure: expected string, got missing"]


def test_resolve_scan(spark):
    table = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "completed"), (4, "running")], "id long, status string")
    assert report.resolve_scan(table).first()["id"] == 3
    assert report.resolve_scan(table, 1).first()["id"] == 1 and report.resolve_scan(table, 2).count() == 0
