"""Queries over reports of scored findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import paths
from proofline.operators import correlate, report
from proofline.plans.correlation import scored
from proofline.plans.registry import query
from proofline.plans.views import Tables


@query("q01_latest_scan", "SELECT id, repo_path, status FROM v_jobs WHERE status = 'completed' AND id = (SELECT max(id) FROM v_jobs WHERE status = 'completed')")
def q01(t: Tables) -> DataFrame:
    return report.resolve_scan(t.view("v_jobs")).select("id", "repo_path", "status")


@query("q02_asset_filter", """
SELECT finding_id FROM v_scored WHERE (contains(lower(algorithm), 'svc1') OR contains(lower(category), 'svc1') OR contains(lower(location), 'svc1') OR contains(lower(library), 'svc1') OR contains(lower(usage), 'svc1'))
 AND priority_label = 'MEDIUM' AND quantum_vulnerable""")
def q02(t: Tables) -> DataFrame:
    return report.filter_assets(scored(t), " SVC1 ", "MEDIUM", True).select("finding_id")


@query("q02_escaped_wildcards", """
SELECT finding_id FROM v_scored WHERE contains(algorithm, '_') OR contains(category, '_') OR contains(location, '_') OR contains(library, '_') OR contains(usage, '_')""")
def q02_escaped(t: Tables) -> DataFrame:
    return report.filter_assets(scored(t), "_").select("finding_id")


SORTS = {"priority": "priority_score DESC", "confidence": "confidence DESC", "algorithm": "algorithm"}


def register_sort(mode: str, order: str) -> None:
    @query(f"q03_sorted_by_{mode}", f"SELECT finding_id, row_number() OVER (ORDER BY {order}, finding_id DESC) AS rank FROM v_scored")
    def run(t: Tables) -> DataFrame:
        from proofline.operators.ordering import global_rank

        columns = scored(t).select("finding_id", "priority_score", "confidence", "algorithm")
        return global_rank(columns, report.sort_order(mode), "rank").select("finding_id", "rank")


for _mode, _order in SORTS.items():
    register_sort(_mode, _order)


@query("q04_page", "SELECT finding_id, priority_score FROM v_scored ORDER BY priority_score DESC, finding_id DESC LIMIT 50 OFFSET 100")
def q04(t: Tables) -> DataFrame:
    return report.list_assets(scored(t), offset=100, limit=50).select("finding_id", "priority_score")


@query("q04_deep_page", "SELECT finding_id, priority_score FROM v_scored ORDER BY priority_score DESC, finding_id DESC LIMIT 200 OFFSET 10000")
def q04_deep(t: Tables) -> DataFrame:
    return report.list_assets(scored(t).select("finding_id", "priority_score"), offset=10_000, limit=200, by_rank=True)


@query("q04_page_totals", "SELECT count(*) AS total, count_if(contains(lower(algorithm), 'rsa')) AS filtered FROM v_scored")
def q04_totals(t: Tables) -> DataFrame:
    return report.page_totals(scored(t), report.contains_any("rsa", ["algorithm"]))


@query("q05_selected_export", "SELECT finding_id, algorithm, location FROM v_scored WHERE usage = 'signature' AND key_size = 256")
def q05(t: Tables) -> DataFrame:
    found = scored(t)
    ids = found.where("usage = 'signature' and key_size = 256").select("finding_id")
    return report.select_assets(found, ids).select("finding_id", "algorithm", "location")


def property_check() -> str:
    cells = {
        "asset:id": "finding_id", "category": "category", "usage": "usage", "evidence-kind": "evidence_kind", "evidence-quality": "lower(confidence_band)",
        "confirmed-use": "CAST(confirmed_use AS VARCHAR)", "capability-only": "CAST(capability_only AS VARCHAR)", "operation-anchor": "operation_anchor", "location": "location",
        "library": "library", "protocol": "protocol", "key-size": "CAST(key_size AS VARCHAR)", "evidence:sources": """concat('["', replace(sources, ',', '","'), '"]')""",
        "confidence": "CAST(confidence AS VARCHAR)", "quantum-vulnerable": "CAST(quantum_vulnerable AS VARCHAR)", "risk-score": "CAST(priority_score AS VARCHAR)",
        "risk-label": "priority_label", "migration-recommendation": "pqc_candidate",
    }
    structs = ", ".join(f"{{'name': 'inventory:{n}', 'value': {v}}}" for n, v in cells.items())
    return f"""
SELECT concat('inventory:asset:', finding_id) AS ref, p.name, p.value FROM (SELECT finding_id, unnest([{structs}]) AS p FROM v_scored) WHERE coalesce(p.value, '') <> ''"""


@query("q06_bill_properties", property_check())
def q06(t: Tables) -> DataFrame:
    components = report.bill_components(scored(t))
    return components.select(F.col("bom-ref").alias("ref"), F.explode("properties").alias("p")).select("ref", "p.name", "p.value")


@query("q06_bill_conflicts", """
SELECT finding_id, concat('{', string_agg(concat('"', field, '":[', vals, ']'), ',' ORDER BY field), '}') AS value FROM
 (SELECT finding_id, field, string_agg(concat('"', value, '"'), ',' ORDER BY value) AS vals FROM (
   SELECT DISTINCT f.finding_id, 'key_size' AS field, CAST(e.key_size AS VARCHAR) AS value FROM v_findings f JOIN k_keyed e ON f.component = e.component AND f.algorithm = e.algorithm AND f.usage = e.usage
     AND f.evidence_kind = e.evidence_kind AND f.location = e.location AND f.operation_anchor = e.operation_anchor WHERE f.key_size_conflict AND e.key_size IS NOT NULL
   UNION ALL SELECT DISTINCT f.finding_id, 'library', e.library FROM v_findings f JOIN k_keyed e ON f.component = e.component AND f.algorithm = e.algorithm AND f.usage = e.usage
     AND f.evidence_kind = e.evidence_kind AND f.location = e.location AND f.operation_anchor = e.operation_anchor WHERE f.library_conflict AND e.library <> '') GROUP BY ALL) GROUP BY finding_id""")
def q06_conflicts(t: Tables) -> DataFrame:
    """The context-conflicts property of every component that has one."""
    evidence = t.view("v_evidence")
    found = correlate.findings(evidence)
    components = report.bill_components(report.attach_context_conflicts(found, correlate.context_conflicts(evidence, found)))
    rows = components.select("bom-ref", F.explode("properties").alias("p")).where("p.name = 'inventory:context-conflicts'")
    return rows.select(F.substring_index("bom-ref", ":", -1).alias("finding_id"), "p.value")


@query("q06_bill_header", """
SELECT 'CycloneDX' AS "bomFormat", '1.6' AS "specVersion", 1 AS version, max(id) AS scan FROM v_jobs WHERE status = 'completed'""")
def q06_header(t: Tables) -> DataFrame:
    header = report.bill_header(report.resolve_scan(t.view("v_jobs")))
    return header.select("bomFormat", "specVersion", "version", F.get("metadata.properties", F.lit(0))["value"].cast("long").alias("scan"))


@query("q07_report_search", """
SELECT finding_id FROM v_scored WHERE algorithm ILIKE '%s_a-2%' OR location ILIKE '%s_a-2%' OR category ILIKE '%s_a-2%' OR usage ILIKE '%s_a-2%'""")
def q07(t: Tables) -> DataFrame:
    """Wildcards in the text keep their meaning here."""
    return report.search_report(scored(t), "S_A-2").select("finding_id")


@query("q08_risk_summary", """
SELECT count(*) AS assets, count_if(quantum_vulnerable) AS quantum_vulnerable, count_if(conflict) AS conflicts, count_if(priority_label = 'CRITICAL') AS critical,
       count_if(priority_label = 'HIGH') AS high, count_if(priority_label = 'MEDIUM') AS medium, count_if(priority_label = 'LOW') AS low FROM v_scored""")
def q08(t: Tables) -> DataFrame:
    return report.risk_summary(scored(t))


@query("q09_migration_priorities", """
SELECT row_number() OVER (ORDER BY priority_score DESC, algorithm, location, finding_id) AS rank, finding_id, priority_score AS score, priority_label AS label, confidence, confidence_band, pqc_candidate AS recommendation,
       risk_reasons AS reasons FROM v_scored ORDER BY rank LIMIT 100 OFFSET 20""")
def q09(t: Tables) -> DataFrame:
    rows = report.migration_priorities(scored(t), offset=20, limit=100)
    return rows.select(
        "rank", "finding_id", "score", "label", "confidence", "confidence_band", "recommendation", F.concat_ws("; ", "reasons").alias("reasons")
    )


GRAPH = """
(SELECT finding_id, sources, nth, ns, coalesce(sum(ns) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
  (SELECT finding_id, sources, source_count AS ns, row_number() OVER (ORDER BY finding_id) AS nth FROM v_scored ORDER BY finding_id LIMIT 200))"""


@query("q10_graph_nodes", f"""
SELECT concat('asset:', finding_id) AS id, 'asset' AS type FROM {GRAPH} WHERE nth - 1 + least(before, 500) < 500
UNION ALL SELECT concat('source:', finding_id, ':', s) AS id, 'evidence' AS type FROM (SELECT *, unnest(string_split(sources, ',')) AS s, unnest(range(ns)) AS i FROM {GRAPH}) WHERE before + i + 1 <= 500 AND nth + before + i + 1 <= 500""")
def q10(t: Tables) -> DataFrame:
    nodes, _, _ = report.evidence_graph(scored(t))
    return nodes.select("id", "type")


@query("q10_graph_edges", f"""
SELECT concat('source:', finding_id, ':', s) AS source, concat('asset:', finding_id) AS target, 'supports' AS relation
FROM (SELECT *, unnest(string_split(sources, ',')) AS s, unnest(range(ns)) AS i FROM {GRAPH}) WHERE before + i + 1 <= 500 AND nth + before + i + 1 <= 500""")
def q10_edges(t: Tables) -> DataFrame:
    _, edges, _ = report.evidence_graph(scored(t))
    return edges


@query("q10_graph_truncation", f"""
SELECT (SELECT count(*) FROM v_scored) AS total_assets, count(DISTINCT finding_id) AS returned_assets, count(*) AS returned_edges, 'asset_limit' AS reasons FROM
 (SELECT *, unnest(range(ns)) AS i FROM {GRAPH}) WHERE before + i + 1 <= 500 AND nth + before + i + 1 <= 500""")
def q10_truncation(t: Tables) -> DataFrame:
    _, _, truncation = report.evidence_graph(scored(t))
    return truncation.select("total_assets", "returned_assets", "returned_edges", F.concat_ws(",", "reasons").alias("reasons"))


@query("q11_dashboard", """
SELECT count(*) AS total_assets, count_if(priority_label IN ('CRITICAL', 'HIGH')) AS high_risk_count, round(avg(confidence), 4) AS avg_confidence, count_if(priority_label = 'CRITICAL') AS critical_count,
       count_if(priority_label = 'HIGH') AS high_count, count_if(priority_label = 'MEDIUM') AS medium_count, count_if(priority_label = 'LOW') AS low_count, count_if(quantum_vulnerable) AS quantum_vulnerable_count,
       count_if(conflict) AS conflict_count, count_if(confirmed_use) AS confirmed_use_count, count_if(capability_only) AS capability_only_count FROM v_scored""")
def q11(t: Tables) -> DataFrame:
    return report.dashboard_summary(scored(t))


@query("q12_confidence_histogram", """
SELECT count_if(confidence <= 0.2) AS c_0_20, count_if(confidence > 0.2 AND confidence <= 0.4) AS c_21_40, count_if(confidence > 0.4 AND confidence <= 0.6) AS c_41_60,
       count_if(confidence > 0.6 AND confidence <= 0.8) AS c_61_80, count_if(confidence > 0.8) AS c_81_100 FROM v_scored""")
def q12(t: Tables) -> DataFrame:
    return report.confidence_histogram(scored(t))


TOP = "SELECT * FROM (SELECT finding_id, priority_score, priority_label, {n} AS l FROM v_scored WHERE {where} ORDER BY priority_score DESC, finding_id DESC LIMIT 10)"


@query("q13_attention_list", f"""
SELECT finding_id, priority_score, priority_label FROM (SELECT finding_id, priority_score, priority_label, min(l) AS l FROM (
 {TOP.format(n=0, where="priority_label = 'CRITICAL'")} UNION ALL {TOP.format(n=1, where="priority_label = 'HIGH'")} UNION ALL {TOP.format(n=2, where="quantum_vulnerable")}) GROUP BY ALL)
ORDER BY priority_score DESC, l, finding_id DESC LIMIT 10""")
def q13(t: Tables) -> DataFrame:
    return report.attention_list(scored(t)).select("finding_id", "priority_score", "priority_label")


@query("q20_path_display", """
SELECT path, concat('…/', array_to_string(string_split(path, '/')[-3:], '/')) AS shown, split_part(path, '/', -1) AS name FROM v_files""")
def q20(t: Tables) -> DataFrame:
    rooted = F.concat(F.lit("/srv/"), "path")
    return t.view("v_files").select("path", paths.display_path(rooted).alias("shown"), paths.repository_name("path").alias("name"))


