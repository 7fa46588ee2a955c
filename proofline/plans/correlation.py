"""Queries over evidence correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.operators import correlate, correlate_spans, score
from proofline.operators.joins import lookup_join
from proofline.plans.registry import query
from proofline.plans.views import Tables


def keyed(t: Tables) -> DataFrame:
    return correlate.with_keys(t.view("v_evidence"))


def scored(t: Tables) -> DataFrame:
    return score.score_findings(correlate.findings(t.view("v_evidence")), t.view("v_context"))


@query("risk_distribution", """
SELECT priority_label, count(*) AS findings, min(priority_score) AS low_score, max(priority_score) AS high_score,
       count_if(quantum_vulnerable) AS quantum_vulnerable, count_if(conflict) AS conflicts, round(avg(confidence), 4) AS avg_confidence
FROM v_scored GROUP BY priority_label""")
def risk_distribution(t: Tables) -> DataFrame:
    return scored(t).groupBy("priority_label").agg(
        F.count(F.lit(1)).alias("findings"), F.min("priority_score").alias("low_score"),
        F.max("priority_score").alias("high_score"), F.count_if("quantum_vulnerable").alias("quantum_vulnerable"),
        F.count_if("conflict").alias("conflicts"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


@query("c01_component", "SELECT component, count(*) AS records FROM v_evidence GROUP BY component")
def c01(t: Tables) -> DataFrame:
    return t.view("v_evidence").groupBy(paths.component(paths.normalise("location")).alias("component")).agg(F.count(F.lit(1)).alias("records"))


@query("c02_usage", """
SELECT usage_raw, CASE usage_raw WHEN 'sign' THEN 'signature' WHEN 'encryption' THEN 'encryption' ELSE 'unknown' END AS usage, count(*) AS records
FROM v_evidence GROUP BY ALL""")
def c02(t: Tables) -> DataFrame:
    return t.view("v_evidence").groupBy("usage_raw", E.usage("usage_raw").alias("usage")).agg(F.count(F.lit(1)).alias("records"))


@query("c03_context", """
SELECT usage, library, '' AS protocol, key_size, evidence_kind, count(*) AS records FROM k_keyed GROUP BY ALL""")
def c03(t: Tables) -> DataFrame:
    return keyed(t).groupBy("usage", "library", "protocol", "key_size", "evidence_kind").agg(F.count(F.lit(1)).alias("records"))


@query("c04_operation_anchor", "SELECT location, operation_anchor, count(*) AS records FROM k_keyed GROUP BY ALL")
def c04(t: Tables) -> DataFrame:
    return keyed(t).groupBy("location", "operation_anchor").agg(F.count(F.lit(1)).alias("records"))


@query("c05_dependency_suppression", """
SELECT f.component, f.algorithm, count(*) AS findings, sum(evidence_count) AS records FROM k_grouped f
JOIN k_suppressed s ON f.component = s.component AND f.algorithm = s.algorithm GROUP BY ALL""")
def c05(t: Tables) -> DataFrame:
    grouped = correlate.group_findings(keyed(t))
    dropped = lookup_join(grouped, correlate.suppressed_pairs(grouped), ["component", "algorithm"], "left_semi", "finding_id")
    return dropped.groupBy("component", "algorithm").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("evidence_count").alias("records")
    )


@query("c06_finding_groups", """
SELECT component, algorithm, usage, evidence_kind, location, operation_anchor, evidence_count FROM k_grouped""")
def c06(t: Tables) -> DataFrame:
    return correlate.group_findings(keyed(t)).select(*correlate.FINDING_KEY, "evidence_count")


@query("c07_operation_conflicts", "SELECT location, operation_anchor FROM k_clashes")
def c07(t: Tables) -> DataFrame:
    return correlate.operation_conflicts(correlate.group_findings(keyed(t)))


@query("c08_context_conflicts", """
SELECT DISTINCT f.finding_id, 'key_size' AS field, CAST(e.key_size AS VARCHAR) AS value
FROM v_findings f JOIN k_keyed e ON f.component = e.component AND f.algorithm = e.algorithm AND f.usage = e.usage
 AND f.evidence_kind = e.evidence_kind AND f.location = e.location AND f.operation_anchor = e.operation_anchor
WHERE f.key_size_conflict AND e.key_size IS NOT NULL
UNION ALL
SELECT DISTINCT f.finding_id, 'library' AS field, e.library AS value
FROM v_findings f JOIN k_keyed e ON f.component = e.component AND f.algorithm = e.algorithm AND f.usage = e.usage
 AND f.evidence_kind = e.evidence_kind AND f.location = e.location AND f.operation_anchor = e.operation_anchor
WHERE f.library_conflict AND e.library <> ''""")
def c08(t: Tables) -> DataFrame:
    return correlate.context_conflicts(t.view("v_evidence"))


@query("c09_evidence_records", """
SELECT substr(sha256(concat_ws(chr(1), 'operation', component, algorithm, usage, evidence_kind, location, operation_anchor)), 1, 16) AS finding_id,
       category, source, library, key_size, confidence, usage_raw, count(*) AS copies
FROM k_keyed GROUP BY component, algorithm, usage, evidence_kind, location, operation_anchor, category, source, library, key_size, confidence, usage_raw""")
def c09(t: Tables) -> DataFrame:
    return correlate.evidence_records(keyed(t)).select(
        "finding_id", "category", "source", "library", "key_size", "confidence", "usage_raw", "copies"
    )


@query("c10_source_confidence", """
SELECT finding_id, sources, source_count, by_ast, by_cert, by_dep, by_rule FROM v_findings""")
def c10(t: Tables) -> DataFrame:
    found = correlate.findings(t.view("v_evidence"))
    return found.select(
        "finding_id", F.concat_ws(",", "sources").alias("sources"), "source_count",
        *[F.try_element_at("confidence_by_source", F.lit(s)).alias(f"by_{s}") for s in ("ast", "cert", "dep", "rule")],
    )


@query("c11_preferred_category", "SELECT finding_id, usage, category FROM v_findings")
def c11(t: Tables) -> DataFrame:
    return correlate.findings(t.view("v_evidence")).select("finding_id", "usage", "category")


@query("c12_logical_ids", "SELECT finding_id, component, algorithm, location FROM v_findings")
def c12(t: Tables) -> DataFrame:
    return correlate.findings(t.view("v_evidence")).select("finding_id", "component", "algorithm", "location")


def reordered(t: Tables) -> DataFrame:
    """Evidence dealt otherwise, over as many tasks (by algorithm alone one task could hold any number of rows), and in another order."""
    moved = t.view("v_evidence").repartition(t.tasks("v_evidence"), "algorithm", "src_order")
    return moved.sortWithinPartitions(F.xxhash64("location", "src_order").desc())


@query("c13_order_independence", "SELECT CAST(0 AS BIGINT) AS changed_findings")
def c13(t: Tables) -> DataFrame:
    """Findings from reordered evidence minus findings from the evidence as read: must be none."""
    columns = ["finding_id", "category", "library", "protocol", "key_size", "conflict", "evidence_count"]
    first = correlate.findings(t.view("v_evidence")).select(*columns)
    second = correlate.findings(reordered(t)).select(*columns)
    return first.exceptAll(second).unionAll(second.exceptAll(first)).agg(F.count(F.lit(1)).alias("changed_findings"))


SPAN_CHECK = """
WITH spans AS (SELECT location, algorithm, line_start, column_start, evidence_kind, count(*) AS n,
   first(usage ORDER BY category, confidence, usage) AS usage,
   max(confidence) FILTER (source = 'ast') AS by_ast, max(confidence) FILTER (source = 'cert') AS by_cert,
   max(confidence) FILTER (source = 'dep') AS by_dep, max(confidence) FILTER (source = 'rule') AS by_rule
   FROM k_keyed GROUP BY ALL)
"""


def span_check(select: str) -> str:
    """Put the span groups in front of a select, as one inline table."""
    body = SPAN_CHECK.split("AS (", 1)[1].rsplit(")", 1)[0]
    return select.replace("spans", f"({body})")


@query("c14_span_identity", """
SELECT location, line_start, column_start, '' AS semantic_anchor, count(*) AS records FROM v_evidence GROUP BY ALL""")
def c14(t: Tables) -> DataFrame:
    return correlate_spans.with_spans(t.view("v_evidence")).groupBy(
        "location", "line_start", "column_start", "semantic_anchor"
    ).agg(F.count(F.lit(1)).alias("records"))


@query("c15_span_groups", span_check("""
SELECT location, algorithm, line_start, column_start, evidence_kind, usage, n AS evidence_count FROM spans"""))
def c15(t: Tables) -> DataFrame:
    return correlate_spans.group_spans(correlate_spans.with_spans(t.view("v_evidence"))).select(
        "location", "algorithm", "line_start", "column_start", "evidence_kind", "usage", "evidence_count"
    )


@query("c16_cross_kind_links", span_check("""
SELECT a.location, a.algorithm, a.line_start, a.column_start, a.evidence_kind, array_to_string(list_sort(list(b.evidence_kind)), ',') AS links
FROM spans a JOIN spans b ON a.location = b.location AND a.algorithm = b.algorithm AND a.line_start IS NOT DISTINCT FROM b.line_start
 AND a.column_start IS NOT DISTINCT FROM b.column_start AND a.evidence_kind <> b.evidence_kind GROUP BY ALL"""))
def c16(t: Tables) -> DataFrame:
    linked = correlate_spans.cross_kind_links(correlate_spans.group_spans(correlate_spans.with_spans(t.view("v_evidence"))))
    return linked.where(F.size("cross_kind_links") > 0).select(
        "location", "algorithm", "line_start", "column_start", "evidence_kind", F.concat_ws(",", "cross_kind_links").alias("links")
    )


@query("c17_ambiguous_matches", span_check("""
SELECT a.location, a.algorithm, a.evidence_kind, a.line_start, a.column_start, CAST(sum(a.n * b.n) AS BIGINT) AS ambiguous_matches
FROM spans a JOIN spans b ON a.location = b.location AND a.algorithm = b.algorithm AND a.evidence_kind <> b.evidence_kind
 AND coalesce(abs(a.line_start - b.line_start) > 5, true) GROUP BY ALL"""))
def c17(t: Tables) -> DataFrame:
    grouped = correlate_spans.group_spans(correlate_spans.with_spans(t.view("v_evidence")))
    return correlate_spans.with_ambiguity(grouped).where("ambiguous_matches > 0").select(
        "location", "algorithm", "evidence_kind", "line_start", "column_start", "ambiguous_matches"
    )


@query("c18_span_confidence", span_check("""
SELECT location, algorithm, line_start, column_start, evidence_kind,
       round(greatest(0.0, (coalesce(by_ast, 0) + coalesce(by_cert, 0) + coalesce(by_dep, 0) + coalesce(by_rule, 0))
         / ((by_ast IS NOT NULL)::INT + (by_cert IS NOT NULL)::INT + (by_dep IS NOT NULL)::INT + (by_rule IS NOT NULL)::INT) - CAST(0.1 AS DOUBLE) * ambiguous), 2) AS confidence
FROM (SELECT s.*, coalesce((SELECT sum(s.n * b.n) FROM spans b WHERE s.location = b.location AND s.algorithm = b.algorithm
        AND s.evidence_kind <> b.evidence_kind AND coalesce(abs(s.line_start - b.line_start) > 5, true)), 0) AS ambiguous FROM spans s)"""))
def c18(t: Tables) -> DataFrame:
    return correlate_spans.findings(t.view("v_evidence")).select(
        "location", "algorithm", "line_start", "column_start", "evidence_kind", "confidence"
    )


@query("c19_span_anchor", """
SELECT location, line_start, CASE WHEN line_start IS NULL THEN concat(location, ':unknown')
   ELSE concat(location, ':L', CAST(((greatest(1, line_start) - 1) // 3) * 3 + 1 AS VARCHAR), ':C', CAST(column_start AS VARCHAR)) END AS span_anchor, count(*) AS records
FROM v_evidence GROUP BY ALL""")
def c19(t: Tables) -> DataFrame:
    return t.view("v_evidence").groupBy(
        "location", "line_start", E.span_anchor("location", "line_start", "column_start").alias("span_anchor")
    ).agg(F.count(F.lit(1)).alias("records"))


@query("c20_moved_line_notes", span_check("""
SELECT location, evidence_kind, CASE WHEN line_start IS NULL THEN NULL ELSE concat('[line=', CAST(line_start AS VARCHAR), ';algo=', algorithm, ';col=', CAST(column_start AS VARCHAR), ']') END AS moved_line_note,
       CASE WHEN line_start IS NULL THEN 'line:None' ELSE concat('line:', CAST(line_start AS VARCHAR), ':col:', CAST(column_start AS VARCHAR)) END AS operation_anchor, algorithm
FROM spans"""))
def c20(t: Tables) -> DataFrame:
    return correlate_spans.findings(t.view("v_evidence")).select(
        "location", "evidence_kind", "moved_line_note", "operation_anchor", "algorithm"
    )
