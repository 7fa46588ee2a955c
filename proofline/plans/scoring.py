"""Queries over confidence and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import scoring as S
from proofline.operators import correlate, score
from proofline.plans.correlation import keyed, scored
from proofline.plans.registry import query
from proofline.plans.views import Tables


@query("r01_confidence", """
SELECT component, algorithm, kinds, conflict, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, mean + least(0.2::DOUBLE, 0.08::DOUBLE * (n - 1)) - CASE WHEN conflict THEN 0.2::DOUBLE ELSE 0::DOUBLE END)), 4) AS confidence
FROM (SELECT component, algorithm, count(*) AS n, string_agg(evidence_kind, ',' ORDER BY evidence_kind) AS kinds, bool_or(several) AS conflict,
        avg(CASE evidence_kind WHEN 'observed_operation' THEN 0.90::DOUBLE WHEN 'configured_protocol' THEN 0.85::DOUBLE WHEN 'declared_capability' THEN 0.65::DOUBLE WHEN 'artifact_metadata' THEN 0.50::DOUBLE ELSE 0.30::DOUBLE END) AS mean
      FROM (SELECT component, algorithm, evidence_kind, max(key_size) > 2048 AS several FROM v_evidence GROUP BY ALL) GROUP BY component, algorithm)""")
def r01(t: Tables) -> DataFrame:
    """Several kinds per (component, algorithm), so that the bonus applies."""
    kinds = t.view("v_evidence").groupBy("component", "algorithm").agg(
        F.array_sort(F.collect_set("evidence_kind")).alias("kinds"),
        F.coalesce(F.max("key_size") > 2048, F.lit(False)).alias("conflict"),
    )
    return kinds.select(
        "component", "algorithm", F.concat_ws(",", "kinds").alias("kinds"), "conflict", S.confidence("kinds", "conflict").alias("confidence")
    )


@query("r01_finding_confidence", "SELECT finding_id, confidence FROM v_scored")
def r01_findings(t: Tables) -> DataFrame:
    return score.with_confidence(correlate.findings(t.view("v_evidence"))).select("finding_id", "confidence")


@query("r02_context_defaults", """
SELECT finding_id, business_criticality, data_sensitivity, data_lifetime_years, migration_time_years, threat_horizon_years, exposure, migration_effort FROM v_scored""")
def r02(t: Tables) -> DataFrame:
    return score.with_context(correlate.findings(t.view("v_evidence")), t.view("v_context")).select("finding_id", *score.CONTEXT_FIELDS)


@query("r03_provenance", """
SELECT f.component, CASE WHEN c.component IS NULL THEN 'policy-default' ELSE 'user-provided' END AS exposure, 'policy-default' AS threat_horizon_years
FROM (SELECT DISTINCT component FROM v_evidence UNION SELECT DISTINCT concat('x', CAST(l_suppkey AS VARCHAR)) FROM lineitem) f LEFT JOIN v_context c ON f.component = c.component""")
def r03(t: Tables) -> DataFrame:
    components = t.view("v_evidence").select("component").unionByName(
        t.table("lineitem").select(F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("component"))
    ).distinct()
    return score.with_context(components, t.view("v_context")).select("component", *[
        F.col("risk_context_provenance")[n].alias(n) for n in ("exposure", "threat_horizon_years")
    ])


@query("r04_quantum_flag", """
SELECT algorithm, quantum_vulnerable, count(*) AS findings FROM v_scored GROUP BY ALL""")
def r04(t: Tables) -> DataFrame:
    return scored(t).groupBy("algorithm", "quantum_vulnerable").agg(F.count(F.lit(1)).alias("findings"))


@query("r05_mosca_overlap", "SELECT finding_id, mosca_window_years, threat_overlap FROM v_scored")
def r05(t: Tables) -> DataFrame:
    return scored(t).select("finding_id", "mosca_window_years", "threat_overlap")


@query("r06_priority_score", "SELECT finding_id, priority_score FROM v_scored")
def r06(t: Tables) -> DataFrame:
    return scored(t).select("finding_id", "priority_score")


@query("r07_priority_label", "SELECT priority_label, priority_score, count(*) AS findings FROM v_scored GROUP BY ALL")
def r07(t: Tables) -> DataFrame:
    return scored(t).groupBy("priority_label", "priority_score").agg(F.count(F.lit(1)).alias("findings"))


@query("r08_recommendation", """
SELECT algorithm, usage, migration_effort, pqc_candidate, hybrid_recommended, count(*) AS findings FROM v_scored GROUP BY ALL""")
def r08(t: Tables) -> DataFrame:
    return scored(t).groupBy("algorithm", "usage", "migration_effort", "pqc_candidate", "hybrid_recommended").agg(
        F.count(F.lit(1)).alias("findings")
    )


@query("r09_explanations", "SELECT finding_id, risk_reasons AS reasons FROM v_scored")
def r09(t: Tables) -> DataFrame:
    return scored(t).select("finding_id", F.concat_ws("; ", "risk_reasons").alias("reasons"))


@query("r10_use_flags", "SELECT evidence_kind, confirmed_use, capability_only, count(*) AS findings FROM v_scored GROUP BY ALL")
def r10(t: Tables) -> DataFrame:
    return scored(t).groupBy("evidence_kind", "confirmed_use", "capability_only").agg(F.count(F.lit(1)).alias("findings"))


KEYED_ID = "substr(sha256(concat_ws(chr(1), 'operation', component, algorithm, usage, evidence_kind, location, operation_anchor)), 1, 16)"


@query("r11_finding_provenance", f"""
SELECT {KEYED_ID} AS finding_id, string_agg(DISTINCT concat(source, '-v1'), ',' ORDER BY concat(source, '-v1')) AS parser_version FROM k_keyed GROUP BY 1""")
def r11(t: Tables) -> DataFrame:
    """Each collector's records carry a parser version."""
    versioned = t.view("v_evidence").withColumn("parser_version", F.concat("source", F.lit("-v1")))
    return score.finding_provenance(correlate.evidence_records(correlate.with_keys(versioned)))


@query("r11_reason_rows", f"""
SELECT DISTINCT {KEYED_ID} AS finding_id, source, evidence_kind, confidence AS base, category, library, key_size, usage_raw FROM k_keyed""")
def r11_reasons(t: Tables) -> DataFrame:
    records = correlate.evidence_records(keyed(t))
    return records.select(
        "finding_id", "source", "evidence_kind", F.col("confidence").alias("base"), "category", "library", "key_size", "usage_raw"
    )


@query("r10_quality_fallback", """
SELECT finding_id, evidence_kind IN ('observed_operation', 'configured_protocol') AS confirmed_use, evidence_kind IN ('declared_capability', 'artifact_metadata') AS capability_only FROM v_scored""")
def r10_fallback(t: Tables) -> DataFrame:
    """Findings of one usage tell their kind as quality only, those of another have a null kind; a kind goes before a quality."""
    own, usage = F.col("evidence_kind"), F.col("usage")
    found = correlate.findings(t.view("v_evidence")).withColumns({
        "evidence_quality": F.when(usage.isin("signature", "hashing"), F.upper(own)).otherwise("configured_protocol"),
        "evidence_kind": F.when(usage == "signature", "").when(usage != "hashing", own),
    })
    return score.assess(score.with_context(found)).select("finding_id", "confirmed_use", "capability_only")


NOTES = ", ".join(f"('{s}', '{k}', '{note}')" for (s, k), note in C.EVIDENCE_NOTES.items())


@query("r11_reason_notes", f"""
SELECT DISTINCT {KEYED_ID} AS finding_id, k_keyed.source, k_keyed.evidence_kind, confidence AS base, 0.0::DOUBLE AS bonus, 0.0::DOUBLE AS penalty, coalesce(note, '') AS note
FROM k_keyed LEFT JOIN (VALUES {NOTES}) n(source, kind, note) ON k_keyed.source = n.source AND k_keyed.evidence_kind = n.kind""")
def r11_notes(t: Tables) -> DataFrame:
    """Why the records of each finding have their confidence."""
    return score.reason_rows(correlate.evidence_records(keyed(t))).fillna("", ["note"]).distinct()


@query("r12_rescore", """
SELECT finding_id, exposure, data_sensitivity, priority_score FROM (
  SELECT finding_id, CASE WHEN usage = 'signature' THEN 'internet' ELSE exposure END AS exposure, CASE WHEN usage = 'signature' AND conflict THEN 'critical' ELSE data_sensitivity END AS data_sensitivity,
         priority_score - CASE exposure WHEN 'isolated' THEN 0 WHEN 'partner' THEN 7 WHEN 'internet' THEN 10 ELSE 3 END - CASE data_sensitivity WHEN 'low' THEN 3 WHEN 'high' THEN 11 WHEN 'critical' THEN 15 ELSE 7 END
         + CASE CASE WHEN usage = 'signature' THEN 'internet' ELSE exposure END WHEN 'isolated' THEN 0 WHEN 'partner' THEN 7 WHEN 'internet' THEN 10 ELSE 3 END
         + CASE CASE WHEN usage = 'signature' AND conflict THEN 'critical' ELSE data_sensitivity END WHEN 'low' THEN 3 WHEN 'high' THEN 11 WHEN 'critical' THEN 15 ELSE 7 END AS priority_score FROM v_scored)""")
def r12(t: Tables) -> DataFrame:
    found = scored(t)
    changes = found.where("usage = 'signature'").select(
        "finding_id", F.lit("internet").alias("exposure"), F.when(F.col("conflict"), "critical").alias("data_sensitivity")
    )
    updated, _ = score.rescore(found, changes, "admin", F.lit("2024-02-01").cast("timestamp_ntz"))
    return updated.select("finding_id", "exposure", "data_sensitivity", "priority_score")


@query("r12_rescore_audit", """
SELECT concat('asset:', finding_id) AS resource, 'asset.risk_context_updated' AS action, '{"exposure":"internet"}' AS details FROM v_scored WHERE usage = 'signature'""")
def r12_audit(t: Tables) -> DataFrame:
    found = scored(t)
    changes = found.where("usage = 'signature'").select("finding_id", F.lit("internet").alias("exposure"))
    _, audit = score.rescore(found, changes, "admin", F.lit("2024-02-01").cast("timestamp_ntz"))
    return audit.select("resource", "action", "details")


@query("r13_mosca_scenarios", """
SELECT component, scenario, years AS scenario_migration_years, x + years - 15 AS gap, x + years - 15 >= 0 AS overlaps FROM
 (SELECT component, coalesce(data_lifetime_years, 10) AS x, scenario, CASE scenario WHEN 'conservative' THEN coalesce(migration_time_years, 3) + 2 WHEN 'baseline' THEN coalesce(migration_time_years, 3)
   ELSE greatest(1, coalesce(migration_time_years, 3) - 2) END AS years FROM v_context, (VALUES ('conservative'), ('baseline'), ('aggressive')) s(scenario))""")
def r13(t: Tables) -> DataFrame:
    context = t.view("v_context").select(
        "component", F.coalesce("data_lifetime_years", F.lit(10)).alias("data_lifetime_years"),
        F.coalesce("migration_time_years", F.lit(3)).alias("migration_time_years"), F.lit(15).alias("threat_horizon_years"),
    )
    return score.mosca_scenarios(context).select("component", "scenario", "scenario_migration_years", "gap", "overlaps")


@query("r14_update_checks", """
SELECT component, concat_ws(',', CASE WHEN b = 'urgent' THEN 'business_criticality' END, CASE WHEN y > 100 THEN 'data_lifetime_years' END) AS errors FROM
 (SELECT component, CASE WHEN exposure = 'partner' THEN 'urgent' ELSE business_criticality END AS b, data_lifetime_years * 10 AS y FROM v_context)""")
def r14(t: Tables) -> DataFrame:
    changes = t.view("v_context").withColumns({
        "business_criticality": F.when(F.col("exposure") == "partner", "urgent").otherwise(F.col("business_criticality")),
        "data_lifetime_years": F.col("data_lifetime_years") * 10,
    })
    return score.validate_updates(changes).select("component", F.concat_ws(",", "errors").alias("errors"))
