"""Confidence and risk over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import scoring as S
from proofline.functions.evidence import confidence_note

CONTEXT_FIELDS = tuple(C.RISK_DEFAULTS)


def with_confidence(found: DataFrame, kinds: str | None = None) -> DataFrame:
    """Adds ``confidence`` and ``confidence_reasons``; the finding's own kind is its one kind by default."""
    if kinds is None:
        return found.withColumns({
            "confidence": S.confidence_of_kind("evidence_kind", "conflict"),
            "confidence_reasons": S.reasons_of_kind("evidence_kind", "conflict"),
        })
    return found.withColumns({
        "confidence": S.confidence(kinds, "conflict"), "confidence_reasons": S.confidence_reasons(kinds, "conflict"),
    })


def with_context(found: DataFrame, context: DataFrame | None = None, on: Sequence[str] = ("component",)) -> DataFrame:
    """Adds the seven context fields, defaults where none was supplied, and where each came from.

    A field counts as supplied when the context row exists and has that column, even if it is null.
    Catalyst broadcasts the context only while its size is under the broadcast threshold.
    """
    if context is None:
        joined, supplied = found.withColumn("_has", F.lit(False)), []
    else:
        supplied = [f for f in CONTEXT_FIELDS if f in context.columns]
        # Several rows for one key would multiply findings: the largest in sort order stands for the key.
        one = context.groupBy(*on).agg(F.max(F.struct(F.lit(True).alias("_given"), *supplied)).alias("_c"))
        renamed = one.select(*on, *[F.col(f"_c.{f}").alias(f"_{f}") for f in supplied], "_c._given")
        joined = found.join(renamed, list(on), "left").withColumn("_has", F.coalesce("_given", F.lit(False)))
    fields: dict[str, Column] = {}
    for name, default in C.RISK_DEFAULTS.items():
        fields[name] = F.coalesce(F.col(f"_{name}"), F.lit(default)) if name in supplied else F.lit(default)
    present = {f: (F.col("_has") if f in supplied else F.lit(False)) for f in CONTEXT_FIELDS}
    out = joined.withColumns({**fields, "risk_context_provenance": S.provenance(present)})
    return out.drop("_has", "_given", *[f"_{f}" for f in supplied])


def assess(found: DataFrame) -> DataFrame:
    """Vulnerability, overlap, priority, label, advice and explanation; expects the context fields."""
    defaults = C.RISK_DEFAULTS
    kind = S.known_kind("evidence_kind", "evidence_quality" if "evidence_quality" in found.columns else None)
    levels = {f"_{n}": S.level(n, defaults[n]) for n in ("data_sensitivity", "business_criticality", "exposure", "migration_effort")}
    first = found.withColumns({
        **levels, "_horizon": S.horizon_years("threat_horizon_years"),
        "quantum_vulnerable": S.quantum_vulnerable("algorithm"),
        "mosca_window_years": S.mosca_window("data_lifetime_years", "migration_time_years"),
        "confirmed_use": S.confirmed_use(kind), "capability_only": S.capability_only(kind),
    })
    sensitivity, criticality, exposure, effort = (F.col(n) for n in levels)
    horizon = F.col("_horizon")
    second = first.withColumn("threat_overlap", F.col("quantum_vulnerable") & (F.col("mosca_window_years") >= horizon))
    flags = [F.col(n) for n in ("quantum_vulnerable", "threat_overlap", "confirmed_use", "capability_only")]
    scored = second.withColumn(
        "priority_score", S.priority_score(*flags, sensitivity, criticality, exposure, effort)
    )
    usage = F.coalesce(F.nullif(F.col("usage"), F.lit("")), F.lit("unknown"))
    return scored.withColumns({
        "priority_label": S.priority_label("priority_score"),
        "pqc_candidate": S.recommendation("algorithm", usage, effort),
        "hybrid_recommended": S.hybrid_recommended("algorithm", usage, effort),
        "risk_reasons": S.risk_reasons(
            F.col("algorithm"), F.col("quantum_vulnerable"), F.col("confirmed_use"), F.col("capability_only"),
            F.col("threat_overlap"), F.col("mosca_window_years"), horizon, sensitivity, criticality, exposure, effort,
        ),
    }).drop(*levels, "_horizon")


def with_band(found: DataFrame) -> DataFrame:
    return found.withColumn("confidence_band", S.band("confidence")).withColumns({
        "confidence_interpretation": F.concat(
            S.band_label("confidence_band"), F.lit(" — "), S.band_description("confidence_band")
        ),
        "evidence_quality": F.lower("confidence_band"),
    })


def score_findings(found: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Confidence, context and risk in one narrow chain over findings."""
    return with_band(assess(with_context(with_confidence(found), context)))


def rescore(found: DataFrame, changes: DataFrame, actor: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Apply context changes (null = unchanged) and score again; returns (findings, audit rows).

    The evidence kind is kept, so a confirmed use stays confirmed after an update.
    """
    fields = [f for f in CONTEXT_FIELDS if f in changes.columns]
    renamed = changes.select("finding_id", *[F.col(f).alias(f"_{f}") for f in fields])
    merged = found.join(renamed, "finding_id", "left").withColumns(
        {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}
    ).drop(*[f"_{f}" for f in fields])
    audit = changes.join(found.select("finding_id"), "finding_id", "left_semi").select(
        at.alias("timestamp"), F.lit(actor).alias("actor_subject"),
        F.lit("asset.risk_context_updated").alias("action"),
        F.concat(F.lit("asset:"), "finding_id").alias("resource"),
        F.to_json(F.struct(*fields)).alias("details"),
    )
    return assess(merged), audit


def finding_provenance(records: DataFrame) -> DataFrame:
    """Parser versions per finding in name order; a finding has as many as there are parsers."""
    return (
        records.where("parser_version <> ''")
        .groupBy("finding_id")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("parser_version"))).alias("parser_version"))
    )


def reason_rows(records: DataFrame, note: Column | None = None) -> DataFrame:
    """Original confidence reasons of each distinct evidence record, one row each; by default with its collector's note."""
    note = confidence_note("source", "evidence_kind") if note is None else note
    return records.select(
        "finding_id", "source", "evidence_kind", F.col("confidence").alias("base"),
        F.lit(0.0).alias("bonus"), F.lit(0.0).alias("penalty"), note.alias("note"),
    )


def mosca_scenarios(context: DataFrame) -> DataFrame:
    """Three what-if rows per input: two more years, as planned, and two years faster (at least one)."""
    x, y, z = F.col("data_lifetime_years"), F.col("migration_time_years"), F.col("threat_horizon_years")
    options = F.array(
        F.struct(F.lit("conservative").alias("scenario"), (y + 2).alias("years")),
        F.struct(F.lit("baseline").alias("scenario"), y.alias("years")),
        F.struct(F.lit("aggressive").alias("scenario"), F.greatest(F.lit(1), y - 2).alias("years")),
    )
    rows = context.withColumn("_option", F.explode(options)).withColumns({
        "scenario": F.col("_option.scenario"), "scenario_migration_years": F.col("_option.years"),
        "gap": x + F.col("_option.years") - z,
    })
    return rows.withColumn("overlaps", F.col("gap") >= 0).drop("_option")


UPDATE_RULES = {
    "business_criticality": C.LEVELS, "data_sensitivity": C.LEVELS, "data_lifetime_years": (0, 100),
    "migration_time_years": (0, 50), "threat_horizon_years": (1, 100), "exposure": C.EXPOSURES,
    "migration_effort": C.LEVELS,
}


def validate_updates(changes: DataFrame) -> DataFrame:
    """Adds ``errors``: the names of supplied fields outside their allowed values or range."""
    checks = []
    for name, allowed in UPDATE_RULES.items():
        if name not in changes.columns:
            continue
        value = F.col(name)
        good = value.between(*allowed) if isinstance(allowed[0], int) else value.isin(*allowed)
        checks.append(F.when(value.isNotNull() & ~good, F.lit(name)))
    return changes.withColumn("errors", F.array_compact(F.array(*checks)))
