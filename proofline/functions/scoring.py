"""Confidence, bands and risk as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions.lookup import column, lookup


def clamp(value: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), column(value).cast("double")))


def band(score: Column | str, bands: Sequence[tuple[str, float, float]] = C.BANDS) -> Column:
    """Band by inclusive ranges; the first listed range that holds the clamped score wins."""
    score = clamp(score)
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, low, high in bands:
        choice = choice.when((score >= F.lit(float(low))) & (score <= F.lit(float(high))), name)
    return choice.otherwise("UNCERTAIN")


def band_by_cutoff(score: Column | str, cutoffs: Mapping[str, float]) -> Column:
    """Band by lower bounds: the highest cutoff the clamped score reaches."""
    score = clamp(score)
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, cutoff in sorted(cutoffs.items(), key=lambda item: item[1], reverse=True):
        choice = choice.when(score >= F.lit(float(cutoff)), name)
    return choice.otherwise("UNCERTAIN")


def band_label(name: Column | str) -> Column:
    return lookup({k: v[0] for k, v in C.BAND_TEXT.items()}, name)


def band_description(name: Column | str) -> Column:
    return lookup({k: v[1] for k, v in C.BAND_TEXT.items()}, name)


def confidence(kinds: Column | str, conflict: Column | str) -> Column:
    """Mean strength of the distinct kinds, a bonus per further kind, less the conflict penalty."""
    kinds = F.array_distinct(F.filter(column(kinds), lambda k: k.isNotNull() & (k != "")))
    count = F.size(kinds)
    strengths = F.transform(kinds, lambda k: lookup(C.KIND_STRENGTH, k, C.KIND_STRENGTH["unknown"]))
    mean = F.aggregate(strengths, F.lit(0.0), lambda total, s: total + s) / count
    bonus = F.least(F.lit(0.20), F.lit(0.08) * (count - 1))
    penalty = F.when(column(conflict), F.lit(0.20)).otherwise(F.lit(0.0))
    scored = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(mean + bonus - penalty, 4)))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, F.lit(0.0)).otherwise(scored)


def confidence_reasons(kinds: Column | str, conflict: Column | str) -> Column:
    kinds = F.array_distinct(F.filter(column(kinds), lambda k: k.isNotNull() & (k != "")))
    count = F.size(kinds)
    strengths = F.transform(kinds, lambda k: lookup(C.KIND_STRENGTH, k, C.KIND_STRENGTH["unknown"]))
    mean = F.aggregate(strengths, F.lit(0.0), lambda total, s: total + s) / count
    bonus = F.least(F.lit(0.20), F.lit(0.08) * (count - 1))
    scored = F.array_compact(F.array(
        F.format_string("%d evidence kind(s)", count), F.format_string("avg=%.2f", mean),
        F.format_string("+bonus=%.2f", bonus), F.when(column(conflict), F.lit("-0.20 operation conflict")),
    ))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, F.array(F.lit("no evidence"))).otherwise(scored)


def confidence_of_kind(kind: Column | str, conflict: Column | str) -> Column:
    """``confidence`` for evidence of one kind: no arrays, so it stays in generated code."""
    strength = lookup(C.KIND_STRENGTH, kind, C.KIND_STRENGTH["unknown"])
    penalty = F.when(column(conflict), F.lit(0.20)).otherwise(F.lit(0.0))
    scored = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(strength - penalty, 4)))
    return F.when(F.coalesce(column(kind), F.lit("")) == "", F.lit(0.0)).otherwise(scored)


def reasons_of_kind(kind: Column | str, conflict: Column | str) -> Column:
    averages = {k: f"avg={v:.2f}" for k, v in C.KIND_STRENGTH.items()}
    lines = [F.lit("1 evidence kind(s)"), lookup(averages, kind, averages["unknown"]), F.lit("+bonus=0.00")]
    listed = F.when(column(conflict), F.array(*lines, F.lit("-0.20 operation conflict"))).otherwise(F.array(*lines))
    return F.when(F.coalesce(column(kind), F.lit("")) == "", F.array(F.lit("no evidence"))).otherwise(listed)


def base_algorithm(algorithm: Column | str) -> Column:
    """Algorithm without a numeric suffix; a suffix that starts with a letter stays."""
    return F.trim(F.regexp_replace(column(algorithm), r"[-_]\d+.*$", ""))


def quantum_vulnerable(algorithm: Column | str, vulnerable: Sequence[str] = C.QUANTUM_VULNERABLE) -> Column:
    return base_algorithm(algorithm).isin(*vulnerable)


def known_kind(kind: Column | str, quality: Column | str | None = None) -> Column:
    """The evidence kind; where it is null or empty the evidence quality, else ``unknown``."""
    return F.coalesce(*[F.nullif(column(c), F.lit("")) for c in (kind, quality) if c is not None], F.lit("unknown"))


def confirmed_use(kind: Column | str) -> Column:
    return F.lower(column(kind)).isin("observed_operation", "configured_protocol")


def capability_only(kind: Column | str) -> Column:
    return F.lower(column(kind)).isin("declared_capability", "artifact_metadata")


def mosca_window(lifetime: Column | str, migration: Column | str) -> Column:
    years = [F.greatest(F.lit(0), F.coalesce(column(c), F.lit(0))) for c in (lifetime, migration)]
    return years[0] + years[1]


def horizon_years(horizon: Column | str) -> Column:
    given = F.nullif(column(horizon), F.lit(0))
    return F.greatest(F.lit(1), F.coalesce(given, F.lit(C.RISK_DEFAULTS["threat_horizon_years"])))


def level(value: Column | str, default: str) -> Column:
    return F.lower(F.coalesce(F.nullif(column(value), F.lit("")), F.lit(default)))


def priority_score(vulnerable: Column, overlap: Column, confirmed: Column, capability: Column,
                   sensitivity: Column, criticality: Column, exposure: Column, effort: Column) -> Column:
    base = (
        F.when(confirmed, C.BASE_POINTS["confirmed"]).when(capability, C.BASE_POINTS["capability"])
        .otherwise(C.BASE_POINTS["other"])
    )
    total = (
        F.when(vulnerable, base).otherwise(0)
        + F.when(overlap, C.OVERLAP_POINTS).otherwise(0)
        + lookup(C.LEVEL_POINTS, sensitivity, C.LEVEL_POINTS["medium"])
        + lookup(C.LEVEL_POINTS, criticality, C.LEVEL_POINTS["medium"])
        + lookup(C.EXPOSURE_POINTS, exposure, C.EXPOSURE_POINTS["internal"])
        + lookup(C.EFFORT_POINTS, effort, C.EFFORT_POINTS["medium"])
    )
    return F.least(F.lit(100), total)


def priority_label(score: Column | str) -> Column:
    score = column(score)
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, floor in C.LABEL_FLOORS[:-1]:
        choice = choice.when(score >= floor, name)
    return choice.otherwise(C.LABEL_FLOORS[-1][0])


def _exchange(algorithm: Column, usage: Column) -> Column:
    return algorithm.isin("RSA", "ECDH", "DH", "ECC") & usage.isin("encryption", "key_establishment", "tls")


def _signature(algorithm: Column, usage: Column) -> Column:
    return algorithm.isin("RSA", "ECDSA", "DSA", "ECC") & (usage == "signature")


def hybrid_recommended(algorithm: Column | str, usage: Column | str, effort: Column | str) -> Column:
    algorithm, usage = column(algorithm), F.lower(column(usage))
    return (_exchange(algorithm, usage) | _signature(algorithm, usage)) & F.lower(column(effort)).isin("high", "critical")


def recommendation(algorithm: Column | str, usage: Column | str, effort: Column | str) -> Column:
    """Migration advice for the algorithm name as written, by usage and effort."""
    hybrid = F.when(hybrid_recommended(algorithm, usage, effort), F.lit(C.RECOMMEND_HYBRID)).otherwise("")
    algorithm, usage = column(algorithm), F.lower(column(usage))
    return (
        F.when(_exchange(algorithm, usage), F.concat(F.lit(C.RECOMMEND_KEM), hybrid))
        .when(_signature(algorithm, usage), F.concat(F.lit(C.RECOMMEND_SIGNATURE), hybrid))
        .when(algorithm == "AES", C.RECOMMEND_AES)
        .when(algorithm.isin("MD5", "SHA-1"), C.RECOMMEND_WEAK_HASH)
        .when(algorithm.startswith("SHA") | algorithm.isin("BLAKE2", "hash"), C.RECOMMEND_HASH)
        .when(algorithm.isin("ML-KEM", "ML-DSA", "SLH-DSA"), C.RECOMMEND_PQC)
        .otherwise(C.RECOMMEND_OTHER)
    )


def risk_reasons(algorithm: Column, vulnerable: Column, confirmed: Column, capability: Column, overlap: Column,
                 window: Column, horizon: Column, sensitivity: Column, criticality: Column,
                 exposure: Column, effort: Column) -> Column:
    note = (
        F.when(confirmed, "confirmed use of").when(capability, "capability-only exposure to").otherwise("evidence of")
    )
    named = F.coalesce(F.nullif(algorithm, F.lit("")), F.lit("Algorithm"))
    exposure_line = F.when(
        vulnerable, F.concat(algorithm, F.lit(" ("), note, F.lit(") is vulnerable to large-scale quantum attacks"))
    ).otherwise(F.concat(named, F.lit(" has no modeled Shor-algorithm exposure")))
    verb = F.when(overlap, F.lit("y overlaps ")).otherwise(F.lit("y does not overlap "))
    return F.array(
        exposure_line,
        F.concat(F.lit("Mosca window "), window.cast("string"), verb, horizon.cast("string"), F.lit("y threat horizon")),
        F.concat(F.lit("Data sensitivity is "), sensitivity),
        F.concat(F.lit("Business criticality is "), criticality),
        F.concat(F.lit("Exposure is "), exposure),
        F.concat(F.lit("Migration effort is "), effort),
    )


def provenance(presence: Mapping[str, Column]) -> Column:
    """``user-provided`` where the field was supplied, else ``policy-default``, per context field."""
    cells: list[Column] = []
    for name, present in presence.items():
        cells += [F.lit(name), F.when(present, "user-provided").otherwise("policy-default")]
    return F.create_map(*cells)


