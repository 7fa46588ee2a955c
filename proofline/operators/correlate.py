"""Evidence to findings by exact operation identity.

One evidence row has: location, algorithm, category, source, evidence_kind, usage_raw, line_start,
column_start, key_size, library, protocol, operation_id, operation_name, context_name, confidence,
parser_version, details (map). ``complete`` adds the absent ones as nulls.

Findings hold only bounded columns. Evidence rows and conflicting values stay in their own tables,
keyed by ``finding_id``, so no group is ever collected into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.catalogs import CATEGORIES, CATEGORY_BY_USAGE, COLLECTORS
from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.functions.lookup import filled, lookup
from proofline.operators.joins import lookup_join
from proofline.session import written

EVIDENCE_FIELDS = {
    "location": "string", "algorithm": "string", "category": "string", "source": "string",
    "evidence_kind": "string", "usage_raw": "string", "line_start": "int", "column_start": "int",
    "key_size": "int", "library": "string", "protocol": "string", "operation_id": "string",
    "operation_name": "string", "context_name": "string", "confidence": "double",
    "parser_version": "string", "details": "map<string,string>",
}
FINDING_KEY = ["component", "algorithm", "usage", "evidence_kind", "location", "operation_anchor"]
CONTEXT_FIELDS = ["library", "protocol", "key_size"]


def complete(evidence: DataFrame) -> DataFrame:
    present = set(evidence.columns)
    chosen = [
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in EVIDENCE_FIELDS.items()
    ]
    return evidence.select(*chosen)


def _details_text() -> Column:
    entries = F.array_sort(F.map_entries("details"))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "\u0002")


def with_keys(evidence: DataFrame) -> DataFrame:
    """Component, usage, context and operation anchor of each record."""
    records = complete(evidence).withColumn("location", paths.normalise("location"))
    detail_columns = ["usage_raw", "library", "protocol", "key_size", "evidence_kind", "operation_name", "context_name"]
    return records.select(
        paths.component("location").alias("component"),
        F.coalesce("algorithm", F.lit("unknown")).alias("algorithm"),
        E.usage("usage_raw").alias("usage"),
        F.coalesce(filled("evidence_kind"), F.lit("unknown")).alias("evidence_kind"),
        "location",
        E.operation_anchor("operation_id", "line_start", "column_start", *detail_columns, _details_text()).alias("operation_anchor"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("library", F.lit("")).alias("library"),
        F.coalesce("protocol", F.lit("")).alias("protocol"),
        "key_size", "line_start", "column_start", "operation_name", "context_name", "usage_raw",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("parser_version", F.lit("")).alias("parser_version"),
        "details",
    )


def finding_id() -> Column:
    return E.identity_hash(F.lit("operation"), *FINDING_KEY)


def source_columns(collectors: Sequence[str]) -> list[Column]:
    """Best confidence per collector; an unregistered collector stops the job."""
    known = F.when(F.col("source").isin(*collectors), F.col("confidence")).otherwise(
        F.raise_error(F.concat(F.lit("unregistered collector: "), F.col("source"))).cast("double")
    )
    return [F.max(F.when(F.col("source") == c, known)).alias(f"_by_{c}") for c in collectors[:-1]] + [
        F.max(F.when(~F.col("source").isin(*collectors[:-1]), known)).alias(f"_by_{collectors[-1]}")
    ]


def source_summary(collectors: Sequence[str]) -> dict[str, Column]:
    names = sorted(collectors)
    pairs = F.filter(
        F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"_by_{c}").alias("confidence")) for c in names]),
        lambda p: p["confidence"].isNotNull(),
    )
    held = [F.when(F.col(f"_by_{c}").isNotNull(), F.lit(c)) for c in names]
    present = [F.when(h.isNotNull(), 1).otherwise(0) for h in held]
    return {
        "sources": F.split(F.concat_ws(",", *held), ","),
        "source_count": sum(present[1:], present[0]),
        "confidence_by_source": F.map_from_entries(pairs),
    }


def context_aggregates() -> list[Column]:
    """Lowest and highest value per context field: equal ends mean one distinct value."""
    cells = []
    for name in CONTEXT_FIELDS:
        value = F.col(name) if name == "key_size" else filled(name)
        cells += [F.min(value).alias(f"_low_{name}"), F.max(value).alias(f"_high_{name}")]
    return cells


def context_summary() -> dict[str, Column]:
    def clash(name: str) -> Column:
        several = F.col(f"_low_{name}") != F.col(f"_high_{name}")
        if name == "key_size":
            several = several | (F.col("_low_key_size") <= 0)
        return F.coalesce(several, F.lit(False))

    def value(name: str, default: Column) -> Column:
        return F.when(clash(name), default).otherwise(F.coalesce(F.col(f"_low_{name}"), default))

    return {
        "library": value("library", F.lit("")),
        "protocol": value("protocol", F.lit("")),
        "key_size": value("key_size", F.lit(None).cast("int")),
        "context_conflict": clash("library") | clash("protocol") | clash("key_size"),
        "conflict_fields": F.array_compact(F.array(*[F.when(clash(n), F.lit(n)) for n in CONTEXT_FIELDS])),
    }


def preferred_category() -> list[Column]:
    primary = F.col("source").isin("ast", "cert", "rule")
    return [F.min(F.when(primary, F.col("category"))).alias("_primary"), F.min("category").alias("_any")]


def final_category() -> Column:
    return lookup(CATEGORY_BY_USAGE, "usage", F.coalesce("_primary", "_any"))


def direct_categories(categories: Sequence[str]) -> Column:
    """Categories of direct evidence as one bit each, a number the aggregation can hold; others stop the job."""
    bit = F.raise_error(F.concat(F.lit("unregistered category: "), F.col("category"))).cast("long")
    for index, name in enumerate(categories):
        bit = F.when(F.col("category") == name, F.lit(1 << index).cast("long")).otherwise(bit)
    return F.bit_or(F.when(F.col("source") != "dep", bit))


def group_findings(keyed: DataFrame, collectors: Sequence[str] = COLLECTORS, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per finding key, before suppression and operation conflicts.

    The hash in front of the key changes no group; it lets the aggregation sort compare one number
    instead of six texts.
    """
    grouped = keyed.groupBy(F.xxhash64(*FINDING_KEY).alias("_hash"), *FINDING_KEY).agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(F.col("source") != "dep").alias("has_direct"),
        direct_categories(categories).alias("_direct"),
        *source_columns(collectors), *context_aggregates(), *preferred_category(),
    )
    return grouped.select(
        finding_id().alias("finding_id"), *FINDING_KEY, final_category().alias("category"),
        *[v.alias(k) for k, v in {**source_summary(collectors), **context_summary()}.items()],
        "evidence_count", "has_direct",
        F.array_compact(F.array(*[
            F.when(F.col("_direct").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(categories)
        ])).alias("direct_categories"),
    )


def suppressed_pairs(grouped: DataFrame) -> DataFrame:
    """(component, algorithm) seen only in dependencies, in components that have direct evidence.

    The window sees one row per algorithm of a component, never findings.
    """
    pairs = grouped.groupBy("component", "algorithm").agg(F.max("has_direct").alias("direct"))
    covered = F.max("direct").over(Window.partitionBy("component"))
    return pairs.withColumn("_covered", covered).where("_covered and not direct").select("component", "algorithm")


def suppress_dependencies(grouped: DataFrame) -> DataFrame:
    """Findings without the suppressed pairs; a few pairs per component are looked up, not shuffled to."""
    return lookup_join(grouped, suppressed_pairs(grouped), ["component", "algorithm"], "left_anti", "finding_id")


def operation_conflicts(grouped: DataFrame) -> DataFrame:
    """Operations where direct evidence names several algorithms in one category."""
    return (
        grouped.select("location", "operation_anchor", "algorithm", F.explode("direct_categories").alias("category"))
        .groupBy("location", "operation_anchor", "category")
        .agg(F.min("algorithm").alias("low"), F.max("algorithm").alias("high"))
        .where("low <> high")
        .select("location", "operation_anchor")
        .distinct()
    )


def findings(evidence: DataFrame, collectors: Sequence[str] = COLLECTORS, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Findings with suppression, operation conflicts and context conflicts.

    The groups are written once to the checkpoint folder: suppression and conflicts both look across
    groups, and evidence may be the end of a whole scan that must not run again for each of them.
    """
    grouped = written(group_findings(with_keys(evidence), collectors, categories), "groups")
    kept = suppress_dependencies(grouped)
    clashes = operation_conflicts(grouped).withColumn("_clash", F.lit(True))
    operation = F.regexp_extract("operation_anchor", r"^id:(.*)$", 1)
    named = F.coalesce(filled(operation), F.col("operation_anchor"))
    return (
        kept.join(clashes, ["location", "operation_anchor"], "left")
        .withColumn("operation_conflict", F.coalesce("_clash", F.lit(False)))
        .withColumn("conflicting_operation", F.when(F.col("operation_conflict"), named))
        .withColumn("conflict", F.col("operation_conflict") | F.col("context_conflict"))
        .drop("_clash", "has_direct", "context_conflict", "direct_categories")
    )


def evidence_records(keyed: DataFrame) -> DataFrame:
    """Distinct evidence per finding with its multiplicity; two equal records count once."""
    columns = [c for c in keyed.columns if c != "details"]
    flat = keyed.withColumn("details", _details_text())
    return flat.groupBy(finding_id().alias("finding_id"), *columns, "details").agg(F.count(F.lit(1)).alias("copies"))


def context_values(keyed: DataFrame) -> DataFrame:
    """Distinct context values per finding in long form: finding_id, field, value."""
    long = F.array(*[
        F.struct(F.lit(n).alias("field"), (F.col(n).cast("string") if n == "key_size" else filled(n)).alias("value"))
        for n in CONTEXT_FIELDS
    ])
    return (
        keyed.select(finding_id().alias("finding_id"), F.explode(long).alias("entry"))
        .where("entry.value is not null")
        .select("finding_id", "entry.field", "entry.value")
        .distinct()
    )


def context_conflicts(evidence: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Every value behind a context conflict, one row each."""
    found = findings(evidence) if found is None else found
    clashing = found.select("finding_id", F.explode("conflict_fields").alias("field"))
    return context_values(with_keys(evidence)).join(clashing, ["finding_id", "field"], "left_semi")
