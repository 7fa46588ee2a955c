"""Evidence to findings by normalised span, with cross-kind links and ambiguity counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.catalogs import AMBIGUITY_PENALTY, COLLECTORS, NEARBY_LINES
from proofline.functions import evidence as E
from proofline.functions import paths
from proofline.operators.correlate import (
    context_aggregates, context_summary, final_category, preferred_category, source_columns, source_summary, with_keys,
)
from proofline.session import written

SPAN_KEY = ["location", "algorithm", "line_start", "column_start", "semantic_anchor"]
GROUP_KEY = [*SPAN_KEY, "evidence_kind"]


def with_spans(evidence: DataFrame) -> DataFrame:
    anchor = E.semantic_anchor("operation_name", "context_name")
    return with_keys(evidence).withColumn("semantic_anchor", F.coalesce(anchor, F.lit("")))


def group_spans(spans: DataFrame, collectors: Sequence[str] = COLLECTORS) -> DataFrame:
    """One row per (file, algorithm, position, semantic anchor, kind)."""
    grouped = spans.groupBy(F.xxhash64(*GROUP_KEY).alias("_hash"), *GROUP_KEY).agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.min(F.struct("category", "confidence", "usage"))["usage"].alias("usage"),
        *source_columns(collectors), *context_aggregates(), *preferred_category(),
    )
    return grouped.select(
        *GROUP_KEY, "usage", final_category().alias("category"),
        *[v.alias(k) for k, v in {**source_summary(collectors), **context_summary()}.items()],
        "evidence_count",
    )


def cross_kind_links(grouped: DataFrame) -> DataFrame:
    """Other evidence kinds at the same span; a span has at most one row per kind, so the window is tiny."""
    kinds = F.collect_set("evidence_kind").over(Window.partitionBy(*SPAN_KEY))
    return grouped.withColumn("cross_kind_links", F.array_sort(F.array_remove(kinds, F.col("evidence_kind"))))


def _line_counts(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("location", "algorithm", "evidence_kind", "line_start").agg(
        F.sum("evidence_count").alias("records")
    )


def ambiguity_counts(grouped: DataFrame, nearby: int = NEARBY_LINES) -> DataFrame:
    """Ambiguous matches per (file, algorithm, kind, line): records of other kinds that are not nearby.

    Counted from a line histogram instead of pairing records: all records of other kinds in the file,
    less those within ``nearby`` lines. Each histogram line is spread to its neighbours and summed, so
    the work is linear in distinct lines whatever the number of records in a file.
    """
    lines = written(_line_counts(grouped), "lines")
    totals = lines.groupBy("location", "algorithm", "evidence_kind").agg(F.sum("records").alias("of_kind"))
    # A handful of kinds per (file, algorithm).
    in_file = Window.partitionBy("location", "algorithm")
    others = totals.select(
        "location", "algorithm", "evidence_kind",
        (F.sum("of_kind").over(in_file) - F.col("of_kind")).alias("other_kinds"),
    ).where("other_kinds > 0")
    targets = lines.join(others, ["location", "algorithm", "evidence_kind"])
    near_same = (
        lines.where("line_start is not null")
        .select("location", "algorithm", "evidence_kind", "records",
                F.explode(F.sequence(F.col("line_start") - nearby, F.col("line_start") + nearby)).alias("line_start"))
        .groupBy("location", "algorithm", "evidence_kind", "line_start")
        .agg(F.sum("records").alias("near_same"))
    )
    # The sums of all kinds come from those of each kind, so lines are spread once.
    near = near_same.groupBy("location", "algorithm", "line_start").agg(F.sum("near_same").alias("near_all"))
    return (
        targets.join(near, ["location", "algorithm", "line_start"], "left")
        .join(near_same, ["location", "algorithm", "evidence_kind", "line_start"], "left")
        .select(
            "location", "algorithm", "evidence_kind", "line_start",
            (F.col("other_kinds") - F.coalesce("near_all", F.lit(0)) + F.coalesce("near_same", F.lit(0))).alias("candidates"),
        )
        .where("candidates > 0")
    )


def with_ambiguity(grouped: DataFrame, nearby: int = NEARBY_LINES) -> DataFrame:
    """Adds ``ambiguous_matches``: candidates per record times the records in the group.

    The groups are written once, since they are counted and then joined with the counts.
    """
    grouped = written(grouped, "spans")
    counts = ambiguity_counts(grouped, nearby).select(
        F.col("location").alias("_location"), F.col("algorithm").alias("_algorithm"),
        F.col("evidence_kind").alias("_kind"), F.col("line_start").alias("_line"), "candidates",
    )
    same = (
        (F.col("location") == F.col("_location")) & (F.col("algorithm") == F.col("_algorithm"))
        & (F.col("evidence_kind") == F.col("_kind")) & F.col("line_start").eqNullSafe(F.col("_line"))
    )
    return (
        grouped.join(counts, same, "left")
        .withColumn("ambiguous_matches", F.coalesce("candidates", F.lit(0)) * F.col("evidence_count"))
        .drop("_location", "_algorithm", "_kind", "_line", "candidates")
    )


def ambiguous_candidates(found: DataFrame, spans: DataFrame, finding_ids: DataFrame | Sequence[str], nearby: int = NEARBY_LINES) -> DataFrame:
    """The candidate records behind the ambiguity count of the chosen findings (a table with ``finding_id``, or a list)."""
    if isinstance(finding_ids, DataFrame):
        picked = found.join(finding_ids.select("finding_id").distinct(), "finding_id", "left_semi")
    else:
        picked = found.where(F.col("finding_id").isin(*finding_ids))
    chosen = picked.select(
        "finding_id", F.col("location"), F.col("algorithm"),
        F.col("evidence_kind").alias("target_kind"), F.col("line_start").alias("target_line"),
    )
    far = F.coalesce(F.abs(F.col("line_start") - F.col("target_line")) > nearby, F.lit(True))
    return (
        spans.join(chosen, ["location", "algorithm"])
        .where((F.col("evidence_kind") != F.col("target_kind")) & far)
        .select(
            "finding_id", F.col("algorithm").alias("candidate_algorithm"),
            F.col("evidence_kind").alias("candidate_evidence_kind"), "location", "line_start",
            "column_start", "semantic_anchor", F.lit(0.3).alias("confidence"), F.lit(False).alias("merge_flag"),
        )
    )


def span_confidence(by_source: Column, ambiguous: Column) -> Column:
    values = F.map_values(by_source)
    mean = F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.greatest(F.size(values), F.lit(1))
    return F.round(F.greatest(F.lit(0.0), mean - F.lit(AMBIGUITY_PENALTY) * ambiguous), 2)


def findings(evidence: DataFrame, collectors: Sequence[str] = COLLECTORS) -> DataFrame:
    """Span findings with links, ambiguity, confidence and position notes."""
    grouped = with_ambiguity(cross_kind_links(group_spans(with_spans(evidence), collectors)))
    note = E.moved_line_note("line_start", "algorithm", "column_start", "semantic_anchor")
    return grouped.select(
        E.identity_hash(F.lit("span"), *GROUP_KEY, note).alias("finding_id"),
        paths.component("location").alias("component"), *GROUP_KEY, "usage", "category",
        "sources", "source_count", "confidence_by_source",
        span_confidence(F.col("confidence_by_source"), F.col("ambiguous_matches")).alias("confidence"),
        "library", "protocol", "key_size", "conflict_fields",
        F.col("context_conflict").alias("conflict"),
        E.span_operation_anchor("line_start", "column_start", "semantic_anchor").alias("operation_anchor"),
        E.span_anchor("location", "line_start", "column_start").alias("span_anchor"),
        F.nullif(note, F.lit("")).alias("moved_line_note"),
        "cross_kind_links", "ambiguous_matches", "evidence_count",
    )
