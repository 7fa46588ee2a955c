"""Corpus evaluation, quality gates, corpus checks and the holdout split.

A case row has: case_id, language, type (positive/negative), family. Labels and detections come as
rows (case_id, algorithm), so a case with many detections is never collected into one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions.lookup import lookup
from proofline.operators.ordering import rank_in_group


def case_results(cases: DataFrame, expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Per case: distinct algorithms matched, extra and missing, with precision, recall and F1."""
    both = expected.select("case_id", "algorithm", F.lit(True).alias("e"), F.lit(False).alias("a")).unionAll(
        detected.select("case_id", "algorithm", F.lit(False).alias("e"), F.lit(True).alias("a"))
    )
    flags = both.groupBy("case_id", "algorithm").agg(F.max("e").alias("e"), F.max("a").alias("a"))
    counts = flags.groupBy("case_id").agg(
        F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(F.col("a") & ~F.col("e")).alias("fp"),
        F.count_if(F.col("e") & ~F.col("a")).alias("fn"), F.count_if("a").alias("found"),
    )
    joined = cases.join(counts, "case_id", "left").fillna(0, ["tp", "fp", "fn", "found"])
    negative = F.col("type") == "negative"
    # A negative case expects nothing: every detection is a false positive.
    clean = joined.withColumns({
        "fp": F.when(negative, F.col("found")).otherwise(F.col("fp")),
        "tp": F.when(negative, 0).otherwise(F.col("tp")), "fn": F.when(negative, 0).otherwise(F.col("fn")),
    })
    no_labels = (F.col("tp") + F.col("fn")) == 0
    empty = F.when(no_labels, 1.0).otherwise(0.0)
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), empty)
    recall = F.when(negative, F.lit(1.0)).otherwise(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), empty))
    f1 = F.when(negative, precision).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return clean.withColumns({
        "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4),
    })


def _aggregates() -> list[Column]:
    positive, negative = F.col("type") == "positive", F.col("type") == "negative"

    def mean(name: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(positive, F.col(name))), F.lit(0.0)), 4).alias(f"macro_{name}")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(positive, F.col(name))), F.lit(0))

    tp, fp, fn = total("tp"), total("fp"), total("fn")
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    good = F.count_if(negative & (F.col("found") == 0))
    return [
        mean("precision"), mean("recall"), mean("f1"),
        F.round(precision, 4).alias("micro_precision"), F.round(recall, 4).alias("micro_recall"),
        F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 4).alias("micro_f1"),
        tp.alias("total_true_positives"), fp.alias("total_false_positives"), fn.alias("total_false_negatives"),
        F.round(F.coalesce(F.try_divide(good, F.count_if(negative)), F.lit(0.0)), 4).alias("negative_accuracy"),
        good.alias("negative_correct"), F.count_if(negative).alias("negative_total"),
        F.count(F.lit(1)).alias("case_count"), F.count_if(positive).alias("positive_cases"),
    ]


def aggregate_cases(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(*_aggregates())


def aggregate_with_total(results: DataFrame, name: str = "language", total: str = "all") -> DataFrame:
    """Slices by one column plus the overall row, in one aggregation."""
    both = results.groupingSets([[F.col(name)], []], F.col(name)).agg(*_aggregates(), F.grouping(name).alias("_all"))
    return both.withColumn(name, F.when(F.col("_all") == 1, total).otherwise(F.col(name))).drop("_all")


def check_gates(overall: DataFrame, minimums: Mapping[str, float] = C.GATE_MINIMUMS,
                previous: Mapping[str, float] | None = None,
                maximum_drop: Mapping[str, float] = C.GATE_MAXIMUM_DROP) -> DataFrame:
    """One row per gate with its value, bound and result. A missing metric fails its gate.

    ``previous`` is the stored baseline of the last accepted run; without it no drop is checked.
    """
    gates = []
    for name, minimum in minimums.items():
        value = F.col(name).cast("double") if name in overall.columns else F.lit(None).cast("double")
        gates.append(F.struct(
            F.concat(F.lit(name), F.lit("_minimum")).alias("gate"), value.alias("value"),
            F.lit(float(minimum)).alias("bound"), F.coalesce(value >= minimum, F.lit(False)).alias("passed"),
        ))
    for name, drop in (maximum_drop.items() if previous else ()):
        if name not in previous:
            continue
        value = F.col(name).cast("double") if name in overall.columns else F.lit(None).cast("double")
        lost = F.round(F.lit(float(previous[name])) - value, 6)
        passed = F.coalesce((lost <= drop) | (F.col("total_true_positives") == 0), F.lit(False))
        gates.append(F.struct(
            F.concat(F.lit(name), F.lit("_drop")).alias("gate"), lost.alias("value"),
            F.lit(float(drop)).alias("bound"), passed.alias("passed"),
        ))
    return overall.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def detector_floors(entries: DataFrame, recall_floor: float = C.DETECTOR_RECALL_FLOOR,
                    precision_floor: float = C.DETECTOR_PRECISION_FLOOR) -> DataFrame:
    """Recall per family over positive entries and overall precision over negative ones, with floors.

    ``entries`` has algorithm_family, positive and detected (whether the family was reported).
    """
    recall = entries.where("positive").groupBy(F.col("algorithm_family").alias("slice")).agg(
        F.count(F.lit(1)).alias("tested"), F.count_if("detected").alias("good"), F.lit(recall_floor).alias("floor")
    )
    precision = entries.where("not positive").groupBy(F.lit("negatives").alias("slice")).agg(
        F.count(F.lit(1)).alias("tested"), F.count_if(~F.col("detected")).alias("good"), F.lit(precision_floor).alias("floor")
    )
    rows = recall.unionByName(precision).withColumn("value", F.try_divide("good", "tested"))
    return rows.withColumn("passed", F.col("value") >= F.col("floor")).withColumn("value", F.round("value", 4))


# --- corpus checks ----------------------------------------------------------------------------------


def entry_errors(corpus: DataFrame) -> DataFrame:
    """Adds ``errors``: the names of failed checks per corpus row. Absent columns count as missing fields."""
    have = set(corpus.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    missing = [F.when(col(f).isNull(), F.lit(f"missing:{f}")) for f in C.CORPUS_FIELDS]
    checks = [
        F.when(col("line_start") >= col("line_end"), F.lit("line_range")),
        F.when(~F.coalesce(col("file_sha256").cast("string").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("file_sha256")),
        F.when(~F.coalesce(col("commit_sha").cast("string").rlike("^[0-9a-f]{40,64}$"), F.lit(False)), F.lit("commit_sha")),
        F.when((F.coalesce(col("operation").cast("string"), F.lit("")) != "") & ~col("operation").cast("string").isin(*C.CORPUS_OPERATIONS), F.lit("operation")),
        F.when(~F.coalesce(col("algorithm_family").cast("string").isin(*C.CORPUS_FAMILIES), F.lit(False)), F.lit("algorithm_family")),
    ]
    return corpus.withColumn("errors", F.array_compact(F.array(*missing, *checks)))


def family_breakdown(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("algorithm_family").agg(
        F.count_if("positive").alias("positive_count"), F.count_if(~F.col("positive")).alias("negative_count"),
        F.concat_ws(",", F.array_sort(F.collect_set("operation"))).alias("operations"),
    )


def duplicate_ids(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("corpus_id").count().where("count > 1")


def corpus_gates(corpus: DataFrame, full: bool = True) -> DataFrame:
    """One row per corpus gate: value, bound, passed. Size gates apply to the full corpus only."""
    families = corpus.groupBy("algorithm_family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    known = F.col("algorithm_family").isin(*C.CORPUS_FAMILIES)
    sizes = families.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positive_count"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_count"),
        F.coalesce(F.min("n"), F.lit(0)).alias("smallest_family"), F.count_if(known).alias("families_covered"),
    )
    languages = corpus.where("language <> ''").groupBy("language").count().agg(F.count(F.lit(1)).alias("language_count"))
    repeats = duplicate_ids(corpus).agg(F.count(F.lit(1)).alias("duplicate_ids"))
    names = ["positive_count", "negative_count", "smallest_family", "families_covered", "language_count", "duplicate_ids"]
    row = sizes.unionByName(languages, allowMissingColumns=True).unionByName(repeats, allowMissingColumns=True).agg(
        *[F.max(n).alias(n) for n in names]
    )
    bounds = {"families_covered": len(C.CORPUS_FAMILIES), "duplicate_ids": 0}
    if full:
        bounds = {"positive_count": C.CORPUS_MINIMUM_SIDE, "negative_count": C.CORPUS_MINIMUM_SIDE,
                  "language_count": C.CORPUS_MINIMUM_LANGUAGES, "smallest_family": C.CORPUS_MINIMUM_FAMILY, **bounds}
    cells = [
        F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(b).cast("long").alias("bound"),
                 ((F.col(n) <= b) if n == "duplicate_ids" else (F.col(n) >= b)).alias("passed"))
        for n, b in bounds.items()
    ]
    return row.select(F.explode(F.array(*cells)).alias("g")).select("g.*")


def stratified_split(frame: DataFrame, stratum: str = "algorithm_family", key: str = "corpus_id",
                     train: float = C.TRAIN_FRACTION, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Adds ``split``: a fixed share of every stratum goes to train, both sides non-empty when it has two rows.

    Rows are ordered by a hash of the seed and their key. Positions come from one range sort over all
    strata, so a stratum with a third of all rows is still sorted by many tasks.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = rank_in_group(frame.withColumn("_draw", draw), [stratum], [F.col("_draw"), F.col(key)], "_nth", "_size")
    cut = F.floor(F.col("_size") * F.lit(float(train)))
    cut = F.when(F.col("_size") >= 2, F.least(F.greatest(cut, F.lit(1)), F.col("_size") - 1)).otherwise(cut)
    return ranked.withColumn("split", F.when(F.col("_nth") <= cut, "train").otherwise("holdout")).drop("_draw", "_nth", "_size")


def with_family(frame: DataFrame, families: Mapping[str, str] = C.FAMILIES) -> DataFrame:
    return frame.withColumn("family", lookup(families, "algorithm", "unknown"))


