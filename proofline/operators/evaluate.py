"""Evaluation of findings against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E

from proofline.operators.assign import NO_KEY, class_counts, class_pairs
from proofline.operators.ordering import rank_in_group

PAIR = ["component", "algorithm"]


def ratio(part: Column, whole: Column, empty: float | None) -> Column:
    value = F.try_divide(part, whole)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def precision_recall(found: DataFrame, tp: str, fp: str, fn: str, no_actual: float | None, no_expected: float | None,
                     digits: int | None = 4) -> DataFrame:
    """Adds precision, recall and F1 with the given values for empty denominators."""
    precision = ratio(F.col(tp), F.col(tp) + F.col(fp), no_actual)
    recall = ratio(F.col(tp), F.col(tp) + F.col(fn), no_expected)
    f1 = F.try_divide(2 * precision * recall, precision + recall)
    if no_actual is not None:
        f1 = F.coalesce(f1, F.lit(0.0))
    cells = {"precision": precision, "recall": recall, "f1": f1}
    return found.withColumns({k: v if digits is None else F.round(v, digits) for k, v in cells.items()})


# --- sets of (component, algorithm) ----------------------------------------------------------


def pair_status(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct (component, algorithm) with flags for each side: one shuffle instead of a full join."""
    both = truth.select(*PAIR, F.lit(True).alias("e"), F.lit(False).alias("a")).unionAll(
        actual.select(*PAIR, F.lit(False).alias("e"), F.lit(True).alias("a"))
    )
    return both.groupBy(*PAIR).agg(F.max("e").alias("is_expected"), F.max("a").alias("is_found"))


def set_metrics(status: DataFrame) -> DataFrame:
    counted = status.agg(
        F.count_if("is_expected").alias("expected"), F.count_if("is_found").alias("found"),
        F.count_if(F.col("is_expected") & F.col("is_found")).alias("true_positives"),
        F.count_if(~F.col("is_expected")).alias("false_positives"),
        F.count_if(~F.col("is_found")).alias("false_negatives"),
    )
    return precision_recall(counted, "true_positives", "false_positives", "false_negatives", 0.0, 1.0)


def missed_pairs(status: DataFrame) -> DataFrame:
    return status.where("is_expected and not is_found").select(*PAIR).orderBy(*PAIR)


def unexpected_pairs(status: DataFrame) -> DataFrame:
    return status.where("is_found and not is_expected").select(*PAIR).orderBy(*PAIR)


def source_set_metrics(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct pairs per source that are expected; ``actual`` has one row per (pair, source)."""
    labels = truth.select(*PAIR).distinct()
    seen = actual.select(*PAIR, "source").distinct()
    marked = seen.join(labels.withColumn("_expected", F.lit(True)), PAIR, "left")
    per = marked.groupBy("source").agg(F.count(F.lit(1)).alias("findings"), F.count("_expected").alias("true_positives"))
    total = labels.agg(F.count(F.lit(1)).alias("_labels"))
    # One row per source and one for the labels, so the unpartitioned window is bounded.
    both = per.unionByName(total, allowMissingColumns=True).withColumn("_total", F.max("_labels").over(Window.partitionBy()))
    return both.where("_labels is null").select(
        "source", "findings", "true_positives",
        F.round(ratio(F.col("true_positives"), F.col("findings"), 0.0), 4).alias("precision"),
        F.round(ratio(F.col("true_positives"), F.col("_total"), 1.0), 4).alias("recall"),
    )


# --- labels and findings as operations --------------------------------------------------------


def alias_table(alias_pairs: DataFrame, column: str = "algorithms") -> DataFrame:
    """Alias to canonical name: the first name of each list with two or more; later lists win.

    ``alias_pairs`` says with ``path`` and ``position`` which list is later; without them the larger list in sort order wins.
    """
    places = [c for c in ("path", "position") if c in alias_pairs.columns]
    lists = alias_pairs.where(F.size(column) >= 2).withColumn("_n", F.struct(*places, column))
    return (
        lists.select("_n", F.element_at(column, 1).alias("canonical"), F.explode(column).alias("alias"))
        .groupBy("alias").agg(F.max_by("canonical", "_n").alias("canonical"))
    )


def resolve_aliases(frame: DataFrame, aliases: DataFrame, column: str = "algorithm") -> DataFrame:
    renamed = aliases.select(F.col("alias").alias(column), "canonical")
    return frame.join(renamed, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def extracted_usage(direct: Column, nested: Column, items: Column) -> Column:
    """Usage from the finding, else its evidence, else the first evidence item that has one."""
    first = F.try_element_at(F.filter(F.transform(items, lambda i: i["usage"]), lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(1))
    found = F.coalesce(F.nullif(direct, F.lit("")), F.nullif(nested, F.lit("")), first)
    return E.usage_alias(F.coalesce(F.trim(F.lower(found)), F.lit("unknown")))


def extracted_number(direct: Column, nested: Column, items: Column, field: str) -> Column:
    """First value that reads as a whole number: the finding, its evidence, then the evidence items."""
    def whole(value: Column) -> Column:
        return F.expr("null").cast("int") if value is None else value.cast("string").try_cast("int")

    listed = F.try_element_at(F.filter(F.transform(items, lambda i: whole(i[field])), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(whole(direct), whole(nested), listed)


# --- one-to-one operation evaluation ------------------------------------------------------------


def operation_counts(expected: DataFrame, actual: DataFrame, pool: Sequence[str] = ("component",)) -> DataFrame:
    """Matched, missed and unexpected operations per pool: the smaller side of a pool always pairs."""
    both = expected.select(*pool, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(
        actual.select(*pool, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    per = both.groupBy(*pool).agg(F.sum("e").alias("expected"), F.sum("a").alias("found"))
    return per.withColumn("true_positives", F.least("expected", "found")).withColumns({
        "false_positives": F.col("found") - F.col("true_positives"),
        "false_negatives": F.col("expected") - F.col("true_positives"),
    })


def operation_metrics(per_pool: DataFrame) -> DataFrame:
    names = ["expected", "found", "true_positives", "false_positives", "false_negatives"]
    totals = per_pool.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return precision_recall(totals, "true_positives", "false_positives", "false_negatives", None, None)


def usage_correct(expected: DataFrame, actual: DataFrame, pool: Sequence[str] = ("component",)) -> DataFrame:
    """Best possible usage agreement: the smaller side of each (pool, usage)."""
    return operation_counts(expected, actual, [*pool, "usage"]).agg(
        F.coalesce(F.sum("true_positives"), F.lit(0)).alias("usage_correct")
    )


def unmatched(operations: DataFrame, pairs: DataFrame, pool: Sequence[str], side: str, order: Sequence[Column]) -> DataFrame:
    """Operations of one side beyond the number its class was paired, in a fixed order.

    Members of a class are interchangeable for the scores, so the first ones in ``order`` count as
    paired. Ranks come from a range sort, so a hot class is spread over many tasks.
    """
    usage, key = ("usage", "key_size") if side == "expected" else ("actual_usage", "actual_key_size")
    used = pairs.groupBy(*pool, F.col(usage).alias("usage"), F.col(key).alias("_key")).agg(F.sum("pairs").alias("_used"))
    ranked = rank_in_group(
        operations.withColumn("_key", F.coalesce(F.col("key_size"), F.lit(NO_KEY)).cast("long")),
        [*pool, "usage", "_key"], order, "_nth",
    )
    return ranked.join(used, [*pool, "usage", "_key"], "left").where(
        F.col("_nth") > F.coalesce("_used", F.lit(0))
    ).drop("_key", "_nth", "_used")


def pool_pairs(expected: DataFrame, actual: DataFrame, pool: Sequence[str], weights: tuple[int, int] | None = (101, 1)) -> tuple[DataFrame, DataFrame]:
    counts = class_counts(expected, actual, pool)
    return class_pairs(counts, pool, weights), counts


def identity_comparison(expected: DataFrame, actual: DataFrame, identity: Sequence[str] = ("file", "line", "algorithm"),
                        by: Sequence[str] = ()) -> DataFrame:
    """Pooled comparison per identity (nulls are one identity), overall or per ``by`` columns."""
    per = operation_counts(expected, actual, [*by, *identity])
    names = ["expected", "found", "true_positives", "false_positives", "false_negatives"]
    totals = per.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return precision_recall(totals, "true_positives", "false_positives", "false_negatives", None, None, 6)


def identity_comparison_with_total(expected: DataFrame, actual: DataFrame, identity: Sequence[str], name: str) -> DataFrame:
    """The same per source and, in the row named ``mixed``, for all sources together."""
    per = operation_counts(expected, actual, [name, *identity])
    names = ["expected", "found", "true_positives", "false_positives", "false_negatives"]
    totals = per.groupingSets([[F.col(name)], []], F.col(name)).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], F.grouping(name).alias("_all")
    )
    labelled = totals.withColumn(name, F.when(F.col("_all") == 1, "mixed").otherwise(F.col(name))).drop("_all")
    return precision_recall(labelled, "true_positives", "false_positives", "false_negatives", None, None, 6)


def finding_line(records: DataFrame, key: str = "finding_id", line: str = "line_start") -> DataFrame:
    """The one line of a finding's evidence, null where its evidence has several or none."""
    return records.groupBy(key).agg(F.min(line).alias("_low"), F.max(line).alias("_high")).select(
        key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("line")
    )


def in_taxonomy(found: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    return found.where(F.col("algorithm").isin(*algorithms))


def fingerprint(frame: DataFrame) -> DataFrame:
    """Order-free digest of a table: equal tables give equal rows, whatever their row order."""
    text = F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(text)).alias("digest"),
        F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("total"),
    )


def is_deterministic(runs: Sequence[DataFrame]) -> bool:
    """Whether every run holds the same rows; one small row per run reaches the driver."""
    first = tuple(fingerprint(runs[0]).first())
    return all(tuple(fingerprint(run).first()) == first for run in runs[1:])


# --- certificates ---------------------------------------------------------------------------------


GRAM = 3


def _pieces(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of characters of the given sizes."""
    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    return F.array_distinct(F.concat(*[runs(size) for size in sizes]))


def certificate_matches(certificates: DataFrame, expectations: DataFrame) -> DataFrame:
    """Best certificate per expected component: same component, else same file name, else containing it.

    Labels still open after the two equi-joins meet only components that hold the label's rarest run of three characters.
    """
    name = F.lower(F.element_at(F.split("component", "/"), -1))
    best = F.struct("finding_order", "found_key_size", "found_not_after", "found_component")
    found = certificates.select(
        "component", name.alias("name"), "finding_order", F.col("key_size").alias("found_key_size"),
        F.col("not_after").alias("found_not_after"), F.col("component").alias("found_component"),
    )
    wanted = expectations.withColumn("name", name)

    def nearest(key: str) -> DataFrame:
        return found.groupBy(key).agg(F.min(best).alias("best"))

    exact = wanted.join(nearest("component"), "component", "left")
    named = exact.where("best is null").drop("best").join(nearest("name"), "name", "left")
    partial = named.where("best is null").drop("best")
    whole = F.lower("component")
    holders = found.groupBy(whole.alias("whole")).agg(F.min(best).alias("row"))
    pieces = holders.select("whole", "row", F.explode(_pieces(F.col("whole"), (0, 1, 2, GRAM))).alias("piece"))
    common = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = partial.select("name").distinct()
    asked = asked.withColumn("piece", F.explode(F.when(F.length("name") < GRAM, F.array("name")).otherwise(_pieces(F.col("name"), (GRAM,)))))
    rarest = asked.join(common, "piece").groupBy("name").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    held = rarest.join(pieces, "piece").where(F.col("whole").contains(F.col("name"))).groupBy("name").agg(F.min("row").alias("best"))
    partial = partial.join(held, "name", "left")
    columns = [*expectations.columns, "best"]
    return (
        exact.where("best is not null").select(*columns)
        .unionByName(named.where("best is not null").select(*columns))
        .unionByName(partial.select(*columns))
    )


def certificate_issues(matches: DataFrame) -> DataFrame:
    """Adds ``issue``: null when key size and expiry agree."""
    key_text = F.coalesce(F.col("key_size").cast("string"), F.lit("None"))
    found_key = F.coalesce(F.col("best.found_key_size").cast("string"), F.lit("None"))
    wrong_key = F.when(
        ~F.col("best.found_key_size").eqNullSafe(F.col("key_size")),
        F.concat(F.lit("key_size mismatch: expected "), key_text, F.lit(", found "), found_key),
    )
    wrong_date = F.when(
        (F.coalesce("not_after", F.lit("")) != "") & ~F.col("best.found_not_after").eqNullSafe(F.col("not_after")),
        F.concat(F.lit("not_after mismatch: expected "), F.col("not_after"), F.lit(", found "),
                 F.coalesce(F.col("best.found_not_after"), F.lit("N/A"))),
    )
    joined = F.nullif(F.concat_ws("; ", wrong_key, wrong_date), F.lit(""))
    return matches.withColumn("issue", F.when(F.col("best").isNull(), "certificate_not_found").otherwise(joined))


def certificate_accuracy(issues: DataFrame) -> DataFrame:
    return issues.agg(
        F.count(F.lit(1)).alias("total_expected"), F.count_if(F.col("issue").isNull()).alias("matched")
    ).withColumn("certificate_accuracy", F.round(F.try_divide("matched", "total_expected"), 4))


