"""Ranks, pages and neighbours over data of any size and skew.

A window without ``partitionBy`` moves every row to one task, and one partitioned by a hot key moves
that key's rows to one task. The operators here sort by range instead: the full sort key ends in a
unique column, so one hot value still spreads over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators.joins import lookup_join
from proofline.session import written

ROW_MASK = (1 << 33) - 1


def global_rank(frame: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in ``order``, which must be a total order.

    Rows are range-partitioned and sorted, then written once to the shared checkpoint folder so that
    the range boundaries cannot change between the counting pass and the numbering pass.
    """
    placed = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)))
    )
    placed = written(placed, "ranked")
    # One row per range partition, so this window and the broadcast are bounded by the partition count.
    counts = placed.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_row") + 1)
        .drop("_range", "_row", "_start")
    )


def rank_in_group(frame: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank",
                  size: str | None = None) -> DataFrame:
    """1-based position inside each group (and the group size); a hot group is sorted by many tasks."""
    ranked = global_rank(frame, [*[F.col(g) for g in group], *order], "_position")
    # One text per group, in which a null differs from every value.
    named = ranked.withColumn("_group", F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in group]))
    spans = named.groupBy("_group").agg(F.min("_position").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    joined = lookup_join(named, spans, ["_group"], "left", "_position").withColumn(name, F.col("_position") - F.col("_start") + 1)
    if size:
        joined = joined.withColumn(size, F.col("_rows"))
    return joined.drop("_position", "_start", "_rows", "_group")


def page(frame: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50, by_rank: bool = False) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` in ``order``; with ``by_rank`` from ranks, for deep pages, else as a top-k."""
    if not by_rank:
        return frame.orderBy(*order).offset(offset).limit(limit)
    ranked = global_rank(frame, order, "_rank")
    return ranked.where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).orderBy("_rank").drop("_rank")


def previous_by_bucket(frame: DataFrame, key: Sequence[str], order: Sequence[str], value: str, bucket: Column,
                       name: str = "previous") -> DataFrame:
    """Previous ``value`` in ``order`` for each key, null for the first row.

    Rows are compared inside (key, bucket); only the last value of each bucket travels further. A key
    with very many rows is therefore split by bucket. ``bucket`` must be monotonic in ``order``.
    """
    split = frame.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    local = split.withColumn("_near", F.lag(value).over(inside)).withColumn("_nth", F.row_number().over(inside))
    last = split.groupBy(*key, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # One row per bucket of a key: bounded by the time span over the bucket width.
    across = Window.partitionBy(*key).orderBy("_bucket")
    carried = last.select(*key, "_bucket", F.lag("_last").over(across).alias("_far"))
    return (
        local.join(carried, [*key, "_bucket"], "left")
        .withColumn(name, F.when(F.col("_nth") == 1, F.col("_far")).otherwise(F.col("_near")))
        .drop("_bucket", "_near", "_nth", "_far")
    )


def previous_in_order(frame: DataFrame, order: Sequence[Column], columns: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Values of the row just before each row in a total order over the whole table."""
    ranked = global_rank(frame, order, "_rank")
    before = ranked.select((F.col("_rank") + 1).alias("_rank"), *[F.col(c).alias(prefix + c) for c in columns])
    return ranked.join(before, "_rank", "left").drop("_rank")
