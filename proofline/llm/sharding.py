"""A uniform shuffle of rows into shards of exact size, planned by a hypergeometric communication matrix.

Rows lie in partitions (by a hash of their key). How many rows of each partition go to each shard is drawn once, as a
random matrix with the partition counts as row sums and the shard sizes as column sums: exactly the law of the counts in
a uniform permutation. Each partition is permuted, hands its first rows to shard 0, the next to shard 1 and so on, and
each shard is permuted again. Only counts reach the driver, and the rows move twice.

Shard sizes differ by one at most (the first shards are the larger ones). The result depends on the rows, the number of
shards and the seed alone, not on the layout of the input, so lost tasks can be run again. Rows whose keys are all equal
are interchangeable. Nulls in keys are ordinary values; an empty table gives an empty result; extra columns are carried
along under any name but the two that are added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.common import packed, rank_in_groups

#: Fewest partitions of the plan, and rows in one when there are more.
MIN_PARTITIONS = 64
ROWS_PER_PARTITION = 1_000_000
#: Rows that are put in order by one task within a shard.
ROWS_PER_RANGE = 200_000
#: Largest plan, and sizes of ranges, in bytes, that are broadcast; larger ones are joined by partition.
PLAN_BYTES = 64 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are among the ``good``; for counts of any size.

    Inverts the distribution over a window of 14 standard deviations around its mode, beyond which less than 1e-30 lies.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    first, last = max(low, mode - int(14 * spread) - 30), min(high, mode + int(14 * spread) + 30)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """A random matrix with row sums ``counts`` and column sums ``sizes``."""
    rng, room, rows = np.random.default_rng(seed), list(sizes), []
    for count in counts:
        left, rest, row = count, sum(room), []
        for shard, free in enumerate(room):
            rest -= free
            taken = hypergeometric(rng, free, rest, left)
            row.append(taken)
            left -= taken
            room[shard] -= taken
        rows.append(row)
    return rows


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def _plan(spark: SparkSession, counts: dict[int, int], shards: int, seed: int) -> DataFrame:
    """(_p, _ends): for each partition, up to which place its rows go to shard 0, 1, ..."""
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(sum(counts.values()), shards), seed)
    rows = [(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(order, matrix)]
    plan = spark.createDataFrame(rows, "_p long, _ends array<long>")
    return F.broadcast(plan) if len(rows) * shards * 8 <= PLAN_BYTES else plan


def shuffle_into_shards(rows: DataFrame, shards: int, keys: list[str], seed: int = 0) -> DataFrame:
    """The rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    total = rows.count()
    partitions = max(MIN_PARTITIONS, math.ceil(total / ROWS_PER_PARTITION))
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.select(packed(rows).alias("_row"), *[F.col(k).alias(n) for k, n in zip(keys, names)])
    keyed = keyed.withColumns({
        "_p": F.pmod(F.xxhash64(F.lit(seed), F.lit("deal"), *names), F.lit(partitions)),
        "_first": F.xxhash64(F.lit(seed), F.lit("first"), *names), "_second": F.xxhash64(F.lit(seed), F.lit("second"), *names),
    })
    counts = {r._p: r["count"] for r in keyed.groupBy("_p").count().collect()}
    local = Window.partitionBy("_p").orderBy("_first", *names)
    placed = keyed.withColumn("_place", F.row_number().over(local) - 1).join(_plan(rows.sparkSession, counts, shards, seed), "_p")
    dealt = placed.withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_place"))))
    dealt = dealt.select("_row", "_second", *names, "shard")
    ranges = max(1, math.ceil(total / shards / ROWS_PER_RANGE))
    return rank_in_groups(dealt, ["shard"], "_second", names, "slot", ranges, few=shards * ranges * 64 <= PLAN_BYTES).select("_row.*", "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int, keys: list[str], seed: int = 0) -> None:
    """Write the shards as Parquet, one folder each, in the order of the slots."""
    dealt = shuffle_into_shards(rows, shards, keys, seed)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
