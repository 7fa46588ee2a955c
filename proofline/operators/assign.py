"""One-to-one pairing of expected and actual operations inside identity pools.

Only usage and key size decide how well a pair scores, so operations with equal metadata are
interchangeable. Pools are reduced to counts per (usage, key size) before any group is formed: a pool
with a third of all rows is still a handful of classes. Exact pairs are settled by a join of those
counts; only the rest of a pool, again counts, reaches the per-pool solver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASS = ["usage", "key_size"]
NO_KEY = -1  # key sizes are compared null-safe: two unknown sizes agree


def class_counts(expected: DataFrame, actual: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Expected and actual counts per pool and metadata class, in one shuffle."""
    key = F.coalesce(F.col("key_size"), F.lit(NO_KEY)).cast("long").alias("key_size")
    columns = [*pool, "usage", key]
    both = expected.select(*columns, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(
        actual.select(*columns, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    return both.groupBy(*pool, *CLASS).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"))


class Network:
    """A flow network with costs: arcs in pairs, the reverse of arc i is i ^ 1."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def connect(self, left: int, right: int, room: int, cost: int) -> int:
        self.out[left].append(len(self.to))
        self.out[right].append(len(self.to) + 1)
        self.to += [right, left]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def distances(self, source: int, potential: list[int]) -> list[float]:
        """Shortest distances in reduced costs, which are never negative, by a heap."""
        best = [math.inf] * len(self.out)
        best[source], heap = 0, [(0, source)]
        while heap:
            far, node = heapq.heappop(heap)
            if far > best[node]:
                continue
            for arc in self.out[node]:
                if self.room[arc]:
                    after = self.to[arc]
                    reach = far + self.cost[arc] + potential[node] - potential[after]
                    if reach < best[after]:
                        best[after] = reach
                        heapq.heappush(heap, (reach, after))
        return best

    def block(self, source: int, sink: int, potential: list[int]) -> bool:
        """Push flow along arcs of no reduced cost, by levels, until no level graph reaches the sink."""
        pushed = False
        while True:
            level, queue = {source: 0}, [source]
            for node in queue:
                for arc in self.out[node]:
                    after = self.to[arc]
                    if self.room[arc] and after not in level and self.cost[arc] + potential[node] == potential[after]:
                        level[after] = level[node] + 1
                        queue.append(after)
            if sink not in level:
                return pushed
            turn, path = [0] * len(self.out), []
            while True:
                node = self.to[path[-1]] if path else source
                if node == sink:
                    amount = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= amount
                        self.room[arc ^ 1] += amount
                    pushed = True
                    path = path[:next(i for i, arc in enumerate(path) if not self.room[arc])]
                    continue
                while turn[node] < len(self.out[node]):
                    arc = self.out[node][turn[node]]
                    after = self.to[arc]
                    if self.room[arc] and level.get(after) == level[node] + 1 and self.cost[arc] + potential[node] == potential[after]:
                        path.append(arc)
                        break
                    turn[node] += 1
                else:
                    if not path:
                        break
                    turn[self.to[path.pop() ^ 1]] += 1


def best_flow(demand: dict, supply: dict, usage_weight: int, key_weight: int) -> list[tuple]:
    """Pair leftover classes for the highest total score.

    Each class connects only to a hub for its usage and a hub for its key size, so the network has as many arcs as classes rather than as pairs.
    Flow is pushed along all shortest paths of one length at a time; lengths are sums of few weights, so there are few rounds, each
    a search with a heap and a blocking flow.
    """
    left, right = sorted(demand.items()), sorted(supply.items())
    hubs = {h: 2 + i for i, h in enumerate(sorted({("key", k[1]) for k, _ in left + right} | {("usage", k[0]) for k, _ in left + right}, key=repr))}
    first = 2 + len(hubs)
    net = Network(first + len(left) + len(right))
    limit = max(sum(demand.values()), sum(supply.values()))
    entering: dict[int, list] = {h: [] for h in hubs.values()}
    leaving: dict[int, list] = {h: [] for h in hubs.values()}
    # Potentials are the distances of the network without flow, where every arc leads from the source to the sink.
    potential = [0] * len(net.out)
    for i, (key, count) in enumerate(left):
        net.connect(0, first + i, count, 0)
        for hub in (hubs["usage", key[0]], hubs["key", key[1]]):
            entering[hub].append((key, net.connect(first + i, hub, limit, 0)))
    for i, (key, count) in enumerate(right):
        node = first + len(left) + i
        for hub, price in ((hubs["usage", key[0]], usage_weight), (hubs["key", key[1]], key_weight)):
            leaving[hub].append((key, net.connect(hub, node, limit, -price)))
            if entering[hub]:
                potential[node] = min(potential[node], -price)
        net.connect(node, 1, count, 0)
        potential[1] = min(potential[1], potential[node])
    while True:
        reach = net.distances(0, potential)
        if math.isinf(reach[1]):
            break
        # What lies further than the sink keeps its place behind it.
        potential = [p + min(r, reach[1]) for p, r in zip(potential, reach)]
        if potential[1] - potential[0] >= 0 or not net.block(0, 1, potential):
            break
    pairs = []
    for hub in hubs.values():
        into = [[key, net.room[arc ^ 1]] for key, arc in entering[hub] if net.room[arc ^ 1]]
        out = [[key, net.room[arc ^ 1]] for key, arc in leaving[hub] if net.room[arc ^ 1]]
        pairs += drain(into, out)
    for e, a, count in pairs:
        demand[e] -= count
        supply[a] -= count
    return pairs + drain([[k, n] for k, n in sorted(demand.items()) if n], [[k, n] for k, n in sorted(supply.items()) if n])


def drain(left: list[list], right: list[list]) -> list[tuple]:
    """Pair two lists of (class, count) front to back until one side is empty."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        count = min(left[i][1], right[j][1])
        out.append((left[i][0], right[j][0], count))
        left[i][1] -= count
        right[j][1] -= count
        i += left[i][1] == 0
        j += right[j][1] == 0
    return out


def class_pairs(counts: DataFrame, pool: Sequence[str], weights: tuple[int, int] | None = (101, 1)) -> DataFrame:
    """Pairs per pool: (usage, key_size) of each side and how many. As many pairs as the smaller side.

    ``weights`` scores a usage match and a key-size match. ``None`` maximises the number of metadata
    matches first and usage matches second, whatever the pool size.
    """
    exact = counts.where((F.col("expected") > 0) & (F.col("actual") > 0)).select(
        *pool, *CLASS, F.col("usage").alias("actual_usage"), F.col("key_size").alias("actual_key_size"),
        F.least("expected", "actual").cast("long").alias("pairs"),
    )
    left = counts.withColumn("_both", F.least("expected", "actual")).select(
        *pool, *CLASS, (F.col("expected") - F.col("_both")).alias("expected"), (F.col("actual") - F.col("_both")).alias("actual")
    ).where("expected > 0 or actual > 0")
    # Pools with only one side left need no solver.
    open_pools = left.groupBy(*pool).agg(F.sum("expected").alias("_e"), F.sum("actual").alias("_a")).where("_e > 0 and _a > 0")
    open_left = left.join(open_pools.select(*pool), list(pool), "left_semi")
    fields = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = ", ".join(f"{p} {fields[p]}" for p in pool) + (
        ", usage string, key_size long, actual_usage string, actual_key_size long, pairs long"
    )
    names = list(pool)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(group["usage"], group["key_size"].astype(int)))
        demand = {k: int(n) for k, n in zip(keys, group["expected"]) if n > 0}
        supply = {k: int(n) for k, n in zip(keys, group["actual"]) if n > 0}
        size = min(sum(demand.values()), sum(supply.values()))
        usage_weight, key_weight = weights or (size + 2, size + 1)
        found = best_flow(demand, supply, usage_weight, key_weight)
        out = pd.DataFrame(
            [(*e, *a, n) for e, a, n in found],
            columns=["usage", "key_size", "actual_usage", "actual_key_size", "pairs"],
        )
        for position, name in enumerate(names):
            out.insert(position, name, group[name].iloc[0])
        return out

    solved = open_left.groupBy(*pool).applyInPandas(solve, schema)
    return exact.unionByName(solved)


def metadata_scores(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: matched, missed and unexpected operations and the metadata matches among the pairs."""
    same_usage = F.col("usage") == F.col("actual_usage")
    same_key = F.col("key_size") == F.col("actual_key_size")

    def total(condition: object) -> object:
        return F.coalesce(F.sum(F.when(condition, F.col("pairs"))), F.lit(0))

    matched = pairs.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("true_positives"), total(same_usage).alias("usage_correct"),
        total(same_key).alias("key_size_correct"), total(same_usage & same_key).alias("metadata_pair_correct"),
        total(same_key & (F.col("key_size") != NO_KEY)).alias("known_key_size_correct"),
    )
    sides = counts.agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("actual"), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(F.col("key_size") != NO_KEY, F.col("expected"))), F.lit(0)).alias("known_key_size_denominator"),
    )
    columns = matched.columns + sides.columns
    both = matched.unionByName(sides, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in columns])
    return both.withColumns({
        "false_positives": F.col("found") - F.col("true_positives"),
        "false_negatives": F.col("expected") - F.col("true_positives"),
        "usage_accuracy": F.round(F.try_divide("usage_correct", "expected"), 4),
        "metadata_pair_accuracy": F.round(F.try_divide("metadata_pair_correct", "expected"), 4),
        "known_key_size_accuracy": F.round(F.try_divide("known_key_size_correct", "known_key_size_denominator"), 4),
    })


