"""Sliding-window rate limit that counts accepted hits only.

Whether a hit is accepted depends on the decisions before it, so one key is decided in time order with
a small state: the accepted instants still in the window, never more than the threshold.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proofline import catalogs as C

MICROS = 1_000_000


def decide_hit(recent: deque, now: int, threshold: int, window: int) -> tuple[bool, int]:
    """Decision for one hit and the seconds to wait; times are microseconds, ``recent`` is the state."""
    while recent and recent[0] < now - window:
        recent.popleft()
    if len(recent) < threshold:
        recent.append(now)
        return True, 0
    return False, max(1, math.ceil((recent[0] + window - now) / MICROS))


def sessions(hits: DataFrame, key: str, at: str, window_seconds: int) -> DataFrame:
    """Adds ``_session``: the time bucket in which a run of hits without an idle window began.

    After a full window without any hit the state is empty, so runs are decided independently. Runs are
    found from occupied time buckets, not from rows: the window below sees one row per key and bucket.
    """
    width = window_seconds * MICROS
    bucketed = hits.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn(
        "_bucket", F.floor(F.col("_t") / width)
    )
    ends = bucketed.groupBy(key, "_bucket").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    in_order = Window.partitionBy(key).orderBy("_bucket")
    idle = F.col("_low") - F.lag("_high").over(in_order) > width
    starts = ends.withColumn("_start", F.when(F.coalesce(idle, F.lit(True)), F.col("_bucket")))
    runs = starts.select(key, "_bucket", F.last("_start", ignorenulls=True).over(in_order).alias("_session"))
    return bucketed.join(runs, [key, "_bucket"]).drop("_bucket")


def decide(hits: DataFrame, key: str, at: str, tie: str, threshold: int = C.RATE_THRESHOLD,
           window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Adds ``allowed`` and ``retry_after`` to every hit.

    Runs spread over tasks, and inside a task rows arrive sorted and pass through in batches: a run is
    never held in memory. Only one unbroken run of one key has to stay in one task.
    """
    rows = sessions(hits, key, at, window_seconds)
    columns = hits.columns
    kinds = dict(hits.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", allowed boolean, retry_after int"
    width = window_seconds * MICROS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            allowed, waits = [], []
            for owner, session, now in zip(batch[key], batch["_session"], batch["_t"]):
                if (owner, session) != current:
                    current, recent = (owner, session), deque()
                good, wait = decide_hit(recent, int(now), threshold, width)
                allowed.append(good)
                waits.append(wait)
            yield batch[columns].assign(allowed=allowed, retry_after=waits)

    ordered = rows.repartition(key, "_session").sortWithinPartitions(key, "_session", "_t", tie)
    return ordered.mapInPandas(run, schema)


def decide_keys(hits: DataFrame, keys: Sequence[str], at: str, tie: str, threshold: int = C.RATE_THRESHOLD,
                window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Adds ``allowed`` and ``retry_after`` to hits that several keys limit at once, say a client and a user name.

    Keys are asked in the order given. Each that has room records the hit; the first that has none rejects it, and later keys
    do not record it. So a key depends on its own hits and on whether earlier keys let them through, never on later ones: the
    keys are decided one after another over all hits, each spread by key and run like ``decide``, and no group joins the hits of
    different keys. A rejected hit waits for the last of its full keys, those not asked included. Each column counts by itself, also
    where two hold equal values; a null key does not limit a hit. Ties in time go by ``tie``, which must be unique.
    """
    rows = hits.withColumns({"_open": F.lit(True), "_wait": F.lit(0).cast("int")})
    for i, key in enumerate(keys):
        # A hit without the key stands alone, so that such hits spread like any other key.
        own = F.when(F.col(key).isNull(), F.concat(F.lit("-"), F.col(tie).cast("string"))).otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
        runs = sessions(rows.withColumn(f"_key{i}", own), f"_key{i}", at, window_seconds)
        rows = runs.withColumnRenamed("_session", f"_session{i}").drop("_t")
    rows = rows.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    width = window_seconds * MICROS
    for i in range(len(keys)):
        rows = _asked(rows, f"_key{i}", f"_session{i}", tie, threshold, width)
    wait = F.when(F.col("_open"), F.lit(0)).otherwise(F.col("_wait")).cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in hits.columns], F.col("_open").alias("allowed"), wait.alias("retry_after"))


def _asked(rows: DataFrame, key: str, session: str, tie: str, threshold: int, width: int) -> DataFrame:
    """The rows after one key was asked: ``_open`` tells whether a hit is still let through, ``_wait`` the longest wait for a full key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for batch in batches:
            opens, waits = [], []
            for owner, run_of, now, is_open, wait in zip(*(batch.column(c).to_pylist() for c in (key, session, "_t", "_open", "_wait"))):
                if (owner, run_of) != current:
                    current, recent = (owner, run_of), deque()
                if owner[0] == "+":
                    if is_open:
                        is_open, _ = decide_hit(recent, now, threshold, width)
                    while recent and recent[0] < now - width:
                        recent.popleft()
                    if len(recent) >= threshold:
                        wait = max(wait, 1, math.ceil((recent[0] + width - now) / MICROS))
                opens.append(is_open)
                waits.append(wait)
            for name, values in (("_open", pa.array(opens, pa.bool_())), ("_wait", pa.array(waits, pa.int32()))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, values)
            yield batch

    ordered = rows.repartition(key, session).sortWithinPartitions(key, session, "_t", tie)
    return ordered.mapInArrow(run, rows.schema)


def decide_stream(hits: DataFrame, key: str, at: str, threshold: int = C.RATE_THRESHOLD,
                  window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """The streaming form: one decision row per hit, state kept per key and dropped after an idle window."""
    kinds = dict(hits.dtypes)
    schema = f"`{key}` {kinds[key]}, at_micros long, allowed boolean, retry_after int"
    width = window_seconds * MICROS

    def update(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        times = sorted(int(t) for batch in batches for t in batch["_t"])
        rows = [(owner[0], now, *decide_hit(recent, now, threshold, width)) for now in times]
        state.update((list(recent),))
        state.setTimeoutDuration(window_seconds * 1000)
        yield pd.DataFrame(rows, columns=[key, "at_micros", "allowed", "retry_after"])

    timed = hits.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    return timed.groupBy(key).applyInPandasWithState(
        update, schema, "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
