"""Job tables, audit events and request metrics. ``now`` is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.operators.ordering import page, previous_by_bucket, previous_in_order

#: Longest page whose ids are broadcast.


def scan_deltas(jobs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Each completed job against the completed job before it."""
    completed = jobs.where("status = 'completed'").select("id", *measures)
    paired = previous_in_order(completed, [F.col("id").asc()], ["id", *measures])
    deltas = [(F.col(m) - F.col(f"previous_{m}")).alias(f"{m}_delta") for m in measures]
    return paired.select("id", "previous_id", *deltas)


def latest_trend(jobs: DataFrame, measure: str = "assets_found") -> DataFrame:
    """Direction and size of the change between the two newest completed jobs; empty with fewer."""
    newest = jobs.where("status = 'completed'").orderBy(F.col("id").desc()).limit(2)
    # Two rows.
    pair = newest.agg(
        F.max_by(measure, "id").alias("latest"), F.min_by(measure, "id").alias("previous"),
        F.max("id").alias("id"), F.count(F.lit(1)).alias("n"),
    ).where("n = 2")
    delta = F.col("latest") - F.col("previous")
    return pair.select(
        "id", F.when(delta == 0, "stable").when(delta > 0, "up").otherwise("down").alias("direction"), F.abs(delta).alias("delta")
    )


def history(jobs: DataFrame, status: str = "all", text: str | None = None) -> DataFrame:
    rows = jobs if status == "all" else jobs.where(F.col("status") == status)
    needle = (text or "").strip().lower()
    if not needle:
        return rows
    return rows.where(F.contains(F.lower("repo_path"), F.lit(needle)) | F.contains(F.col("id").cast("string"), F.lit(needle)))


def clean_blind_spots(spots: Column) -> Column:
    kept = F.filter(spots, lambda s: ~s.startswith(C.LEGACY_BLIND_SPOT_PREFIX))
    return F.coalesce(kept, F.array().cast("array<string>"))


def listing(jobs: DataFrame, failures: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of jobs, newest first, with one row per child failure (null for none).

    Failures stay rows: a job can have as many as it has files.
    """
    shown = page(jobs, [F.col("id").desc()], offset, limit)
    child = failures.select(F.col("scan_job_id").alias("id"), F.col("path").alias("failure_path"), F.col("reason").alias("failure_reason"))
    return shown.join(child, "id", "left")


def audit_listing(events: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return page(events, [F.col("id").desc()], offset, limit)


def purge_audit(events: DataFrame, now: Column, days: int = C.AUDIT_RETENTION_DAYS, actor: str = "admin") -> tuple[DataFrame, DataFrame]:
    """(events kept, one audit row that reports the purge)."""
    if not 1 <= days <= 365:
        raise ValueError("retention is between 1 and 365 days")
    cutoff = now - F.make_dt_interval(F.lit(days))
    old = F.coalesce(F.col("timestamp") < cutoff, F.lit(False))
    report = events.agg(F.count_if(old).alias("deleted")).select(
        now.alias("timestamp"), F.lit(actor).alias("actor_subject"), F.lit("audit.retention_purged").alias("action"),
        F.lit("audit_logs").alias("resource"), F.lit(days).alias("days"), cutoff.alias("cutoff"), "deleted",
    )
    return events.where(~old), report


# --- job supervision -------------------------------------------------------------------------------


def stale_jobs(jobs: DataFrame, now: Column, hours: int = C.STALE_AFTER_HOURS) -> DataFrame:
    """Queued or running jobs older than the limit as they read after recovery."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 3_600_000_000
    stale = F.col("status").isin(*C.STALE_STATUSES) & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return jobs.where(stale).select(
        "id", F.col("status").alias("previous_status"), F.lit("failed").alias("status"), now.alias("finished_at"),
        F.lit(C.STALE_NOTE).alias("note"), F.round(age, 1).alias("age_hours"),
    )


def abandoned_jobs(jobs: DataFrame, dispatches: DataFrame, now: Column, timeout: int = C.JOB_TIMEOUT_SECONDS,
                   grace: int = C.HEARTBEAT_GRACE_SECONDS) -> DataFrame:
    """Running jobs without a recent heartbeat and how each is closed."""
    running = jobs.where("status = 'running' and started_at is not null").select("id", "started_at")
    calls = dispatches.select(F.col("scan_job_id").alias("id"), "heartbeat_at", "cancellation_requested_at")

    def seconds(n: int) -> Column:
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))

    silent = F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - seconds(grace))
    overdue = F.col("started_at") <= now - seconds(timeout + grace)
    closed = running.join(calls, "id").where(silent).withColumn(
        "status", F.when(F.col("cancellation_requested_at").isNotNull(), "cancelled").when(overdue, "timed_out").otherwise("failed")
    )
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for status, text in C.ABANDONED_TEXT.items():
        choice = choice.when(F.col("status") == status, text)
    return closed.select(
        "id", "status", now.alias("finished_at"),
        F.greatest(F.lit(0), F.round(micros / 1000)).cast("long").alias("duration_ms"), choice.alias("blind_spot"),
    )


def expired_leases(leases: DataFrame, now: Column, older_than_seconds: int = 0) -> DataFrame:
    """Unreleased leases past their expiry, marked released."""
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(older_than_seconds))
    return leases.where(~F.col("released") & (F.col("expires_at") < cutoff)).withColumn("released", F.lit(True))


def admit(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each requested repository: its newest active job if there is one, else a new job."""
    active = jobs.where(F.col("status").isin(*C.ACTIVE_STATUSES)).groupBy("repo_path").agg(F.max("id").alias("active_id"))
    asked = requests.select("repo_path").distinct()
    return asked.join(active, "repo_path", "left").select(
        "repo_path", "active_id", F.when(F.col("active_id").isNull(), "queued").otherwise("reused").alias("outcome")
    )


def duration_percentiles(jobs: DataFrame, samples: int = C.DURATION_SAMPLES, order: str = "id", value: str = "duration_ms") -> DataFrame:
    """p50, p95 and p99 with linear interpolation over the newest samples; negative ones do not count."""
    newest = jobs.where(F.col(value) >= 0).orderBy(F.col(order).desc()).limit(samples)
    return newest.agg(
        *[F.percentile(F.col(value), F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)], F.count(F.lit(1)).alias("sample_count")
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("duration_ms").alias("duration_ms_sum"))


def active_gauge(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*C.ACTIVE_STATUSES)).alias("active_jobs"))


def path_template(path: Column) -> Column:
    """Stable template of a parameterised request path."""
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, template in C.PATH_TEMPLATES:
        choice = choice.when(path.startswith(prefix), template)
    return choice.otherwise(path)


def request_metrics(requests: DataFrame) -> DataFrame:
    return requests.groupBy(
        F.upper("method").alias("method"), path_template(F.col("path")).alias("path"), F.col("status").cast("string").alias("status")
    ).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("duration_s"), 4).alias("duration_s"))


# --- progress and rate limits, batch form -------------------------------------------------------------


def progress_changes(snapshots: DataFrame, key: str, at: str, tie: str, payload: str, finished: Column, bucket: Column) -> DataFrame:
    """Snapshots whose payload differs from the one before, up to and including the first final one.

    The final snapshot also closes the stream: it has ``is_done``.
    """
    ends = snapshots.where(finished).groupBy(key).agg(F.min(F.struct(at, tie)).alias("_end"))
    open_rows = snapshots.join(ends, key, "left").where(
        F.col("_end").isNull() | (F.struct(at, tie) <= F.col("_end"))
    )
    done = F.coalesce(F.struct(at, tie) == F.col("_end"), F.lit(False))
    marked = open_rows.withColumn("is_done", done).drop("_end")
    compared = previous_by_bucket(marked, [key], [at, tie], payload, bucket, "_before")
    changed = ~F.col(payload).eqNullSafe(F.col("_before")) | F.col("_before").isNull()
    return compared.withColumn("is_change", changed).where("is_change or is_done").drop("_before")


def trailing_hits(hits: DataFrame, key: str, at: str, window_seconds: int = C.RATE_WINDOW_SECONDS) -> DataFrame:
    """Hits per key and instant, and in the trailing window (both ends included).

    The window is a difference of two running counts: up to the instant, and before the window's start, which enters the
    order as a marker of its own. Running counts are taken inside time buckets, and bucket totals are carried, so the work is
    linear in the hits and a key with very many hits is split by time.
    """
    width = window_seconds * 1_000_000
    counted = hits.groupBy(key, at).agg(F.count(F.lit(1)).alias("hits")).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    instants = counted.select(key, "_t", F.col("_t").alias("_at"), F.lit(1).alias("_kind"), "hits")
    starts = counted.select(key, "_t", (F.col("_t") - width).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("hits"))
    order = instants.unionByName(starts).withColumn("_bucket", F.floor(F.col("_at") / width))
    inside = Window.partitionBy(key, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # One row per bucket of a key: bounded by the time span over the window's width.
    across = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = order.groupBy(key, "_bucket").agg(F.sum("hits").alias("_sum"))
    carried = totals.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_base"))
    running = order.withColumn("_run", F.sum("hits").over(inside)).join(
        carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("_run", F.col("_run") + F.col("_base"))
    window = running.groupBy(key, "_t").agg(
        (F.max(F.when(F.col("_kind") == 1, F.col("_run"))) - F.max(F.when(F.col("_kind") == 0, F.col("_run")))).alias("hits_in_window")
    ).select(F.col(key).alias("_key"), F.col("_t").alias("_time"), "hits_in_window")
    return counted.join(window, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_time"))).drop("_key", "_time", "_t")
