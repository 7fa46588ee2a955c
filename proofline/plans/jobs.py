"""Queries over job tables, audit events, metrics and the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import paths
from proofline.operators import jobs
from proofline.plans.registry import query
from proofline.plans.views import Tables
from proofline.streaming import rate_limit


def at(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


@query("q14_scan_deltas", """
SELECT id, lag(id) OVER w AS previous_id, assets_found - lag(assets_found) OVER w AS assets_found_delta, coverage_pct - lag(coverage_pct) OVER w AS coverage_pct_delta,
       conflict_count - lag(conflict_count) OVER w AS conflict_count_delta, quantum_count - lag(quantum_count) OVER w AS quantum_count_delta
FROM v_jobs WHERE status = 'completed' WINDOW w AS (ORDER BY id)""")
def q14(t: Tables) -> DataFrame:
    return jobs.scan_deltas(t.view("v_jobs"), ["assets_found", "coverage_pct", "conflict_count", "quantum_count"])


@query("q14_latest_trend", """
SELECT id, CASE WHEN assets_found = p THEN 'stable' WHEN assets_found > p THEN 'up' ELSE 'down' END AS direction, abs(assets_found - p) AS delta
FROM (SELECT id, assets_found, lag(assets_found) OVER (ORDER BY id) AS p FROM v_jobs WHERE status = 'completed') ORDER BY id DESC LIMIT 1""")
def q14_trend(t: Tables) -> DataFrame:
    return jobs.latest_trend(t.view("v_jobs"))


@query("q15_scan_history", "SELECT id, repo_path FROM v_jobs WHERE status = 'failed' AND (contains(repo_path, 'repo4') OR contains(CAST(id AS VARCHAR), 'repo4'))")
def q15(t: Tables) -> DataFrame:
    return jobs.history(t.view("v_jobs"), "failed", " REPO4 ").select("id", "repo_path")


FAILURES = """
SELECT o_orderkey AS scan_job_id, concat('src/f', CAST(l_linenumber AS VARCHAR), '.py') AS path, CASE l_returnflag WHEN 'R' THEN 'oversized' WHEN 'A' THEN 'unreadable' ELSE 'parse_error' END AS reason
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'"""


@query("q16_scan_listing", f"""
SELECT j.id, j.status, f.path AS failure_path, f.reason AS failure_reason FROM (SELECT * FROM v_jobs ORDER BY id DESC LIMIT 50 OFFSET 10) j LEFT JOIN ({FAILURES}) f ON j.id = f.scan_job_id""")
def q16(t: Tables) -> DataFrame:
    return jobs.listing(t.view("v_jobs"), t.sql(FAILURES), 10, 50).select("id", "status", "failure_path", "failure_reason")


@query("q16_legacy_blind_spots", """
SELECT id, CASE WHEN status = 'failed' THEN 'partial results' ELSE repo_path || '|partial results' END AS blind_spots FROM v_jobs""")
def q16_spots(t: Tables) -> DataFrame:
    first = F.when(F.col("status") == "failed", F.concat(F.lit("__failed_file__:"), "repo_path")).otherwise(F.col("repo_path"))
    spots = jobs.clean_blind_spots(F.array(first, F.lit("partial results")))
    return t.view("v_jobs").select("id", F.concat_ws("|", spots).alias("blind_spots"))


@query("q17_failure_checks", """
SELECT file_id, lang NOT IN ('en', 'de') AS safe_path, lang <> 'fr' AS known_reason FROM v_files""")
def q17(t: Tables) -> DataFrame:
    """Paths of two languages are made unsafe and one language gets an unknown reason."""
    from proofline.catalogs import FAILURE_REASONS

    path = F.when(F.col("lang") == "en", F.concat(F.lit("/"), "path")).when(
        F.col("lang") == "de", F.replace("path", F.lit("/f"), F.lit("/../f"))).otherwise(F.col("path"))
    reason = F.when(F.col("lang") == "fr", "unknown").otherwise("oversized")
    return t.view("v_files").select(
        "file_id", paths.safe_failure_path(path).alias("safe_path"), reason.isin(*FAILURE_REASONS).alias("known_reason")
    )


@query("q18_audit_listing", "SELECT id, timestamp, actor_subject, action, details FROM v_audit ORDER BY id DESC LIMIT 200 OFFSET 300")
def q18(t: Tables) -> DataFrame:
    return jobs.audit_listing(t.view("v_audit"), 300, 200)


@query("q19_audit_kept", "SELECT id, action FROM v_audit WHERE timestamp >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY")
def q19(t: Tables) -> DataFrame:
    kept, _ = jobs.purge_audit(t.view("v_audit"), at("2024-02-20"), 30)
    return kept.select("id", "action")


@query("q19_audit_purge_row", """
SELECT 'audit.retention_purged' AS action, 30 AS days, count_if(timestamp < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS deleted FROM v_audit""")
def q19_row(t: Tables) -> DataFrame:
    _, row = jobs.purge_audit(t.view("v_audit"), at("2024-02-20"), 30)
    return row.select("action", "days", "deleted")


CHANGES = """
(SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS before, min(CASE WHEN event_type = 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS stop, (ts, event_id) AS here
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("t01_progress_changes", f"""
SELECT event_id, user_id, event_type, before IS NULL OR before <> event_type AS is_change, coalesce(here = stop, false) AS is_done FROM {CHANGES}
WHERE (stop IS NULL OR here <= stop) AND (before IS NULL OR before <> event_type OR coalesce(here = stop, false))""")
def t01(t: Tables) -> DataFrame:
    """Change-only feed per user until the first error."""
    changes = jobs.progress_changes(
        t.table("events"), "user_id", "ts", "event_id", "event_type", F.col("event_type") == "error", F.date_trunc("day", F.col("ts").cast("timestamp"))
    )
    return changes.select("event_id", "user_id", "event_type", "is_change", "is_done")


@query("t02_trailing_hits", """
SELECT user_id, ts, CAST(hits AS BIGINT) AS hits, CAST(sum(hits) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS hits_in_window
FROM (SELECT user_id, ts, count(*) AS hits FROM events GROUP BY ALL)""")
def t02(t: Tables) -> DataFrame:
    return jobs.trailing_hits(t.table("events"), "user_id", "ts", 6 * 3600)


def decided(name: str, source: str, key: str, threshold: int, hours: int) -> str:
    """A recursive table ``name``: the n-th hits of all keys are decided together, each from the accepted instants its key still has."""
    width = hours * 3_600_000_000
    return f"""
{name}_in AS MATERIALIZED (SELECT {key} AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n, asked FROM {source}),
{name}(k, n, event_id, allowed, wait, recent) AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM {name}_in
  UNION ALL
  SELECT k, n, event_id, passed, CASE WHEN len(after) >= {threshold} THEN CAST(greatest(1, ceil((after[1] + {width} - t) / 1000000.0)) AS BIGINT) ELSE 0 END, after
  FROM (SELECT *, CASE WHEN passed THEN list_append(kept, t) ELSE kept END AS after
        FROM (SELECT *, asked AND len(kept) < {threshold} AS passed
              FROM (SELECT i.*, [x FOR x IN r.recent IF x >= i.t - {width}] AS kept FROM {name} r JOIN {name}_in i ON i.k = r.k AND i.n = r.n + 1))))"""


@query("t02_rate_decisions", f"""
WITH RECURSIVE hits AS (SELECT *, true AS asked FROM events), {decided("d", "hits", "user_id", 2, 6)}
SELECT user_id, ts, event_id, allowed, CAST(CASE WHEN allowed THEN 0 ELSE wait END AS INTEGER) AS retry_after FROM d JOIN events USING (event_id)""")
def t02_decisions(t: Tables) -> DataFrame:
    """Accepted and rejected hits with the wait before the next try; depends on every earlier decision."""
    return rate_limit.decide(t.table("events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 2, 6 * 3600)


@query("t02_multi_key", f"""
WITH RECURSIVE hits AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN concat(event_type, user_id % 40) END AS place, true AS asked FROM events),
{decided("d", "hits", "user_id", 2, 12)},
later AS (SELECT h.event_id, h.ts, h.place, d.allowed AS asked FROM hits h JOIN d ON h.event_id = d.event_id WHERE place IS NOT NULL), {decided("e", "later", "place", 2, 12)}
SELECT h.event_id, h.user_id, h.place, coalesce(e.allowed, d.allowed) AS allowed,
       CAST(CASE WHEN coalesce(e.allowed, d.allowed) THEN 0 ELSE greatest(d.wait, coalesce(e.wait, 0)) END AS INTEGER) AS retry_after
FROM hits h JOIN d ON h.event_id = d.event_id LEFT JOIN e ON h.event_id = e.event_id""")
def t02_multi_key(t: Tables) -> DataFrame:
    """Hits limited by user and, errors aside, by place; both with one threshold and window."""
    place = F.when(F.col("event_type") != "error", F.concat("event_type", (F.col("user_id") % 40).cast("string")))
    hits = t.table("events").select("event_id", "ts", "user_id", place.alias("place"))
    return rate_limit.decide_keys(hits, ["user_id", "place"], "ts", "event_id", 2, 12 * 3600).drop("ts")


@query("t03_stale_jobs", """
SELECT id, status AS previous_status, 'failed' AS status, TIMESTAMP '2001-08-01 12:00:00' AS finished_at, 'Recovered from stale state by app lifecycle cleanup' AS note,
       round(epoch_us(TIMESTAMP '2001-08-01 12:00:00' - started_at) / 3600000000, 1) AS age_hours
FROM v_jobs WHERE status IN ('running', 'queued') AND started_at < TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 3 HOUR""")
def t03(t: Tables) -> DataFrame:
    return jobs.stale_jobs(t.view("v_jobs"), at("2001-08-01 12:00:00"))


@query("t04_abandoned_jobs", """
SELECT j.id, CASE WHEN cancellation_requested_at IS NOT NULL THEN 'cancelled' WHEN started_at <= TIMESTAMP '2001-08-01 00:00:10' - INTERVAL 345 SECOND THEN 'timed_out' ELSE 'failed' END AS status,
       epoch_ms(TIMESTAMP '2001-08-01 00:00:10') - epoch_ms(started_at) AS duration_ms,
       CASE WHEN cancellation_requested_at IS NOT NULL THEN 'Scan cancelled; results are incomplete' WHEN started_at <= TIMESTAMP '2001-08-01 00:00:10' - INTERVAL 345 SECOND THEN 'Scan exceeded its time limit; results are incomplete'
            ELSE 'Scan supervisor stopped responding; results are incomplete' END AS blind_spot
FROM v_jobs j JOIN v_dispatch d ON j.id = d.scan_job_id WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '2001-08-01 00:00:10' - INTERVAL 45 SECOND)""")
def t04(t: Tables) -> DataFrame:
    closed = jobs.abandoned_jobs(t.view("v_jobs"), t.view("v_dispatch"), at("2001-08-01 00:00:10"))
    return closed.select("id", "status", "duration_ms", "blind_spot")


@query("t05_expired_leases", "SELECT scan_job_id, expires_at, true AS released FROM v_dispatch WHERE NOT released AND expires_at < TIMESTAMP '1999-01-01' - INTERVAL 60 SECOND")
def t05(t: Tables) -> DataFrame:
    return jobs.expired_leases(t.view("v_dispatch").select("scan_job_id", "expires_at", "released"), at("1999-01-01"), 60)


@query("t06_duration_percentiles", """
SELECT round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99, count(*) AS sample_count
FROM (SELECT CAST(duration_ms AS DOUBLE) AS duration_ms FROM v_jobs WHERE duration_ms >= 0 ORDER BY id DESC LIMIT 100)""")
def t06(t: Tables) -> DataFrame:
    row = jobs.duration_percentiles(t.view("v_jobs"))
    return row.select(*[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")], "sample_count")


@query("t07_request_metrics", """
SELECT 'GET' AS method, CASE WHEN page_id % 3 = 0 THEN '/scans/{id}' WHEN page_id % 3 = 1 THEN '/assets/{id}' ELSE '/metrics' END AS path,
       CASE WHEN contains(url, 'https') THEN '200' ELSE '301' END AS status, count(*) AS requests, round(sum(length(html) / 1000.0::DOUBLE), 4) AS duration_s FROM pages GROUP BY ALL""")
def t07(t: Tables) -> DataFrame:
    """Requests derived from pages: two parameterised paths and one plain path."""
    number = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/scans/"), number, F.lit("/events"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("/assets/"), number)).otherwise("/metrics")
    requests = t.table("pages").select(
        F.lit("get").alias("method"), path.alias("path"), F.when(F.col("url").contains("https"), 200).otherwise(301).alias("status"),
        (F.length("html") / 1000.0).alias("duration_s"),
    )
    return jobs.request_metrics(requests)


@query("t08_status_counts", "SELECT status, count(*) AS jobs, CAST(sum(duration_ms) AS BIGINT) AS duration_ms_sum FROM v_jobs GROUP BY status")
def t08(t: Tables) -> DataFrame:
    return jobs.status_counts(t.view("v_jobs"))


@query("t08_active_gauge", "SELECT count_if(status IN ('pending', 'queued', 'running')) AS active_jobs FROM v_jobs")
def t08_gauge(t: Tables) -> DataFrame:
    return jobs.active_gauge(t.view("v_jobs"))


@query("t09_admission", """
SELECT r.repo_path, a.id AS active_id, CASE WHEN a.id IS NULL THEN 'queued' ELSE 'reused' END AS outcome
FROM (SELECT DISTINCT concat('/srv/repo', CAST(c_custkey % 80 AS VARCHAR)) AS repo_path FROM customer) r
LEFT JOIN (SELECT repo_path, max(id) AS id FROM v_jobs WHERE status IN ('pending', 'queued', 'running') GROUP BY repo_path) a ON r.repo_path = a.repo_path""")
def t09(t: Tables) -> DataFrame:
    requests = t.table("customer").select(F.concat(F.lit("/srv/repo"), (F.col("c_custkey") % 80).cast("string")).alias("repo_path"))
    return jobs.admit(requests, t.view("v_jobs"))
