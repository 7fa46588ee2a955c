"""Streaming operators against their batch form and a direct simulation."""

from __future__ import annotations

import json
import random
from collections import deque

from pyspark.sql import functions as F

from proofline.operators import jobs
from proofline.streaming import progress, rate_limit, requests


def hits(count=400):
    chance = random.Random(9)
    now, rows = 0, []
    for i in range(count):
        now += chance.choice([0, 1, 1, 2, 5, 90])
        rows.append((chance.choice(["a", "a", "b"]), now, i))
    return rows


def direct(rows, threshold, window):
    """Accepted hits per key, decided one by one."""
    accepted: dict = {}
    result = {}
    for key, now, i in rows:
        recent = [t for t in accepted.get(key, []) if t >= now - window]
        if len(recent) < threshold:
            recent.append(now)
            result[i] = (True, 0)
        else:
            result[i] = (False, max(1, recent[0] + window - now))
        accepted[key] = recent
    return result


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, second int, id int").select("key", F.timestamp_seconds("second").alias("at"), "id")


def test_batch_decisions_equal_direct_simulation(spark):
    rows = hits()
    for threshold, window in ((1, 3), (3, 10), (2, 60)):
        found = rate_limit.decide(table(spark, rows), "key", "at", "id", threshold, window).collect()
        assert {r["id"]: (r["allowed"], r["retry_after"]) for r in found} == direct(rows, threshold, window)


def test_several_keys_equal_direct_simulation(spark):
    """Clients and users limit together: earlier keys record what later ones reject, nulls do not limit, equal values of two keys stay apart."""
    chance, now, rows = random.Random(21), 0, []
    for i in range(600):
        now += chance.choice([0, 0, 1, 1, 3, 40])
        rows.append((chance.choice(["x", "x", "y", None]), chance.choice(["x", "u", "v", None]), chance.choice(["p", None]), now, i))
    frame = spark.createDataFrame(rows, "client string, user string, place string, second int, id int").select(
        "client", "user", "place", F.timestamp_seconds("second").alias("at"), "id", F.lit(None).cast("long").alias("note"))
    for threshold, window in ((1, 3), (2, 10), (3, 60)):
        kept, want = {}, {}
        for *keys, now, i in rows:
            named = [(place, k) for place, k in enumerate(keys) if k is not None]
            for k in named:
                kept[k] = [t for t in kept.get(k, []) if t >= now - window]
            allowed = True
            for k in named:
                allowed = allowed and len(kept[k]) < threshold
                if allowed:
                    kept[k].append(now)
            want[i] = (allowed, 0 if allowed else max(max(1, kept[k][0] + window - now) for k in named if len(kept[k]) >= threshold))
        found = rate_limit.decide_keys(frame, ["client", "user", "place"], "at", "id", threshold, window)
        assert found.columns == [*frame.columns, "allowed", "retry_after"]
        got = {r["id"]: (r["allowed"], r["retry_after"]) for r in found.collect()}
        assert got == want and 50 < sum(a for a, _ in want.values()) < 550
    assert rate_limit.decide_keys(frame.limit(0), ["client", "user"], "at", "id").count() == 0


def test_idle_windows_split_a_key(spark):
    rows = [("a", s, i) for i, s in enumerate([0, 5, 10, 200, 205, 900])]
    found = rate_limit.sessions(table(spark, rows), "key", "at", 60)
    assert found.select("_session").distinct().count() == 3


def test_one_decision():
    recent: deque = deque()
    results = [rate_limit.decide_hit(recent, t * rate_limit.MICROS, 2, 60 * rate_limit.MICROS) for t in (0, 10, 20, 60, 61)]
    assert results == [(True, 0), (True, 0), (False, 40), (False, 1), (True, 0)]


def stream(spark, frame, folder, files=3):
    """Write the frame as ordered files and read it back one file per batch."""
    for part in range(files):
        frame.where(F.col("_file") == part).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    schema = frame.drop("_file").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collect(query_frame, name, mode, folder):
    query = (
        query_frame.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return query_frame.sparkSession.table(name).collect()


def test_streaming_rate_limit(spark, tmp_path):
    rows = hits(90)
    frame = table(spark, rows).withColumn("_file", F.floor(F.col("id") / 30))
    source = stream(spark, frame, str(tmp_path / "in"))
    found = collect(rate_limit.decide_stream(source, "key", "at", 2, 60), "limited", "append", str(tmp_path / "check"))
    expected = sorted((key, now, *direct(rows, 2, 60)[i]) for key, now, i in rows)
    assert sorted((r["key"], r["at_micros"] // rate_limit.MICROS, r["allowed"], r["retry_after"]) for r in found) == expected


def test_streaming_progress(spark, tmp_path):
    data = [("j1", 1, "running", 0), ("j1", 2, "running", 0), ("j1", 3, "running", 5), ("j1", 4, "completed", 9), ("j1", 5, "running", 1),
            ("j2", 1, "queued", 0), ("j2", 6, "failed", 0)]
    frame = spark.createDataFrame(data, "job string, second int, status string, found int").select(
        "job", F.timestamp_seconds("second").alias("at"), "status", "found", F.floor(F.col("second") / 3).alias("_file"))
    source = stream(spark, frame, str(tmp_path / "in"))
    found = collect(progress.changes(source, "job", "at", "status", ["found"]), "progress", "append", str(tmp_path / "check"))
    sent = sorted((r["job"], r["event"], json.loads(r["payload"])["found"]) for r in found)
    assert sent == [("j1", "data", 0), ("j1", "data", 5), ("j1", "data", 9), ("j1", "done", 9), ("j2", "data", 0), ("j2", "data", 0), ("j2", "done", 0)]
    batch = jobs.progress_changes(
        frame.withColumn("payload", F.to_json(F.struct("status", "found"))).withColumn("tie", F.lit(0)), "job", "at", "tie", "payload",
        F.col("status").isin("completed", "failed"), F.date_trunc("hour", "at"))
    assert batch.where("is_change").count() == 5 and batch.where("is_done").count() == 2


def test_streaming_request_metrics(spark, tmp_path):
    data = [("get", f"/scans/{i}/events", 200, i * 40, 0.5) for i in range(30)] + [("post", "/metrics", 500, 7, 1.0)]
    frame = spark.createDataFrame(data, "method string, path string, status int, second int, duration_s double").select(
        "method", "path", "status", F.timestamp_seconds("second").alias("ts"), "duration_s", F.floor(F.col("second") / 500).alias("_file"))
    source = stream(spark, frame, str(tmp_path / "in"))
    found = collect(requests.windowed_metrics(source), "metrics", "complete", str(tmp_path / "check"))
    totals: dict = {}
    for r in found:
        key = (r["method"], r["path"], r["status"])
        totals[key] = (totals.get(key, (0, 0))[0] + r["requests"], totals.get(key, (0, 0))[1] + r["duration_s"])
    plain = {(r["method"], r["path"], r["status"]): (r["requests"], r["duration_s"]) for r in jobs.request_metrics(frame).collect()}
    assert totals == plain and ("GET", "/scans/{id}", "200") in totals


def test_job_supervision_rules(spark):
    at = F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))
    table = spark.sql("""SELECT * FROM VALUES (1, 'running', timestamp_ntz'2024-01-01 09:00:00'), (2, 'running', timestamp_ntz'2024-01-01 08:59:59'),
        (3, 'completed', timestamp_ntz'2023-01-01'), (4, 'queued', timestamp_ntz'2024-01-01 06:00:00') AS t(id, status, started_at)""")
    assert {r["id"]: r["age_hours"] for r in jobs.stale_jobs(table, at).collect()} == {2: 3.0, 4: 6.0}
    samples = spark.createDataFrame([(i, v) for i, v in enumerate([-1, 10, 20, 30, 40])], "id int, duration_ms long")
    row = jobs.duration_percentiles(samples).first()
    assert (row["p50"], row["p95"], row["sample_count"]) == (25.0, 38.5, 4)
