from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import queries, sharding


def shuffled(docs, shards, seed=0):
    return sharding.shuffle_into_shards(docs, shards, ["doc_id", "text"], seed)


def test_hypergeometric_has_the_exact_law():
    rng = np.random.default_rng(1)
    good, bad, draws, n = 7, 9, 6, 20_000
    seen = np.bincount([sharding.hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=draws + 1) / n
    law = [math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(draws + 1)]
    assert np.abs(seen - law).max() < 0.015


@pytest.mark.parametrize("good,bad,draws", [(0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10), (10**11, 10**12, 10**6), (10**12, 3, 10**9)])
def test_hypergeometric_at_the_edges(good, bad, draws):
    value = sharding.hypergeometric(np.random.default_rng(2), good, bad, draws)
    assert max(0, draws - bad) <= value <= min(good, draws)
    assert abs(value - draws * good / (good + bad)) <= 20 * math.sqrt(draws) + 1


def test_matrix_sums():
    counts, sizes = [5, 0, 17, 3, 1], sharding.shard_sizes(26, 4)
    matrix = np.array(sharding.communication_matrix(counts, sizes, 5))
    assert matrix.sum(1).tolist() == counts and matrix.sum(0).tolist() == sizes and matrix.min() >= 0


def test_shards_are_exact_gapless_and_independent_of_layout(documents):
    rows = [(i, f"text {i % 40}") for i in range(500)] + [(None, None)] * 3 + [(7, "text 7")]
    docs = documents(rows, extra=("_p", "_ends", "slot_", "_row"))
    first = shuffled(docs, 7).collect()
    again = shuffled(docs.repartition(3), 7).collect()
    place = lambda rows: sorted((r.shard, r.slot, str(r.doc_id), r.text) for r in rows)
    assert place(first) == place(again) != place(shuffled(docs, 7, seed=1).collect())
    assert sorted((str(r.doc_id), str(r.text)) for r in first) == sorted((str(d), str(t)) for d, t in rows)
    for shard in range(7):
        slots = sorted(r.slot for r in first if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (72, 73) and set(docs.columns) < set(first[0].asDict())


def test_ranges_of_a_shard_join_without_gaps(documents, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 10)
    found = shuffled(documents([(i, "same") for i in range(300)]), 2).collect()
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in range(2) for i in range(150)]


def test_rows_are_spread_evenly(documents):
    docs = documents([(i, None) for i in range(400)])
    where = {}
    for seed in range(12):
        for r in shuffled(docs, 4, seed).collect():
            where.setdefault(r.doc_id, []).append(r.shard)
    counts = np.bincount(np.concatenate(list(where.values())), minlength=4)
    assert counts.tolist() == [1200] * 4
    together = sum(a == b for v in where.values() for a, b in zip(v, v[1:])) / (400 * 11)
    assert abs(together - 0.25) < 0.03


def test_empty_table_and_fewer_rows_than_shards(documents):
    assert shuffled(documents([]), 5).count() == 0
    assert sorted((r.shard, r.slot) for r in shuffled(documents([(1, "a"), (2, "b")]), 5).collect()) == [(0, 0), (1, 0)]


def test_written_shards(documents, spark, tmp_path):
    sharding.write_shards(documents([(i, str(i)) for i in range(50)]), f"{tmp_path}/s", 3, ["doc_id"])
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().collect()) == [16, 17, 17]


def test_the_query_deals_whole_texts_and_takes_its_digests_from_them(documents, spark, tmp_path, monkeypatch):
    documents([(i, f"text {i}") for i in range(60)] + [(None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op6_sharding"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {(i, len(f"text {i}") + 8, zlib.crc32(f"text {i}".encode())) for i in range(60)} | {(None, 8, 0)}
    deal = sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda *a: deal(*a).withColumn("text", F.concat(F.lit("dealt "), "text")))
    found = queries.QUERIES["op6_sharding"](spark, str(tmp_path)).where("doc_id = 7").collect()
    assert [(r.size, r.text_crc32) for r in found] == [(20, zlib.crc32(b"dealt text 7"))]


def test_rows_move_twice(documents, spark):
    plan = shuffled(documents([(i, str(i)) for i in range(50)]), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == plan.count("Join Inner") > 0
