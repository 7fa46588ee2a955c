"""Set and operation evaluation, assignment against brute force, certificates, corpus and gates."""

from __future__ import annotations

import collections
import functools
import itertools
import random
import time

from pyspark.sql import functions as F

from proofline.operators import assign, corpus, evaluate

OPERATION = "component string, algorithm string, usage string, key_size int, line int, id int"


def ops(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], OPERATION)


def scores(spark, expected, actual, pool=("component",), weights=(101, 1)):
    counts = assign.class_counts(ops(spark, expected), ops(spark, actual), list(pool))
    return assign.metadata_scores(assign.class_pairs(counts, list(pool), weights), counts).first()


def test_usage_match_wins(spark):
    result = scores(spark, [("a", "RSA", "encryption", 256, 1)], [("a", "RSA", "encryption", 512, 1), ("a", "RSA", "signature", 256, 1)])
    assert (result["true_positives"], result["usage_correct"], result["key_size_correct"]) == (1, 1, 0)


def test_duplicates_are_false_positives(spark):
    same = ("a", "RSA", "encryption", 256, 1)
    result = scores(spark, [same], [same] * 3)
    assert (result["true_positives"], result["false_positives"], result["false_negatives"]) == (1, 2, 0)


def test_unknown_key_sizes_agree_but_are_not_known(spark):
    result = scores(spark, [("a", "RSA", "tls", None, 1), ("b", "RSA", "tls", 256, 1)], [("a", "RSA", "tls", None, 1)])
    assert (result["key_size_correct"], result["known_key_size_correct"], result["known_key_size_denominator"]) == (1, 0, 1)


def best(expected, actual, usage_weight, key_weight):
    """Highest total score over every pairing of the smaller side."""
    small, large = sorted((expected, actual), key=len)
    totals = [
        sum(usage_weight * (s[2] == o[2]) + key_weight * (s[3] == o[3]) for s, o in zip(small, chosen))
        for chosen in itertools.permutations(large, len(small))
    ]
    return max(totals, default=0)


def test_assignment_reaches_the_best_total_score(spark):
    chance = random.Random(11)
    expected, actual, wanted, wanted_joint = [], [], {}, {}
    for pool in range(60):
        sides = [
            [(f"p{pool}", "RSA", chance.choice("uvw"), chance.choice([None, 1, 2]), 1) for _ in range(chance.randrange(6))] for _ in range(2)
        ]
        expected += sides[0]
        actual += sides[1]
        size = min(len(sides[0]), len(sides[1]))
        wanted[f"p{pool}"] = best(*sides, 101, 1)
        wanted_joint[f"p{pool}"] = best(*sides, size + 2, size + 1)
        wanted_joint[f"n{pool}"] = size
    counts = assign.class_counts(ops(spark, expected), ops(spark, actual), ["component"])
    for weights, target in (((101, 1), wanted), (None, wanted_joint)):
        totals: dict = {}
        pairs: dict = {}
        for r in assign.class_pairs(counts, ["component"], weights).collect():
            size = wanted_joint[r["component"].replace("p", "n")]
            u, k = weights or (size + 2, size + 1)
            gain = u * (r["usage"] == r["actual_usage"]) + k * (r["key_size"] == r["actual_key_size"])
            totals[r["component"]] = totals.get(r["component"], 0) + gain * r["pairs"]
            pairs[r["component"]] = pairs.get(r["component"], 0) + r["pairs"]
        for pool in range(60):
            assert totals.get(f"p{pool}", 0) == target[f"p{pool}"]
            assert pairs.get(f"p{pool}", 0) == wanted_joint[f"n{pool}"]


def test_unmatched_lists(spark):
    expected = ops(spark, [("a", "RSA", "tls", 1, 9), ("a", "RSA", "tls", 1, 3), ("b", "AES", "tls", None, 1)])
    actual = ops(spark, [("a", "RSA", "tls", 1, 5)])
    pairs, _ = evaluate.pool_pairs(expected, actual, ["component"])
    missed = evaluate.unmatched(expected, pairs, ["component"], "expected", [F.col("line"), F.col("id")])
    assert sorted((r["component"], r["line"]) for r in missed.collect()) == [("a", 9), ("b", 1)]
    assert evaluate.unmatched(actual, pairs, ["component"], "actual", [F.col("line"), F.col("id")]).count() == 0


def test_set_metrics_without_findings(spark):
    none = ops(spark, [])
    result = evaluate.set_metrics(evaluate.pair_status(ops(spark, [("a", "RSA", "tls", 1, 1)]), none)).first()
    assert (result["precision"], result["recall"], result["f1"]) == (0.0, 0.0, 0.0)
    result = evaluate.set_metrics(evaluate.pair_status(none, none)).first()
    assert (result["precision"], result["recall"]) == (0.0, 1.0)


def test_determinism(spark):
    one = spark.range(100)
    assert evaluate.is_deterministic([one, one.repartition(7)])
    assert not evaluate.is_deterministic([one, one.where("id <> 5")])
    assert not evaluate.is_deterministic([one.unionAll(one.limit(1)), one.unionAll(one.where("id = 99"))])


def test_certificates(spark):
    found = spark.createDataFrame([
        ("certs/server.crt", 2, 2048, "2026-01-01"), ("certs/server.crt", 1, 1024, "2026-01-01"), ("deep/Client.crt", 3, 2048, "2025-01-01"),
        ("x/archive-old.crt.bak", 4, 256, ""),
    ], "component string, finding_order int, key_size int, not_after string")
    wanted = spark.createDataFrame([
        ("certs/server.crt", 2048, "2026-01-01"), ("certs/client.crt", 2048, "2026-01-01"), ("old.crt", 256, ""), ("none.crt", 1, ""),
    ], "component string, key_size int, not_after string")
    issues = evaluate.certificate_issues(evaluate.certificate_matches(found, wanted))
    assert {r["component"]: r["issue"] for r in issues.collect()} == {
        "certs/server.crt": "key_size mismatch: expected 2048, found 1024",
        "certs/client.crt": "not_after mismatch: expected 2026-01-01, found 2025-01-01", "old.crt": None, "none.crt": "certificate_not_found",
    }
    assert evaluate.certificate_accuracy(issues).first()["certificate_accuracy"] == 0.25


def test_corpus_case_rules_and_gates(spark):
    cases = spark.createDataFrame([("p1", "go", "positive"), ("p2", "go", "positive"), ("n1", "go", "negative"), ("n2", "c", "negative")],
                                  "case_id string, language string, type string")
    labels = spark.createDataFrame([("p1", "AES"), ("p1", "RSA"), ("p2", "AES")], "case_id string, algorithm string")
    seen = spark.createDataFrame([("p1", "AES"), ("p1", "AES"), ("p1", "MD5"), ("n2", "TLS")], "case_id string, algorithm string")
    results = corpus.case_results(cases, labels, seen)
    rows = {r["case_id"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in results.collect()}
    assert rows == {"p1": (1, 1, 1, 0.5, 0.5, 0.5), "p2": (0, 0, 1, 0.0, 0.0, 0.0), "n1": (0, 0, 0, 1.0, 1.0, 1.0), "n2": (0, 1, 0, 0.0, 1.0, 0.0)}
    overall = corpus.aggregate_cases(results)
    assert overall.first()["negative_accuracy"] == 0.5
    gates = {r["gate"]: r["passed"] for r in corpus.check_gates(overall.drop("micro_recall"), previous={"micro_precision": 0.52}).collect()}
    assert gates == {"micro_precision_minimum": False, "macro_precision_minimum": False, "micro_recall_minimum": False,
                     "negative_accuracy_minimum": False, "micro_precision_drop": True}


def test_split_keeps_both_sides(spark):
    rows = spark.createDataFrame([(f, i) for f, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)], "algorithm_family string, corpus_id int")
    split = corpus.stratified_split(rows).groupBy("algorithm_family").pivot("split", ["train", "holdout"]).count().fillna(0)
    assert {r["algorithm_family"]: (r["train"], r["holdout"]) for r in split.collect()} == {"a": (0, 1), "b": (1, 1), "c": (7, 3)}
    assert sorted(corpus.stratified_split(rows).collect()) == sorted(corpus.stratified_split(rows.repartition(3)).collect())


def test_corpus_entry_errors(spark):
    rows = spark.createDataFrame([("c", "go", "RSA", "u", "ab" * 20, "f", "cd" * 32, 1, 2, True, "l", "sign"),
                                  ("c", "go", "XYZ", "u", "zz", "f", "cd", 3, 3, None, "l", "guess")],
                                 "corpus_id string, language string, algorithm_family string, repo_url string, commit_sha string, file_path string, "
                                 "file_sha256 string, line_start int, line_end int, positive boolean, label string, operation string")
    errors = [r["errors"] for r in corpus.entry_errors(rows).collect()]
    assert errors[0] == [] and set(errors[1]) == {"missing:positive", "line_range", "file_sha256", "commit_sha", "operation", "algorithm_family"}
    assert {r["gate"]: r["passed"] for r in corpus.corpus_gates(rows.fillna(False), full=False).collect()} == {"families_covered": False, "duplicate_ids": False}


def brute_total(demand, supply, usage_weight, key_weight):
    """The highest total of a pairing, by trying every partner for each expected operation in turn."""
    left = [k for k, n in sorted(demand.items()) for _ in range(n)]

    @functools.lru_cache(maxsize=None)
    def best(i, rest):
        if i == len(left):
            return 0
        found = best(i + 1, rest)
        for k, n in rest:
            if n:
                after = tuple((q, m - (q == k)) for q, m in rest)
                found = max(found, (left[i][0] == k[0]) * usage_weight + (left[i][1] == k[1]) * key_weight + best(i + 1, after))
        return found

    return best(0, tuple(sorted(supply.items())))


def test_best_flow_reaches_the_highest_total():
    rng = random.Random(8)
    for _ in range(150):
        sides = [collections.Counter((rng.choice("abc"), rng.choice([-1, 128, 256])) for _ in range(rng.randint(0, 6))) for _ in range(2)]
        both = sides[0] & sides[1]
        demand, supply = dict(sides[0] - both), dict(sides[1] - both)
        weights = rng.choice([(101, 1), (3, 2), (8, 7)])
        pairs = assign.best_flow(dict(demand), dict(supply), *weights)
        total = sum(n * ((e[0] == a[0]) * weights[0] + (e[1] == a[1]) * weights[1]) for e, a, n in pairs)
        assert total == brute_total(demand, supply, *weights)
        assert sum(n for _, _, n in pairs) == min(sum(demand.values()), sum(supply.values()))
        for side, counts in ((0, demand), (1, supply)):
            used = collections.Counter()
            for pair in pairs:
                used[pair[side]] += pair[2]
            assert all(used[k] <= counts[k] for k in used)


def test_best_flow_of_thousands_of_classes():
    rng = random.Random(9)
    classes = [{(f"u{rng.randrange(300)}", rng.randrange(3_000)): rng.randint(1, 9) for _ in range(2_500)} for _ in range(2)]
    started = time.time()
    pairs = assign.best_flow(*[dict(c) for c in classes], 101, 1)
    assert time.time() - started < 30
    assert sum(n for _, _, n in pairs) == min(sum(c.values()) for c in classes)
