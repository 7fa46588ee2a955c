"""Queries over evaluation against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.operators import corpus, correlate, evaluate, report
from proofline.operators.assign import class_counts, class_pairs, metadata_scores
from proofline.plans.correlation import scored
from proofline.plans.registry import query
from proofline.plans.views import Tables

USAGE = "CASE usage_raw WHEN 'sign' THEN 'signature' ELSE usage_raw END"
STATUS = """
(SELECT component, algorithm, bool_or(e) AS is_expected, bool_or(a) AS is_found FROM
 (SELECT component, algorithm, true AS e, false AS a FROM v_truth UNION ALL SELECT component, algorithm, false, true FROM v_evidence) GROUP BY ALL)"""
TRUTH_OPS = f"(SELECT truth_id, component, algorithm, {USAGE} AS usage, key_size, line FROM v_truth)"
FOUND_OPS = f"(SELECT component, algorithm, {USAGE} AS usage, key_size, line_start AS line FROM v_evidence)"


def expected_ops(t: Tables) -> DataFrame:
    return t.view("v_truth").select("truth_id", "component", "algorithm", E.usage_alias("usage_raw").alias("usage"), "key_size", "line")


def actual_ops(t: Tables) -> DataFrame:
    return t.view("v_evidence").select(
        "component", "algorithm", E.usage_alias("usage_raw").alias("usage"), "key_size", F.col("line_start").alias("line"), "src_order", "src_line"
    )


def status(t: Tables) -> DataFrame:
    return evaluate.pair_status(t.view("v_truth"), t.view("v_evidence"))


@query("v01_set_metrics", f"""
SELECT expected, found, tp AS true_positives, found - tp AS false_positives, expected - tp AS false_negatives, round(tp / found, 4) AS precision, round(tp / expected, 4) AS recall,
       round(2 * (tp / found) * (tp / expected) / (tp / found + tp / expected), 4) AS f1
FROM (SELECT count_if(is_expected) AS expected, count_if(is_found) AS found, count_if(is_expected AND is_found) AS tp FROM {STATUS})""")
def v01(t: Tables) -> DataFrame:
    return evaluate.set_metrics(status(t))


@query("v01_missed_pairs", f"SELECT component, algorithm FROM {STATUS} WHERE is_expected AND NOT is_found")
def v01_missed(t: Tables) -> DataFrame:
    return evaluate.missed_pairs(status(t))


@query("v01_unexpected_pairs", f"SELECT component, algorithm FROM {STATUS} WHERE is_found AND NOT is_expected")
def v01_unexpected(t: Tables) -> DataFrame:
    return evaluate.unexpected_pairs(status(t))


@query("v02_source_metrics", """
SELECT source, count(*) AS findings, count(t.component) AS true_positives, round(count(t.component) / count(*), 4) AS precision,
       round(count(t.component) / (SELECT count(*) FROM (SELECT DISTINCT component, algorithm FROM v_truth)), 4) AS recall
FROM (SELECT DISTINCT source, component, algorithm FROM v_evidence) e LEFT JOIN (SELECT DISTINCT component, algorithm FROM v_truth) t ON e.component = t.component AND e.algorithm = t.algorithm GROUP BY source""")
def v02(t: Tables) -> DataFrame:
    return evaluate.source_set_metrics(t.view("v_truth"), t.view("v_evidence"))


@query("v03_alias_resolution", """
SELECT CASE algorithm WHEN 'RSA-2048' THEN 'RSA' WHEN 'ECDH' THEN 'ECDSA' ELSE algorithm END AS algorithm, count(*) AS records FROM v_evidence GROUP BY 1""")
def v03(t: Tables) -> DataFrame:
    pairs = t.spark.createDataFrame([(["RSA", "RSA-2048"],), (["ECDSA", "ECDH"],), (["AES"],)], "algorithms array<string>")
    return evaluate.resolve_aliases(t.view("v_evidence"), evaluate.alias_table(pairs)).groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("records")
    )


@query("v04_field_fallbacks", """
SELECT src_order, src_line, CASE usage_raw WHEN 'sign' THEN 'signature' WHEN 'encryption' THEN 'encryption' ELSE CASE WHEN category = 'key_exchange' THEN 'key_establishment' WHEN category = 'hash' THEN 'hashing' ELSE category END END AS usage,
       coalesce(key_size, line_start) AS key_size FROM v_evidence""")
def v04(t: Tables) -> DataFrame:
    """Usage and key size from three places: the finding, its evidence, its evidence items."""
    rows = t.view("v_evidence")
    direct = F.when(F.col("usage_raw") == "sign", F.lit(" Sign "))
    nested = F.when(F.col("usage_raw") == "encryption", F.col("usage_raw")).otherwise("")
    items = F.array(
        F.struct(F.lit("").alias("usage"), F.lit("large").alias("key_size")),
        F.struct(F.col("category").alias("usage"), F.col("line_start").cast("string").alias("key_size")),
    )
    usage = evaluate.extracted_usage(direct, nested, items)
    number = evaluate.extracted_number(F.lit("n/a"), F.col("key_size"), items, "key_size")
    return rows.select("src_order", "src_line", usage.alias("usage"), number.alias("key_size"))


def pool_check(pool: str) -> str:
    return f"""
SELECT CAST(sum(e) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS found, CAST(sum(least(e, a)) AS BIGINT) AS true_positives, CAST(sum(a - least(e, a)) AS BIGINT) AS false_positives,
       CAST(sum(e - least(e, a)) AS BIGINT) AS false_negatives, round(sum(least(e, a)) / sum(a), 4) AS precision, round(sum(least(e, a)) / sum(e), 4) AS recall,
       round(2 * sum(least(e, a)) / (sum(a) + sum(e)), 4) AS f1
FROM (SELECT {pool}, sum(e) AS e, sum(a) AS a FROM (SELECT component, algorithm, 1 AS e, 0 AS a FROM v_truth UNION ALL SELECT component, algorithm, 0, 1 FROM v_evidence) GROUP BY {pool})"""


@query("v05_operation_counts", pool_check("component, algorithm"))
def v05(t: Tables) -> DataFrame:
    return evaluate.operation_metrics(evaluate.operation_counts(expected_ops(t), actual_ops(t), ["component", "algorithm"]))


@query("v05_component_counts", pool_check("component"))
def v05_component(t: Tables) -> DataFrame:
    return evaluate.operation_metrics(evaluate.operation_counts(expected_ops(t), actual_ops(t), ["component"]))


@query("v06_assignment", f"""
SELECT component, algorithm, CAST(least(e, a) AS BIGINT) AS pairs FROM
 (SELECT component, algorithm, sum(e) AS e, sum(a) AS a FROM (SELECT component, algorithm, 1 AS e, 0 AS a FROM {TRUTH_OPS} UNION ALL SELECT component, algorithm, 0, 1 FROM {FOUND_OPS}) GROUP BY ALL) WHERE e > 0 AND a > 0""")
def v06(t: Tables) -> DataFrame:
    """Pairs per pool from the class-level assignment; the check knows how many there must be."""
    pairs, _ = evaluate.pool_pairs(expected_ops(t), actual_ops(t), ["component", "algorithm"])
    return pairs.groupBy("component", "algorithm").agg(F.sum("pairs").alias("pairs"))


@query("v07_usage_correct", f"""
SELECT CAST(sum(least(e, a)) AS BIGINT) AS usage_correct FROM (SELECT component, algorithm, usage, sum(e) AS e, sum(a) AS a FROM
 (SELECT component, algorithm, usage, 1 AS e, 0 AS a FROM {TRUTH_OPS} UNION ALL SELECT component, algorithm, usage, 0, 1 FROM {FOUND_OPS}) GROUP BY ALL)""")
def v07(t: Tables) -> DataFrame:
    pool = ["component", "algorithm"]
    counts = class_counts(expected_ops(t), actual_ops(t), pool)
    return metadata_scores(class_pairs(counts, pool), counts).select("usage_correct")


@query("v07_metadata_scores")
def v07_scores(t: Tables) -> DataFrame:
    pool = ["component", "algorithm"]
    counts = class_counts(expected_ops(t), actual_ops(t), pool)
    return metadata_scores(class_pairs(counts, pool), counts)


@query("v08_missed_operations", f"""
SELECT component, algorithm, CAST(greatest(0, e - a) AS BIGINT) AS missed FROM
 (SELECT component, algorithm, sum(e) AS e, sum(a) AS a FROM (SELECT component, algorithm, 1 AS e, 0 AS a FROM {TRUTH_OPS} UNION ALL SELECT component, algorithm, 0, 1 FROM {FOUND_OPS}) GROUP BY ALL) WHERE e > a""")
def v08(t: Tables) -> DataFrame:
    pool, expected = ["component", "algorithm"], expected_ops(t)
    pairs, _ = evaluate.pool_pairs(expected, actual_ops(t), pool)
    missed = evaluate.unmatched(expected, pairs, pool, "expected", [F.col("line"), F.col("truth_id")])
    return missed.groupBy(*pool).agg(F.count(F.lit(1)).alias("missed"))


@query("v08_unexpected_operations", f"""
SELECT component, algorithm, CAST(greatest(0, a - e) AS BIGINT) AS unexpected FROM
 (SELECT component, algorithm, sum(e) AS e, sum(a) AS a FROM (SELECT component, algorithm, 1 AS e, 0 AS a FROM {TRUTH_OPS} UNION ALL SELECT component, algorithm, 0, 1 FROM {FOUND_OPS}) GROUP BY ALL) WHERE a > e""")
def v08_unexpected(t: Tables) -> DataFrame:
    pool, actual = ["component", "algorithm"], actual_ops(t)
    pairs, _ = evaluate.pool_pairs(expected_ops(t), actual, pool)
    order = [F.col("line"), F.col("src_order"), F.col("src_line"), F.monotonically_increasing_id()]
    extra = evaluate.unmatched(actual, pairs, pool, "actual", order[:3])
    return extra.groupBy(*pool).agg(F.count(F.lit(1)).alias("unexpected"))


def identity_check(by: str, keys: str, where: str = "") -> str:
    by_select = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {by_select}CAST(sum(e) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS found, CAST(sum(least(e, a)) AS BIGINT) AS true_positives, CAST(sum(a - least(e, a)) AS BIGINT) AS false_positives,
       CAST(sum(e - least(e, a)) AS BIGINT) AS false_negatives, round(sum(least(e, a)) / nullif(sum(a), 0), 6) AS precision, round(sum(least(e, a)) / nullif(sum(e), 0), 6) AS recall,
       round(CASE WHEN sum(least(e, a)) > 0 THEN 2 * sum(least(e, a)) / (sum(a) + sum(e)) END, 6) AS f1
FROM (SELECT {keys}, sum(e) AS e, sum(a) AS a FROM (SELECT component, line, algorithm, 1 AS e, 0 AS a FROM {TRUTH_OPS} UNION ALL SELECT component, line, algorithm, 0, 1 FROM {FOUND_OPS}) {where} GROUP BY {keys}) {group}"""


@query("v09_identity_comparison", identity_check("", "component, line, algorithm"))
def v09(t: Tables) -> DataFrame:
    return evaluate.identity_comparison(expected_ops(t), actual_ops(t), ["component", "line", "algorithm"])


@query("v10_finding_line", """
SELECT location, algorithm, usage_raw, CASE WHEN count(DISTINCT line_start) = 1 THEN min(line_start) END AS line FROM v_evidence GROUP BY location, algorithm, usage_raw""")
def v10(t: Tables) -> DataFrame:
    rows = t.view("v_evidence").withColumn("group", F.struct("location", "algorithm", "usage_raw"))
    return evaluate.finding_line(rows, "group").select("group.*", "line")


TAXONOMY = ("RSA", "AES", "ECDSA", "DSA")


@query("v11_taxonomy_slices", f"""
{identity_check("component", "component, line, algorithm", "WHERE algorithm IN ('RSA', 'AES', 'ECDSA', 'DSA')")}
UNION ALL SELECT 'mixed' AS component, * FROM ({identity_check("", "component, line, algorithm", "WHERE algorithm IN ('RSA', 'AES', 'ECDSA', 'DSA')")})""")
def v11(t: Tables) -> DataFrame:
    return evaluate.identity_comparison_with_total(
        evaluate.in_taxonomy(expected_ops(t), TAXONOMY), evaluate.in_taxonomy(actual_ops(t), TAXONOMY), ["line", "algorithm"], "component"
    )


def evidence_runs(t: Tables) -> list[DataFrame]:
    """Evidence as read, and twice dealt by other keys over as many tasks: by category alone, or over three, a task could hold any number of rows."""
    given, tasks = t.view("v_evidence"), t.tasks("v_evidence")
    return [given, given.repartition(tasks, "category", "src_order"), given.repartition(tasks + 1, "src_line", "src_order")]


@query("v12_determinism", "SELECT (SELECT count(*) FROM v_findings) AS rows, 1 AS distinct_digests")
def v12(t: Tables) -> DataFrame:
    """Fingerprints of three runs, two over reordered input; equal runs have one distinct digest."""
    prints = None
    for run in evidence_runs(t):
        row = evaluate.fingerprint(correlate.findings(run).drop("sources", "confidence_by_source", "conflict_fields"))
        prints = row if prints is None else prints.unionByName(row)
    return prints.groupBy().agg(F.max("rows").alias("rows"), F.countDistinct("rows", "digest", "total").alias("distinct_digests"))


CERT_WANTED = """
(SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN concat('certs/s', CAST(n_nationkey AS VARCHAR), '.crt') WHEN 1 THEN concat('other/S', CAST(n_nationkey AS VARCHAR), '.crt')
   WHEN 2 THEN concat('s', CAST(n_nationkey AS VARCHAR), '.c') ELSE 'absent' END AS component, 2048 AS key_size, '2026-01-01' AS not_after FROM nation)"""


def certificate_issues(t: Tables) -> DataFrame:
    wanted = t.sql(f"SELECT * FROM {CERT_WANTED} w")
    return evaluate.certificate_issues(evaluate.certificate_matches(t.view("v_certs"), wanted))


CERT_BEST = f"""
(SELECT w.*, coalesce((SELECT min(finding_order) FROM v_certs c WHERE c.component = w.component),
   (SELECT min(finding_order) FROM v_certs c WHERE lower(split_part(c.component, '/', -1)) = lower(split_part(w.component, '/', -1))),
   (SELECT min(finding_order) FROM v_certs c WHERE contains(lower(c.component), lower(split_part(w.component, '/', -1))))) AS best FROM {CERT_WANTED} w)"""
CERT_ISSUES = f"""
(SELECT b.n_nationkey, CASE WHEN best IS NULL THEN 'certificate_not_found' ELSE nullif(concat_ws('; ',
   CASE WHEN c.key_size IS DISTINCT FROM b.key_size THEN concat('key_size mismatch: expected ', CAST(b.key_size AS VARCHAR), ', found ', coalesce(CAST(c.key_size AS VARCHAR), 'None')) END,
   CASE WHEN c.not_after <> b.not_after THEN concat('not_after mismatch: expected ', b.not_after, ', found ', c.not_after) END), '') END AS issue
 FROM {CERT_BEST} b LEFT JOIN v_certs c ON b.best = c.finding_order)"""


@query("v13_certificate_issues", f"SELECT n_nationkey, issue FROM {CERT_ISSUES}")
def v13(t: Tables) -> DataFrame:
    return certificate_issues(t).select("n_nationkey", "issue")


@query("v13_certificate_accuracy", f"""
SELECT count(*) AS total_expected, count_if(issue IS NULL) AS matched, round(count_if(issue IS NULL) / count(*), 4) AS certificate_accuracy FROM {CERT_ISSUES}""")
def v13_accuracy(t: Tables) -> DataFrame:
    return evaluate.certificate_accuracy(certificate_issues(t))


# --- corpus -----------------------------------------------------------------------------------------

CASE_ROWS = """
(SELECT case_id, language, type, tp, CASE WHEN type = 'negative' THEN found ELSE fp END AS fp, CASE WHEN type = 'negative' THEN 0 ELSE fn END AS fn, found,
   round(CASE WHEN type = 'negative' THEN CASE WHEN found > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END WHEN found = 0 THEN 0.0::DOUBLE ELSE tp / found END, 4) AS precision,
   round(CASE WHEN type = 'negative' THEN 1.0::DOUBLE ELSE tp / expected END, 4) AS recall,
   round(CASE WHEN type = 'negative' THEN CASE WHEN found > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (found + expected) END, 4) AS f1
 FROM (SELECT case_id, language, type, CASE WHEN type = 'negative' THEN 0 ELSE 2 END AS expected, CASE WHEN found_key = 6 THEN 0 ELSE 1 END AS found,
        CASE WHEN type = 'positive' AND found_key <> 6 AND found_key IN (expected_key, expected_key + 1) THEN 1 ELSE 0 END AS tp,
        CASE WHEN found_key <> 6 AND found_key NOT IN (expected_key, expected_key + 1) THEN 1 ELSE 0 END AS fp,
        2 - CASE WHEN found_key <> 6 AND found_key IN (expected_key, expected_key + 1) THEN 1 ELSE 0 END AS fn FROM v_cases))"""


def case_results(t: Tables) -> DataFrame:
    """Two labels per positive case; each case reports one algorithm, twice, or none."""
    cases = t.view("v_cases")
    labels = cases.where("type = 'positive'").select("case_id", F.explode(F.array("expected_key", F.col("expected_key") + 1)).alias("algorithm"))
    reported = cases.where("found_key <> 6").select("case_id", F.explode(F.array("found_key", "found_key")).alias("algorithm"))
    return corpus.case_results(cases.select("case_id", "language", "type"), labels, reported)


@query("v14_case_results", f"SELECT case_id, type, tp, fp, fn, found, precision, recall, f1 FROM {CASE_ROWS}")
def v14(t: Tables) -> DataFrame:
    return case_results(t).select("case_id", "type", "tp", "fp", "fn", "found", "precision", "recall", "f1")


AGGREGATES = """
round(coalesce(avg(precision) FILTER (type = 'positive'), 0), 4) AS macro_precision, round(coalesce(avg(recall) FILTER (type = 'positive'), 0), 4) AS macro_recall,
round(coalesce(avg(f1) FILTER (type = 'positive'), 0), 4) AS macro_f1,
round(sum(tp) FILTER (type = 'positive') / sum(tp + fp) FILTER (type = 'positive'), 4) AS micro_precision, round(sum(tp) FILTER (type = 'positive') / sum(tp + fn) FILTER (type = 'positive'), 4) AS micro_recall,
round(2 * sum(tp) FILTER (type = 'positive') / sum(2 * tp + fp + fn) FILTER (type = 'positive'), 4) AS micro_f1,
CAST(sum(tp) FILTER (type = 'positive') AS BIGINT) AS total_true_positives, CAST(sum(fp) FILTER (type = 'positive') AS BIGINT) AS total_false_positives, CAST(sum(fn) FILTER (type = 'positive') AS BIGINT) AS total_false_negatives,
round(count_if(type = 'negative' AND found = 0) / count_if(type = 'negative'), 4) AS negative_accuracy, count_if(type = 'negative' AND found = 0) AS negative_correct, count_if(type = 'negative') AS negative_total,
count(*) AS case_count, count_if(type = 'positive') AS positive_cases"""


@query("v15_corpus_metrics", f"SELECT {AGGREGATES} FROM {CASE_ROWS}")
def v15(t: Tables) -> DataFrame:
    return corpus.aggregate_cases(case_results(t))


@query("v16_language_slices", f"SELECT language, {AGGREGATES} FROM {CASE_ROWS} GROUP BY language UNION ALL SELECT 'all' AS language, {AGGREGATES} FROM {CASE_ROWS}")
def v16(t: Tables) -> DataFrame:
    return corpus.aggregate_with_total(case_results(t))


@query("v17_quality_gates", f"""
SELECT gate, value, bound, CASE WHEN gate LIKE '%_minimum' THEN value >= bound ELSE value <= bound END AS passed FROM (
 SELECT unnest([{{'gate': 'micro_precision_minimum', 'value': micro_precision, 'bound': 0.75::DOUBLE}}, {{'gate': 'macro_precision_minimum', 'value': macro_precision, 'bound': 0.7::DOUBLE}},
  {{'gate': 'micro_recall_minimum', 'value': micro_recall, 'bound': 0.95::DOUBLE}}, {{'gate': 'negative_accuracy_minimum', 'value': negative_accuracy, 'bound': 0.9167::DOUBLE}},
  {{'gate': 'micro_recall_drop', 'value': round(0.2 - micro_recall, 6), 'bound': 0.02::DOUBLE}}], recursive := true) FROM (SELECT {AGGREGATES} FROM {CASE_ROWS}))""")
def v17(t: Tables) -> DataFrame:
    return corpus.check_gates(corpus.aggregate_cases(case_results(t)), previous={"micro_recall": 0.2})


@query("v18_families", """
SELECT CASE algorithm WHEN 'AES' THEN 'symmetric' WHEN 'RSA' THEN 'asymmetric' WHEN 'ECDSA' THEN 'asymmetric' WHEN 'ECDH' THEN 'key_exchange' WHEN 'ML-KEM' THEN 'key_exchange'
   WHEN 'SHA-256' THEN 'hash' WHEN 'MD5' THEN 'hash' WHEN 'HMAC' THEN 'mac' ELSE 'unknown' END AS family, count(*) AS records FROM v_evidence GROUP BY 1""")
def v18(t: Tables) -> DataFrame:
    return corpus.with_family(t.view("v_evidence")).groupBy("family").agg(F.count(F.lit(1)).alias("records"))


def corpus_rows(t: Tables) -> DataFrame:
    """The corpus view with the remaining required fields filled in, so that errors are row-specific."""
    return t.view("v_corpus").withColumns({
        "repo_url": F.lit("https://example.org/r"), "file_path": F.lit("src/a"), "label": F.lit("l"),
        "file_sha256": F.sha2("corpus_id", 256), "commit_sha": F.sha1("commit_sha"),
    })


@query("v19_entry_errors", """
SELECT doc_id, concat_ws(',', CASE WHEN line_start >= line_end THEN 'line_range' END, CASE WHEN operation = 'bad_op' THEN 'operation' END) AS errors FROM v_corpus""")
def v19(t: Tables) -> DataFrame:
    return corpus.entry_errors(corpus_rows(t)).select("doc_id", F.concat_ws(",", "errors").alias("errors"))


@query("v20_corpus_gates", """
SELECT gate, value, bound, CASE WHEN gate = 'duplicate_ids' THEN value <= bound ELSE value >= bound END AS passed FROM (
 SELECT 'positive_count' AS gate, count_if(positive) AS value, 150::BIGINT AS bound FROM v_corpus UNION ALL SELECT 'negative_count', count_if(NOT positive), 150 FROM v_corpus
 UNION ALL SELECT 'language_count', count(DISTINCT language), 4 FROM v_corpus UNION ALL SELECT 'smallest_family', min(n), 20 FROM (SELECT count(*) AS n FROM v_corpus GROUP BY algorithm_family)
 UNION ALL SELECT 'families_covered', count(DISTINCT algorithm_family), 9 FROM v_corpus
 UNION ALL SELECT 'duplicate_ids', count(*), 0 FROM (SELECT corpus_id FROM v_corpus GROUP BY corpus_id HAVING count(*) > 1))""")
def v20(t: Tables) -> DataFrame:
    return corpus.corpus_gates(t.view("v_corpus"))


@query("v20_family_breakdown", """
SELECT algorithm_family, count_if(positive) AS positive_count, count_if(NOT positive) AS negative_count, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM v_corpus GROUP BY algorithm_family""")
def v20_families(t: Tables) -> DataFrame:
    return corpus.family_breakdown(t.view("v_corpus"))


@query("v21_holdout_split", """
SELECT doc_id, algorithm_family, CASE WHEN nth <= CASE WHEN n >= 2 THEN least(greatest(floor(n * 0.7::DOUBLE), 1), n - 1) ELSE floor(n * 0.7::DOUBLE) END THEN 'train' ELSE 'holdout' END AS split FROM
 (SELECT doc_id, algorithm_family, row_number() OVER (PARTITION BY algorithm_family ORDER BY md5(concat('26164:', CAST(doc_id AS VARCHAR))), doc_id) AS nth, count(*) OVER (PARTITION BY algorithm_family) AS n FROM v_corpus)""")
def v21(t: Tables) -> DataFrame:
    return corpus.stratified_split(t.view("v_corpus").select("doc_id", "algorithm_family"), key="doc_id")


@query("v22_detector_floors", """
SELECT slice, tested, good, floor, round(good / tested, 4) AS value, good / tested >= floor AS passed FROM (
 SELECT algorithm_family AS slice, count(*) AS tested, count_if(line_start % 5 <> 0) AS good, 0.7::DOUBLE AS floor FROM v_corpus WHERE positive GROUP BY 1
 UNION ALL SELECT 'negatives', count(*), count_if(line_start % 5 = 0), 0.6::DOUBLE FROM v_corpus WHERE NOT positive)""")
def v22(t: Tables) -> DataFrame:
    return corpus.detector_floors(t.view("v_corpus").withColumn("detected", F.col("line_start") % 5 != 0))


@query("v23_row_errors", """
SELECT finding_id, concat_ws(',', CASE WHEN usage = 'unknown' THEN 'missing:usage' END, CASE WHEN exposure = 'partner' THEN 'value:exposure' END, CASE WHEN confidence > 0.85 THEN 'range:confidence' END) AS errors FROM v_scored""")
def v23(t: Tables) -> DataFrame:
    """Scored findings with three kinds of damage."""
    damaged = scored(t).withColumns({
        "usage": F.nullif("usage", F.lit("unknown")), "exposure": F.when(F.col("exposure") == "partner", "public").otherwise(F.col("exposure")),
        "confidence": F.when(F.col("confidence") > 0.85, F.col("confidence") + 1).otherwise(F.col("confidence")),
    })
    return report.row_errors(damaged).select("finding_id", F.concat_ws(",", "errors").alias("errors"))


@query("v24_bill_errors", """
SELECT doc_id, e.error FROM documents d JOIN (VALUES (1, 'missing top-level key ''version'''), (2, 'component[1] missing ''name'''), (2, 'component[0].property[1] missing ''value'''),
 (3, 'missing top-level key ''components'''), (3, '''components'' must be a list')) e(k, error) ON d.doc_id % 4 = e.k""")
def v24(t: Tables) -> DataFrame:
    """Bill documents around each text, three of four with structural errors."""
    name = F.to_json(F.struct(F.col("text").alias("name")))
    good = '{"bomFormat": "CycloneDX", "specVersion": "1.6", %s "metadata": {}, "note": '
    part = '{"type": "library", "name": "AES", "properties": [{"name": "a", "value": "b"}, {"name": "c"%s}]}'
    listed = ', "components": [' + part + ', {"type": "library"%s}]}'
    key = F.col("doc_id") % 4
    head = F.when(key == 1, F.lit(good % "")).otherwise(F.lit(good % '"version": 1,'))
    tail = F.when(key == 2, F.lit(listed % ("", ""))).when(key == 3, F.lit("}")).otherwise(F.lit(listed % (', "value": ""', ', "name": "RSA"')))
    documents = t.table("documents").select("doc_id", F.concat(head, name, tail).alias("document"))
    return report.bill_errors(documents)
