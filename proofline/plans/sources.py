"""Queries over scope, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import paths
from proofline.operators import correlate, manifests, report, score
from proofline.plans.correlation import scored
from proofline.plans.extraction import CERTIFICATE_VALUES, CODE_HITS
from proofline.plans.registry import query
from proofline.plans.views import Tables
from proofline.session import ensure_checkpoint_dir
from proofline.sources import collect, corpora, files, sinks, truth

SCOPED = """
(SELECT *, regexp_extract(path, '[.][a-z]+$') AS ext, length > 1000 AS big FROM v_files
 WHERE NOT regexp_matches(path, '/(node_modules|venv|dist|build|env)/'))"""


@query("s01_file_inventory", f"""
SELECT path, length, ext IN ('.py', '.java', '.go', '.pem') AS in_scope FROM {SCOPED}""")
def s01(t: Tables) -> DataFrame:
    return files.inventory(t.view("v_files")).select("path", "length", "in_scope")


@query("s02_collector_routing", f"""
SELECT path, 'rule' AS collector, 'source_rules' AS parser FROM {SCOPED} WHERE ext IN ('.py', '.java', '.go')
UNION ALL SELECT path, 'ast', 'python_calls' FROM {SCOPED} WHERE ext = '.py'
UNION ALL SELECT path, 'cert', 'pem' FROM {SCOPED} WHERE ext = '.pem'""")
def s02(t: Tables) -> DataFrame:
    return files.routes(t.view("v_files"))


def new_folder(t: Tables) -> str:
    """A new folder of the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


def scoped(t: Tables) -> DataFrame:
    """Scope with a byte limit low enough that some test texts pass it."""
    return files.with_failure(files.inventory(t.view("v_files")), 1000)


@query("s03_read_failures", f"""
SELECT path, 'oversized' AS reason FROM {SCOPED} WHERE big AND ext IN ('.py', '.java', '.go', '.pem')""")
def s03(t: Tables) -> DataFrame:
    return files.read_failures(scoped(t))


@query("s04_limit_guard", f"""
SELECT (SELECT count(*) FROM v_files WHERE NOT regexp_matches(path, '/(node_modules|venv|dist|build|env)/')) AS files, (SELECT count(*) FROM v_evidence) AS evidence""")
def s04(t: Tables) -> DataFrame:
    """Guarded counts; the limits are raised so that the largest test tables pass."""
    counted = files.inventory(t.view("v_files")).agg(F.count(F.lit(1)).alias("files"))
    evidence = t.view("v_evidence").agg(F.count(F.lit(1)).alias("evidence"))
    both = counted.unionByName(evidence, allowMissingColumns=True).agg(F.max("files").alias("files"), F.max("evidence").alias("evidence"))
    return files.limit_guard(files.limit_guard(both, 10**9, "file count", "files"), 10**10, "evidence count", "evidence")


@query("s05_relative_paths", """
SELECT path, CASE WHEN lang = 'en' THEN NULL ELSE replace(concat(split_part(path, '/', 2), ' %7E', substr(path, length('repositories/') + length(split_part(path, '/', 2)) + 1)), '%7E', '~') END AS relative_path
FROM v_files""")
def s05(t: Tables) -> DataFrame:
    """A blank and a tilde are put into each path; English files lie outside the root."""
    root = F.lit("/srv/scan")
    tail = F.regexp_replace(F.substr(F.col("path"), F.lit(14)), r"^([^/]*)", "$1 ~")
    full = F.concat(F.when(F.col("lang") == "en", F.lit("/srv/other/")).otherwise(F.lit("/srv/scan/")), tail)
    return t.view("v_files").select("path", paths.relative_path(full, root).alias("relative_path"))


@query("s06_failure_table", f"""
SELECT path, 'oversized' AS reason FROM {SCOPED} WHERE big AND ext IN ('.py', '.java', '.go', '.pem')
UNION ALL SELECT path, 'certificate_error' FROM {SCOPED} WHERE NOT big AND ext = '.pem'""")
def s06(t: Tables) -> DataFrame:
    rows = scoped(t)
    parser = rows.where(paths.extension("path") == ".pem").select("path", F.lit("certificate_error").alias("reason"))
    return files.failures(files.read_failures(rows), parser)


@query("s07_coverage", f"""
SELECT count(*) AS total_files, count_if(ext <> '.md') AS in_scope_files, count_if(ext <> '.md' AND big) AS failed_files, count_if(ext <> '.md' AND NOT big) AS scanned_files,
       round(100.0::DOUBLE * count_if(ext <> '.md' AND NOT big) / count_if(ext <> '.md'), 2) AS coverage_pct FROM {SCOPED}""")
def s07(t: Tables) -> DataFrame:
    return files.coverage(scoped(t))


@query("s08_collector_stats", """
SELECT count_if(source = 'ast') AS ast, count_if(source = 'rule') AS rule, count_if(source = 'dep') AS dep, count_if(source = 'cert') AS cert FROM v_evidence""")
def s08(t: Tables) -> DataFrame:
    return files.collector_stats(t.view("v_evidence"))


@query("s09_blind_spots", f"""
SELECT 7 AS statements, concat(CAST(count_if(ext <> '.md' AND big) AS VARCHAR), ' supported file(s) had read or parser errors; evidence may be partial') AS last_statement FROM {SCOPED}""")
def s09(t: Tables) -> DataFrame:
    spots = files.blind_spots(files.coverage(scoped(t)))
    return spots.select(F.size("blind_spots").alias("statements"), F.element_at("blind_spots", -1).alias("last_statement"))


def with_job(found: DataFrame) -> DataFrame:
    return found.withColumn("scan_job_id", F.substring("component", 4, 10).cast("long") + 1)


@query("s11_job_rollup", """
SELECT j.id, j.status, coalesce(n, 0) AS assets_found, coalesce(c, 0) AS avg_confidence FROM v_jobs j
LEFT JOIN (SELECT CAST(substr(component, 4) AS BIGINT) + 1 AS id, count(*) AS n, round(avg(confidence), 4) AS c FROM v_scored GROUP BY 1) f ON j.id = f.id""")
def s11(t: Tables) -> DataFrame:
    return sinks.job_rollup(with_job(scored(t)), t.view("v_jobs")).select("id", "status", "assets_found", "avg_confidence")


@query("s12_evidence_json")
def s12(t: Tables) -> DataFrame:
    """The lines the JSON sink writes."""
    return t.view("v_evidence").select(F.to_json(F.struct(
        "algorithm", "category", "source", "location", "evidence_kind", "line_start", "column_start", "key_size", "confidence"
    )).alias("line"))


@query("s12_stored_evidence_json", """
SELECT algorithm, category, source, location, evidence_kind, line_start, column_start, key_size, confidence FROM v_evidence""")
def s12_stored(t: Tables) -> DataFrame:
    """Evidence written by the JSON sink and read back."""
    columns = ["algorithm", "category", "source", "location", "evidence_kind", "line_start", "column_start", "key_size", "confidence"]
    rows, folder = t.view("v_evidence").select(*columns), new_folder(t)
    sinks.write_evidence_json(rows, f"{folder}/evidence")
    return t.spark.read.schema(rows.schema).json(f"{folder}/evidence")


@query("s13_asset_csv", """
SELECT finding_id AS id, algorithm, key_size, category, priority_label, priority_score, confidence, quantum_vulnerable, location, usage, library, protocol, evidence_kind, pqc_candidate FROM v_scored""")
def s13(t: Tables) -> DataFrame:
    return sinks.asset_rows(scored(t))


@query("s13_bill_csv", "SELECT algorithm AS name, 'library' AS type, location, category, confidence FROM v_scored")
def s13_bill(t: Tables) -> DataFrame:
    return sinks.bill_rows(scored(t))


@query("s13_risk_csv", """
SELECT algorithm, location, priority_score AS score, priority_label AS level, CASE WHEN hybrid_recommended THEN 'yes' ELSE 'no' END AS hybrid, pqc_candidate AS recommendation, risk_reasons AS reasons FROM v_scored""")
def s13_risk(t: Tables) -> DataFrame:
    return sinks.risk_rows(scored(t))


@query("s14_risk_text", """
SELECT rank, concat('P', CAST(rank AS VARCHAR), ' | ', priority_label, ' ', CAST(priority_score AS VARCHAR), '/100 | ', algorithm, ' (', usage, ') | ', location, ' | ', operation_anchor, ' | ', pqc_candidate) AS line
FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, algorithm, location, finding_id) AS rank FROM v_scored)""")
def s14(t: Tables) -> DataFrame:
    return report.report_lines(scored(t).select(
        "finding_id", "priority_score", "priority_label", "algorithm", "usage", "location", "operation_anchor", "pqc_candidate"))


@query("s15_truth_checks", """
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'ground truth is not valid JSON' WHEN 2 THEN 'asset missing valid ''algorithm''' WHEN 3 THEN concat(chr(39), 'blind_spots', chr(39), ' must be a list')
   WHEN 4 THEN 'ground truth is not a JSON object' END AS message FROM documents""")
def s15(t: Tables) -> DataFrame:
    """Truth documents that carry each text as a reason; four of five are damaged."""
    reason = F.to_json(F.struct(F.lit("a").alias("component"), F.lit("AES").alias("algorithm"), F.col("text").alias("reason")))
    key = F.col("doc_id") % 5
    good = F.concat(F.lit('{"assets": [{"component": "a", "algorithm": "RSA"}], "blind_spots": ['), reason, F.lit("]}"))
    blank = F.concat(F.lit('{"assets": [{"component": "a", "algorithm": " "}], "blind_spots": ['), reason, F.lit("]}"))
    single = F.concat(F.lit('{"assets": [], "blind_spots": '), reason, F.lit("}"))
    text = F.when(key == 1, F.concat(good, F.lit("}"))).when(key == 2, blank).when(key == 3, single).when(
        key == 4, F.concat(F.lit("["), reason, F.lit("]"))).otherwise(good)
    documents = t.table("documents").select("doc_id", F.col("n_chars").alias("length"), text.alias("text"))
    return truth.check_truth(documents).select("doc_id", "message")


@query("s18_corpus_drift", """
SELECT language, CAST(count(*) AS BIGINT) AS only_manifest, CAST(count_if(doc_id % 100 = 0) AS BIGINT) AS only_stored FROM v_corpus
WHERE doc_id % 50 = 0 GROUP BY language""")
def s18(t: Tables) -> DataFrame:
    """The stored copy lacks some rows and has another operation in others."""
    corpus = t.view("v_corpus")
    changed = F.when(F.col("doc_id") % 100 == 0, "decrypt").otherwise(F.col("operation"))
    stored = corpus.where("doc_id % 100 <> 50").withColumn("operation", changed)
    return corpora.drift(corpus, stored)


@query("s19_checksums", """
SELECT path, CASE WHEN file_id % 7 = 0 THEN 'mismatch' WHEN file_id % 11 = 0 THEN 'missing' ELSE 'ok' END AS status FROM v_files""")
def s19(t: Tables) -> DataFrame:
    """A manifest with some wrong hashes, against a tree with some files gone."""
    rows = t.view("v_files")
    digest = F.sha2(F.col("content").cast("binary"), 256)
    manifest = rows.select("path", F.when(F.col("file_id") % 7 == 0, F.reverse(digest)).otherwise(digest).alias("sha256"))
    present = rows.where("file_id % 7 = 0 or file_id % 11 <> 0")
    return files.verify_checksums(present, manifest).select("path", "status")


MANIFEST_KEYS = {
    0: {0: ["cryptography"], 1: ["pyjwt", "pyotp"], 3: ["argon2-cffi"]},
    1: {0: ["org.bouncycastle", "org.bouncycastle"], 3: ["javax.crypto"]},
    2: {0: ["crypto-js", "elliptic"], 1: ["jose"]},
    3: {0: ["bcrypt", "rbnacl"], 1: ["openssl", "rbnacl"], 2: ["rbnacl"], 3: ["rbnacl"]},
    4: {0: ["golang.org/x/crypto", "github.com/google/tink/go"], 1: ["filippo.io/ed25519", "github.com/google/tink/go"],
        2: ["github.com/google/tink/go"], 3: ["github.com/google/tink/go"]},
    5: {0: ["ring", "rustls"], 1: ["sha2", "rustls"], 2: ["rustls"], 3: ["ed25519-dalek", "rustls"]},
}
ECOSYSTEMS = {0: "pypi", 1: "maven", 2: "npm", 3: "gem", 4: "go", 5: "cargo"}


def manifest_check(form: int) -> str:
    rows = ", ".join(f"({k}, '{n}')" for k, names in MANIFEST_KEYS[form].items() for n in names)
    return f"""
SELECT path, '{ECOSYSTEMS[form]}' AS ecosystem, x.package FROM v_manifests m JOIN (VALUES {rows}) x(name_key, package) ON m.name_key = x.name_key
WHERE m.format_key = {form}"""


def register_manifest(form: int, name: str, file: str) -> None:
    @query(name, manifest_check(form))
    def run(t: Tables) -> DataFrame:
        rows = t.view("v_manifests").where(paths.file_name("path") == file)
        return manifests.declared_packages(rows).select("path", "ecosystem", "package")


for _form, _name, _file in (
    (0, "e14_requirements", "requirements.txt"), (1, "e15_pom", "pom.xml"), (2, "e16_package_lock", "package-lock.json"),
    (3, "e17_gemfile_lock", "Gemfile.lock"), (4, "e18_go_sum", "go.sum"), (5, "e19_cargo_lock", "Cargo.lock"),
):
    register_manifest(_form, _name, _file)


def catalog_values() -> str:
    rows = ", ".join(f"('{e}', '{p}', '{a}', '{c}')" for e, p, provided in C.PACKAGE_CATALOG for a, c in provided)
    return f"(VALUES {rows}) c(ecosystem, package, algorithm, category)"


NORMAL = "regexp_replace(regexp_extract(lower(split_part(raw_name, '/', -1)), '^[^<>=!~;@# ]*'), '[-_.]+', '-', 'g')"


@query("e20_package_algorithms", f"""
SELECT p.row_id, p.ecosystem, p.package, c.algorithm, c.category FROM (SELECT row_id, ecosystem, {NORMAL} AS package FROM v_packages) p
JOIN {catalog_values()} ON p.ecosystem = c.ecosystem AND p.package = c.package""")
def e20(t: Tables) -> DataFrame:
    from proofline.functions.text import package_name

    return manifests.expand_packages(t.view("v_packages").select("row_id", "ecosystem", package_name("raw_name").alias("package")))


@query("e21_package_names", f"SELECT row_id, raw_name, {NORMAL} AS package FROM v_packages")
def e21(t: Tables) -> DataFrame:
    from proofline.functions.text import package_name

    return t.view("v_packages").select("row_id", "raw_name", package_name("raw_name").alias("package"))


@query("e26_manifest_failures", """
SELECT path, 'parse_error' AS reason FROM v_manifests WHERE (format_key = 1 AND name_key = 2) OR (format_key = 2 AND name_key = 3)""")
def e26_manifests(t: Tables) -> DataFrame:
    return manifests.manifest_failures(t.view("v_manifests"))


def full_scan(t: Tables) -> collect.Scan:
    """Code, manifests and certificates of the test tables as one scan."""
    parts = [t.view(v).select("path", "content") for v in ("v_code", "v_manifests", "v_pem")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("length", F.length("content").cast("long"))
    return collect.scan(rows, hold=True)


def full_scan_check() -> str:
    provided = ", ".join(f"('{e}', '{p}', '{a}')" for e, p, pairs in C.PACKAGE_CATALOG for a, _ in pairs)
    declared = " UNION ALL ".join(f"({manifest_check(form)})" for form in ECOSYSTEMS)
    return f"""
SELECT location, source, algorithm, count(*) AS records FROM (
 SELECT path AS location, 'rule' AS source, h.algorithm FROM v_code c JOIN {CODE_HITS} ON c.lang_key = h.lang_key AND c.snippet_key = h.snippet_key
 UNION ALL SELECT path, 'ast', f.algorithm FROM v_code c JOIN (VALUES (0, 'SHA-256'), (1, 'AES'), (1, 'AES'), (2, 'HMAC'), (4, 'TLS'), (4, 'TLS')) f(snippet_key, algorithm)
   ON c.snippet_key = f.snippet_key WHERE c.lang_key = 0
 UNION ALL SELECT path, 'cert', c.algorithm FROM v_pem p JOIN {CERTIFICATE_VALUES} ON (p.doc_id - p.pem_key) % 12 = c.variant WHERE p.pem_key IN (1, 2)
 UNION ALL SELECT path, 'dep', p.algorithm FROM ({declared}) d JOIN (VALUES {provided}) p(ecosystem, package, algorithm) ON d.ecosystem = p.ecosystem AND d.package = p.package) found GROUP BY ALL"""


@query("s01_full_scan", full_scan_check())
def s01_full(t: Tables) -> DataFrame:
    """Every collector over all files, which are opened once."""
    return full_scan(t).evidence.groupBy("location", "source", "algorithm").agg(F.count(F.lit(1)).alias("records"))


@query("s06_full_scan_failures", """
SELECT path, 'parse_error' AS reason FROM v_code WHERE lang_key = 0 AND snippet_key = 5
UNION ALL SELECT path, 'parse_error' FROM v_manifests WHERE (format_key = 1 AND name_key = 2) OR (format_key = 2 AND name_key = 3)
UNION ALL SELECT path, 'certificate_error' FROM v_pem WHERE pem_key <> 1""")
def s06_full(t: Tables) -> DataFrame:
    return full_scan(t).failures.select("path", "reason")


def persisted(t: Tables) -> tuple[str, int]:
    """The full scan as job 7 and every finding of the evidence view, in a new folder of the checkpoint folder."""
    folder = new_folder(t)
    sinks.persist_scan(full_scan(t), scored(t), folder, 7)
    sinks.persist_findings(scored(t).where("priority_score > 50"), f"{folder}/findings", 8)
    return folder, 7


@query("s10_persisted_findings", "SELECT finding_id, priority_score, priority_label FROM v_scored")
def s10_findings(t: Tables) -> DataFrame:
    """Findings of one scan, written and read back from its partition."""
    return sinks.stored(t.spark, persisted(t)[0], "findings", 7).select("finding_id", "priority_score", "priority_label")


@query("s10_job_row", f"""
SELECT 'completed' AS status, total_files, total_files AS in_scope_files, failed_files, total_files - failed_files AS scanned_files,
 round(100.0::DOUBLE * (total_files - failed_files) / total_files, 2) AS coverage_pct, (SELECT count(*) FROM v_scored) AS assets_found, ast, rule, dep, cert
FROM (SELECT (SELECT count(*) FROM v_code) + (SELECT count(*) FROM v_manifests) + (SELECT count(*) FROM v_pem) AS total_files,
 (SELECT count(*) FROM v_code WHERE lang_key = 0 AND snippet_key = 5) + (SELECT count(*) FROM v_manifests WHERE (format_key = 1 AND name_key = 2) OR (format_key = 2 AND name_key = 3))
 + (SELECT count(*) FROM v_pem WHERE pem_key <> 1) AS failed_files),
 (SELECT sum(records) FILTER (WHERE source = 'ast')::BIGINT AS ast, sum(records) FILTER (WHERE source = 'rule')::BIGINT AS rule, sum(records) FILTER (WHERE source = 'dep')::BIGINT AS dep, sum(records) FILTER (WHERE source = 'cert')::BIGINT AS cert FROM ({full_scan_check()}))""")
def s10_job(t: Tables) -> DataFrame:
    """The job row of a persisted scan."""
    return sinks.stored(t.spark, persisted(t)[0], "jobs", 7).select(
        "status", "total_files", "in_scope_files", "failed_files", "scanned_files", "coverage_pct", "assets_found", "ast", "rule", "dep", "cert"
    )


@query("s10_scan_findings", f"""
SELECT DISTINCT location, algorithm FROM ({full_scan_check()})""")
def s10_scan(t: Tables) -> DataFrame:
    """Files to evidence to findings to risk: what a scan found, stored with the same scan's failures and job row, and read back."""
    folder, scan = new_folder(t), full_scan(t).held()
    sinks.persist_scan(scan, score.score_findings(correlate.findings(scan.evidence)), folder, 7)
    return sinks.stored(t.spark, folder, "findings", 7).select("location", "algorithm").distinct()


@query("s06_notes_and_spans", f"""
SELECT path AS location, 'rule' AS source, h.algorithm, line_start, line_start AS line_end, 'regex match against code pattern' AS note FROM v_code c JOIN {CODE_HITS} ON c.lang_key = h.lang_key AND c.snippet_key = h.snippet_key
UNION ALL SELECT path, 'cert', c.algorithm, NULL, NULL, CASE WHEN eku_oids = '' THEN 'artifact metadata; EKU not established' ELSE 'artifact metadata; EKU established' END
FROM v_pem p JOIN {CERTIFICATE_VALUES} ON (p.doc_id - p.pem_key) % 12 = c.variant WHERE p.pem_key IN (1, 2)""")
def s06_notes(t: Tables) -> DataFrame:
    """Line spans and confidence notes of the rule and certificate records of a scan."""
    found = full_scan(t).evidence.where("source in ('rule', 'cert')")
    return found.select("location", "source", "algorithm", "line_start", "line_end", F.col("confidence_note").alias("note"))


@query("q01_scan_report", """
SELECT priority_label, count(*) AS findings FROM v_scored WHERE priority_score > 50 GROUP BY priority_label""")
def q01_report(t: Tables) -> DataFrame:
    """Priorities of the newest completed scan, whose partition alone is read."""
    folder, _ = persisted(t)
    jobs = t.spark.createDataFrame([(7, "completed"), (8, "completed"), (9, "failed")], "id long, status string")
    newest = report.resolve_scan(jobs).first()["id"]
    found = sinks.stored(t.spark, folder, "findings", newest)
    return found.groupBy("priority_label").agg(F.count(F.lit(1)).alias("findings"))
