"""Queries over extraction from source text, certificates and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.functions.text import redact_map, redact_text
from proofline.operators import certificates, python_calls, source_rules
from proofline.plans.registry import query
from proofline.plans.views import Tables

# Hits of the rule scan on the code view: (language, snippet, algorithm, usage, line, column, key size, protocol).
CODE_HITS = """(VALUES
 (0, 1, 'AES', 'encryption', 1, 0, NULL, ''), (0, 1, 'AES', 'encryption', 2, 0, NULL, ''), (0, 4, 'TLS', 'tls', 2, 0, NULL, 'TLS'),
 (1, 0, 'AES', 'encryption', 1, 0, NULL, ''), (1, 1, 'AES', 'encryption', 1, 17, 256, ''), (1, 3, 'SHA-256', 'hashing', 1, 0, NULL, ''),
 (1, 5, 'TLS', 'tls', 1, 0, NULL, 'TLS'),
 (2, 0, 'ECDH', 'key_establishment', 1, 0, NULL, ''), (2, 1, 'TLS', 'tls', 1, 0, NULL, 'TLS'), (2, 2, 'ML-KEM', 'key_establishment', 3, 0, NULL, ''),
 (2, 4, 'ChaCha20', 'encryption', 1, 0, NULL, '')) h(lang_key, snippet_key, algorithm, usage_raw, line_start, column_start, key_size, protocol)"""
# Rule hits without the guards: the folded rules alone, on masked statements.
FIRST_PATTERNS = r"""(VALUES
 (0, 1, 1, 'AES', 'AES'), (0, 1, 2, 'AES', 'AES'), (0, 4, 2, 'TLS', 'SSLContext'), (1, 0, 1, 'AES', 'AES'), (1, 1, 1, 'AES', 'AES'),
 (1, 3, 1, 'SHA-256', '\bMessageDigest\s*\.\s*getInstance\s*\(\s*[\"'']SHA-?256[\"'']'), (1, 5, 1, 'TLS', 'TLSv?1[._]?[23]'), (2, 0, 1, 'ECDH', 'ECDH'), (2, 1, 1, 'TLS', 'tls\.Config'),
 (2, 2, 3, 'ML-KEM', 'mlkem'), (2, 4, 1, 'ChaCha20', 'ChaCha20')) h(lang_key, snippet_key, line, algorithm, pattern)"""


@query("e01_masked_source", """
SELECT path, length(content) AS characters, length(content) - length(replace(content, chr(10), '')) AS line_breaks,
       CASE WHEN lang_key = 0 AND snippet_key = 0 THEN 'hashlib.sha256(b   )' WHEN lang_key = 0 AND snippet_key = 3 THEN '  return hashlib.md5(b   )'
            WHEN lang_key = 1 THEN CASE snippet_key WHEN 0 THEN 'Cipher.getInstance("AES/GCM/NoPadding");' WHEN 1 THEN 'String u =      ; KeyGenerator.getInstance("AES").init(256);'
                 WHEN 3 THEN 'MessageDigest.getInstance("SHA-256");' WHEN 5 THEN 'SSLContext c = SSLContext.getInstance("TLSv1.3");' END END AS code
FROM v_code""")
def e01(t: Tables) -> DataFrame:
    code = t.view("v_code").withColumn("extension", F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    masked = code.withColumn("masked", source_rules.masked_text("content", "extension"))
    lines = F.split("masked", "\n")
    shown = F.when((F.col("lang_key") == 0) & F.col("snippet_key").isin(0, 3), F.get(lines, F.lit(1))).when(
        (F.col("lang_key") == 1) & F.col("snippet_key").isin(0, 1, 3, 5), F.get(lines, F.lit(0)))
    return masked.select("path", F.length("masked").alias("characters"), (F.size(lines) - 1).alias("line_breaks"), shown.alias("code"))


@query("e02_lines", "SELECT doc_id, i, line FROM v_lines")
def e02(t: Tables) -> DataFrame:
    return t.lines()


@query("e02_statements", """
SELECT path, length(content) - length(replace(content, chr(10), '')) + 1 + CASE WHEN lang_key = 1 THEN CASE snippet_key WHEN 1 THEN 2 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END ELSE 0 END AS statements
FROM v_code""")
def e02_statements(t: Tables) -> DataFrame:
    rows = source_rules.statements(t.view("v_code"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("statements"))


def pack_check() -> str:
    """Folded rules over the raw document lines, one row per algorithm and line."""
    cells = " UNION ALL ".join(
        f"SELECT doc_id, i, '{name}' AS algorithm FROM v_lines WHERE regexp_matches(line, '{source_rules.folded(patterns)}')"
        for name, _, patterns in C.RULE_PACK
    )
    return cells


@query("e03_rule_hits_on_lines", pack_check())
def e03(t: Tables) -> DataFrame:
    """The whole rule pack over every line of every document."""
    lines = source_rules.candidates(t.lines(), "line")
    found = source_rules.matched_algorithms(F.col("line"), F.col("_lower"), F.lit(False))
    return lines.select("doc_id", "i", F.explode(found).alias("algorithm"))


@query("e03_first_pattern", f"""
SELECT path, line, h.algorithm, pattern FROM v_code c JOIN {FIRST_PATTERNS} ON c.lang_key = h.lang_key AND c.snippet_key = h.snippet_key""")
def e03_first(t: Tables) -> DataFrame:
    hits = source_rules.scan_statements(source_rules.statements(t.view("v_code")))
    return hits.select("path", "line", "algorithm", "pattern")


@query("e04_named_constants", """
SELECT path, 'AES' AS algorithm FROM v_code WHERE lang_key = 2 AND snippet_key = 3""")
def e04(t: Tables) -> DataFrame:
    """Statements left out because they assign a constant named after the algorithm."""
    rows = source_rules.statements(t.view("v_code")).where("not dynamic")
    found = source_rules.matched_algorithms(F.col("text"), F.lower("text"), F.col("extension") == ".java")
    named = rows.withColumn("algorithm", F.explode(found))
    names = [n for n, _, _ in C.RULE_PACK]
    return named.where(source_rules.is_named_constant(F.col("text"), F.col("algorithm"), names)).select("path", "algorithm")


@query("e05_language_guards", """
SELECT path, CASE WHEN snippet_key = 2 THEN 'field' ELSE 'declaration' END AS guard FROM v_code WHERE lang_key = 1 AND snippet_key IN (2, 4)""")
def e05(t: Tables) -> DataFrame:
    rows = source_rules.candidates(source_rules.statements(t.view("v_code")), "text").where("extension = '.java'")
    guard = F.when(F.col("text").rlike(C.JAVA_FIELD), "field").when(source_rules.is_java_declaration(F.col("text")), "declaration")
    return rows.select("path", guard.alias("guard")).where("guard is not null")


@query("e06_dynamic_regions", """
SELECT path, unnest([1, 2]) AS line FROM v_code WHERE lang_key = 2 AND snippet_key = 2""")
def e06(t: Tables) -> DataFrame:
    return source_rules.statements(t.view("v_code")).where("dynamic").select("path", "line")


@query("e07_usage_inference", """
SELECT location, algorithm, CASE WHEN algorithm IN ('SHA-256', 'MD5') THEN 'hashing' WHEN algorithm = 'ECDSA' THEN 'signature' WHEN algorithm IN ('ECDH', 'ML-KEM') THEN 'key_establishment'
   WHEN algorithm = 'AES' THEN 'encryption' WHEN usage_raw = 'sign' THEN 'signature' ELSE 'encryption' END AS usage, count(*) AS records
FROM v_evidence GROUP BY ALL""")
def e07(t: Tables) -> DataFrame:
    return t.view("v_evidence").groupBy(
        "location", "algorithm", E.usage_from_line(F.concat_ws(" ", "usage_raw", F.lit("key")), "algorithm").alias("usage")
    ).agg(F.count(F.lit(1)).alias("records"))


@query("e08_single_number", """
SELECT doc_id, i, CASE WHEN len(list_distinct(regexp_extract_all(line, '\\b([0-9]{3,6})\\b', 1))) = 1
   THEN CAST(regexp_extract(line, '\\b([0-9]{3,6})\\b', 1) AS INT) END AS number FROM v_lines""")
def e08(t: Tables) -> DataFrame:
    """The key-size rule (one distinct number, else none) with a plain number pattern over all lines."""
    return t.lines().select("doc_id", "i", E.single_number("line", r"\b([0-9]{3,6})\b").alias("number"))


@query("e08_key_sizes", f"""
SELECT path, h.algorithm, h.key_size FROM v_code c JOIN {CODE_HITS} ON c.lang_key = h.lang_key AND c.snippet_key = h.snippet_key WHERE h.key_size IS NOT NULL""")
def e08_sizes(t: Tables) -> DataFrame:
    return source_rules.evidence(t.view("v_code")).where("key_size is not null").select(
        F.col("location").alias("path"), "algorithm", "key_size"
    )


@query("e09_line_tags", """
SELECT doc_id, i, CASE WHEN contains(lower(line), 'bouncycastle') THEN 'Bouncy Castle' WHEN contains(lower(line), 'openssl') THEN 'OpenSSL'
   WHEN contains(lower(line), 'cryptography') THEN 'Python cryptography' WHEN contains(lower(line), 'crypto.') THEN 'PyCryptodome' ELSE '' END AS library,
   CASE WHEN regexp_matches(lower(line), 'sign|verify|digest|hash|sha|md5|exchange|derive|kem|agreement') THEN '' WHEN regexp_matches(lower(line), 'tls|ssl') THEN 'TLS' ELSE '' END AS protocol
FROM v_lines""")
def e09(t: Tables) -> DataFrame:
    usage = E.usage_from_line("line", F.lit("RSA"))
    return t.lines().select(
        "doc_id", "i", E.library_from_line("line").alias("library"), E.protocol_from_usage(usage).alias("protocol")
    )


@query("e09_rule_evidence", f"""
SELECT path AS location, h.algorithm, usage_raw, CAST(line_start AS INT) AS line_start, CAST(column_start AS INT) AS column_start, key_size, protocol
FROM v_code c JOIN {CODE_HITS} ON c.lang_key = h.lang_key AND c.snippet_key = h.snippet_key""")
def e09_evidence(t: Tables) -> DataFrame:
    """Masking, splitting, rules, guards and tags together over all derived source files."""
    return source_rules.evidence(t.view("v_code")).select(
        "location", "algorithm", "usage_raw", "line_start", "column_start", "key_size", "protocol"
    )


@query("e10_python_facts", """
SELECT path, kind, name, line FROM v_code c JOIN (VALUES
 (0, 'import', 'hashlib', 1), (0, 'call', 'hashlib.sha256', 2),
 (1, 'import', 'Crypto.Cipher', 1), (1, 'import', 'Crypto.Cipher.AES', 1), (1, 'call', 'Crypto.Cipher.AES.new', 2),
 (2, 'import', 'hmac', 1), (2, 'import', 'hashlib', 1), (2, 'call', 'hmac.new', 2),
 (4, 'import', 'ssl', 1), (4, 'call', 'ssl.SSLContext', 2), (5, 'error', 'SyntaxError', NULL)) f(snippet_key, kind, name, line) ON c.snippet_key = f.snippet_key
WHERE c.lang_key = 0""")
def e10(t: Tables) -> DataFrame:
    return python_calls.facts(t.view("v_code")).select("path", "kind", "name", "line")


@query("e11_import_evidence", """
SELECT path AS location, CASE snippet_key WHEN 1 THEN 'AES' ELSE 'TLS' END AS algorithm, CASE snippet_key WHEN 1 THEN 'encryption' ELSE 'protocol' END AS category,
       CAST(0.5 AS DOUBLE) AS confidence, 'declared_capability' AS evidence_kind
FROM v_code WHERE lang_key = 0 AND snippet_key IN (1, 4)""")
def e11(t: Tables) -> DataFrame:
    return python_calls.import_evidence(python_calls.facts(t.view("v_code"))).select(
        "location", "algorithm", "category", "confidence", "evidence_kind"
    )


@query("e12_call_evidence", """
SELECT path AS location, f.algorithm, f.category, f.usage_raw, f.digest, CAST(0.9 AS DOUBLE) AS confidence FROM v_code c JOIN (VALUES
 (0, 'SHA-256', 'hash', 'hashing', NULL), (1, 'AES', 'encryption', 'encryption', NULL), (2, 'HMAC', 'mac', 'unknown', 'SHA-512'), (4, 'TLS', 'protocol', 'tls', NULL)
 ) f(snippet_key, algorithm, category, usage_raw, digest) ON c.snippet_key = f.snippet_key WHERE c.lang_key = 0""")
def e12(t: Tables) -> DataFrame:
    return python_calls.call_evidence(python_calls.facts(t.view("v_code"))).select(
        "location", "algorithm", "category", "usage_raw", F.try_element_at("details", F.lit("digest_algorithm")).alias("digest"), "confidence"
    )


@query("e13_aes_modes", """
SELECT path, 'MODE_GCM' AS mode FROM v_code WHERE lang_key = 0 AND snippet_key = 1""")
def e13(t: Tables) -> DataFrame:
    calls = python_calls.classify_facts(python_calls.facts(t.view("v_code"))).where("kind = 'call' and name like '%AES.new'")
    arguments = F.from_json("args", python_calls.ARGUMENTS)
    return calls.select("path", F.try_element_at(arguments, F.lit("1"))["attr"].alias("mode"))


@query("e22_pem_blocks", """
SELECT path, CAST(b.block AS INT) AS block, b.plausible FROM v_pem p JOIN (VALUES (1, 0, true), (2, 0, true), (2, 1, false)) b(pem_key, block, plausible) ON p.pem_key = b.pem_key""")
def e22(t: Tables) -> DataFrame:
    return certificates.pem_blocks(t.view("v_pem")).select("path", "block", "plausible")


@query("e22_pem_failures", "SELECT path, 'certificate_error' AS reason FROM v_pem WHERE pem_key <> 1")
def e22_failures(t: Tables) -> DataFrame:
    return certificates.pem_failures(t.view("v_pem"))


#: What the certificates of v_pem hold, by (doc_id - doc_id % 4) % 12.
CERTIFICATE_VALUES = """(VALUES (0, 'RSA', 'encryption', 'rsa', 512, 'rsa.example', 'ca.example', '2051-01-02T03:04:05+00:00', '1001', 'sha256WithRSAEncryption', '1.3.6.1.5.5.7.3.1,1.3.6.1.5.5.7.3.2', '', false, 'a.example,10.0.0.1'), (4, 'ECDSA', 'signature', 'ec', 256, 'ec.example', 'ca.example', '2051-01-02T03:04:05+00:00', '1002', 'ecdsa-with-SHA256', '', 'digitalSignature,keyEncipherment', true, ''), (8, 'Ed25519', 'signature', 'ed25519', 0, 'ed.example', 'ca.example', '2051-01-02T03:04:05+00:00', '1003', 'ed25519', '1.3.6.1.5.5.7.3.3', '', false, ''))
 c(variant, algorithm, category, key_type, key_size, subject_cn, issuer, not_after, serial_number, signature_algorithm, eku_oids, key_usage, is_ca, san)"""


@query("e23_decoded_certificates", f"""
SELECT path, CAST(0 AS INT) AS block, key_type, CAST(key_size AS INT) AS key_size, subject_cn, issuer, 'v3' AS version, '2026-01-01T00:00:00+00:00' AS not_before, not_after,
       serial_number, signature_algorithm, eku_oids, key_usage, is_ca, san
FROM v_pem p JOIN {CERTIFICATE_VALUES} ON (p.doc_id - p.pem_key) % 12 = c.variant WHERE p.pem_key IN (1, 2)""")
def e23_decoded(t: Tables) -> DataFrame:
    """Every certificate of the PEM files, decoded from its block."""
    found = certificates.decoded(t.view("v_pem"))
    return found.select(
        "path", "block", "key_type", "key_size", "subject_cn", "issuer", "version", "not_before", "not_after", "serial_number", "signature_algorithm",
        *[F.concat_ws(",", name).alias(name) for name in ("eku_oids", "key_usage")], "is_ca", F.concat_ws(",", "san").alias("san"),
    )


@query("e23_pem_evidence", f"""
SELECT path AS location, algorithm, category, CAST(key_size AS INT) AS key_size, CASE c.variant WHEN 0 THEN 'tls' WHEN 4 THEN 'unknown' ELSE 'signature' END AS usage_raw,
       CASE c.variant WHEN 4 THEN 'artifact_metadata' ELSE 'configured_protocol' END AS evidence_kind, CAST(0.95 AS DOUBLE) AS confidence, subject_cn, not_after
FROM v_pem p JOIN {CERTIFICATE_VALUES} ON (p.doc_id - p.pem_key) % 12 = c.variant WHERE p.pem_key IN (1, 2)""")
def e23_pem(t: Tables) -> DataFrame:
    """Evidence from PEM files, without a table of decoded certificates."""
    found = certificates.evidence(certificates.decoded(t.view("v_pem")))
    details = [F.try_element_at("details", F.lit(name)).alias(name) for name in ("subject_cn", "not_after")]
    return found.select("location", "algorithm", "category", "key_size", "usage_raw", "evidence_kind", F.col("confidence").cast("double").alias("confidence"), *details)


@query("e23_certificate_evidence", """
SELECT path AS location, CASE key_type WHEN 'rsa' THEN 'RSA' WHEN 'ec' THEN 'ECDSA' WHEN 'ed25519' THEN 'Ed25519' WHEN 'dsa' THEN 'DSA' ELSE key_type END AS algorithm,
       CASE key_type WHEN 'rsa' THEN 'encryption' WHEN 'X448PublicKey' THEN 'unknown' ELSE 'signature' END AS category, coalesce(key_size, 0) AS key_size,
       CASE finding_order % 5 WHEN 0 THEN 'tls' WHEN 3 THEN 'tls' WHEN 4 THEN 'unknown' ELSE 'signature' END AS usage_raw,
       CASE finding_order % 5 WHEN 4 THEN 'artifact_metadata' ELSE 'configured_protocol' END AS evidence_kind
FROM v_certs""")
def e23(t: Tables) -> DataFrame:
    decoded = t.view("v_certs").withColumn("eku_oids", F.filter(F.split("eku_text", ","), lambda o: o != ""))
    return certificates.evidence(decoded).select("location", "algorithm", "category", "key_size", "usage_raw", "evidence_kind")


@query("e24_category_lookup", """
SELECT algorithm, CASE algorithm WHEN 'RSA' THEN 'encryption' WHEN 'AES' THEN 'encryption' WHEN 'ECDSA' THEN 'signature' WHEN 'SHA-256' THEN 'hash' WHEN 'MD5' THEN 'hash'
   WHEN 'HMAC' THEN 'mac' WHEN 'ECDH' THEN 'key_exchange' WHEN 'ML-KEM' THEN 'key_exchange' ELSE 'unknown' END AS known_category, count(*) AS records FROM v_evidence GROUP BY ALL""")
def e24(t: Tables) -> DataFrame:
    return t.view("v_evidence").groupBy("algorithm", E.category("algorithm").alias("known_category")).agg(F.count(F.lit(1)).alias("records"))


@query("e25_redacted_text", """
SELECT doc_id, CASE WHEN regexp_matches(text, 'PRIVATE KEY-----|(?i:(password|secret|token|api_key)\\s*[:=])') THEN '[REDACTED]' ELSE text END AS text FROM documents""")
def e25(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", redact_text("text").alias("text"))


@query("e25_redacted_map", """
SELECT doc_id, '[REDACTED]' AS token, source, CASE WHEN regexp_matches(text, 'PRIVATE KEY-----|(?i:(password|secret|token|api_key)\\s*[:=])') THEN '[REDACTED]' ELSE text END AS note FROM documents""")
def e25_map(t: Tables) -> DataFrame:
    fields = redact_map(F.create_map(F.lit("Token"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("note"), F.col("text")))
    return t.table("documents").select(
        "doc_id", fields["Token"].alias("token"), fields["source"].alias("source"), fields["note"].alias("note")
    )


@query("e26_parse_failures", "SELECT path, 'parse_error' AS reason FROM v_code WHERE lang_key = 0 AND snippet_key = 5")
def e26(t: Tables) -> DataFrame:
    return python_calls.parse_failures(python_calls.facts(t.view("v_code")))
