"""Derived input views over the shared test tables, one text for both engines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "v_files": """
SELECT doc_id AS file_id,
       concat('repositories/', source, '/', CASE doc_id % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'lib' WHEN 3 THEN 'venv' ELSE 'app' END,
              '/f', CAST(doc_id AS VARCHAR), CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.go' WHEN 3 THEN '.pem' ELSE '.md' END) AS path,
       n_chars AS length, text AS content, lang
FROM documents""",
    "v_packages": """
SELECT p_partkey AS row_id,
       CASE p_size % 6 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'gem' WHEN 3 THEN 'go' WHEN 4 THEN 'cargo' ELSE 'maven' END AS ecosystem,
       concat(CASE p_partkey % 8 WHEN 0 THEN 'Cryptography' WHEN 1 THEN 'node_modules/crypto-js' WHEN 2 THEN 'bcrypt' WHEN 3 THEN 'argon2_cffi'
              WHEN 4 THEN 'ring' WHEN 5 THEN 'python.jose' WHEN 6 THEN 'left-pad' ELSE 'ecdsa' END,
              CASE p_partkey % 3 WHEN 0 THEN '==1.2' WHEN 1 THEN ' ; extra' ELSE '' END) AS raw_name
FROM part""",
    "v_evidence": """
SELECT concat('svc', CAST(l_suppkey % 20 AS VARCHAR)) AS component,
       concat('repositories/svc', CAST(l_suppkey % 20 AS VARCHAR), '/f', CAST(l_orderkey % 100 AS VARCHAR),
              CASE l_partkey % 10 WHEN 8 THEN '.lock' WHEN 9 THEN '.pem' ELSE '.py' END) AS location,
       CASE WHEN l_partkey % 10 = 8 AND l_suppkey % 3 = 0 THEN 'Argon2' ELSE CASE l_partkey % 9 WHEN 0 THEN 'RSA' WHEN 1 THEN 'AES' WHEN 2 THEN 'ECDSA' WHEN 3 THEN 'SHA-256' WHEN 4 THEN 'MD5' WHEN 5 THEN 'HMAC' WHEN 6 THEN 'ECDH' WHEN 7 THEN 'ML-KEM' ELSE 'RSA-2048' END END AS algorithm,
       CASE l_partkey % 9 WHEN 0 THEN 'encryption' WHEN 1 THEN 'encryption' WHEN 2 THEN 'signature' WHEN 3 THEN 'hash' WHEN 4 THEN 'hash' WHEN 5 THEN 'mac' WHEN 6 THEN 'key_exchange' WHEN 7 THEN 'key_exchange' ELSE 'encryption' END AS category,
       CASE l_partkey % 10 WHEN 8 THEN 'dep' WHEN 9 THEN 'cert' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'ast' ELSE 'rule' END END AS source,
       CASE l_partkey % 10 WHEN 8 THEN 'declared_capability' WHEN 9 THEN CASE l_linestatus WHEN 'O' THEN 'configured_protocol' ELSE 'artifact_metadata' END
            ELSE CASE WHEN l_linenumber = 5 THEN 'configured_protocol' ELSE 'observed_operation' END END AS evidence_kind,
       CASE l_returnflag WHEN 'R' THEN 'sign' WHEN 'A' THEN 'encryption' ELSE 'unknown' END AS usage_raw,
       CASE WHEN l_partkey % 10 >= 8 THEN NULL ELSE l_linenumber * 4 END AS line_start,
       CASE WHEN l_partkey % 10 >= 8 THEN NULL ELSE l_linenumber % 3 END AS column_start,
       CASE l_partkey % 7 WHEN 0 THEN 2048 WHEN 1 THEN 4096 WHEN 2 THEN 256 WHEN 3 THEN 0 ELSE NULL END AS key_size,
       CASE l_suppkey % 4 WHEN 0 THEN 'openssl' WHEN 1 THEN 'bouncycastle' ELSE '' END AS library,
       CAST(CASE l_partkey % 10 WHEN 8 THEN 0.70 WHEN 9 THEN 0.95 ELSE CASE l_linenumber % 2 WHEN 0 THEN 0.90 ELSE 0.82 END END AS DOUBLE) AS confidence,
       l_orderkey AS src_order, l_linenumber AS src_line
FROM lineitem""",
    "v_context": """
SELECT concat('svc', CAST(n_nationkey AS VARCHAR)) AS component,
       CASE n_nationkey % 8 WHEN 0 THEN 'critical' WHEN 4 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE NULL END AS business_criticality,
       CASE n_nationkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE NULL END AS data_sensitivity,
       CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_nationkey % 21 END AS data_lifetime_years,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 1 + n_nationkey % 7 END AS migration_time_years,
       CASE n_nationkey % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'partner' WHEN 2 THEN 'isolated' ELSE NULL END AS exposure,
       CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE NULL END AS migration_effort
FROM nation""",
    "v_jobs": """
SELECT o_orderkey AS id, concat('/srv/repo', CAST(o_custkey % 50 AS VARCHAR)) AS repo_path,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'queued' ELSE 'running' END
            ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'cancelled' WHEN '2-HIGH' THEN 'timed_out' WHEN '5-LOW' THEN 'completed' ELSE 'failed' END END AS status,
       o_orderdate AS started_at, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, CAST(floor(o_totalprice) AS BIGINT) % 500 AS assets_found,
       CAST(o_orderkey % 101 AS DOUBLE) AS coverage_pct, CAST(o_orderkey % 13 AS BIGINT) AS conflict_count, CAST(o_orderkey % 29 AS BIGINT) AS quantum_count
FROM orders""",
    "v_dispatch": """
SELECT o_orderkey AS scan_job_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS heartbeat_at,
       CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate ELSE NULL END AS cancellation_requested_at, o_orderkey % 3 = 0 AS released, o_orderdate AS expires_at
FROM orders""",
    "v_truth": """
SELECT p_partkey AS truth_id, concat('svc', CAST(p_partkey % 20 AS VARCHAR)) AS component,
       CASE p_size % 6 WHEN 0 THEN 'RSA' WHEN 1 THEN 'AES' WHEN 2 THEN 'ECDSA' WHEN 3 THEN 'SHA-256' WHEN 4 THEN 'DSA' ELSE 'ChaCha20' END AS algorithm,
       CASE p_partkey % 3 WHEN 0 THEN 'sign' WHEN 1 THEN 'encryption' ELSE 'unknown' END AS usage_raw,
       CASE p_size % 4 WHEN 0 THEN 2048 WHEN 1 THEN 256 ELSE NULL END AS key_size, 4 + (p_partkey % 7) * 4 AS line
FROM part""",
    "v_pred": """
SELECT l.doc_id, CAST((l.doc_id * 37) % 1000 AS DOUBLE) / 1000.0 AS confidence, l.quality AS outcome,
       CASE l.doc_id % 4 WHEN 0 THEN 'ast' WHEN 1 THEN 'rule' WHEN 2 THEN 'dep' ELSE 'cert' END AS source, d.lang AS algorithm,
       substr(md5(CAST(l.doc_id % 250 AS VARCHAR)), 1, 16) AS context_hash
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_cases": """
SELECT doc_id AS case_id, lang AS language, CASE WHEN doc_id % 4 = 0 THEN 'negative' ELSE 'positive' END AS type,
       doc_id % 5 AS expected_key, doc_id % 7 AS found_key FROM documents""",
    "v_corpus": """
SELECT doc_id, concat('c-', CAST(doc_id % 990 AS VARCHAR)) AS corpus_id, lang AS language,
       CASE doc_id % 9 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'AES' WHEN 3 THEN 'SHA-256' WHEN 4 THEN 'HMAC' WHEN 5 THEN 'Ed25519' WHEN 6 THEN 'ML-KEM' WHEN 7 THEN 'ML-DSA' ELSE 'ChaCha20' END AS algorithm_family,
       md5(text) AS commit_sha, doc_id % 40 AS line_start, (doc_id * 3) % 41 AS line_end, doc_id % 2 = 0 AS positive,
       CASE WHEN doc_id % 50 = 0 THEN 'bad_op' ELSE 'encrypt' END AS operation FROM documents""",
    "v_code": """
SELECT doc_id, concat('repositories/', source, '/app/f', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.go' END) AS path,
       doc_id % 3 AS lang_key, CAST(floor(doc_id / 3) AS BIGINT) % 6 AS snippet_key,
       concat(CASE doc_id % 3
         WHEN 0 THEN CASE CAST(floor(doc_id / 3) AS BIGINT) % 6
           WHEN 0 THEN concat('import hashlib', chr(10), 'hashlib.sha256(b"x")')
           WHEN 1 THEN concat('from Crypto.Cipher import AES', chr(10), 'AES.new(k, AES.MODE_GCM)')
           WHEN 2 THEN concat('import hmac, hashlib', chr(10), 'hmac.new(k, m, hashlib.sha512)')
           WHEN 3 THEN concat('def f(hashlib):', chr(10), '  return hashlib.md5(b"x")')
           WHEN 4 THEN concat('import ssl as s', chr(10), 's.SSLContext()')
           ELSE concat('def broken(:', chr(10), '  pass') END
         WHEN 1 THEN CASE CAST(floor(doc_id / 3) AS BIGINT) % 6
           WHEN 0 THEN 'Cipher.getInstance("AES/GCM/NoPadding");'
           WHEN 1 THEN 'String u = "AES"; KeyGenerator.getInstance("AES").init(256);'
           WHEN 2 THEN 'private AES engine'
           WHEN 3 THEN 'MessageDigest.getInstance("SHA-256");'
           WHEN 4 THEN 'public void md5Hex(String s) {'
           ELSE 'SSLContext c = SSLContext.getInstance("TLSv1.3");' END
         ELSE CASE CAST(floor(doc_id / 3) AS BIGINT) % 6
           WHEN 0 THEN 'c := ecdh.P256()'
           WHEN 1 THEN 'cfg := tls.Config{}'
           WHEN 2 THEN concat('x := getattr(obj,', chr(10), 'kyber)', chr(10), 'y := mlkem.New()')
           WHEN 3 THEN 'AES = 1'
           WHEN 4 THEN 'a, b := chacha20poly1305.New(k)'
           ELSE '// RSA only in a comment' END END,
         chr(10), CASE doc_id % 3 WHEN 0 THEN concat('# ', replace(text, chr(10), concat(chr(10), '# '))) ELSE concat('/* ', text, ' */') END) AS content
FROM documents""",
    "v_manifests": """
SELECT p_partkey AS row_id, p_partkey % 6 AS format_key, p_size % 4 AS name_key,
       concat('repositories/m', CAST(p_partkey AS VARCHAR), '/', CASE p_partkey % 6 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'package-lock.json'
              WHEN 3 THEN 'Gemfile.lock' WHEN 4 THEN 'go.sum' ELSE 'Cargo.lock' END) AS path,
       CASE p_partkey % 6
         WHEN 0 THEN concat('# ', p_name, chr(10), '-r base.txt', chr(10), CASE p_size % 4 WHEN 0 THEN 'Cryptography==41' WHEN 1 THEN 'PyJWT[crypto]>=2' WHEN 2 THEN 'cryptography-impostor==1' ELSE 'Argon2_CFFI ; extra' END,
                            chr(10), chr(10), CASE p_size % 4 WHEN 0 THEN 'cryptography' WHEN 1 THEN 'pyotp # mfa' WHEN 2 THEN 'left-pad' ELSE 'argon2.cffi' END)
         WHEN 1 THEN CASE p_size % 4
           WHEN 0 THEN '<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>java.security</groupId><artifactId>p</artifactId></parent><dependencies><dependency><groupId>org.bouncycastle</groupId><artifactId>bcprov</artifactId></dependency><dependency><groupId>org.bouncycastle</groupId><artifactId>bcpkix</artifactId></dependency></dependencies></project>'
           WHEN 1 THEN '<project><dependencies><dependency><groupId>evil.org.bouncycastle.fake</groupId><artifactId>fake</artifactId></dependency></dependencies></project>'
           WHEN 2 THEN '<!DOCTYPE project><project><dependencies><dependency><groupId>javax.crypto</groupId><artifactId>jce</artifactId></dependency></dependencies></project>'
           ELSE '<project><build><plugins><plugin><groupId>org.bouncycastle</groupId><artifactId>plugin</artifactId></plugin></plugins></build><dependencies><dependency><groupId>Javax.Crypto</groupId><artifactId>jce</artifactId></dependency></dependencies></project>' END
         WHEN 2 THEN CASE p_size % 4
           WHEN 0 THEN '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/crypto-js": {"version": "4.2"}}, "dependencies": {"node_modules/crypto-js": {"version": "1.0"}, "Elliptic": {"version": "6.5"}}}'
           WHEN 1 THEN '{"lockfileVersion": 1, "dependencies": {"jose": {"version": "5.0"}}}'
           WHEN 2 THEN '{"lockfileVersion": 2, "packages": {"node_modules/left-pad": {"version": "1.3"}}}'
           ELSE '{"lockfileVersion": 3, "packages": {' END
         WHEN 3 THEN concat('GEM', chr(10), '  specs:', chr(10), CASE p_size % 4 WHEN 0 THEN '    bcrypt (3.1.20)' WHEN 1 THEN '    openssl (3.2.0)' WHEN 2 THEN 'bcrypt (3.1.20)' ELSE '    rake (13.0)' END, chr(10), '      rbnacl (>= 1)')
         WHEN 4 THEN concat(CASE p_size % 4 WHEN 0 THEN 'golang.org/x/crypto v0.21.0 h1:aa=' WHEN 1 THEN 'filippo.io/ed25519 v1.1.0/go.mod h1:bb=' WHEN 2 THEN 'github.com/golang-jwt/jwt/v5 v5.0.0 h1:cc=' ELSE 'golang.org/x/crypto' END, chr(10), 'github.com/google/tink/go v1.7.0 h1:dd=')
         ELSE concat('version = 3', chr(10), '[[package]]', chr(10), 'name = "', CASE p_size % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'sha2' WHEN 2 THEN 'serde' ELSE 'ed25519_dalek' END, '"', chr(10), 'version = "0.1"', chr(10), chr(10),
                     '[[package]]', chr(10), 'name = "rustls"', chr(10), 'version = "0.23"') END AS content
FROM part""",
    "v_pem": """
SELECT doc_id, concat('certs/c', CAST(doc_id AS VARCHAR), '.pem') AS path, doc_id % 4 AS pem_key,
       concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('-----BEGIN CERTIFICATE-----', chr(10), CASE (doc_id - doc_id % 4) % 12 WHEN 0 THEN '@rsa' WHEN 4 THEN '@ec' ELSE '@ed' END, chr(10), '-----END CERTIFICATE-----')
         WHEN 2 THEN concat(concat('-----BEGIN CERTIFICATE-----', chr(10), CASE (doc_id - doc_id % 4) % 12 WHEN 0 THEN '@rsa' WHEN 4 THEN '@ec' ELSE '@ed' END, chr(10), '-----END CERTIFICATE-----'), chr(10), concat('-----BEGIN CERTIFICATE-----', chr(10), 'AAECAwQF', chr(10), '-----END CERTIFICATE-----'))
         ELSE '-----BEGIN CERTIFICATE----- truncated' END) AS content
FROM documents""",
    "v_certs": """
SELECT p_partkey AS finding_order, concat('certs/', p_brand, '/c', CAST(p_partkey AS VARCHAR), '.pem') AS path,
       CASE p_size % 5 WHEN 0 THEN 'rsa' WHEN 1 THEN 'ec' WHEN 2 THEN 'ed25519' WHEN 3 THEN 'dsa' ELSE 'X448PublicKey' END AS key_type,
       CASE p_size % 5 WHEN 0 THEN 2048 WHEN 1 THEN 256 WHEN 3 THEN 1024 ELSE NULL END AS key_size,
       CASE p_partkey % 5 WHEN 0 THEN '1.3.6.1.5.5.7.3.1' WHEN 1 THEN '1.3.6.1.5.5.7.3.3' WHEN 2 THEN 'emailProtection' WHEN 3 THEN '1.3.6.1.5.5.7.3.2,codeSigning' ELSE '' END AS eku_text,
       concat('certs/s', CAST(p_partkey % 300 AS VARCHAR), '.crt') AS component, CASE p_partkey % 2 WHEN 0 THEN '2026-01-01' ELSE '2027-01-01' END AS not_after
FROM part""",
    "v_audit": """
SELECT event_id AS id, ts AS timestamp, concat('user', CAST(user_id AS VARCHAR)) AS actor_subject, event_type AS action, props AS details FROM events""",
}

#: Certificates made for the view: RSA for servers, an elliptic curve for an authority, Ed25519 for code. Their signatures are not valid.
for _mark, _body in (
    ("@rsa", "MIIBRDCCASCgAwIBAgICA+kwCwYJKoZIhvcNAQELMCMxDDAKBgNVBAoTA09yZzETMBEGA1UEAwwKY2EuZXhhbXBsZTAgFw0yNjAxMDEwMDAwMDBaGA8yMDUxMDEwMjAzMDQwNVowJDEMMAoGA1UEChMDT3JnMRQwEgYDVQQDDAtyc2EuZXhhbXBsZTBcMA0GCSqGSIb3DQEBAQUAA0sAMEgCQQC85c9Dgwxxws3MaSkvReZ4MJ1reZZe2jLa5EVQggHivXOrSHZ3NNfBx/3oBeyZEI3bW1+rj00+J92hSUxzzyVtAgMBAAGjPTA7MB0GA1UdJQQWMBQGCCsGAQUFBwMBBggrBgEFBQcDAjAaBgNVHREEEzARgglhLmV4YW1wbGWHBAoAAAEwCwYJKoZIhvcNAQELAxEAWlpaWlpaWlpaWlpaWlpaWg=="),
    ("@ec", "MIIBAjCB4KADAgECAgID6jAKBggqhkjOPQQDAjAjMQwwCgYDVQQKEwNPcmcxEzARBgNVBAMMCmNhLmV4YW1wbGUwIBcNMjYwMTAxMDAwMDAwWhgPMjA1MTAxMDIwMzA0MDVaMCMxDDAKBgNVBAoTA09yZzETMBEGA1UEAwwKZWMuZXhhbXBsZTA4MBMGByqGSM49AgEGCCqGSM49AwEHAyEA8r/HAnuiIv8R6e9f4qmHe9sEKEaMb7akWPhyz2bd0HWjIzAhMA8GA1UdEwEB/wQFMAMBAf8wDgYDVR0PAQH/BAQDAgWgMAoGCCqGSM49BAMCAxEAWlpaWlpaWlpaWlpaWlpaWg=="),
    ("@ed", "MIHeMIHBoAMCAQICAgPrMAUGAytlcDAjMQwwCgYDVQQKEwNPcmcxEzARBgNVBAMMCmNhLmV4YW1wbGUwIBcNMjYwMTAxMDAwMDAwWhgPMjA1MTAxMDIwMzA0MDVaMCMxDDAKBgNVBAoTA09yZzETMBEGA1UEAwwKZWQuZXhhbXBsZTAqMAUGAytlcAMhAHthTkKKGG9KTBFtr0mf1+gN/h+vQi1QzS0Ybtm55NbjoxcwFTATBgNVHSUEDDAKBggrBgEFBQcDAzAFBgMrZXADEQBaWlpaWlpaWlpaWlpaWlpa"),
):
    VIEWS["v_pem"] = VIEWS["v_pem"].replace(_mark, _body)

# Check-side only: the line view differs in text between the engines.
LINES_CHECK = """
SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) a FROM documents)"""

# Check-side only: the findings chain, written once and shared by the report checks.
CHECKS = {
    "v_lines": LINES_CHECK,
    "k_keyed": """
SELECT *, CASE WHEN usage_raw IN ('sign','verify') THEN 'signature' WHEN usage_raw = 'encryption' THEN 'encryption' ELSE 'unknown' END AS usage,
       CASE WHEN line_start IS NOT NULL THEN concat('line:', CAST(line_start AS VARCHAR), ':column:', CAST(column_start AS VARCHAR))
            ELSE concat('evidence:', substr(sha256(concat_ws(chr(1), usage_raw, library, chr(0), coalesce(CAST(key_size AS VARCHAR), chr(0)), evidence_kind, chr(0), chr(0), chr(0))), 1, 16)) END AS operation_anchor
FROM v_evidence""",
    "k_grouped": """
SELECT substr(sha256(concat_ws(chr(1), 'operation', component, algorithm, usage, evidence_kind, location, operation_anchor)), 1, 16) AS finding_id,
       component, algorithm, usage, evidence_kind, location, operation_anchor,
       CASE usage WHEN 'signature' THEN 'signature' WHEN 'encryption' THEN 'encryption'
            ELSE coalesce(min(category) FILTER (source IN ('ast','cert','rule')), min(category)) END AS category,
       count(*) AS evidence_count, bool_or(source <> 'dep') AS has_direct,
       max(confidence) FILTER (source = 'ast') AS by_ast, max(confidence) FILTER (source = 'cert') AS by_cert,
       max(confidence) FILTER (source = 'dep') AS by_dep, max(confidence) FILTER (source = 'rule') AS by_rule,
       count(DISTINCT source) AS source_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
       count(DISTINCT nullif(library, '')) AS n_library, min(nullif(library, '')) AS low_library,
       count(DISTINCT key_size) AS n_key_size, min(key_size) AS low_key_size
FROM k_keyed GROUP BY component, algorithm, usage, evidence_kind, location, operation_anchor""",
    "k_suppressed": """
SELECT component, algorithm FROM k_grouped GROUP BY component, algorithm
HAVING NOT bool_or(has_direct) AND component IN (SELECT component FROM k_grouped WHERE has_direct)""",
    "k_clashes": """
SELECT DISTINCT location, operation_anchor FROM
 (SELECT location, operation_anchor, category FROM k_keyed WHERE source <> 'dep' GROUP BY ALL HAVING count(DISTINCT algorithm) > 1)""",
    "v_findings": """
SELECT f.finding_id, f.component, f.algorithm, f.usage, f.evidence_kind, f.location, f.operation_anchor, f.category, f.sources, f.source_count,
       f.by_ast, f.by_cert, f.by_dep, f.by_rule, f.evidence_count,
       CASE WHEN n_library = 1 THEN low_library ELSE '' END AS library, '' AS protocol,
       CASE WHEN n_key_size = 1 AND low_key_size > 0 THEN low_key_size END AS key_size,
       n_library > 1 AS library_conflict, (n_key_size > 1 OR coalesce(low_key_size <= 0, false)) AS key_size_conflict,
       c.location IS NOT NULL AS operation_conflict,
       (c.location IS NOT NULL OR n_library > 1 OR n_key_size > 1 OR coalesce(low_key_size <= 0, false)) AS conflict
FROM k_grouped f
LEFT JOIN k_suppressed s ON f.component = s.component AND f.algorithm = s.algorithm
LEFT JOIN k_clashes c ON f.location = c.location AND f.operation_anchor = c.operation_anchor
WHERE s.component IS NULL""",
    "k_scored": """
SELECT f.*,
       round(greatest(0.0, CAST(CASE evidence_kind WHEN 'observed_operation' THEN 0.90 WHEN 'configured_protocol' THEN 0.85 WHEN 'declared_capability' THEN 0.65
             WHEN 'artifact_metadata' THEN 0.50 ELSE 0.30 END AS DOUBLE) - CASE WHEN conflict THEN CAST(0.20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS confidence,
       coalesce(x.business_criticality, 'medium') AS business_criticality, coalesce(x.data_sensitivity, 'medium') AS data_sensitivity,
       coalesce(x.data_lifetime_years, 10) AS data_lifetime_years, coalesce(x.migration_time_years, 3) AS migration_time_years, 15 AS threat_horizon_years,
       coalesce(x.exposure, 'internal') AS exposure, coalesce(x.migration_effort, 'medium') AS migration_effort, x.component IS NOT NULL AS has_context,
       regexp_replace(f.algorithm, '[-_][0-9]+.*$', '') IN ('RSA','ECDSA','ECDH','DH','DSA','ECC') AS quantum_vulnerable,
       evidence_kind IN ('observed_operation','configured_protocol') AS confirmed_use, evidence_kind IN ('declared_capability','artifact_metadata') AS capability_only
FROM v_findings f LEFT JOIN v_context x ON f.component = x.component""",
    "v_scored": """
SELECT t.*, CASE WHEN priority_score >= 75 THEN 'CRITICAL' WHEN priority_score >= 50 THEN 'HIGH' WHEN priority_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority_label,
       CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' WHEN confidence >= 0.4 THEN 'LOW' ELSE 'UNCERTAIN' END AS confidence_band,
       CASE WHEN algorithm IN ('RSA','ECDH','DH','ECC') AND usage IN ('encryption','key_establishment','tls')
              THEN concat('Evaluate ML-KEM for key establishment', CASE WHEN migration_effort IN ('high','critical') THEN '; use a standards-approved classical/PQC hybrid transition where compatibility requires it' ELSE '' END)
            WHEN algorithm IN ('RSA','ECDSA','DSA','ECC') AND usage = 'signature'
              THEN concat('Evaluate ML-DSA; consider SLH-DSA where conservative hash-based signatures fit', CASE WHEN migration_effort IN ('high','critical') THEN '; use a standards-approved classical/PQC hybrid transition where compatibility requires it' ELSE '' END)
            WHEN algorithm = 'AES' THEN 'Retain symmetric design; prefer AES-256 for long-lived data'
            WHEN algorithm IN ('MD5','SHA-1') THEN 'Replace deprecated hash with SHA-256 or SHA-3 independent of quantum migration'
            WHEN algorithm LIKE 'SHA%' OR algorithm IN ('BLAKE2','hash') THEN 'Use SHA-256/SHA-3 with adequate output length; no public-key migration required'
            WHEN algorithm IN ('ML-KEM','ML-DSA','SLH-DSA') THEN 'Already aligned with a NIST post-quantum standard; validate implementation and protocol'
            ELSE 'Assess algorithm, protocol role, compatibility and standards profile' END AS pqc_candidate,
       ((algorithm IN ('RSA','ECDH','DH','ECC') AND usage IN ('encryption','key_establishment','tls')) OR (algorithm IN ('RSA','ECDSA','DSA','ECC') AND usage = 'signature'))
         AND migration_effort IN ('high','critical') AS hybrid_recommended,
       concat_ws('; ', CASE WHEN quantum_vulnerable THEN concat(algorithm, ' (', CASE WHEN confirmed_use THEN 'confirmed use of' WHEN capability_only THEN 'capability-only exposure to' ELSE 'evidence of' END, ') is vulnerable to large-scale quantum attacks')
                            ELSE concat(algorithm, ' has no modeled Shor-algorithm exposure') END,
                 concat('Mosca window ', CAST(mosca_window_years AS VARCHAR), 'y ', CASE WHEN threat_overlap THEN 'overlaps' ELSE 'does not overlap' END, ' 15y threat horizon'),
                 concat('Data sensitivity is ', data_sensitivity), concat('Business criticality is ', business_criticality),
                 concat('Exposure is ', exposure), concat('Migration effort is ', migration_effort)) AS risk_reasons
FROM (SELECT s.*, data_lifetime_years + migration_time_years AS mosca_window_years,
             quantum_vulnerable AND data_lifetime_years + migration_time_years >= 15 AS threat_overlap,
             CASE WHEN quantum_vulnerable THEN CASE WHEN confirmed_use THEN 15 WHEN capability_only THEN 8 ELSE 10 END ELSE 0 END
             + CASE WHEN quantum_vulnerable AND data_lifetime_years + migration_time_years >= 15 THEN 25 ELSE 0 END
             + CASE data_sensitivity WHEN 'low' THEN 3 WHEN 'high' THEN 11 WHEN 'critical' THEN 15 ELSE 7 END
             + CASE business_criticality WHEN 'low' THEN 3 WHEN 'high' THEN 11 WHEN 'critical' THEN 15 ELSE 7 END
             + CASE exposure WHEN 'isolated' THEN 0 WHEN 'partner' THEN 7 WHEN 'internet' THEN 10 ELSE 3 END
             + CASE migration_effort WHEN 'low' THEN 1 WHEN 'high' THEN 5 WHEN 'critical' THEN 5 ELSE 3 END AS priority_score
      FROM k_scored s) t""",
}

_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


#: Views whose rows are dealt out before they are derived: table, unique key, and rows for one task. So many rows are some seconds
#: of work and some tens of MB in one task, however large the table is.
SPREAD = {
    "v_evidence": ("lineitem", ("l_orderkey", "l_linenumber"), 250_000),
    "v_code": ("documents", ("doc_id",), 5_000),
    "v_manifests": ("part", ("p_partkey",), 50_000),
}


class Tables:
    """The test tables and derived views of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, view: str) -> int:
        """Over how many tasks the rows of a view are dealt: one per core, more in proportion to the rows (a count of Parquet footers)."""
        name, _, rows = SPREAD[view]
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table(name).count() // rows))

    def dealt(self, view: str) -> DataFrame:
        """The table under a view, dealt by its key: a few splits can hold any number of rows. By key, since dealing in turn would sort first."""
        name, key, _ = SPREAD[view]
        return self.table(name).repartition(self.tasks(view), *key)

    def sql(self, text: str) -> DataFrame:
        """Run view text against the parquet files of this folder."""
        text = _TABLE.sub(lambda m: f"{m[1]} parquet.`{self.folder}/{m[2]}.parquet`", text)
        return self.spark.sql(text.replace("VARCHAR", "STRING"))

    def view(self, name: str) -> DataFrame:
        if name not in SPREAD:
            return self.sql(VIEWS[name])
        source = f"dealt_{uuid.uuid4().hex}"
        self.dealt(name).createTempView(source)
        try:
            return self.sql(_TABLE.sub(lambda m: f"{m[1]} {source}", VIEWS[name]))
        finally:
            self.spark.catalog.dropTempView(source)

    def lines(self) -> DataFrame:
        return self.dealt("v_code").selectExpr("doc_id", "posexplode(split(text, '\\n')) AS (i, line)")


def with_views(check: str) -> str:
    """Prefix check SQL with the views it names, in dependency order."""
    bodies = {**VIEWS, **CHECKS}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[vk]_\w+\b", text):
            if name in bodies and name not in needed:
                visit(bodies[name])
                needed.append(name)

    visit(check)
    if not needed:
        return check
    return "WITH " + ",\n".join(f"{n} AS ({bodies[n]})" for n in needed) + "\n" + check
