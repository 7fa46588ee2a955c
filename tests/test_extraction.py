"""Source, manifest and certificate extraction on literal files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import text as X
from proofline.operators import certificates, manifests, python_calls, source_rules
from proofline.sources import collect, files

DIGESTS = {"md5": "MD5", "sha1": "SHA-1", "sha256": "SHA-256", "sha512": "SHA-512", "blake2b": "BLAKE2"}
#: How a digest function gets its name: import, name bound by it, and the function as called.
BINDINGS = {
    "module": ("import hashlib", "hashlib", "hashlib.{f}"),
    "renamed_module": ("import hashlib as tools", "tools", "tools.{f}"),
    "function": ("from hashlib import {f}", "{f}", "{f}"),
    "renamed_function": ("from hashlib import {f} as pick", "pick", "pick"),
}
#: Where a call stands, and whether the bound name still means the import there.
PLACES = {
    "module": ("{call}(v)", True),
    "method": ("class Store:\n    def put(self, v):\n        return {call}(v)", True),
    "coroutine": ("async def put(v):\n    async with v:\n        return {call}(v)", True),
    "lambda": ("run = lambda v: {call}(v)", True),
    "comprehension": ("out = [{call}(v) for v in values if v]", True),
    "nested": ("def outer():\n    def inner(v):\n        return {call}(v)\n    return inner", True),
    "lambda_parameter": ("run = lambda {name}: {call}(v)", False),
    "loop_variable": ("out = [{call}(v) for {name} in values]", False),
    "local": ("def put(v):\n    {name} = v\n    return {call}(v)", False),
    "other_import": ("import unrelated as {name}\n{call}(v)", False),
    "docstring": ("def put(v):\n    \"\"\"Like {call}(v).\"\"\"\n    return v", False),
}
#: A provider call by language with its algorithm, and the comment marks of that language.
SELECTORS = [
    (".java", 'Signature.getInstance("SHA256withRSA")', "RSA", "//"),
    (".java", 'KeyGenerator.getInstance("ChaCha20")', "ChaCha20", "//"),
    (".js", "crypto.createHash('sha512')", "SHA-512", "//"),
    (".go", "sha1.New()", "SHA-1", "//"),
]


def python_grid():
    for f, algorithm in DIGESTS.items():
        for bound, (imported, name, call) in BINDINGS.items():
            for place, (text, seen) in PLACES.items():
                name_, call_ = name.format(f=f), call.format(f=f)
                yield f"grid_{f}_{bound}_{place}.py", f"{imported.format(f=f)}\n{text.format(name=name_, call=call_)}\n", {algorithm} if seen else set()


def selector_grid():
    for i, (suffix, call, algorithm, mark) in enumerate(SELECTORS):
        yield f"code{i}{suffix}", f"begin();\nuse({call});\n", {algorithm}
        yield f"twice{i}{suffix}", f"use({call}); use({call});", {algorithm}
        yield f"line_note{i}{suffix}", f"begin(); {mark} {call}\n", set()
        yield f"long_note{i}{suffix}", f"/* first\n{call}\n*/ begin();", set()
        yield f"after_note{i}{suffix}", f"/* first */ use({call});", {algorithm}


CASES = [
    *python_grid(),
    *selector_grid(),
    ("argument.py", "import hashlib\n\n\ndef check(payload, hashlib):\n    return hashlib.sha256(payload)\n", set()),
    ("relative.py", "from .hashlib import sha256\nsha256()", set()),
    ("attribute.py", "import hashlib\nhashlib.md5 = other\nhashlib.md5()", set()),
    ("default.py", "import hashlib\ndef f(x=hashlib.md5()):\n pass", {"MD5"}),
    ("kdf.py", "import hashlib\nhashlib.pbkdf2_hmac('sha256', b'p', b's', 1)", {"PBKDF2"}),
    ("nomode.py", "from Crypto.Cipher import AES as Engine\nEngine.new(key)", {"AES"}),
    ("constant.go", "AES = 1\nRSA_KEY = 2", {"RSA"}),
    ("crate.rs", "let h = Hmac::<Sha256>::new_from_slice(k);", {"HMAC", "SHA-256"}),
    ("hmac.js", "const m = crypto.createHmac('sha512', k)", {"HMAC", "SHA-512"}),
    ("mac.java", "x = new HMac(new SHA256Digest());", set()),
]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = spark.createDataFrame([(f"app/{n}", c, len(c)) for n, c, _ in CASES], "path string, content string, length long")
    found = collect.scan(rows).evidence.select("location", "algorithm").distinct().collect()
    result: dict = {}
    for r in found:
        result.setdefault(r["location"], set()).add(r["algorithm"])
    return result


@pytest.mark.parametrize("name, source, expected", CASES, ids=[c[0] for c in CASES])
def test_expected_algorithms(scanned, name, source, expected):
    assert scanned.get(f"app/{name}", set()) == expected


def test_masking_keeps_lines_and_selectors():
    source = 'a = "x;y" // note\nCipher.getInstance( "AES" , "BC");\n/* two\nlines */ `t`'
    masked = source_rules.mask(source, ".java")
    assert len(masked) == len(source) and masked.count("\n") == source.count("\n")
    assert '"AES"' in masked and "BC" not in masked and "note" not in masked and "two" not in masked
    assert source_rules.mask("x = 1 # y", ".go") == "x = 1 # y"


def test_statements_and_columns():
    assert list(source_rules.split_statements('a;"b;c";d\ne')) == [(1, 0, "a"), (1, 2, '"b;c"'), (1, 8, "d"), (2, 0, "e")]


def test_dynamic_regions_close_with_their_parentheses():
    flags = [s["dynamic"] for s in source_rules.marked_statements("x = getattr(\no,\nkyber)\ny = mlkem\n", ".go")]
    assert flags == [True, True, True, False]


def test_marks_never_hide_a_match(spark):
    texts = [
        "EVP_PKEY_derive_init", "KeyPairGenerator.getInstance(EC)", "org.apache.commons.codec", "shaCrypt(x)", "APR1CRYPT", "tweetnacl", "gcm.New(k)",
        "TLSv1_2", "SSLv23_method()", "x509.Certificate", "Diffie-Hellman", "HMAC (x)", "HMAC_Final", "new HMACSHA1", "sha-1", "SHA_DIGEST_LENGTH", "crypto.subtle.decrypt",
        "getDigest(SHA_1)", "MessageDigest.getInstance('SHA1')", "EC_GROUP_new_curve", "ml_dsa", "Dilithium", "ChaChaEngine", "get(X, SHA_512)", "sha2Crypt(SHA_256)",
    ] + [p for _, _, patterns in C.RULE_PACK for p in patterns if p.isalnum()]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for java in (False, True):
        gated = source_rules.matched_algorithms(F.col("text"), F.lower("text"), F.lit(java))
        plain = source_rules.matched_algorithms(F.col("text"), F.lower("text"), F.lit(java), marks={})
        for r in rows.select("text", gated.alias("g"), plain.alias("p"), source_rules.may_match(F.lower("text")).alias("m")).collect():
            assert r["g"] == r["p"] and (r["m"] or not r["p"]), r["text"]


def test_first_pattern_and_key_size(spark):
    code = 'KeyGenerator.getInstance("AES").init(256); crypto.createECDH(x); RSA.generate(2048, e)'
    rows = spark.createDataFrame([("a.js", code)], "path string, content string")
    found = {(r["algorithm"], r["column_start"]): r for r in source_rules.evidence(rows).collect()}
    assert found["AES", 0]["key_size"] == 256 and found["RSA", 64]["key_size"] == 2048
    assert found["ECDSA", 42]["details"]["pattern"] == r"crypto\.createECDH" and found["ECDH", 42]["details"]["pattern"] == "ECDH"
    assert found["ECDH", 42]["usage_raw"] == "key_establishment"


def test_hmac_digest_and_unparsable_file(spark):
    rows = spark.createDataFrame([
        ("a.py", "import hmac, hashlib\nhmac.new(k, m, hashlib.sha256)\nhmac.digest(k, m, 'SHA-512')\nhmac.new(k, digestmod='md5')"), ("b.py", "def ("),
    ], "path string, content string")
    facts = python_calls.facts(rows)
    digests = sorted(r["details"]["digest_algorithm"] for r in python_calls.call_evidence(facts).collect())
    assert digests == ["MD5", "SHA-256", "SHA-512"]
    assert [(r["path"], r["reason"]) for r in python_calls.parse_failures(facts).collect()] == [("b.py", "parse_error")]


@pytest.mark.parametrize("line, package", [
    ("cryptography # application crypto", "cryptography"), ('cryptography; python_version >= "3.10"', "cryptography"),
    ("Argon2_CFFI==23.1", "argon2-cffi"), ("python-jose[cryptography]>=3", "python-jose"), ("cryptography-impostor==1", None), ("-r x", None), ("# bcrypt", None),
])
def test_requirements(spark, line, package):
    rows = spark.createDataFrame([("x/requirements.txt", f"{line}\n{line}\n")], "path string, content string")
    assert [r["package"] for r in manifests.declared_packages(rows).collect()] == ([package] if package else [])


POM = "<project xmlns='http://maven.apache.org/POM/4.0.0'><dependencies>%s</dependencies></project>"
DEPENDENCY = "<dependency><groupId>%s</groupId><artifactId>%s</artifactId></dependency>"


@pytest.mark.parametrize("document, count, failed", [
    (POM % (DEPENDENCY % ("org.bouncycastle", "a") + DEPENDENCY % ("org.bouncycastle", "b") + DEPENDENCY % ("org.bouncycastle", "a")), 2, False),
    (POM % (DEPENDENCY % ("evil.org.bouncycastle.fake", "a")), 0, False),
    ("<!DOCTYPE x>" + POM % (DEPENDENCY % ("org.bouncycastle", "a")), 0, True),
    ("<project><groupId>org.bouncycastle</groupId>", 0, True),
    ("<project><!-- " + DEPENDENCY % ("org.bouncycastle", "a") + " --></project>", 0, False),
])
def test_pom(spark, document, count, failed):
    rows = spark.createDataFrame([("x/pom.xml", document)], "path string, content string")
    assert manifests.declared_packages(rows).count() == count
    assert (manifests.manifest_failures(rows).count() == 1) is failed


def test_lock_files_expand_to_algorithms(spark):
    rows = spark.createDataFrame([
        ("a/go.sum", "golang.org/x/crypto v1 h1:x=\ngolang.org/x/crypto v1/go.mod h1:y=\n"),
        ("a/Cargo.lock", '[[package]]\nname = "ring"\nversion = "1"\n\n[[package]]\nname = "ring"\nversion = "2"\n'),
        ("a/Gemfile.lock", "GEM\n  specs:\n    openssl (3.0)\n"), ("a/package-lock.json", '{"packages": {"node_modules/@s/jose": {"version": "1"}}}'),
    ], "path string, content string")
    found = manifests.evidence(rows)
    assert {r["location"]: r["n"] for r in found.groupBy("location").agg(F.count("*").alias("n")).collect()} == {
        "a/go.sum": 4, "a/Cargo.lock": 4, "a/Gemfile.lock": 3, "a/package-lock.json": 3}
    assert found.where("source = 'dep' and evidence_kind = 'declared_capability' and confidence = 0.7").count() == 14


def test_certificates(spark):
    decoded = spark.createDataFrame([
        ("a.crt", "rsa", 2048, ["1.3.6.1.5.5.7.3.1"]), ("b.crt", "ed25519", None, []), ("c.crt", "Other", 1, ["codeSigning"]),
    ], "path string, key_type string, key_size int, eku_oids array<string>")
    rows = {r["location"]: (r["algorithm"], r["category"], r["key_size"], r["usage_raw"], r["evidence_kind"]) for r in certificates.evidence(decoded).collect()}
    assert rows == {"a.crt": ("RSA", "encryption", 2048, "tls", "configured_protocol"), "b.crt": ("Ed25519", "signature", 0, "unknown", "artifact_metadata"),
                    "c.crt": ("Other", "unknown", 1, "signature", "configured_protocol")}


def test_redaction_is_recursive(spark):
    rows = spark.createDataFrame([({"Token": "x", "note": "password = y", "ok": "z"}, (["api_key: 1", "plain"], "secret value"))],
                                 "m map<string,string>, s struct<list:array<string>,snippet:string>")
    row = X.redact_columns(rows, "m", "s").first()
    assert row["m"] == {"Token": C.REDACTED, "note": C.REDACTED, "ok": "z"}
    assert row["s"]["list"] == [C.REDACTED, "plain"] and row["s"]["snippet"] == C.REDACTED


def test_tree_scan(spark, tmp_path):
    for name, body in {"src/__init__.py": "import ssl\n", "node_modules/x.py": "import ssl\n", "venv/y.py": "import ssl", "src/big.py": "#" * 200,
                       "src/notes.md": "AES", "src/bad.py": "def (", "src/a.pem": "nothing"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "src" / "link.py").symlink_to(tmp_path / "src" / "bad.py")
    tree = files.read_tree(spark, str(tmp_path), max_bytes=100)
    rows = tree.withColumn("path", F.col("relative"))
    scoped = files.with_failure(files.inventory(rows), 100)
    assert {r["path"] for r in scoped.collect()} == {"src/__init__.py", "src/big.py", "src/notes.md", "src/bad.py", "src/a.pem", "src/link.py"}
    assert {(r["path"], r["reason"]) for r in files.read_failures(scoped).collect()} == {("src/big.py", "oversized"), ("src/link.py", "linked_file")}
    scan = collect.scan(rows.where("path <> 'src/big.py'"))
    failed = files.failures(scan.failures)
    assert [(r["path"], r["reason"]) for r in failed.collect()] == [
        ("src/a.pem", "certificate_error"), ("src/bad.py", "parse_error"), ("src/link.py", "linked_file")]
    row = files.coverage(scan.scoped, scan.failures).first()
    assert (row["total_files"], row["in_scope_files"], row["failed_files"], row["coverage_pct"]) == (5, 4, 3, 25.0)
    with pytest.raises(ValueError, match="file count"):
        files.list_tree(spark, str(tmp_path), max_files=2)
    with pytest.raises(ValueError, match="profile"):
        files.excluded_dirs("sources")


@pytest.mark.parametrize("above", ["build/checkout", "env/dist/one", "plain"])
def test_only_names_below_the_root_exclude(spark, tmp_path, above):
    root = tmp_path / above
    for name in ("a.py", "deep/er/b.py", "deep/build/c.py", "env/d.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("import hashlib\nhashlib.md5(x)\n")
    scan = collect.scan(files.read_tree(spark, str(root)))
    assert {r["relative"] for r in scan.scoped.collect()} == {"a.py", "deep/er/b.py"}
    assert {r["location"] for r in scan.evidence.where("algorithm = 'MD5'").collect()} == {str(root / "a.py"), str(root / "deep/er/b.py")}


def test_files_of_any_size_are_scanned_unless_a_limit_is_given(spark):
    body = "#" * 9_000_000 + "\nimport hashlib\nhashlib.md5(x)\n"
    rows = spark.createDataFrame([("app/big.py", body, len(body))], "path string, content string, length long")
    assert collect.scan(rows).evidence.where("algorithm = 'MD5'").count() >= 1
    limited = collect.scan(rows, max_bytes=8_000_000)
    assert limited.evidence.count() == 0 and [r["reason"] for r in limited.failures.collect()] == ["oversized"]


def test_a_long_comment_before_the_literal_changes_nothing(spark):
    body = "Cipher.getInstance(/*" + "x" * 900 + '*/ "AES/GCM/NoPadding");'
    rows = spark.createDataFrame([("app/A.java", body, len(body))], "path string, content string, length long")
    assert {r["algorithm"] for r in collect.scan(rows).evidence.collect()} == {"AES"}


def test_a_held_scan_opens_files_once(spark, tmp_path):
    (tmp_path / "build").mkdir()
    for name, body in {"a.py": "import hashlib\nhashlib.md5(x)\n", "requirements.txt": "cryptography==41\n", "c.pem": "none", "d.py": "def ("}.items():
        (tmp_path / "build" / name).write_text(body)
    tree = files.read_tree(spark, str(tmp_path / "build"))
    held, plain = collect.scan(tree, hold=True), collect.scan(tree)
    for one in (held.evidence, held.failures):
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert "_read" not in plan and "MapInPandas load" not in plan
    rows = lambda df: sorted(map(str, df.drop("path", "details").collect()))
    assert rows(held.evidence) == rows(plain.evidence) and rows(held.failures) == rows(plain.failures)
    assert held.failures.count() == 2


def test_broken_manifests_are_failures(spark):
    good = '[[package]]\nname = "ring"\nversion = "0.1"\ndependencies = [\n "a 1",\n]\nn = 3 # c\n'
    cases = {
        "a/pom.xml": ("<project><a><b></a></b></project>", True), "b/pom.xml": ("<project><a><b/></a></project>", False),
        "c/pom.xml": ("<project><a>x & y</a></project>", True), "d/pom.xml": ('<?xml version="1.0"?><!-- c --><project xmlns="u"><a/></project>', False),
        "a/Cargo.lock": (good.replace('= "ring"', '= = "ring"'), True), "b/Cargo.lock": (good, False),
        "c/Cargo.lock": (good.replace('"ring"', '"ring'), True), "d/Cargo.lock": ("", False),
    }
    rows = spark.createDataFrame([(p, c) for p, (c, _) in cases.items()], "path string, content string")
    assert {r["path"] for r in manifests.manifest_failures(rows).collect()} == {p for p, (_, bad) in cases.items() if bad}


def test_records_carry_the_lines_of_their_call_and_why_they_are_believed(spark):
    content = "import hashlib\n\ndigest = hashlib.sha256(\n    b'one'\n    + join(\n        b'two',\n    )\n)\n"
    found = python_calls.evidence(python_calls.facts(spark.createDataFrame([("a.py", content)], "path string, content string")))
    calls = {(r["evidence_kind"], r["line_start"], r["line_end"], r["confidence_note"]) for r in found.collect()}
    assert ("observed_operation", 3, 6, "direct call site confirmed in source") in calls
    assert {(start, end, note) for kind, start, end, note in calls if kind == "declared_capability"} <= {(1, 1, "import only; no confirmed operation")}
    rows = spark.createDataFrame([("x/requirements.txt", "cryptography==1\n")], "path string, content string")
    assert {(r["line_end"], r["confidence_note"]) for r in manifests.evidence(rows).collect()} == {(None, "dependency declared; operation not confirmed")}


def test_calls_that_select_an_algorithm_are_found_behind_any_number_of_blanks():
    assert len("KeyPairGenerator.getInstance(") < source_rules.SELECTOR_REACH
    gap = " " * 500 + "/* why */\n" * 50
    masked = source_rules.mask(f'Cipher{gap}.{gap}getInstance{gap}({gap}"AES/GCM")', ".java")
    assert '"AES/GCM"' in masked and "why" not in masked
