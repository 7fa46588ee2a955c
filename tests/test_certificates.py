from __future__ import annotations

import random

import pytest

from proofline.operators import certificates, x509
from proofline.sources import collect
from tests import der


def fields(data):
    return x509.decode(data)


def test_fields_of_a_server_certificate():
    data = der.certificate(der.key("rsa", 2048), "www.example", "root", 12345678901234567890, extensions=(der.SERVER, der.NAMES, der.SIGN_AND_WRAP, der.AUTHORITY))
    assert fields(data) == {
        "key_type": "rsa", "key_size": 2048, "subject_cn": "www.example", "issuer": "root", "version": "v3", "not_before": "2026-01-01T00:00:00+00:00",
        "not_after": "2051-01-02T03:04:05+00:00", "serial_number": "12345678901234567890", "signature_hash_algorithm": "sha256",
        "signature_algorithm": "sha256WithRSAEncryption", "eku_oids": ["1.3.6.1.5.5.7.3.1", "1.3.6.1.5.5.7.3.2"],
        "key_usage": ["digitalSignature", "keyEncipherment"], "is_ca": True, "san": ["a.example", "10.0.0.1"],
    }


@pytest.mark.parametrize("public,kind,size", [
    (der.key("rsa", 1024), "rsa", 1024), (der.key("rsa", 4096), "rsa", 4096), (der.key("dsa", 1024), "dsa", 1024), (der.key("ec", 256), "ec", 256),
    (der.key("ec", 384), "ec", 384), (der.key("ec", 521), "ec", 521), (der.key("1.3.101.112"), "ed25519", 0), (der.key("1.3.101.113"), "Ed448PublicKey", 0),
])
def test_key_types_and_sizes(public, kind, size):
    found = fields(der.certificate(public))
    assert (found["key_type"], found["key_size"]) == (kind, size)


def test_versions_times_and_names():
    old = fields(der.certificate(der.key("ec", 256), version=1, before=der.tlv(0x17, b"510203040506Z")))
    assert old["version"] == "v1" and old["not_before"] == "1951-02-03T04:05:06+00:00" and old["eku_oids"] == [] and old["is_ca"] is False
    body = der.certificate(der.key("ec", 256), common="é host")
    assert fields(body)["subject_cn"] == "é host"
    assert fields(der.certificate(der.key("ec", 256), signature="1.2.3.4"))["signature_algorithm"] == "1.2.3.4"


def test_what_does_not_hold_is_refused():
    good = der.certificate(der.key("ec", 256), extensions=(der.SERVER,))
    bad = [
        b"", good[:-1], good + b"\0", good[:40], b"\x30\x80" + good, der.certificate(der.key("ec", 256), serial=0), der.certificate(der.key("ec", 256), serial=-5),
        der.certificate(der.key("1.2.3")), der.certificate(der.key("ec", 256), before=der.tlv(0x17, b"269901000000Z")), der.certificate(der.key("ec", 256), version=2),
    ]
    assert fields(good) and [fields(b) for b in bad] == [None] * len(bad)


def test_a_broken_extension_counts_as_absent():
    broken = der.extension(der.EKU, b"\x30\x7f\x01")
    found = fields(der.certificate(der.key("ec", 256), extensions=(broken, der.NAMES)))
    assert found["eku_oids"] == [] and found["san"] == ["a.example", "10.0.0.1"]


def test_random_damage_never_escapes():
    rng, good = random.Random(3), der.certificate(der.key("rsa", 512), extensions=(der.SERVER, der.NAMES, der.SIGN_AND_WRAP))
    for _ in range(3000):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        x509.decode(bytes(data[:rng.randint(1, len(data))] if rng.random() < 0.3 else data))


def test_a_scan_decodes_its_certificates(spark):
    server, code, bad = der.certificate(der.key("rsa", 2048), extensions=(der.SERVER,)), der.certificate(der.key("1.3.101.112"), extensions=(der.CODE,)), b"\x30\x03\x02\x01\x01"
    rows = [
        ("certs/bundle.pem", f"text\n{der.pem(server)}\n{der.pem(bad)}\n{der.pem(code)}"), ("certs/one.CRT", der.pem(der.certificate(der.key("ec", 384)))),
        ("certs/none.cer", "no block"), ("certs/broken.pem", "-----BEGIN CERTIFICATE-----\n?!\n-----END CERTIFICATE-----"), ("readme.txt", der.pem(server)),
    ]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content string")
    for hold in (False, True):
        scan = collect.scan(files, hold=hold)
        found = {(r.location, r.algorithm, r.key_size, r.usage_raw, r.evidence_kind) for r in scan.evidence.where("source = 'cert'").collect()}
        assert found == {
            ("certs/bundle.pem", "RSA", 2048, "tls", "configured_protocol"), ("certs/bundle.pem", "Ed25519", 0, "signature", "configured_protocol"),
            ("certs/one.CRT", "ECDSA", 384, "unknown", "artifact_metadata"),
        }
        failed = sorted(r.path for r in scan.failures.where("reason = 'certificate_error'").collect())
        assert failed == ["certs/broken.pem", "certs/bundle.pem", "certs/none.cer"]


def test_blocks_keep_their_places(spark):
    content = "\n".join([der.pem(der.certificate(der.key("ec", 256), f"h{i}")) for i in range(3)] + [der.pem(b"x")])
    files = spark.createDataFrame([("a.pem", content), ("b.pem", None)], "path string, content string")
    rows = certificates.decoded_blocks(files).orderBy("block").collect()
    assert [(r.block, r.decoded, r.subject_cn) for r in rows] == [(0, True, "h0"), (1, True, "h1"), (2, True, "h2"), (3, False, None)]
    assert {r.path for r in certificates.pem_failures(files).collect()} == {"a.pem", "b.pem"}
