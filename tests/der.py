"""Makes DER certificates for tests; their signatures are not valid."""

from __future__ import annotations

import base64
import random


def tlv(tag: int, value: bytes) -> bytes:
    size = len(value)
    if size < 0x80:
        return bytes([tag, size]) + value
    length = size.to_bytes((size.bit_length() + 7) // 8)
    return bytes([tag, 0x80 | len(length)]) + length + value


def seq(*parts: bytes) -> bytes:
    return tlv(0x30, b"".join(parts))


def integer(value: int) -> bytes:
    return tlv(0x02, value.to_bytes(value.bit_length() // 8 + 1, signed=True))


def oid(dotted: str) -> bytes:
    first, second, *rest = map(int, dotted.split("."))
    out = b""
    for arc in [40 * first + second, *rest]:
        groups = [arc & 0x7F]
        while arc := arc >> 7:
            groups.append(0x80 | arc & 0x7F)
        out += bytes(reversed(groups))
    return tlv(0x06, out)


def name(common: str, tag: int = 0x0C) -> bytes:
    return seq(tlv(0x31, seq(oid("2.5.4.10"), tlv(0x13, b"Org"))), tlv(0x31, seq(oid("2.5.4.3"), tlv(tag, common.encode()))))


def key(kind: str, bits: int = 0, seed: int = 1) -> bytes:
    rng = random.Random(seed)
    number = (1 << bits - 1) | rng.getrandbits(bits - 1) if bits else 0
    point = tlv(0x03, b"\0" + rng.randbytes(32))
    if kind == "rsa":
        return seq(seq(oid("1.2.840.113549.1.1.1"), tlv(0x05, b"")), tlv(0x03, b"\0" + seq(integer(number), integer(65537))))
    if kind == "dsa":
        return seq(seq(oid("1.2.840.10040.4.1"), seq(integer(number), integer(3), integer(2))), tlv(0x03, b"\0" + integer(5)))
    if kind == "ec":
        curve = {256: "1.2.840.10045.3.1.7", 384: "1.3.132.0.34", 521: "1.3.132.0.35"}[bits]
        return seq(seq(oid("1.2.840.10045.2.1"), oid(curve)), point)
    return seq(seq(oid(kind)), point)


def extension(dotted: str, value: bytes, critical: bool = False) -> bytes:
    return seq(oid(dotted), *([tlv(0x01, b"\xff")] if critical else []), tlv(0x04, value))


def certificate(
    public: bytes, common: str = "host", issuer: str = "ca", serial: int = 7, signature: str = "1.2.840.113549.1.1.11", extensions: tuple[bytes, ...] = (),
    before: bytes = tlv(0x17, b"260101000000Z"), after: bytes = tlv(0x18, b"20510102030405Z"), version: int = 3,
) -> bytes:
    start = [tlv(0xA0, integer(version - 1))] if version > 1 else []
    body = seq(
        *start, integer(serial), seq(oid(signature)), name(issuer), seq(before, after), name(common), public,
        *([tlv(0xA3, seq(*extensions))] if extensions else []),
    )
    return seq(body, seq(oid(signature)), tlv(0x03, b"\0" + b"\x5a" * 16))


def pem(data: bytes) -> str:
    return f"-----BEGIN CERTIFICATE-----\n{base64.b64encode(data).decode()}\n-----END CERTIFICATE-----"


EKU, KEY_USAGE, BASIC, SAN = "2.5.29.37", "2.5.29.15", "2.5.29.19", "2.5.29.17"
SERVER = extension(EKU, seq(oid("1.3.6.1.5.5.7.3.1"), oid("1.3.6.1.5.5.7.3.2")))
CODE = extension(EKU, seq(oid("1.3.6.1.5.5.7.3.3")))
NAMES = extension(SAN, seq(tlv(0x82, b"a.example"), tlv(0x87, bytes([10, 0, 0, 1]))))
SIGN_AND_WRAP = extension(KEY_USAGE, tlv(0x03, b"\x05\xa0"), critical=True)
AUTHORITY = extension(BASIC, seq(tlv(0x01, b"\xff")), critical=True)
