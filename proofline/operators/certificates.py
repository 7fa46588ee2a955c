"""PEM blocks, the certificates in them, and evidence from their fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline import catalogs as C
from proofline.functions import evidence as E
from proofline.functions.lookup import column, lookup
from proofline.operators import x509

BLOCK = r"(?s)-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----"


#: The fields of a certificate.
FIELDS = {
    "key_type": "string", "key_size": "int", "subject_cn": "string", "issuer": "string", "version": "string", "not_before": "string", "not_after": "string",
    "serial_number": "string", "signature_hash_algorithm": "string", "signature_algorithm": "string", "eku_oids": "array<string>",
    "key_usage": "array<string>", "is_ca": "boolean", "san": "array<string>",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def pem_blocks(files: DataFrame) -> DataFrame:
    """One row per certificate block with its position and whether its body can be a certificate at all: base64 of a DER sequence."""
    blocks = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(0))).alias("block", "pem"))
    body = F.regexp_replace("pem", r"-----[A-Z ]+-----|\s", "")
    der = F.try_to_binary(body, F.lit("base64"))
    plausible = F.coalesce(F.startswith(F.hex(der), F.lit("30")), F.lit(False))
    return blocks.withColumn("plausible", plausible)


def decoded_blocks(files: DataFrame) -> DataFrame:
    """Every block of every file with the fields of its certificate; ``decoded`` is false, and the fields null, where it holds none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x509.decode_pem(pem) for pem in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([f is not None for f in found], pa.bool_()),
                *[pa.array([f and f[name] for f in found], _ARROW[kind]) for name, kind in FIELDS.items()],
            ], names=["path", "block", "decoded", *FIELDS])

    schema = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
    return pem_blocks(files).select("path", "block", "pem").mapInArrow(decode, f"path string, block int, decoded boolean, {schema}")


def decoded(files: DataFrame) -> DataFrame:
    """The certificates of PEM files: one row per block that holds one."""
    return decoded_blocks(files).where("decoded").drop("decoded")


def pem_failures(files: DataFrame) -> DataFrame:
    """Files without any block, or with a block that holds no certificate; the file's other blocks still count."""
    empty = F.col("content").isNull() | (F.size(F.regexp_extract_all("content", F.lit(BLOCK), F.lit(0))) == 0)
    broken = decoded_blocks(files).where("not decoded").select("path").distinct()
    return files.where(empty).select("path").unionByName(broken).select("path", F.lit("certificate_error").alias("reason"))


def usage_from_eku(oids: Column | str) -> Column:
    """``tls`` for server or client authentication, ``signature`` for code signing or mail, else unknown."""
    oids = F.coalesce(column(oids), F.array().cast("array<string>"))

    def holds(marks: tuple[str, ...]) -> Column:
        return F.exists(oids, lambda o: F.lower(o).rlike("|".join(m.replace(".", r"\.") for m in marks)))

    return F.when(holds(C.EKU_TLS), "tls").when(holds(C.EKU_SIGNATURE), "signature").otherwise("unknown")


def evidence(certificates: DataFrame) -> DataFrame:
    """Evidence from decoded rows: path, key_type, key_size, eku_oids, key_usage, is_ca, san, subject_cn, ..."""
    usage = usage_from_eku("eku_oids")
    kind = F.when(usage == "unknown", "artifact_metadata").otherwise("configured_protocol")
    key = F.lower("key_type")
    texts = [c for c in ("subject_cn", "issuer", "version", "not_before", "not_after", "serial_number",
                         "signature_hash_algorithm", "signature_algorithm") if c in certificates.columns]
    lists = [c for c in ("eku_oids", "key_usage", "san") if c in certificates.columns]
    cells: list[Column] = []
    for name in texts:
        cells += [F.lit(name), F.coalesce(F.col(name), F.lit(""))]
    for name in lists:
        cells += [F.lit(name), F.concat_ws(",", name)]
    if "is_ca" in certificates.columns:
        cells += [F.lit("is_ca"), F.coalesce(F.col("is_ca"), F.lit(False)).cast("string")]
    return certificates.select(
        F.col("path").alias("location"),
        lookup({k: v[0] for k, v in C.KEY_TYPES.items()}, key, F.col("key_type")).alias("algorithm"),
        lookup({k: v[1] for k, v in C.KEY_TYPES.items()}, key, "unknown").alias("category"),
        F.lit("cert").alias("source"), kind.alias("evidence_kind"), usage.alias("usage_raw"),
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("int").alias("column_start"),
        F.lit(None).cast("int").alias("column_end"), F.coalesce("key_size", F.lit(0)).cast("int").alias("key_size"),
        F.lit("").alias("library"), F.lit("").alias("protocol"), F.lit(C.CERTIFICATE_CONFIDENCE).alias("confidence"),
        F.lit("cert-v2").alias("parser_version"), E.confidence_note(F.lit("cert"), kind).alias("confidence_note"),
        F.create_map(*cells).alias("details"),
    )
