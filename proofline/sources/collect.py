"""Every collector over a files table, with failures kept apart from evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import redact_map
from proofline.operators import certificates, manifests, python_calls, source_rules
from proofline.session import written
from proofline.sources import files as inventory


@dataclass(frozen=True)
class Scan:
    """Lazy results of one scan."""

    scoped: DataFrame
    evidence: DataFrame
    failures: DataFrame

    def held(self) -> Scan:
        """The same results written once, for callers that read them more than once: every read of a lazy one scans again."""
        return Scan(self.scoped, written(self.evidence, "evidence"), written(self.failures, "failed"))


def scan(files: DataFrame, profile: str = "source", decoded_certificates: DataFrame | None = None, max_bytes: int | None = None, hold: bool = False) -> Scan:
    """Evidence of all readable in-scope files. A file one collector cannot parse is a failure row, and
    the other collectors still report on it. ``max_bytes`` makes larger files failures, if given. Certificates are decoded from the files, unless
    a table of decoded ones is given.

    With ``hold`` the files are opened once: what is in scope is written as Parquet, split by the kind of file, and evidence
    and failures read only the kinds they need of that. Without it each collector reads the files table itself, which suits a
    stored table.
    """
    scoped = inventory.with_failure(inventory.inventory(files, profile), max_bytes)
    collectors = F.transform("handlers", lambda h: h["collector"])
    kind = F.when(F.array_contains(collectors, "ast"), "python").when(F.array_contains(collectors, "rule"), "source").when(
        F.array_contains(collectors, "dep"), "manifest").when(F.array_contains(collectors, "cert"), "pem").otherwise("none")
    scoped = scoped.withColumn("kind", kind)
    if hold:
        kept = F.when(F.col("in_scope") & F.col("failure").isNull(), F.col("content")).alias("content")
        scoped = written(scoped.select(*[c for c in scoped.columns if c != "content"], kept), "content", ["kind"])
    readable = scoped.where("in_scope and failure is null")
    of = lambda *kinds: readable.where(F.col("kind").isin(*kinds)).select("path", "content")
    facts = python_calls.facts(of("python"))
    parts = [
        python_calls.evidence(facts), source_rules.evidence(of("python", "source")), manifests.evidence(of("manifest")),
        certificates.evidence(certificates.decoded(of("pem")) if decoded_certificates is None else decoded_certificates),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    failed = inventory.read_failures(scoped).unionByName(python_calls.parse_failures(facts)).unionByName(
        manifests.manifest_failures(of("manifest"))).unionByName(certificates.pem_failures(of("pem")))
    return Scan(scoped, merged.withColumn("details", redact_map("details")), failed)
