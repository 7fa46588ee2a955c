"""Columns derived from one evidence record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.catalogs import (
    EVIDENCE_NOTES, FAMILIES, KEY_SIZE_RULES, LIBRARY_TAGS, RULE_PACK, USAGE_ALIASES, USAGE_BY_ALGORITHM, USAGE_BY_WORD, USAGES,
)
from proofline.functions.lookup import column, filled, literal_map, lookup

MISSING = "\u0000"


def category(algorithm: Column | str, default: str = "unknown") -> Column:
    return lookup({name: group for name, group, _ in RULE_PACK}, algorithm, default)


def family(algorithm: Column | str, default: str = "unknown") -> Column:
    return lookup(FAMILIES, algorithm, default)


def usage_alias(raw: Column | str) -> Column:
    """Canonical usage name; names without an alias pass through."""
    raw = column(raw)
    return F.coalesce(F.try_element_at(literal_map(USAGE_ALIASES), raw), raw)


def usage(raw: Column | str) -> Column:
    """Canonical usage, ``unknown`` for anything outside the five recognised usages."""
    value = usage_alias(F.lower(F.trim(F.coalesce(column(raw), F.lit("unknown")))))
    return F.when(value.isin(*USAGES), value).otherwise("unknown")


def usage_from_line(line: Column | str, algorithm: Column | str) -> Column:
    """Usage by algorithm, else by the words on the line."""
    line, algorithm = F.lower(column(line)), column(algorithm)
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, algorithms in USAGE_BY_ALGORITHM.items():
        choice = choice.when(algorithm.isin(*algorithms), name)
    for name, words in USAGE_BY_WORD:
        choice = choice.when(line.rlike("|".join(words)), name)
    return choice.when((algorithm == "TLS") | line.rlike("tls|ssl"), "tls").otherwise("encryption")


def library_from_line(line: Column | str) -> Column:
    line = F.lower(column(line))
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for mark, name in LIBRARY_TAGS:
        choice = choice.when(line.contains(mark), name)
    return choice.otherwise("")


def protocol_from_usage(value: Column | str) -> Column:
    return F.when(column(value) == "tls", "TLS").otherwise("")


def confidence_note(source: Column | str, kind: Column | str) -> Column:
    """Why a record of this collector and kind has its confidence; null for others."""
    return F.try_element_at(literal_map({f"{s}:{k}": note for (s, k), note in EVIDENCE_NOTES.items()}), F.concat_ws(":", column(source), column(kind)))


def single_number(line: Column | str, *patterns: str) -> Column:
    """The one distinct number the patterns capture on the line, else null."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(column(line), F.lit(p), F.lit(1)) for p in patterns])))
    return F.when(F.size(found) == 1, F.element_at(found, 1).cast("int"))


def key_size_from_line(line: Column | str, algorithm: Column | str) -> Column:
    algorithm = column(algorithm)
    choice = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, patterns in KEY_SIZE_RULES.items():
        choice = choice.when(algorithm == name, single_number(line, *patterns))
    return choice


def identity_hash(*parts: Column | str) -> Column:
    """16 hex characters over the parts; null and empty text stay distinct."""
    cells = [F.coalesce(column(p).cast("string"), F.lit(MISSING)) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u0001", *cells), 256), 1, 16)


def operation_anchor(operation_id: Column | str, line: Column | str, at_column: Column | str, *details: Column | str) -> Column:
    """Explicit operation id, else the position, else a hash of the details for unlocated evidence."""
    line, at_column, operation_id = column(line), column(at_column), filled(operation_id)
    position = F.concat(
        F.lit("line:"), line.cast("string"),
        F.coalesce(F.concat(F.lit(":column:"), at_column.cast("string")), F.lit("")),
    )
    return (
        F.when(operation_id.isNotNull(), F.concat(F.lit("id:"), operation_id))
        .when(line.isNotNull(), position)
        .otherwise(F.concat(F.lit("evidence:"), identity_hash(*details)))
    )


def semantic_anchor(operation_name: Column | str, context_name: Column | str) -> Column:
    return F.coalesce(
        F.concat(F.lit("op:"), filled(operation_name)), F.concat(F.lit("ctx:"), filled(context_name))
    )


def line_bucket(line: Column | str) -> Column:
    """First line of the three-line bucket the line falls in."""
    return (F.floor((F.greatest(F.lit(1), column(line)) - 1) / 3) * 3 + 1).cast("int")


def span_anchor(location: Column | str, line: Column | str, at_column: Column | str) -> Column:
    line, at_column = column(line), column(at_column)
    placed = F.concat_ws(
        ":", column(location), F.concat(F.lit("L"), line_bucket(line).cast("string")),
        F.concat(F.lit("C"), at_column.cast("string")),
    )
    return F.when(line.isNotNull(), placed).otherwise(F.concat(column(location), F.lit(":unknown")))


def span_operation_anchor(line: Column | str, at_column: Column | str, anchor: Column | str) -> Column:
    return F.concat_ws(
        ":", F.concat(F.lit("line:"), F.coalesce(column(line).cast("string"), F.lit("None"))),
        F.concat(F.lit("col:"), column(at_column).cast("string")), F.concat(F.lit("ctx:"), filled(anchor)),
    )


def moved_line_note(line: Column | str, algorithm: Column | str, at_column: Column | str, anchor: Column | str) -> Column:
    """Bracketed position note; empty when the evidence has no line."""
    line = column(line)
    parts = F.concat_ws(
        ";", F.concat(F.lit("line="), line.cast("string")), F.concat(F.lit("algo="), column(algorithm)),
        F.concat(F.lit("col="), column(at_column).cast("string")), F.concat(F.lit("ctx="), filled(anchor)),
    )
    return F.when(line.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), parts, F.lit("]")))
