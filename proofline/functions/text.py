"""Redaction and package names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.catalogs import REDACTED, SENSITIVE_FIELDS, SENSITIVE_TEXT
from proofline.functions.lookup import column


def redact_text(value: Column | str) -> Column:
    value = column(value)
    return F.when(value.rlike(SENSITIVE_TEXT), F.lit(REDACTED)).otherwise(value)


def redact_map(value: Column | str) -> Column:
    return F.transform_values(
        column(value),
        lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_FIELDS), F.lit(REDACTED)).otherwise(redact_text(v)),
    )


def redact_nested(value: Column, data_type: T.DataType) -> Column:
    """Redact every string below ``value``; a sensitive field is replaced whatever it holds."""
    if isinstance(data_type, T.StringType):
        return redact_text(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: redact_nested(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        if isinstance(data_type.valueType, T.StringType):
            return redact_map(value)
        # A map value must keep its type, so a sensitive non-text value becomes null.
        return F.transform_values(
            value,
            lambda k, v: F.when(~F.lower(k).isin(*SENSITIVE_FIELDS), redact_nested(v, data_type.valueType)),
        )
    if isinstance(data_type, T.StructType):
        fields = [
            (F.lit(REDACTED) if field.name.lower() in SENSITIVE_FIELDS
             else redact_nested(value[field.name], field.dataType)).alias(field.name)
            for field in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_columns(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: redact_nested(F.col(n), frame.schema[n].dataType) for n in names})


def package_name(raw: Column | str) -> Column:
    """Declared package name: last path segment, without version or marker, separators as one hyphen."""
    last = F.element_at(F.split(F.lower(F.trim(column(raw))), "/"), -1)
    return F.regexp_replace(F.element_at(F.split(last, r"[<>=!~\[;@#\s]"), 1), r"[-_.]+", "-")


def valid_json(text: Column | str) -> Column:
    """Whether the text is one JSON value with nothing after it.

    JSON readers stop at the end of the first value; inside brackets, trailing text no longer parses or
    shows up as a second element.
    """
    held = F.try_parse_json(F.concat(F.lit("["), column(text), F.lit("]")))
    first, second = (F.try_variant_get(held, f"$[{i}]", "variant") for i in (0, 1))
    return F.coalesce(first.isNotNull() & second.isNull(), F.lit(False))
