"""Small fixed lookups folded into the plan as literals, so no join is planned for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_map(pairs: Mapping[str, object]) -> Column:
    cells: list[Column] = []
    for key, value in pairs.items():
        cells += [F.lit(key), F.lit(value)]
    return F.create_map(*cells)


def lookup(pairs: Mapping[str, object], key: Column | str, default: object | Column | None = None) -> Column:
    """The mapped value of ``key``; ``default`` where the key is null or not listed."""
    found = F.try_element_at(literal_map(pairs), column(key))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def filled(value: Column | str) -> Column:
    """The text itself, or null where it is empty."""
    return F.nullif(column(value), F.lit(""))
