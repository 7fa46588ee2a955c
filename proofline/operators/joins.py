"""Joins against lookup tables on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(frame: DataFrame, lookup: DataFrame, on: list[str], how: str, spread_by: str, salts: int = 0) -> DataFrame:
    """Left, semi or anti join of a large frame with a lookup table.

    Spark broadcasts the lookup while its bytes are under the broadcast threshold; beyond it, adaptive execution splits hot
    keys of the sorted join. With ``salts`` both sides are joined on a salt taken from ``spread_by`` too, so that one hot
    key spreads over that many tasks whatever Spark does.
    """
    if how not in ("left", "left_semi", "left_anti"):
        raise ValueError("a salted lookup is only repeated on the right: left, left_semi or left_anti")
    if not salts:
        return frame.join(lookup, on, how)
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
