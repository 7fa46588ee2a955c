"""What several corpus operators need: written intermediate tables, ASCII lower case, ranks inside groups."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import ensure_checkpoint_dir

#: Bytes that separate words and are stripped from lines: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Sub-buckets of a group when rows are numbered inside it.
RANK_BUCKETS = 256
_A_TO_Z = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared checkpoint folder and read it back: a short lineage with prunable columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that a newer one replaces. Nothing that is still to be computed may read them."""
    for table in tables:
        path = getattr(table, "saved_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay: where lower() makes a text longer (U+0130 does), only A-Z change."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_A_TO_Z)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that work columns can never clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def rank_in_groups(df: DataFrame, groups: list[str], spread: str, order: list[str], into: str, buckets: int | Column = RANK_BUCKETS, few: bool = False) -> DataFrame:
    """Number the rows of each group from 0 in the order of ``spread`` (a uniform 64-bit hash), then ``order``.

    A group is cut into ``buckets`` ranges of the hash, so that a group of any size is sorted by many tasks; the sizes
    of the ranges (at most groups x buckets rows) give each range its offset. Where these are ``few``, they are broadcast, so that
    the rows never move for them.
    """
    wide = buckets if isinstance(buckets, Column) else F.lit(buckets)
    unit = (F.shiftrightunsigned(F.col(spread).bitwiseXOR(F.lit(-(2**63))), 11)) / F.lit(float(2**53))
    cut = df.withColumn("_range", F.least(F.floor(unit * wide), wide.cast("long") - 1))
    sizes = cut.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    offsets = F.broadcast(offsets) if few else offsets
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{i}"))
    inside = Window.partitionBy(*groups, "_range").orderBy(spread, *order)
    placed = cut.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, same)
    return placed.withColumn(into, (F.col("_offset") + F.col("_place")).cast("long")).drop(
        "_range", "_r", "_offset", "_place", *[f"_g_{i}" for i in range(len(groups))]
    )
