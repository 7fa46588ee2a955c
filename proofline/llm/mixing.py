"""Mixing sources to target weights by entropy balancing.

A source's target share of all words follows from its weight, but no source may give more than ``MOST`` times its words.
Among all document rates from 0 to ``MOST`` that give each token constraint its target, the one closest to taking each
document once (in relative entropy) is exponentially tilted: ``rate = min(MOST, exp(multiplier * size / mean size))``.
The constraints are the words of each source within each band of lengths (a band spans a factor of two), so that a source
keeps its profile of short and long documents. The convex dual, one multiplier per constraint, is solved by Newton steps;
each step is one aggregation over the table of distinct (source, size), with a bracket that Newton may not leave.

Rates become whole copies by systematic rounding along the sizes of a source: the running sum of rates, plus a start, is
cut at whole numbers. Copies differ from the wanted number by less than one at every size, so a source's words miss
their target by less than its longest document; of ``STARTS`` starts the one that comes closest is used.

A null or blank text has size 0. A null source is a source of its own. Rows that repeat each other are separate rows with
copies of their own; which of them gets more is arbitrary. Null doc_ids are ordinary. Sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import packed, rank_in_groups, saved

WEIGHTS = (5, 2, 1)
#: A document and a source are taken this many times at most.
MOST = 3
#: Rates are counted in units of 1 / UNIT, so that sums of them are exact.
UNIT = 1 << 20
STARTS = 64
TOLERANCE = 1e-9
MAX_STEPS = 60
ROWS_PER_RANGE = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but space, \\t, \\n, \\v, \\f and \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Source names in code point order, null last, as a key that is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(key, source_size, target) from rows with ``key`` and ``size``: water-filling under the cap of ``MOST`` times.

    One row per source passes through one task, after the words have been summed.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    by_name = totals.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(MOST)
    ordered = by_name.withColumns({"weight": weight, "cap": cap}).withColumn("ratio", F.col("cap") / F.col("weight"))
    upward = Window.orderBy("ratio", "key")
    before, everything = upward.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = ordered.withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("rest") / F.col("open"))
    # Sources are in the order in which they reach their cap: the first that does not reach it fixes the common level.
    common = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.least("cap", common * F.col("weight"))).select("key", "source_size", "target")


def _solve(cells: DataFrame) -> DataFrame:
    """(key, band, multiplier, mean): Newton's method on the dual, for every (source, band) at once.

    ``cells`` holds key, size, band, n and ratio (target over words of the source).
    """
    log = F.log("ratio")
    state = saved(
        cells.where("size > 0").groupBy("key", "band").agg(
            (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.max("ratio").alias("ratio"),
        ).select(
            "key", "band", "mean", "ratio", log.alias("multiplier"), F.least(log * 2, log / 2).alias("low"),
            F.greatest(log * 2, log / 2).alias("high"), F.lit(1.0).alias("gap"),
        ), "multipliers",
    )
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.col("multiplier") * x)
        words = F.col("n") * x
        sums = cells.where("size > 0").drop("ratio").join(state, ["key", "band"]).groupBy(
            "key", "band", "mean", "ratio", "multiplier", "low", "high"
        ).agg(
            F.sum(words * F.least(tilt, F.lit(float(MOST)))).alias("given"), F.sum(words * F.col("ratio")).alias("wanted"),
            F.sum(F.when(tilt < MOST, words * x * tilt).otherwise(0.0)).alias("slope"),
        )
        over = F.col("given") > F.col("wanted")
        bracket = sums.withColumns({
            "high": F.when(over, F.col("multiplier")).otherwise(F.col("high")),
            "low": F.when(over, F.col("low")).otherwise(F.col("multiplier")),
            "step": F.col("multiplier") - (F.col("given") - F.col("wanted")) / F.when(F.col("slope") > 0, F.col("slope")),
            "gap": F.abs(F.col("given") / F.col("wanted") - 1),
        })
        inside = (F.col("step") >= F.col("low")) & (F.col("step") <= F.col("high"))
        moved = F.when(F.col("gap") <= TOLERANCE, F.col("multiplier")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = saved(bracket.withColumn("multiplier", moved).select(state.columns), "multipliers")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("key", "band", "multiplier", "mean")


def _rounding(cells: DataFrame) -> DataFrame:
    """(key, size, n, units, base, start): rates in units, their running sum below a size, the start of the source."""
    below = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    based = saved(cells.withColumn("base", F.coalesce(F.sum(F.col("units") * F.col("n")).over(below), F.lit(0))), "bases")
    start = F.expr(f"transform(sequence(0, {STARTS - 1}), i -> bigint((2 * i + 1) * {UNIT // (2 * STARTS)}))")
    tried = based.withColumn("start", F.explode(start))
    end = F.col("base") + F.col("units") * F.col("n") + F.col("start")
    words = F.sum(F.col("size") * (F.shiftright(end, 20) - F.shiftright(F.col("base") + F.col("start"), 20)))
    missed = tried.groupBy("key", "start").agg(F.abs(words - F.max("target")).alias("miss"))
    best = missed.groupBy("key").agg(F.min(F.struct("miss", "start"))["start"].alias("start"))
    return based.join(best, "key").select("key", "size", "n", "units", "base", "start", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """One row per document: id, text_hash, key, size, source_size, target, rate and copies."""
    rows = saved(docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.lit(seed), text).alias("text_hash"), _source_key(F.col(source)).alias("key"),
        word_count(F.col(text)).alias("size"),
    ), "sizes")
    targets = saved(source_targets(rows, weights), "targets")
    cells = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).join(targets, "key")
    cells = saved(cells.withColumns({
        "band": F.length(F.bin("size")), "ratio": F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)),
    }), "cells")
    capped = F.col("ratio") >= MOST * (1 - 1e-12)
    solved = _solve(cells.where((F.col("ratio") > 0) & ~capped))
    tilted = F.exp(F.col("multiplier") * F.col("size") / F.col("mean"))
    # At the cap every rate is MOST, where the multiplier has no finite value; documents without words follow their source.
    rate = F.least(F.lit(float(MOST)), F.when(capped, F.lit(float(MOST))).otherwise(F.coalesce(tilted, F.col("ratio"))))
    units = F.round(rate * UNIT).cast("long")
    planned = _rounding(cells.join(solved, ["key", "band"], "left").withColumn("units", units))
    spread = rows.withColumn("spread", F.xxhash64(F.lit(seed), F.lit("order"), "id", "text_hash"))
    ranked = rank_in_groups(
        spread.join(planned, ["key", "size"]), ["key", "size"], "spread", ["id", "text_hash"], "place",
        F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_RANGE)).cast("int"),
    )
    at = F.col("base") + F.col("place") * F.col("units") + F.col("start")
    copies = F.shiftright(at + F.col("units"), 20) - F.shiftright(at, 20)
    return ranked.select("id", "text_hash", "key", "size", "source_size", "target", (F.col("units") / UNIT).alias("rate"), copies.alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its copies say. Rows that repeat each other share theirs."""
    plan = mix(docs, doc_id, text, source, weights, seed).groupBy("id", "text_hash", "key").agg(
        F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows"),
    ).where("_copies > 0").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("key").alias("_key"), "_copies", "_rows")
    rows = docs.select(packed(docs).alias("_row"), F.col(doc_id).alias("_doc"), F.xxhash64(F.lit(seed), text).alias("_text"), _source_key(F.col(source)).alias("_source"))
    found = rows.join(plan, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")) & (F.col("_source") == F.col("_key")))
    once = found.where("_rows = 1").select("_row", "_copies")
    shared = found.where("_rows > 1").groupBy("_id", "_hash", "_key").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
    return once.unionByName(shared.select("_row", "_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
