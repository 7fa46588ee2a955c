"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest of the 48-bit hashes of a set of shingles, sorted, as base64 text; a set with fewer shingles
is held whole. Sketches of parts merge into the sketch of the whole. Two sketches estimate resemblance, containment and
the number of distinct shingles. A null or blank text has an empty sketch; two empty sketches are alike (1.0), an empty
and any other are not (0.0).

``with_edits`` also fingerprints each document's edited text, whose second half is taken from the next document in the
order of doc_id (after the last comes the first). Documents are dealt into ranges of doc_id; the document that opens a range is
sent to the range before it as well, so that whole texts move once. Rows with the same doc_id follow each other in the
order of their texts. Rows without doc_id have no place in the order: no document is next, which counts as an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.shingles import text_shingles

K = 128
HASH_BYTES = 6
#: Characters handled at once inside a task.
CHUNK_CHARS = 1 << 21
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles_estimate double"
)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes, cut to 48 bits."""
    short = hashes >> np.uint64(64 - 8 * HASH_BYTES)
    return short[np.append(True, short[1:] != short[:-1])[:len(short)]][:k]


def encode(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES:].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, HASH_BYTES)
    return np.pad(raw, ((0, 0), (8 - HASH_BYTES, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets, from their sketches."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index; exact while the union has at most k shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~twice))
    rank = np.cumsum(distinct)
    size = min(k, int(rank[-1]))
    return float(np.count_nonzero(twice & (rank[1:] <= size)) / size)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** (8 * HASH_BYTES) / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's shingles that the second holds."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def fingerprint_column(text: Column, k: int = K) -> Column:
    """The fingerprint of each whole text."""

    @F.pandas_udf("string")
    def fingerprints(texts):
        import pandas as pd

        out, rows = [], texts.tolist()
        for begin, end in _chunks(rows):
            out += [encode(sketch(h, k)) for h in text_shingles(rows[begin:end])]
        return pd.Series(out, dtype="object")

    return fingerprints(text)


def merged_fingerprints(parts: DataFrame, groups: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group from those of its parts: distinct hashes, the k smallest of which are kept.

    Runs on built-in functions: hashes of equal length sort as text in base16, so a group is reduced by ranks, first within
    salted parts of it and then over the at most k hashes of each part.
    """
    from pyspark.sql import Window

    width = 2 * HASH_BYTES
    digits = F.hex(F.unbase64(F.col(fingerprint)))
    each = parts.select(*groups, F.explode(F.regexp_extract_all(digits, F.lit(f".{{{width}}}"), F.lit(0))).alias("_h")).distinct()
    salted = each.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(64)))
    for by in ([*groups, "_salt"], groups):
        salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= k)
    joined = F.concat_ws("", F.sort_array(F.collect_list("_h")))
    found = salted.groupBy(*groups).agg(F.translate(F.base64(F.unhex(joined)), "\r\n", "").alias("_merged"))
    all_groups = parts.select(*groups).distinct()
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    return all_groups.alias("a").join(found.alias("b"), same, "left").select(
        *[F.col(f"a.{g}") for g in groups], F.coalesce("_merged", F.lit("")).alias(fingerprint)
    )


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, tail, doc_id, text), sorted, to results. A row is answered when the one after it is known."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles_estimate", pa.float64()),
    ])

    def answer(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts: dict[str, None] = {}
        changed = [edited(text, following) for _, text, following in rows]
        for (_, text, following), new in zip(rows, changed):
            texts |= dict.fromkeys((text, following, new))
        known = {t: sketch(h) for t, h in zip(texts, text_shingles(list(texts)))}
        columns = [
            [r[0] for r in rows], [len(r[1]) for r in rows],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [encode(known[r[1]]) for r in rows], [encode(known[t]) for t in changed],
            [resemblance(known[r[1]], known[t]) for r, t in zip(rows, changed)], [resemblance(known[r[1]], known[r[2]]) for r in rows],
            [distinct_count(known[r[1]]) for r in rows],
        ]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    waiting, ready, size = None, [], 0
    for batch in batches:
        for bucket, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if waiting and waiting[0] == bucket:
                ready.append((waiting[1], waiting[2], text))
                size += 2 * len(waiting[2]) + len(text)
            waiting = None if tail else (bucket, doc_id, text)
            if bucket < 0:
                ready.append((doc_id, text, ""))
                waiting, size = None, size + len(text)
            if size >= CHUNK_CHARS:
                yield answer(ready)
                ready, size = [], 0
    if ready:
        yield answer(ready)


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``, by halving."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    step = lambda have, add: F.when((have + add <= len(bounds)) & (F.get(at, have + add - 1) <= value), have + add).otherwise(have)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: see the module's text and RESULT."""
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    found = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts"), F.min("id").alias("least")).first()
    bounds = sorted(set(found.cuts or []) - {found.least})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = _bucket(bounds, F.col("doc_id"))
    entry = lambda bucket, tail: F.struct(bucket.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    places = F.array_compact(F.array(
        F.when(F.col("doc_id").isNotNull(), entry(own, 0)).otherwise(entry(-1 - F.pmod(F.xxhash64("text"), F.lit(ranges)), 0)),
        F.when(F.col("doc_id").isin(bounds) if bounds else F.lit(False), entry(own - 1, 1)),
        F.when(F.col("doc_id") == F.lit(found.least), entry(F.lit(len(bounds)), 1)),
    ))
    dealt = rows.withColumn("place", F.explode(places)).select("place.bucket", "place.tail", "doc_id", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    return ordered.mapInArrow(_follow, RESULT)
