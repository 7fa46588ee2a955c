"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without blanks at its ends, A-Z lower-cased; keys of at least ``min_chars`` code points count. The index
keeps, append-only, which document refers to which key (and takes references back when documents are deleted): the sum per
(key, document) is the exact reference, the number of documents per key the reference count, the largest doc_id the keeper.
One cuckoo filter per shard of keys holds exactly the keys whose count reaches ``min_docs``. Keys enter and leave it as documents are inserted
and deleted; since the exact table says which keys are inside, a delete never takes another key's fingerprint.

Cleaning asks the filters first, inside the task that reads the text: a key that is not there is kept without any exchange. The
few others are looked up in the exact table. Filters are broadcast while they are below FILTER_BYTES in all; beyond that every key is
looked up exactly, with the same result.

Documents are told apart by doc_id; rows without one count together as the smallest document, so they never keep a repeated
line. A null text is one empty line. Repeated rows are cleaned alike. Inserting a document twice, or deleting one that is
not there, changes nothing. Extra columns stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import BLANKS, ascii_lower, packed, saved
from proofline.llm.shingles import scrambled
from proofline.session import ensure_checkpoint_dir

MIN_CHARS = 20
MIN_DOCS = 3
#: Fewest shards, and repeated keys for which one more is opened at the first insert.
SHARDS = 64
SHARD_KEYS = 250_000
#: Bytes of all filters up to which they are broadcast.
FILTER_BYTES = 64 << 20
SLOTS = 4
LOAD = 0.85
MAX_KICKS = 500
FILTER = "shard int, buckets binary, stash array<binary>, held long"


class CuckooFilter:
    """Set of 128-bit keys as 16-bit fingerprints, each in one of two buckets; a key that finds no room is stashed whole."""

    def __init__(self, table: np.ndarray, stash: list[bytes] | None = None, held: int = 0):
        self.table, self.stash, self.held = table, list(stash or []), held

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, (int(keys / LOAD / SLOTS)).bit_length()), SLOTS), dtype=np.uint16))

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)[:, 0]
        mask = np.uint64(len(self.table) - 1)
        mark = (words & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (words >> np.uint64(16)) & mask
        return mark, first.astype(np.int64), (first ^ (scrambled(mark.astype(np.uint64)) & mask)).astype(np.int64)

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        mark, a, b = self._places(keys)
        found = (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)
        if self.stash:
            stash = set(self.stash)
            found |= np.array([k in stash for k in keys])
        return found

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        mask = len(self.table) - 1
        for key, mark, a, b in zip(keys, *(x.tolist() for x in self._places(keys))):
            self.held += 1
            if self._put(a, mark) or self._put(b, mark):
                continue
            undo, at, moving = [], b, mark
            for kick in range(MAX_KICKS):
                slot = (key[8] + kick) % SLOTS
                undo.append((at, slot, int(self.table[at, slot])))
                self.table[at, slot], moving = moving, undo[-1][2]
                at ^= int(scrambled(np.array([moving], dtype=np.uint64))[0]) & mask
                if self._put(at, moving):
                    break
            else:
                for place, slot, old in reversed(undo):
                    self.table[place, slot] = old
                self.stash.append(key)

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.table[bucket]
        for slot in range(SLOTS):
            if not row[slot]:
                row[slot] = mark
                return True
        return False

    def delete(self, keys: list[bytes]) -> None:
        """Take out keys that are inside."""
        if not keys:
            return
        for key, mark, a, b in zip(keys, *(x.tolist() for x in self._places(keys))):
            self.held -= 1
            if key in self.stash:
                self.stash.remove(key)
                continue
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def _filter_of(row: tuple) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(row[1], dtype=np.uint16).reshape(-1, SLOTS).copy(), [bytes(k) for k in row[2]], row[3])


def _update(key, filters, changes):
    """One shard: apply its changes (key, op) to its filter, or build it anew from all its keys (op 2)."""
    import pandas as pd

    keys = {op: [bytes(k) for k in changes["key"][changes["op"] == op]] for op in (1, 2, -1)}
    if keys[2] or not len(filters):
        every = keys[2] or keys[1]
        own = CuckooFilter.sized(2 * len(every))
        own.insert(every)
    else:
        own = _filter_of(tuple(filters.iloc[0]))
        own.delete(keys[-1])
        own.insert(keys[1])
    return pd.DataFrame({"shard": [int(key[0])], "buckets": [own.table.tobytes()], "stash": [own.stash], "held": [own.held]})


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """128 bits that stand for the line's key; null if the key is too short to count."""
    stripped = F.btrim(line, F.lit(BLANKS))
    digest = F.substring(F.unhex(F.sha2(ascii_lower(stripped), 256)), 1, 16)
    return F.when(F.char_length(stripped) >= min_chars, digest)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class LineIndex:
    """State of a corpus' lines in a folder that all executors share; each change adds files and a version.

    To open it again, give ``path``, ``version`` and ``shards`` as the attributes say after the last change.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, version: int = 0, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None):
        if path is None:
            ensure_checkpoint_dir(spark)
            path = f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}"
        self.spark, self.path, self.version = spark, path, version
        self.min_docs, self.min_chars, self.shards = min_docs, min_chars, shards

    def _keys(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(id, row, key): the distinct counting keys of each row; ``row`` tells rows without doc_id apart."""
        rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("row"), F.explode(lines(F.col(text))).alias("line"))
        return rows.select("id", "row", line_key(F.col("line"), self.min_chars).alias("key")).where("key is not null")

    def references(self) -> DataFrame:
        """(key, id) of all present references."""
        if not self.version:
            return self.spark.createDataFrame([], "key binary, id long")
        written = self.spark.read.parquet(*[f"{self.path}/refs/{v}" for v in range(1, self.version + 1)])
        if self.version == 1:
            return written.select("key", "id")
        return written.groupBy("key", "id").agg(F.sum("sign").alias("n")).where("n > 0").select("key", "id")

    def counts(self) -> DataFrame:
        """(key, n_docs, keeper) of all keys."""
        return self.references().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], FILTER)
        return self.spark.read.schema(FILTER).parquet(f"{self.path}/filters/{self.version}")

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        new = self._keys(docs, doc_id, text).select("key", F.col("id").cast("long").alias("id")).distinct()
        if self.version:
            old = self.references()
            new = new.alias("n").join(old.alias("o"), F.col("n.key").eqNullSafe(F.col("o.key")) & F.col("n.id").eqNullSafe(F.col("o.id")), "left_anti")
        self._change(new, 1)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Take back all references of the given doc_ids."""
        gone = ids.select(F.col(doc_id).cast("long").alias("gone")).distinct()
        self._change(self.references().join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_semi"), -1)

    def _change(self, refs: DataFrame, sign: int) -> None:
        before, old_filters = self.counts(), self.filters()
        refs.select("key", "id", F.lit(sign).cast("long").alias("sign")).write.parquet(f"{self.path}/refs/{self.version + 1}")
        written = self.spark.read.parquet(f"{self.path}/refs/{self.version + 1}")
        first = not self.version
        touched = written.groupBy("key").agg(F.sum("sign").alias("moved"))
        if not first:
            known = before.join(touched.select("key"), "key", "left_semi")
            touched = touched.join(known, "key", "left")
        was = F.lit(0) if first else F.coalesce("n_docs", F.lit(0))
        crossed = touched.select("key", was.alias("was"), (was + F.col("moved")).alias("now"))
        high = lambda c: F.col(c) >= self.min_docs
        op = F.when(high("now") & ~high("was"), 1).when(high("was") & ~high("now"), -1)
        changes = saved(crossed.select("key", op.alias("op")).where("op is not null"), "changes")
        if self.shards is None:
            self.shards = max(SHARDS, changes.count() // SHARD_KEYS)
        changes = changes.withColumn("shard", _shard(F.col("key"), self.shards))
        self.version += 1
        if not first:
            entering = {r.shard: r["sum(op)"] for r in changes.groupBy("shard").agg(F.sum("op")).collect()}
            sizes = old_filters.select("shard", "held", F.octet_length("buckets").alias("size")).collect()
            crowded = [r.shard for r in sizes if r.held + entering.get(r.shard, 0) > 0.95 * r.size / 2]
            if crowded:
                every = self.counts().where(high("n_docs")).select("key", F.lit(2).alias("op"), _shard(F.col("key"), self.shards).alias("shard"))
                changes = changes.where(~F.col("shard").isin(crowded)).unionByName(every.where(F.col("shard").isin(crowded)))
        changed = old_filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_update, FILTER)
        changed.write.parquet(f"{self.path}/filters/{self.version}")

    def _possible(self, keys: DataFrame) -> DataFrame:
        """Keys that may be repeated: all that the filters do not rule out."""
        held = self.filters()
        size = held.agg(F.sum(F.octet_length("buckets") + 16 * F.size("stash"))).first()[0] or 0
        if size > FILTER_BYTES:
            return keys
        rows = [tuple(r) for r in held.collect()]
        shared, shards = self.spark.sparkContext.broadcast(rows), self.shards
        numbered = keys.select("id", "row", "key", _shard(F.col("key"), shards).alias("shard"))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {r[0]: _filter_of(r) for r in shared.value}
            for batch in batches:
                shard, own = batch.column(3).to_numpy(), batch.column(2).to_pylist()
                found = np.zeros(len(shard), dtype=bool)
                for s in np.unique(shard).tolist():
                    if s in filters:
                        at = np.flatnonzero(shard == s)
                        found[at] = filters[s].has([own[i] for i in at])
                yield batch.select([0, 1, 2]).filter(pa.array(found))

        return numbered.mapInArrow(ask, keys.schema)

    def drops(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, row, drop): the keys that a row loses."""
        asked = self._possible(self._keys(docs, doc_id, text).select(F.col("id").cast("long").alias("id"), "row", "key"))
        repeated = self.counts().where(F.col("n_docs") >= self.min_docs).select("key", "keeper")
        lost = asked.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("id", "row").agg(F.collect_set("key").alias("drop"))

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "kept_text") -> DataFrame:
        """``docs`` with ``n_lines``, ``n_dropped`` and the text of the lines that stay."""
        lost = self.drops(docs, doc_id, text).select(F.col("id").alias("_id"), F.col("row").alias("_hash"), F.col("drop").alias("_drop"))
        rows = docs.select(packed(docs).alias("_row"), F.col(doc_id).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.col(text)).alias("_own"))
        found = rows.join(lost, F.col("_own").eqNullSafe(F.col("_hash")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
        min_chars = self.min_chars

        @F.pandas_udf("kept string, n_dropped bigint")
        def without(texts, drops):
            import pandas as pd

            kept, dropped = [], []
            for one, drop in zip(texts, drops):
                every = one.split("\n") if one is not None else None
                stay = _stay(every, {bytes(k) for k in drop}, min_chars) if every else None
                kept.append("\n".join(stay) if every else None)
                dropped.append(len(every) - len(stay) if every else 0)
            return pd.DataFrame({"kept": kept, "n_dropped": dropped})

        # Only texts that lose lines are handed to Python.
        told = found.withColumn("_k", without(F.when(F.col("_drop").isNotNull(), F.col("_text")), F.col("_drop")))
        return told.select("_row.*", F.size(lines(F.col("_text"))).cast("long").alias("n_lines"), "_k.n_dropped", F.coalesce("_k.kept", "_text").alias(into))


def _stay(every: list[str], drop: set[bytes], min_chars: int) -> list[str]:
    import hashlib

    out = []
    for line in every:
        key = line.strip(BLANKS)
        if len(key) < min_chars or hashlib.sha256(key.encode("utf-8", "surrogatepass").lower()).digest()[:16] not in drop:
            out.append(line)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """Index all documents and clean them: repeated lines stay only in the largest doc_id that holds them."""
    index = LineIndex(docs.sparkSession, **options)
    index.insert(docs, doc_id, text)
    return index.clean(docs, doc_id, text)
