"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are put in order, by hash and then by content,
and the place in that order is the block's integer name. Adjacent names of a document are then paired, the distinct
pairs are sorted and named the same way, and so on until each document has one name. Two documents with the same number
of rounds share a name only if every block is equal, so a name is an identity without collisions.

Rows: every input row takes part. A null text counts as empty (one empty block). Rows that repeat both doc_id and
text are copies of each other; exactly one of them is kept. A null doc_id never wins against a number; if all doc_ids of
a group are null, one row of it is kept. Extra columns are carried along and may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import ascii_lower, packed, saved

#: Code points in a block: large enough that most documents are one block, small enough to sort and ship.
BLOCK_CHARS = 16_384


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _blocks(text: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.char_length(text) <= block_chars, F.array(text)).otherwise(cut)


def _in_order(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct keys with an integer that follows their order; written once, so that the numbers are fixed."""
    ordered = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return saved(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(id, sha, n, pos, name) of blocks with hash ``h`` and content ``block``.

    Contents travel once, after equal blocks of a task have been merged. Hashes that stand for one content only, as good
    as all, are named without it; the others are told apart by their contents.
    """
    variants = blocks.groupBy("h").agg(F.collect_set("block").alias("variants"))
    keys = saved(
        variants.select("h", (F.size("variants") > 1).alias("shared"), F.posexplode(F.sort_array("variants")).alias("tie", "content"))
        .select("h", "tie", F.when(F.col("shared"), F.col("content")).alias("content")), "block-keys",
    )
    names = _in_order(keys, ["h", "tie"], "block-names")
    places = ["id", "sha", "n", "pos", "name"]
    alone = blocks.drop("block").join(names.where("content is null").select("h", "name"), "h").select(*places)
    shared = names.where("content is not null")
    if shared.isEmpty():
        return alone
    both = blocks.join(shared.select("h").distinct(), "h", "left_semi").join(
        shared.select("h", F.col("content").alias("block"), "name"), ["h", "block"]
    )
    return alone.unionByName(both.select(*places))


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """(id, sha, level, name, copies): one row per distinct (doc_id, text); equal (level, name) means equal texts.

    ``hash_bits`` shortens the ordering hash and is there for tests: results do not depend on it.
    """
    normal = docs.select(F.col(doc_id).alias("id"), _normal(F.col(text)).alias("t"))
    cut = normal.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), _blocks(F.col("t"), block_chars).alias("blocks"))
    blocks = cut.select("id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    h = F.xxhash64("block")
    blocks = blocks.withColumn("h", h if hash_bits >= 64 else F.pmod(h, F.lit(2**hash_bits)))
    named = _name_blocks(blocks).groupBy("id", "sha", "n", "pos", "name").agg(F.count(F.lit(1)).alias("copies"))
    now = saved(named, "names-0")
    longest = now.agg(F.max("n")).first()[0] or 1
    done = now.where("n = 1").select("id", "sha", F.lit(0).alias("level"), "name", "copies")
    for level in range(1, math.ceil(math.log2(longest)) + 1):
        even = F.col("pos") % 2 == 0
        pairs = saved(
            now.where("n > 1").groupBy("id", "sha", "n", "copies", F.floor(F.col("pos") / 2).alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            ), f"pairs-{level}",
        )
        names = _in_order(pairs.select("a", "b").distinct(), ["a", "b"], f"names-{level}")
        now = pairs.join(names, ["a", "b"]).select("id", "sha", F.ceil(F.col("n") / 2).alias("n"), "pos", "name", "copies")
        done = done.unionByName(now.where("n = 1").select("id", "sha", F.lit(level).alias("level"), "name", "copies"))
    return done


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(id, sha, keep_id, group_size, copies, best): one row per distinct (doc_id, text)."""
    one = saved(identities(docs, doc_id, text, **options), "identities")
    totals = one.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return one.join(totals, ["level", "name"]).select(
        "id", "sha", "keep_id", "group_size", "copies", F.col("id").eqNullSafe(F.col("keep_id")).alias("best")
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    each = groups(docs, doc_id, text, **options).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, whole: of equal texts the one with the largest doc_id."""
    best = groups(docs, doc_id, text, **options).where("best").select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), F.col("copies").alias("_copies"))
    rows = docs.select(packed(docs).alias("_row"), F.col(doc_id).alias("_doc"), F.unhex(F.sha2(_normal(F.col(text)), 256)).alias("_text"))
    kept = rows.join(best, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")))
    once = kept.where("_copies = 1").select("_row")
    repeated = kept.where("_copies > 1").groupBy("_id", "_sha").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")
