"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct word shingles. Two permutations make all coordinates of its signature: the first
gives each shingle a position on a circle, the second, shifted by k, gives the values of which coordinate k is the minimum. As shifts are
neighbouring places of one array, a shingle contributes one contiguous slice of the second permutation. BANDS bands of ROWS coordinates
make two documents with a Jaccard index of exactly 0.75 miss each other in all bands once in 400,000 pairs, and less above.

Documents with equal sets are one class. The bands are dealt to rounds. In a round, the components that meet in a bucket are joined by a tree of pairs, one member
speaking for each; links found are contracted before the next round, so that a group of near copies carries about one pair a member in all, and never meets
itself again. Then the members of buckets that still hold several components meet
the class that has the fewest shingles of its own. Afterwards
only members of different components in a bucket are compared, and never two of the bucket's largest component, so no link
between components is lost and a group is not paired with itself. Compressed signatures (one bit per coordinate, six standard deviations of tolerance) and set sizes
discard hopeless candidates. So does, after the first step, an exact bound: two sets share at
most the smaller of their counts of shingles with one, two, up to four, up to eight ... holders, and nothing of what has one holder.
That settles variants that lie just too far from their group without comparing them with all of it. Every link is
confirmed on the full sets.

Rows: null, blank and empty texts have empty sets, are linked with nothing and are kept. Rows that repeat doc_id
and text, and rows without doc_id, belong to the component of their text; component_id is the smallest doc_id that is not null
(null if there is none). Exactly the rows whose doc_id equals it are kept; a component without any doc_id keeps all its rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import forget, packed, saved
from proofline.llm.shingles import scrambled, shingles, text_shingles

BANDS = 48
ROWS = 5
#: Positions on the circle.
CIRCLE = 1 << 22
PERCENT = 75
#: Bands of each round of linking, all bands in the end.
ROUNDS = (2, 6, 14, 26)
#: Shares of a bucket's components that meet each other before the bucket's do.
SALTS = 256
#: Differing bits of 240 beyond which a pair cannot have a Jaccard index of 0.75 (mean 30, standard deviation 5.1).
MOST_BITS = 61
#: Classes of shingles by the number of their holders, in powers of two; the last has no upper end.
CLASSES = 14
CHUNK_BYTES = 1 << 21
_SLICE_ROWS = 512


@functools.lru_cache(maxsize=1)
def _circle(size: int = CIRCLE, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The second permutation; row i of the view holds its values at i, i + 1, ... around the circle."""
    values = np.random.default_rng(size).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((values, values[:coordinates - 1])), coordinates)


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a set of 64-bit shingle hashes."""
    circle = _circle()
    places = (scrambled(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - (CIRCLE.bit_length() - 1))).astype(np.int64)
    low = circle[places[:_SLICE_ROWS]].min(axis=0)
    for i in range(_SLICE_ROWS, len(places), _SLICE_ROWS):
        np.minimum(low, circle[places[i:i + _SLICE_ROWS]].min(axis=0), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per signature and band."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(ROWS):
        key = scrambled(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key.view(np.int64)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), at


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text_hash, text) to (id, text_hash, n, set_key, bands, bits)."""
    for batch in batches:
        data, offsets = _raw(batch.column(2))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES)))
            end = min(end, len(batch))
            sets = shingles(data, offsets[begin:end + 1])
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bands, bits = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                signed = np.stack([signature(sets[i]) for i in full])
                small = np.zeros((len(full), 256), dtype=np.uint8)
                small[:, :signed.shape[1]] = signed & 1
                for i, key, one in zip(full, band_keys(signed), np.packbits(small, axis=1).view(np.int64)):
                    keys[i], bands[i], bits[i] = hashlib.sha256(sets[i].tobytes()).digest()[:16], key, one
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
            ], names=["id", "text_hash", "n", "set_key", "bands", "bits"])
            begin = end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b), sorted by a, to the pairs whose full sets are alike."""
    last, known = None, None
    for batch in batches:
        links_a, links_b = [], []
        for a, b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if a != last:
                last, known = a, text_shingles([text_a])[0]
            other = text_shingles([text_b])[0]
            both = len(np.intersect1d(known, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(known) + len(other) - both):
                links_a.append(a)
                links_b.append(b)
        yield pa.record_batch([pa.array(links_a, pa.int64()), pa.array(links_b, pa.int64())], names=["a", "b"])


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends, without loops and repeats."""
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))
    both = edges.join(side("a"), "a").join(side("b"), "b").where("label_a != label_b")
    return both.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (a, b).

    Each node points to its smallest neighbour, or to itself if that is larger; pointers are followed to their roots by doubling. Edges are then contracted to
    the roots, where most become loops and go, until none is left.
    """
    edges = saved(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = saved(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "roots")
        while True:
            onward = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
            moved = saved(roots.join(onward, "label").select("node", F.col("further").alias("label"), (F.col("further") < F.col("label")).alias("moved")), "roots")
            forget(roots)
            roots = moved.select("node", "label")
            roots.saved_path = moved.saved_path
            if moved.where("moved").isEmpty():
                break
        labels, old = (roots, None) if labels is None else (_composed(labels, roots), labels)
        shorter = saved(_relabelled(edges, roots), "edges")
        forget(edges, *([old, roots] if old is not None else []))
        edges = shorter
    return labels


def _composed(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """Labels after their own labels moved on."""
    onward = moved.select(F.col("node").alias("_from"), F.col("label").alias("_to"))
    return saved(labels.join(onward, F.col("label") == F.col("_from"), "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all nodes after the links (a, b) between them, contracted to the present labels, have joined their components."""
    edges = saved(_relabelled(links, labels), "contracted")
    return labels if edges.isEmpty() else _composed(labels, components(edges))


def _sizes_fit(a: Column, b: Column) -> Column:
    """Sets of such sizes can reach the threshold at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _bits_fit(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(4)), F.lit(0)) <= MOST_BITS


def _explode_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingle)."""
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = text_shingles([text])[0].view(np.int64)
            yield pa.record_batch([pa.array(np.full(len(found), node, dtype=np.int64)), pa.array(found)], names=["node", "shingle"])


def _class_counts(texts: DataFrame, among: DataFrame) -> DataFrame:
    """(node, classes): a node's shingles counted by how many of the given nodes hold them: 1, 2, up to 4, up to 8, ...

    Equal hashes of different shingles can only move a count to a higher class in both nodes.
    """
    each = texts.join(among, "node", "left_semi").select("node", "text").mapInArrow(_explode_shingles, "node long, shingle long").distinct()
    holders = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    level = F.least(F.ceil(F.log2("holders")), F.lit(CLASSES - 1)).alias("level")
    levels = each.join(holders, "shingle").select("node", level)
    return levels.groupBy("node").agg(F.array(*[F.count_if(F.col("level") == k) for k in range(CLASSES)]).alias("classes"))


def _classes_fit(n_a: Column, a: Column, n_b: Column, b: Column) -> Column:
    """Two sets share at most the smaller count of each class, and none of what only one holds; can that be enough?"""
    both = sum((F.least(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(1, CLASSES)), F.lit(0))
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that hold on the full sets."""
    one = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    full = pairs.join(one("b"), "b").join(one("a"), "a").sortWithinPartitions("a")
    return saved(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, found by (id, text_hash). A Bloom filter keeps other texts out of the exchange."""
    spark, options = docs.sparkSession, {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    }
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        # The trivial condition makes the planner see a selective side, without which it adds no filter.
        wanted = wanted.where("node >= 0")
        found = docs.join(wanted, (docs.text_hash == wanted._hash) & docs.id.eqNullSafe(wanted._id))
        return saved(found.select("node", "text"), "texts")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp, main) in the buckets with more than one component; ``main`` is the bucket's largest."""
    placed = members.join(labels, "node").select("key", "node", F.col("label").alias("comp"))
    shares = saved(placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size")), "shares")
    parts = shares.groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("parts"))
    return saved(placed.join(parts.where("parts > 1").select("key", "main"), "key"), "loose")


def _tree_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that join the components of each bucket into a tree of depth two: one member speaks for a component, the first of
    each of SALTS shares for its share, and the first of them for the bucket. So a bucket has one pair less than components, and no member has many."""
    placed = members.join(labels, "node").select("key", "node", F.col("label").alias("comp"))
    speakers = placed.groupBy("key", "comp").agg(F.min(F.struct(F.xxhash64("key", "node").alias("by"), "node"))["node"].alias("node"))
    speakers = saved(speakers.withColumn("share", F.pmod(F.xxhash64("comp"), F.lit(SALTS))), "speakers")
    first = speakers.groupBy("key", "share").agg(F.min("node").alias("head"))
    top = first.groupBy("key").agg(F.min("head").alias("top"), F.count(F.lit(1)).alias("shares")).where("shares > 1").select("key", "top")
    low = speakers.join(first, ["key", "share"]).select("node", "head")
    high = first.join(top, "key").select(F.col("head").alias("node"), F.col("top").alias("head"))
    return low.unionByName(high).where("node != head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, n (set size), component (a number, null for empty sets)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")
    prints = saved(rows.mapInArrow(_print, "id long, text_hash long, n long, set_key binary, bands array<long>, bits array<long>"), "prints")
    sets = prints.where("n > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("bits").alias("bits"),
    )
    nodes = saved(sets.select("set_key", "first.id", "first.text_hash", "n", "bands", "bits").withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    # A round takes its bands; the bands' numbers are part of their keys.
    deal = functools.reduce(lambda done, i: done.when(F.col("band") < sum(ROUNDS[:i + 1]), i), range(len(ROUNDS)), F.when(F.lit(False), None))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("key")
    members = saved(banded.join(shared, "key").select("key", "node", deal.alias("round")), "members")

    small = nodes.select("node", "n", "bits")
    side = lambda name: small.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    among = saved(members.select("node").distinct().join(nodes.select("node", F.col("id").alias("_id"), F.col("text_hash").alias("_hash")), "node"), "wanted")
    texts = _texts(rows, among)
    first = saved(among.select("node", F.col("node").alias("label")), "labels")
    stars: DataFrame | None = None
    for i in range(len(ROUNDS)):
        pairs = _tree_pairs(members.where(F.col("round") == i), first)
        pairs = pairs.join(stars, ["a", "b"], "left_anti") if stars is not None else pairs
        likely = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(F.col("n_a"), F.col("n_b")) & _bits_fit(F.col("bits_a"), F.col("bits_b")))
        likely = saved(likely.select("a", "b"), "stars")
        first = merged(first, _links(likely, texts))
        stars = likely if stars is None else stars.unionByName(likely)

    # Buckets that still hold several components: their members meet the one with the fewest shingles of its own,
    # which lies nearest to what the group has in common, and then whatever is left meets the others.
    loose = _open_buckets(members.select("key", "node"), first)
    among = loose.select("node").distinct()
    facts = saved(small.join(_class_counts(texts, among), "node"), "facts")
    faced = saved(loose.join(facts, "node"), "faced")
    centre = faced.groupBy("key").agg(F.min(F.struct(F.get("classes", F.lit(0)).alias("own"), "node", "comp", "n", "bits", "classes")).alias("c"))
    near = faced.join(centre, "key").where((F.col("comp") != F.col("c.comp")) & _classes_fit(
        F.col("n"), F.col("classes"), F.col("c.n"), F.col("c.classes")
    ) & _bits_fit(F.col("bits"), F.col("c.bits")))
    near = near.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    tried = saved(near.join(stars, ["a", "b"], "left_anti"), "near")
    second = merged(first, _links(tried, texts))

    last = _open_buckets(faced.select("key", "node"), second)
    # At most one key per band.
    keys = last.groupBy("node").agg(F.collect_list("key").alias("keys"))
    last = saved(last.withColumn("main", F.col("comp") == F.col("main")).join(facts, "node").join(keys, "node"), "last")
    x, y = last.where("not main").alias("x"), last.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (
        F.col("y.main") | (F.col("x.node") < F.col("y.node"))
    ) & _classes_fit(F.col("x.n"), F.col("x.classes"), F.col("y.n"), F.col("y.classes")) & _bits_fit(F.col("x.bits"), F.col("y.bits")) & (
        # A pair is met in the first bucket that it shares, and nowhere else.
        F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    ))
    pairs = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = _links(pairs.join(stars.unionByName(tried), ["a", "b"], "left_anti"), texts)
    labels = merged(second, more)

    classes = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("component"))
    return prints.select("id", "text_hash", "n", "set_key").join(classes, "set_key", "left").select("id", "text_hash", "n", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and text_hash."""
    found = saved(near_classes(docs, doc_id, text), "classes")
    least = found.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "text_hash",
    ).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, whole."""
    kept = near_duplicates(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(packed(docs).alias("_row"), F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return rows.join(kept, same, "left_semi").select("_row.*")
