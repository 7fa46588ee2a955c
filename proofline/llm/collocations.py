"""Phrases of two to four words whose parts rarely stand without each other, counted over vertically partitioned suffixes.

Texts are lower-cased (A-Z), split into pieces and words; every count is per language. The suffix tree of all pieces, cut off at
four words, is never built whole. It is partitioned by prefixes, as ERA does:

1. One-word prefixes are counted. A suffix ends before a word that occurs less than ``least`` times, as no phrase reaches across it.
2. Prefixes are extended to two words and counted; those below ``least`` are dropped.
3. The remaining prefixes are put into groups of about ``budget`` suffixes: prefixes fall into PREFIX_BUCKETS ranges of a hash, neighbouring
   ranges are packed until the budget is full, and a range beyond the budget is dealt to several groups by its suffixes' third word.
4. Each group's suffixes meet in one task, which builds the group's subtree from them in sorted order, on its own and as a stream: a node is a run of suffixes with
   one prefix, and its count the total of its leaves. So memory does not depend on a group's size.

Words are carried as 64-bit numbers of (language, word). All words of the corpus are checked for numbers that clash; if one clash could
matter, the numbers are drawn anew, so counts are exact. Which words and two-word prefixes are frequent is told to the scans by bit maps of BITS bits;
a wrong "yes" sends a suffix that is later dropped by its exact count. Everything else moves by shuffles after summing within the task.

Rows: null and empty texts have no words; a null language counts as ``und``; repeated rows count each time; other columns do not
matter and may have any name; an empty table gives an empty result. A text of any length is read whole. Ties in score and count are ranked by the phrase's bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import saved
from proofline.llm.shingles import _cuts, _word_hashes, scrambled

LEAST = 30
DEPTH = 4
TOP = 2_000
UNKNOWN = "und"
#: Suffixes that a group holds, about.
BUDGET = 1 << 20
PREFIX_BUCKETS = 1 << 16
#: Bits of a map of frequent prefixes: 8 MB each, whatever the data.
BITS = 1 << 26
#: Bytes of text worked on at once, words remembered by a counting task, and suffixes summed before they leave a task.
CHUNK_BYTES = 1 << 23
KNOWN_WORDS = 1 << 19
HELD_SUFFIXES = 1 << 21

#: A-Z to a-z; what ends a piece to a line feed.
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_CLEAN_BYTES = _CLEAN.tobytes()


def _lang_seeds(langs: list[str], seed: int) -> np.ndarray:
    """One number per language."""
    digests = [hashlib.sha256(f"{seed}:{x}".encode("utf-8", "surrogatepass")).digest() for x in langs]
    return np.array([int.from_bytes(d[:8], "little") for d in digests], dtype=np.uint64)


def _word_numbers(data: np.ndarray, starts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, before the language is mixed in, and places of the words of concatenated texts. Seeds other than 0 take a keyed digest, slowly."""
    numbers, places = _word_hashes(data, starts)
    if seed:
        raw, key, known, bounds = data.tobytes(), seed.to_bytes(8, "little"), {}, [*places.tolist(), len(data)]
        words = [raw[a:b].split()[0] for a, b in zip(bounds, bounds[1:])]
        for word in set(words):
            known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
        numbers = np.array([known[w] for w in words], dtype=np.uint64)
    return numbers, places


def _numbers(words: list[bytes], seed: int) -> np.ndarray:
    """The numbers of single cleaned words."""
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    return np.concatenate([_word_numbers(data[a:b], bounds[(bounds > a) & (bounds < b)] - a, seed)[0] for a, b in _cuts_at(bounds)])


def _cuts_at(bounds: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end at a bound."""
    at = 0
    while at < bounds[-1]:
        end = int(bounds[min(np.searchsorted(bounds, at + size), len(bounds) - 1)])
        yield at, end
        at = end


def _mixed(words: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Numbers of (language, word); 0 stands for no word."""
    return np.maximum(scrambled(words ^ lang), np.uint64(1))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, bytes, offsets) of a (lang, text) batch in parts of bounded size."""
    column = batch.column(1).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw, langs, begin = np.frombuffer(data if data is not None else b"", dtype=np.uint8), batch.column(0).to_pylist(), 0
    while begin < len(batch):
        end = min(max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK_BYTES))), len(batch))
        yield langs[begin:end], raw[at[begin]:at[end]], at[begin:end + 1] - at[begin]
        begin = end


def _count_words(seed: int) -> Callable:
    """(lang, text) to sums per task: (number, lang, word, n); the total of a language has no word."""

    def flush(known: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in known.items():
            words = list(counts)
            if words:
                numbers = _mixed(_numbers(words, seed), _lang_seeds([lang], seed))
                yield pa.record_batch([
                    pa.array(numbers.view(np.int64)), pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ], names=["number", "lang", "word", "n"])
                yield pa.record_batch([
                    pa.array([0], pa.int64()), pa.array([lang]), pa.array([None], pa.string()), pa.array([sum(counts.values())], pa.int64()),
                ], names=["number", "lang", "word", "n"])
        known.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Counter] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                words = text.as_py().translate(_CLEAN_BYTES).split()
                if words:
                    known.setdefault(lang, Counter()).update(words)
            if sum(len(c) for c in known.values()) > KNOWN_WORDS:
                yield from flush(known)
        yield from flush(known)

    return count


def _suffix_words(langs: list[str], data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, and whether the next word stands in the same piece of the same text."""
    data = _CLEAN[data]
    numbers, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in _cuts(data, offsets):
        value, place = _word_numbers(data[begin:end], offsets[(offsets > begin) & (offsets < end)] - begin, seed)
        numbers.append(value)
        places.append(place + begin)
    words, where = np.concatenate(numbers), np.concatenate(places)
    owner = np.searchsorted(offsets, where, side="right") - 1
    names = sorted(set(langs))
    order = {x: i for i, x in enumerate(names)}
    code = np.array([order[x] for x in langs])
    words = _mixed(words, _lang_seeds(names, seed)[code[owner]]) if len(words) else words
    ends = np.flatnonzero(data == 10)
    piece = np.searchsorted(ends, where)
    joined = np.append((piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False)[:len(words)]
    return words, joined


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return scrambled(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (BITS.bit_length() - 1))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows with their counts added up (a clash of hashes may leave a row in two)."""
    key = columns[0]
    for c in columns[1:]:
        key = _pair_hash(key, c)
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _emit(select: Callable, names: list[str], seed: int) -> Callable:
    """(lang, text) to the rows that ``select`` makes of words, summed within the task in parts of bounded size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            columns, counts = _summed(columns, np.ones(len(columns[0]), dtype=np.int64))
            held.clear()
            return pa.record_batch([*[pa.array(c.view(np.int64)) for c in columns], pa.array(counts)], names=[*names, "n"])

        for batch in batches:
            for langs, data, offsets in _chunks(batch):
                found = select(*_suffix_words(langs, data, offsets, seed))
                held.append(found)
                size += len(found[0])
                if size >= HELD_SUFFIXES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return scan


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1) or (w1, w2) to the bits of their map."""
    for batch in batches:
        words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
        hashes = words[0] if len(words) == 1 else _pair_hash(*words)
        yield pa.record_batch([pa.array((hashes >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64))], names=["at"])


def _bit_map(prefixes: DataFrame) -> np.ndarray:
    """The map of a table of prefixes: at most BITS bits, gathered as at most BITS / 64 numbers."""
    cells = prefixes.mapInArrow(_places, "at long").selectExpr("shiftright(at, 6) AS place", "shiftleft(1L, int(at & 63)) AS bit")
    table = cells.groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()
    whole = np.zeros(BITS // 64, dtype=np.int64)
    whole[table["place"].to_numpy(dtype=np.int64)] = table["bits"].to_numpy(dtype=np.int64)
    return whole.view(np.uint8)


def _grouped(pairs: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each range of prefix hashes its first group and how many groups share it; at most PREFIX_BUCKETS totals are gathered."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = (_pair_hash(a.view(np.uint64), b.view(np.uint64)) >> np.uint64(48)).astype(np.int64)
            yield pa.record_batch([pa.array(at), pa.array(n)], names=["at", "n"])

    table = pairs.select("w1", "w2", "n").mapInArrow(ranges, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(PREFIX_BUCKETS, dtype=np.int64)
    totals[table["at"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.int64)
    first, shares, group, held = np.zeros(PREFIX_BUCKETS, np.int64), np.ones(PREFIX_BUCKETS, np.int64), 0, 0
    for at, total in enumerate(totals.tolist()):
        if held and held + total > budget:
            group, held = group + 1, 0
        first[at], shares[at] = group, max(1, -(-total // budget))
        if total > budget:
            group += int(shares[at])
        else:
            held += total
    return first, shares


def _subtree(least: int) -> Callable:
    """Sorted suffixes (w1, w2, w3, w4, n) to the nodes of three and four words that have ``least`` suffixes below them.

    A node is a run of sorted suffixes with one prefix, and its count the total of its leaves; the last node of each depth stays open from batch to batch.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still: dict[int, tuple[list[int], int]] = {}

        def nodes(rows: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
            keys = [np.concatenate([r[0][i] for r in rows]) for i in range(4)]
            counts = np.concatenate([r[1] for r in rows])
            return pa.record_batch([*[pa.array(k) for k in keys], pa.array(counts)], names=["w1", "w2", "w3", "w4", "n"])

        for batch in batches:
            if not len(batch):
                continue
            *words, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            closed = []
            for depth in (3, 4):
                new = np.ones(len(n), dtype=bool)
                new[1:] = False
                for w in words[:depth]:
                    new[1:] |= w[1:] != w[:-1]
                first = np.flatnonzero(new)
                totals = np.add.reduceat(n, first)
                keys = [w[first] if i < depth else np.zeros(len(first), np.int64) for i, w in enumerate(words)]
                if depth in still:
                    key, total = still[depth]
                    if all(int(k[0]) == x for k, x in zip(keys, key)):
                        totals[0] += total
                    else:
                        keys = [np.concatenate(([x], k)) for k, x in zip(keys, key)]
                        totals = np.concatenate(([total], totals))
                still[depth] = ([int(k[-1]) for k in keys], int(totals[-1]))
                keep = totals[:-1] >= least
                if depth == 4:
                    keep &= keys[3][:-1] != 0
                closed.append(([k[:-1][keep] for k in keys], totals[:-1][keep]))
            yield nodes(closed)
        for depth, (key, total) in still.items():
            if total >= least and (depth == 3 or key[3]):
                yield nodes([([np.array([x], np.int64) for x in key], np.array([total], np.int64))])

    return build


def _vocabulary(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(number, lang, word, n) of all words, and the seed under which no clash of numbers can reach ``least``."""
    seed = 0
    while True:
        counted = rows.mapInArrow(_count_words(seed), "number long, lang string, word string, n long")
        words = saved(counted.groupBy("number", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
        clash = words.where("word IS NOT NULL").groupBy("number").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
        if clash.where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            return words, seed
        seed += 1


def phrase_counts(rows: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Of (lang, text): the vocabulary, and (w1, w2, w3, w4, n), the words and phrases that occur ``least`` times; 0 is no word."""
    context = rows.sparkSession.sparkContext
    words, seed = _vocabulary(rows, least)
    often = words.where((F.col("n") >= least) & F.col("word").isNotNull())
    one = context.broadcast(_bit_map(often.select("number")))

    def joined_pairs(numbers: np.ndarray, joined: np.ndarray) -> np.ndarray:
        known = _in_map(one.value, numbers)
        return joined & known & np.append(known[1:], False)[:len(known)]

    def pairs_of(numbers: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(joined_pairs(numbers, joined))
        return [numbers[at], numbers[at + 1]]

    scanned = rows.mapInArrow(_emit(pairs_of, ["w1", "w2"], seed), "w1 long, w2 long, n long")
    pairs = saved(scanned.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "prefixes")
    two = context.broadcast(_bit_map(pairs.select("w1", "w2")))
    groups = context.broadcast(_grouped(pairs, budget))

    def suffixes_of(numbers: np.ndarray, joined: np.ndarray) -> list[np.ndarray]:
        good = np.zeros(len(numbers) + 2, dtype=bool)
        at = np.flatnonzero(joined_pairs(numbers, joined))
        good[at] = _in_map(two.value, _pair_hash(numbers[at], numbers[at + 1]))
        at = np.flatnonzero(good[:-2] & good[1:-1])
        padded = np.append(numbers, np.zeros(3, np.uint64))
        a, b, c, d = numbers[at], numbers[at + 1], numbers[at + 2], np.where(good[at + 2], padded[at + 3], np.uint64(0))
        first, shares = groups.value
        place = (_pair_hash(a, b) >> np.uint64(48)).astype(np.int64)
        group = first[place] + (scrambled(c + np.uint64(1)) % shares[place].astype(np.uint64)).astype(np.int64)
        return [group.astype(np.uint64), a, b, c, d]

    suffixes = rows.mapInArrow(_emit(suffixes_of, ["g", "w1", "w2", "w3", "w4"], seed), "g long, w1 long, w2 long, w3 long, w4 long, n long")
    met = suffixes.repartition("g").sortWithinPartitions("w1", "w2", "w3", "w4").select("w1", "w2", "w3", "w4", "n")
    deep = met.mapInArrow(_subtree(least), "w1 long, w2 long, w3 long, w4 long, n long")
    zero = F.lit(0).cast("long")
    singles = often.select(F.col("number").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "n")
    doubles = pairs.select("w1", "w2", zero.alias("w3"), zero.alias("w4"), "n")
    return words, saved(singles.unionByName(doubles).unionByName(deep), "phrases")


def _part(first: int, last: int, prefix: str) -> list[Column]:
    """The words at first..last (from 1) as the key of a phrase."""
    return [(F.col(f"w{first + i}") if first + i <= last else F.lit(0).cast("long")).alias(f"{prefix}{i + 1}") for i in range(DEPTH)]


def _exploded(phrases: DataFrame, parts: dict[int, list[list[Column]]]) -> DataFrame:
    """Each phrase once for each entry that its number of words has in ``parts``."""
    size = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    chosen = functools.reduce(
        lambda done, m: done.when(size == m, F.array(*[F.struct(*entry) for entry in parts[m]])), parts, F.when(F.lit(False), None),
    )
    return phrases.withColumn("_part", F.explode(chosen)).select(*phrases.columns, "_part.*")


def _same(one: DataFrame, other: DataFrame, left: str, right: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [one[f"{left}{i}"] == other[f"{right}{i}"] for i in range(1, DEPTH + 1)])


def _counts_as(phrases: DataFrame, prefix: str, count: str) -> DataFrame:
    return phrases.select(*[F.col(f"w{i}").alias(f"{prefix}{i}") for i in range(1, DEPTH + 1)], F.col("n").alias(count))


def score(a: str, both: str) -> Column:
    """floor(2000000 * a / both) of whole numbers, exact beyond 64 bits."""
    return F.expr(f"(2000000 * cast({a} AS decimal(20,0))) div cast({both} AS decimal(20,0))")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, phrases = phrase_counts(rows, least, budget)
    key = [f"w{i}" for i in range(1, DEPTH + 1)]
    candidates = phrases.where("w2 != 0").withColumnRenamed("n", "a")

    cuts = _exploded(candidates, {
        m: [[F.lit(k).alias("k"), *_part(1, k, "p"), *_part(k + 1, m, "q")] for k in range(1, m)] for m in range(2, DEPTH + 1)
    })
    front, rest = _counts_as(phrases, "f", "l"), _counts_as(phrases, "g", "r")
    parts = cuts.join(front, _same(cuts, front, "p", "f"))
    parts = parts.join(rest, _same(parts, rest, "q", "g")).withColumn("score", score("a", "l + r"))
    best = parts.groupBy(*key, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(*key, "a", "cut.l", "cut.r", "cut.score")

    inner = _exploded(candidates, {
        m: [_part(i, i + size - 1, "p") for size in range(2, m) for i in range(1, m - size + 2)] for m in range(3, DEPTH + 1)
    })
    longer = inner.groupBy(*[F.col(f"p{i}").alias(f"f{i}") for i in range(1, DEPTH + 1)]).agg(F.max("a").alias("longer"))
    held = best.join(longer, _same(best, longer, "w", "f") & F.expr("100 * cast(longer AS decimal(20,0)) >= 80 * cast(a AS decimal(20,0))"), "left_anti")

    # The words of a phrase: at most four rows each.
    named = held.select(*held.columns, F.posexplode(F.filter(F.array(*key), lambda w: w != 0)).alias("at", "number"))
    spelled = named.join(words.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("number", "lang", "word"), "number")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    found = spelled.groupBy("lang", *key, "a", "l", "r", "score").agg(phrase)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    totals = words.where("word IS NULL").select(F.col("lang").alias("_lang"), F.col("n"))
    return ranked.where(F.col("rank") <= top).join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
    )
