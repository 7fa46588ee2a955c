"""Periodic runs of words by Baier's grouping: Lyndon arrays under both orders, Lyndon roots extended into runs.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; it counts from
``max(least, times * q)`` words on. Every run holds a Lyndon root: under the order of words by which its end falls (or under the
reverse one), the longest Lyndon word from some place among its first q words has q words. The first phase of Baier's
suffix sorter finds the longest Lyndon word at every place: suffixes are grouped by their first word, groups are taken from the highest
down, and each member hands its group's context to the nearest suffix before it that is still in a lower group; the context that a group ends
with is the Lyndon word of its members. It runs once under either order. A root at i of length p is then extended by the longest common
extensions of i and i + p to the right and to the left.

A run of five words or more repeats five-word sequences at its period, so a place whose five words stand nowhere else in the document cannot lie in the run.
Stretches of places that do repeat (found with hashes, which can only add places) hold every run whole, and are what is grouped and searched.

Rows: a null or empty text, or one of blanks, has no words and no runs. Repeated rows give repeated results, a null doc_id is an ordinary one,
other columns do not matter and may have any name, and an empty table gives an empty result. Runs are sorted by start, then period, so ties have one order. A text of
any length is searched whole, in the task that holds its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.shingles import scrambled

#: Fewest words of a run, and how many times its period it must hold.
LEAST = 6
TIMES = 4
#: Words of the sequences that must repeat inside a run.
GRAM = 5
#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 1 << 22
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_array(ids: list[int], letters: int) -> list[int]:
    """The length of the longest Lyndon word at each place, of a sequence of numbers below ``letters``; its end is lower than all."""
    n = len(ids)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, letter in enumerate(ids):
        members[letter].append(i)
    group, live = list(ids), [len(m) for m in members]
    width = [1] * letters
    below, above = list(range(-1, letters - 1)), list(range(1, letters + 1))
    before, done, longest = list(range(-1, n - 1)), bytearray(n), [1] * n
    top = letters - 1
    while top >= 0:
        if live[top]:
            context, heirs = width[top], {}
            for i in members[top]:
                if group[i] != top:
                    continue
                done[i], longest[i] = 1, context
                p = before[i]
                while p >= 0 and done[p]:
                    before[i] = p = before[p]
                if p >= 0:
                    heirs[p] = heirs.get(p, 0) + 1
            # Heirs of one group that take the context equally often stay together, those that take it more often go higher.
            sets: dict[tuple[int, int], list[int]] = {}
            for p, times in heirs.items():
                sets.setdefault((times, group[p]), []).append(p)
            for times, old in sorted(sets, reverse=True):
                moved = sets[times, old]
                if len(moved) == live[old]:
                    width[old] += times * context
                    continue
                new = len(width)
                moved.sort()
                members.append(moved)
                width.append(width[old] + times * context)
                live.append(len(moved))
                live[old] -= len(moved)
                upper = above[old]
                below.append(old)
                above.append(upper)
                above[old] = new
                below[upper] = new
                for p in moved:
                    group[p] = new
        top = below[top]
    return longest


def _common(data: bytes, i: int, j: int, most: int) -> int:
    """How many of the 4-byte words at i and at j > i agree, up to ``most``: galloping, then halving."""
    known, step = 0, 16
    while known < most:
        size = min(step, most - known)
        if data[4 * (i + known):4 * (i + known + size)] == data[4 * (j + known):4 * (j + known + size)]:
            known, step = known + size, step * 2
            continue
        low, high = 0, size
        while high - low > 1:
            middle = (low + high) // 2
            if data[4 * (i + known + low):4 * (i + known + middle)] == data[4 * (j + known + low):4 * (j + known + middle)]:
                low = middle
            else:
                high = middle
        return known + low
    return known


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period. ``times`` is 3 or more."""
    n = len(ids)
    if n < least:
        return []
    numbers, dense = np.unique(ids, return_inverse=True)
    letters, places = len(numbers), np.arange(n)
    data, back = dense.astype("<u4").tobytes(), dense[::-1].astype("<u4").tobytes()
    found = set()
    for order in (dense, letters - 1 - dense):
        roots = np.array(lyndon_array(order.tolist(), letters))
        # The first root of a run starts among its first p words, so that at least (times - 2) p + 1 words follow its repetition.
        ahead = (times - 2) * roots + 1
        fits = places + roots + ahead <= n
        fits[fits] = dense[places[fits]] == dense[places[fits] + roots[fits]]
        ends: dict[int, int] = {}
        for i in np.flatnonzero(fits).tolist():
            p = int(roots[i])
            if i + p <= ends.get(p, 0):
                continue
            more = _common(data, i, i + p, n - i - p)
            if more <= (times - 2) * p:
                continue
            end = i + p + more
            start = i - _common(back, n - i - p, n - i, i)
            ends[p] = end
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, the words' numbers in a row (equal words, equal numbers), and the texts' bounds."""
    words, known, ids = [], {}, []
    for text in texts:
        own = text.split()
        words.append(own)
        ids += [known.setdefault(w, len(known)) for w in own]
    return words, np.array(ids, dtype=np.int64), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def _stretches(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, begin, end): maximal stretches of one text whose five-word sequences all repeat in it."""
    size = len(ids) - GRAM + 1
    if size <= 0:
        return
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = owner[:size].astype(np.uint64)
    for k in range(GRAM):
        key = scrambled(key * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + size].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    repeats = np.zeros(size + 1, dtype=bool)
    repeats[order[1:][equal]] = True
    repeats[order[:-1][equal]] = True
    repeats[:size] &= owner[:size] == owner[GRAM - 1:]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], repeats)).astype(np.int8)))
    for begin, last in edges.reshape(-1, 2).tolist():
        yield int(owner[begin]), begin, last + GRAM - 1


def document_runs(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text; words lie between ASCII white space."""
    words, ids, bounds = _numbered(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, begin, end in _stretches(ids, bounds):
        if end - begin >= LEAST:
            shift = begin - int(bounds[text])
            found[text] += [(start + shift, length, period) for start, length, period in runs(ids[begin:end])]
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(words, found)]


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run after its first period, with one blank between."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, runs, collapsed)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                done = document_runs(texts[begin:i + 1])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, i + 1 - begin),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in done], kind),
                    pa.array([_collapsed(w, r) for w, r in done], pa.binary()).cast(pa.string()),
                ], names=["doc_id", "runs", "collapsed"])
                begin, size = i + 1, 0


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per input row: doc_id, runs (start, length, period; in words) and the collapsed text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).alias("text"))
    own = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_search, f"doc_id {own}, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text; where crc32(doc_id) is divisible by ten, its words from some place on repeat with some period."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.transform(
        F.filter(F.array(F.struct(words.alias("w"), F.floor(F.crc32(doc_id.cast("string")) / 10).alias("g"))), lambda x: F.size(x["w"]) > 0),
        lambda x: F.transform(
            F.array(F.struct(x["w"].alias("w"), x["g"].alias("g"), F.size(x["w"]).alias("n"), (x["g"] % F.size(x["w"])).cast("int").alias("a"))),
            lambda y: F.array_join(F.transform(y["w"], lambda w, i: F.when(i < y["a"], w).otherwise(
                F.get(y["w"], (y["a"] + (i - y["a"]) % (1 + F.floor((y["n"] - y["a"]) / (3 + y["g"] % 8)))).cast("int"))
            )), " "),
        )[0],
    )
    return F.when(F.crc32(doc_id.cast("string")) % 10 == 0, F.coalesce(F.get(made, F.lit(0)), F.lit(""))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: first start, then period) and digests of runs and collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS less)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.back")).alias("start"), F.col("_longest.length").alias("length"), (-F.col("_longest.less")).alias("period"),
        F.expr("(1000 * _longest.length) div (-_longest.less)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
