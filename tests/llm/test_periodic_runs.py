from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from proofline.llm import periodic_runs, queries


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, least=6, times=4):
    out, n = [], len(s)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and not any(all(s[k] == s[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(words):
    found = brute_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_lyndon_arrays_and_runs_of_random_sequences():
    rng = random.Random(2)
    for _ in range(1500):
        letters, n = rng.randint(1, 4), rng.randint(0, 45)
        s = [rng.randrange(letters) for _ in range(n)]
        if n > 6 and rng.random() < 0.6:
            a, p = rng.randrange(n), 1 + rng.randrange(5)
            s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert periodic_runs.lyndon_array(s, letters) == brute_lyndon(s)
        assert periodic_runs.runs(np.array(s, dtype=np.int64)) == brute_runs(s)
        assert periodic_runs.document_runs([b" ".join(b"w%d" % x for x in s)])[0][1] == brute_runs(s)


def test_long_sequences_take_time_in_proportion():
    whole = np.tile(np.random.default_rng(3).integers(0, 60, 5_000), 8)
    assert periodic_runs.runs(whole) == [(0, 40_000, 5_000)]
    assert periodic_runs.runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.runs(np.arange(200_000)) == []


def rows():
    rng = random.Random(4)
    out = [(-1, None), (-2, ""), (-3, " \t\n\x0b\x0c\r "), (None, "a " * 9), (-4, " x " * 7 + "y"), (-4, " x " * 7 + "y"), (-5, "A a " * 4)]
    for i in range(300):
        words = [rng.choice("abcde") + rng.choice(["", "é", "1."]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            words += [rng.choice("abc")] * rng.randint(2, 12) + words[:3] * rng.randint(2, 6)
        out.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "\r\n"]) for w in words)))
    return out


def test_digests_match_brute_force(documents):
    table = rows()
    docs = documents([(i, t) for i, t in table], extra=("x",)).withColumnRenamed("source", "runs").withColumnRenamed("lang", "collapsed")
    found = periodic_runs.digests(periodic_runs.find_runs(docs, "doc_id", periodic_runs.planted(docs.doc_id, docs.text)))
    got = sorted(((r.doc_id, tuple(r)[1:]) for r in found.collect()), key=str)
    assert got == sorted(((i, brute_row(brute_planted(i, t))) for i, t in table), key=str)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_and_text_of_the_operator(documents):
    docs = documents([(1, "head " + "x y " * 4 + "tail"), (2, "no run here")])
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1, 8, 2)] and found[1].collapsed == "head x y tail"
    assert found[2].runs == [] and found[2].collapsed == "no run here"
    assert periodic_runs.find_runs(documents([])).collect() == []


@pytest.mark.parametrize("words", [150_000])
def test_very_long_text(documents, words):
    text = "w " * 3 + " ".join(str(i % 7_001) for i in range(words))
    found = periodic_runs.find_runs(documents([(5, text)])).collect()[0]
    assert [tuple(r) for r in found.runs] == [(3, words, 7_001)]
    assert found.collapsed == "w w w " + " ".join(str(i) for i in range(7_001))


def test_query_reads_the_whole_table(spark, tmp_path, documents):
    table = [(i, t) for i, t in rows() if i is not None and i >= 0]
    documents(table).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_row(brute_planted(i, t)) for i, t in table}
