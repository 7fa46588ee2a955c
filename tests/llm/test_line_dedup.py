from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from proofline.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line, least):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    return key if len(key) >= least else None


def brute(rows, least=5, docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key_of(line, least):
                holders[key_of(line, least)].add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if not (key_of(x, least) and len(h := holders[key_of(x, least)]) >= docs and i != max(h))]
        out.append((i, len(every), len(every) - len(stay), "\n".join(stay)))
    return sorted(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    pool = [f"line number {i}" for i in range(12)] + ["ÄÖ is A Line", "äö is a line", "abc", "", "  spaced Line \t", "spaced line\x0b", "spaced line\xa0", "\x1cspaced line"]
    return [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)) + [f"own {rng.random()}"] * rng.randint(0, 1))) for i in range(n)]


def cleaned(index, docs):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.clean(docs).collect())


def test_matches_brute_force(documents):
    rows = corpus(1) + [(500, None), (501, ""), (502, "\n\n"), (503, "line number 1\r\nLINE NUMBER 1\nline number 2")]
    docs = documents(rows, extra=("key", "_row", "drop"))
    found = ld.dedup_lines(docs, min_chars=5)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()) == brute(rows)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]


def test_inserts_and_deletions_are_reversible(documents, spark):
    a, b, c = corpus(2, 40), [(i + 40, t) for i, t in corpus(3, 40)], [(i + 80, t) for i, t in corpus(4, 40)]
    index = ld.LineIndex(spark, min_chars=5, shards=3)
    index.insert(documents(a))
    assert cleaned(index, documents(a)) == brute(a)
    index.insert(documents(b + a[:5]))
    assert cleaned(index, documents(a + b)) == brute(a + b)
    index.insert(documents(c))
    index.delete(documents(b + [(999, "x")]))
    assert cleaned(index, documents(a + c)) == brute(a + c)
    again = ld.LineIndex(spark, index.path, index.version, min_chars=5, shards=3)
    again.delete(documents(c))
    assert cleaned(again, documents(a)) == brute(a)
    repeated = {bytes(r.key) for r in again.counts().where("n_docs >= 3").collect()}
    assert sum(r.held for r in again.filters().collect()) == len(repeated)
    again.delete(documents(a))
    assert again.counts().count() == 0 and sum(r.held for r in again.filters().collect()) == 0


def test_filters_grow_and_the_exact_way_gives_the_same(documents, spark, monkeypatch):
    rows = [(i, "\n".join(f"shared line {j}" for j in range(i % 7 * 20))) for i in range(40)]
    index = ld.LineIndex(spark, shards=2, min_chars=5)
    index.insert(documents(rows[:8] + [(100 + i, "shared line 3") for i in range(4)]))
    index.insert(documents(rows))
    every = rows + [(100 + i, "shared line 3") for i in range(4)]
    assert cleaned(index, documents(every)) == brute(every)
    monkeypatch.setattr(ld, "FILTER_BYTES", 0)
    assert cleaned(index, documents(every)) == brute(every)


def test_repeated_rows_and_null_ids(documents):
    rows = [(1, "a shared line here"), (1, "a shared line here"), (2, "a shared line here"), (None, "a shared line here"), (None, "only mine it is"), (None, None)]
    found = ld.dedup_lines(documents(rows), min_chars=5).collect()
    assert sorted((str(r.doc_id), r.n_dropped, r.kept_text) for r in found) == sorted([
        ("1", 1, ""), ("1", 1, ""), ("2", 0, "a shared line here"), ("None", 1, ""), ("None", 0, "only mine it is"), ("None", 0, ""),
    ])
    assert ld.dedup_lines(documents([])).count() == 0


def keys(n, salt=""):
    return [hashlib.sha256(f"{salt}{i}".encode()).digest()[:16] for i in range(n)]


@pytest.mark.parametrize("n,size", [(0, 10), (500, 500), (3000, 1500)])
def test_cuckoo_filter(n, size):
    one = ld.CuckooFilter.sized(size)
    one.insert(keys(n))
    assert one.has(keys(n)).all() and one.held == n
    assert one.has(keys(2000, "other")).mean() < 0.02
    before = one.has(keys(n))
    one.insert(keys(50, "more"))
    assert one.has(keys(50, "more")).all()
    one.delete(keys(50, "more"))
    assert (one.has(keys(n)) == before).all() and one.held == n
    one.delete(keys(n))
    assert one.held == 0 and not one.table.any() and not one.stash
