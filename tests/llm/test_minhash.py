from __future__ import annotations

import random

import numpy as np
import pytest

from proofline.llm import minhash
from proofline.llm.shingles import exact_shingles, text_shingles


def brute(rows):
    """doc_id to (n_shingles, component_id) for distinct doc_ids."""
    sets = {d: exact_shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def near_copies(seed, groups=12, size=9, words=80, passage=()):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 50)}" for _ in range(words)] + list(passage)
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(text).title() if rng.random() < 0.2 else " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,passage", [(1, ()), (2, tuple(f"p{i}" for i in range(70)))])
def test_components_match_brute_force(documents, seed, passage):
    rows = near_copies(seed, passage=passage) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "a"), (906, "a b c")]
    found = minhash.near_duplicates(documents(rows, extra=("node", "n", "bands", "key", "label"))).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert {r.doc_id for r in found if r.kept} == {d for d, (_, c) in want.items() if c == d}


def test_signature_estimates_the_jaccard_index():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    mixed = np.union1d(a[:2400], rng.integers(0, 2**64, 300, dtype=np.uint64))
    truth = 2400 / (len(a) + 300)
    assert np.mean(minhash.signature(a) == minhash.signature(mixed)) == pytest.approx(truth, abs=0.1)
    by_hand = minhash._circle()
    places = (minhash.scrambled(a ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(42)).astype(int)
    row = by_hand[:, 0]
    k = 17
    assert minhash.signature(a)[k] == min(row[(p + k) % minhash.CIRCLE] for p in places)
    assert len(minhash.signature(text_shingles(["one"])[0])) == minhash.BANDS * minhash.ROWS


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (102, 101)]
    labels = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 102: 100}


def test_repeated_rows_null_ids_and_kept_rows(documents):
    text = "one two three four five six seven"
    rows = [(4, text), (4, text), (3, text + " "), (None, text), (None, "other words here now yes"), (9, None)]
    docs = documents(rows, extra=("node", "_row"))
    found = minhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == sorted([
        ("4", "3", False), ("4", "3", False), ("3", "3", True), ("None", "3", False), ("None", "None", True), ("9", "9", True),
    ])
    kept = minhash.drop_near_copies(docs)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
