from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import fingerprint as fp
from proofline.llm import shingles as sh

ODD = ["", " \t\n", "one", "One two", "a b c d", "a b c d e", "A B C D E", "a b c d e a b c d e", "x\x1cy z\x85 w v u t s", "é È ß \U0001f600 \x0b q r", "w" * 3000, "a " * 40 + "b"]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_shingle_hashes_stand_for_the_shingles(monkeypatch, piece):
    monkeypatch.setattr(sh, "PIECE", piece)
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choices(["ab", "Cd", "é", "f\n", "g"], k=rng.randint(1, 60))) for _ in range(60)]
    seen: dict[int, bytes] = {}
    for text, hashes in zip(texts, sh.text_shingles(texts)):
        exact = sh.exact_shingles(text)
        assert len(hashes) == len(exact) and sorted(set(hashes.tolist())) == hashes.tolist()
        alone = sh.text_shingles([text])[0]
        assert alone.tolist() == hashes.tolist()
        for other, known in list(seen.items()):
            assert known in exact or other not in set(hashes.tolist())
        if len(exact) == 1:
            seen[int(hashes[0])] = next(iter(exact))
    assert len(set(seen.values())) == len(seen)


def test_pairs_have_the_same_intersection_as_their_shingles():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab", k=rng.randint(3, 30))) for _ in range(60)]
    hashes = [set(h.tolist()) for h in sh.text_shingles(texts)]
    exact = [sh.exact_shingles(t) for t in texts]
    for i in range(60):
        for j in range(i):
            assert len(hashes[i] & hashes[j]) == len(exact[i] & exact[j])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64)), np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64))
    union, part = np.union1d(a, b), np.union1d(a, b[:3000])
    sa, sb = fp.sketch(a), fp.sketch(b)
    assert fp.merge(sa, sb).tolist() == fp.sketch(union).tolist()
    assert fp.decode(fp.encode(sa)).tolist() == sa.tolist() and len(sa) == fp.K
    assert fp.distinct_count(fp.sketch(union)) == pytest.approx(12000, rel=0.3)
    assert fp.resemblance(fp.sketch(part), sa) == pytest.approx(2 / 3, abs=0.15)
    assert fp.containment(sa, fp.sketch(part)) == pytest.approx(1, abs=0.2)
    small, other = np.arange(5, dtype=np.uint64) << np.uint64(20), np.arange(3, 9, dtype=np.uint64) << np.uint64(20)
    assert fp.resemblance(small, other) == 2 / 9 and fp.distinct_count(small) == 5


def brute(rows):
    order = sorted((d, t or "") for d, t in rows if d is not None)
    out = {}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        new = t[:len(t) - half] + following[:half]
        exact = [sh.exact_shingles(x) for x in (t, new, following)]
        jaccard = lambda a, b: float(a == b) if not a or not b else len(a & b) / len(a | b)
        out.setdefault(d, []).append((len(t), hashlib.sha256(new.encode()).hexdigest(), jaccard(exact[0], exact[1]), jaccard(exact[0], exact[2])))
    return out


def test_edited_texts_follow_the_order_of_ids(documents):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choices(["ab", "c", "dé", "\U0001f600"], k=rng.randint(0, 25)))) for i in range(120)] + [(7, None), (8, ""), (8, "again"), (None, "a b"), (None, None)]
    found = fp.with_edits(documents(rows, extra=("bucket", "tail"))).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    for d in want:
        mine = sorted((r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found if r.doc_id == d)
        assert mine == sorted(want[d])
    alone = [r for r in found if r.doc_id is None]
    assert sorted(r.near_next for r in alone) == [0.0, 1.0]
    assert {r.edited_sha256 for r in alone} == {hashlib.sha256(x.encode()).hexdigest() for x in ("", "a ")}


def test_one_document_and_none(documents):
    assert fp.with_edits(documents([])).count() == 0
    only = fp.with_edits(documents([(5, "abcd")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1.0


def test_merged_fingerprints(documents, spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdef", k=90)), None, "s" if i % 2 else None) for i in range(40)] + [(99, "", None, "e")]
    prints = documents(rows).withColumn("fingerprint", fp.fingerprint_column(F.col("text")))
    found = {r.source: r.fingerprint for r in fp.merged_fingerprints(prints, ["source"]).collect()}
    for source in ("s", None):
        union = np.unique(np.concatenate(sh.text_shingles([t for _, t, _, s in rows if s == source])))
        assert found[source] == fp.encode(fp.sketch(union))
    assert found["e"] == ""
