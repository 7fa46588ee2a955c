from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from proofline.llm import quality, queries

GOOD = "the of and thing with that water stone über está".split()


def brute_features(text):
    """The features themselves, not hashed."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = Counter(("word", w) for w in words)
    for w in words:
        marked = ["<", *w, ">"]
        for n in quality.GRAMS:
            out.update((n, *marked[i:i + n]) for i in range(len(marked) - n + 1))
    out["again"] = quality.REPEAT_TIMES * sum(a == b for a, b in zip(words, words[1:]))
    return +out


def counted(texts):
    sums = [Counter() for _ in texts]
    for buckets, owners in quality.text_features(texts):
        for b, o in zip(buckets.tolist(), owners.tolist()):
            sums[o][b] += 1
    return sums


def hard_texts():
    return ["", " \n ", "a", "a a a", "word word\tword\x0bWord é<>é", "x" * 50, "The the THE, the. \x1c \x85", "last", "last first", "first"]


def test_features_match_brute_force():
    texts, bucket = hard_texts(), {}
    for text, got in zip(texts, counted(texts)):
        want = brute_features(text)
        assert sum(got.values()) == sum(want.values())
        assert sorted(got.values()) == sorted(want.values()), text
        for feature, n in want.items():
            alone = {b for b in got if got[b] == n}
            bucket[feature] = bucket.get(feature, alone) & alone
    # One bucket fits each feature in all texts that have it.
    assert all(bucket.values())


def test_pieces_change_nothing(monkeypatch):
    texts = hard_texts() + ["again again " * 40, " ".join(GOOD) * 9]
    whole = counted(texts)
    monkeypatch.setattr(quality, "CHUNK_CHARS", 7)
    assert counted(texts) == whole


def corpus(n=600):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        good, words = rng.random() < 0.8, rng.choices(GOOD, k=rng.randint(8, 60))
        if not good:
            junk = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if junk == 0 else [w + "%%%" for w in words] if junk == 1 else [w for w in words for _ in range(5)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, documents):
    docs, labels = corpus()
    rows = docs + [(-1, None), (-2, ""), (None, "the the"), (docs[0][0], docs[0][1]), (-3, "word " * 300_000)]
    marks = spark.createDataFrame(labels + [(-2, None), (None, 1), (99_999, 0), labels[0]], "doc_id long, quality int")
    return documents(rows, extra=("score",)).withColumnRenamed("lang", "quality").withColumnRenamed("source", "_label"), marks, dict(labels)


def test_held_out_documents_are_told_apart(tables):
    docs, marks, labels = tables
    rows = quality.scored(docs, marks).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.3 else 0)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and np.mean([r.predicted == labels[r.doc_id] for r in judged]) >= 0.98
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    assert len({r.score for r in rows if r.doc_id in (-1, -2)}) == 1
    assert next(r for r in rows if r.doc_id == -3).predicted == 0


def test_reruns_agree_and_labels_alone_are_learned(tables, spark):
    docs, marks, _ = tables
    one, two = quality.train(docs, marks), quality.train(docs.repartition(3), marks.repartition(5))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    # What is held out teaches nothing.
    turned = marks.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality")
    assert np.array_equal(one.weights, quality.train(docs, turned).weights)


def test_without_labels_or_with_one_kind(tables, spark, documents):
    docs, marks, _ = tables
    assert quality.train(docs, marks.where("false")).scores(["x", ""]) == [0.5, 0.5]
    scores = quality.train(docs, marks.where("quality = 1")).scores(["x", ""])
    assert scores[0] == scores[1] > 0.9
    assert quality.scored(documents([]), marks).collect() == []


def test_the_sample_is_bounded(tables, monkeypatch):
    docs, marks, _ = tables
    seen = []
    monkeypatch.setattr(quality, "fit", lambda sample: seen.append(sample))
    monkeypatch.setattr(quality, "SAMPLE", 50)
    quality.train(docs, marks)
    monkeypatch.setattr(quality, "SAMPLE_CELLS", 500)
    quality.train(docs, marks)
    assert len(seen[0]) == 50 and sum(len(s[1]) for s in seen[1]) <= 500 < sum(len(s[1]) for s in seen[0])


def test_query_is_registered():
    assert "op13_quality" in queries.QUERIES
