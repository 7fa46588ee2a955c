from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import collocations


def brute(table, least=30, top=2000):
    """Rows of (lang, rank, phrase, a, l, r, n, score) from a table of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in table:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def table(seed=1, size=500, words="of the in new york city é E x1 über"):
    rng = random.Random(seed)
    rows = []
    for _ in range(size):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice(words.split()) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", " \x1c ", " "])
            if rng.random() < 0.2:
                text += "New York city hall "
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), (None, None), ("xx", ""), ("yy", " \t\n.,")]


def run(documents, rows, **options):
    docs = documents([(i, text, lang) for i, (lang, text) in enumerate(rows)], extra=("n",)).withColumnRenamed("source", "w1")
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


def test_phrases_match_brute_force(documents):
    rows = table()
    got = run(documents, rows)
    assert len(got) > 40 and got == brute(rows)


def test_small_groups_ties_and_tops(documents):
    rows = table(seed=2, size=150)
    # A budget of one suffix deals every prefix, and the third words of every prefix, to groups of their own.
    assert run(documents, rows, least=3, top=7, budget=1) == brute(rows, least=3, top=7)


def test_empty_tables_and_rare_words(documents):
    assert run(documents, []) == []
    assert run(documents, [("en", None), (None, "")]) == []
    assert run(documents, [("en", "some words that are rare")] * 29) == []
    assert run(documents, [("en", "one two")] * 30) == [("en", 1, "one two", 30, 30, 30, 60, 1_000_000)]


def test_one_very_long_text(documents):
    rng = random.Random(5)
    text = " ".join(rng.choice("a b c d e f g h".split()) for _ in range(200_000)) + " " + "z" * 1_500_000
    assert run(documents, [("en", text)], top=50) == brute([("en", text)], top=50)


def clashing():
    """Two words whose sums of powers agree whatever the base: a Thue-Morse word and its complement."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_whose_numbers_clash_are_told_apart(documents):
    one, two = clashing()
    assert np.unique(collocations._numbers([one.encode(), two.encode()], 0)).size == 1
    rows = [("en", f"{one} x"), ("en", f"{two} x"), ("en", f"{one} y")] * 3
    assert run(documents, rows, least=3) == brute(rows, least=3)


def test_score_is_exact_beyond_64_bits(spark):
    cases = [(5 * 10**15, 10**16 - 1), (2**60 + 1, 2**61 + 1), (3, 7), (30, 60)]
    frame = spark.createDataFrame(cases, "a long, b long").select("a", "b", collocations.score("a", "b").alias("score"))
    assert {(r.a, r.b): r.score for r in frame.collect()} == {(a, b): 2_000_000 * a // b for a, b in cases}


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_subtrees_are_the_same_for_any_batches(size):
    rng = np.random.default_rng(6)
    leaves = sorted({tuple(r) for r in rng.integers(1, 4, (60, 3)).tolist() for r in [(*r, int(x)) for x in rng.integers(0, 3, 4)]})
    counts = rng.integers(1, 5, len(leaves)).tolist()
    want = Counter()
    for leaf, n in zip(leaves, counts):
        want[(*leaf[:3], 0)] += n
        if leaf[3]:
            want[leaf] += n
    columns = [pa.array(c, pa.int64()) for c in [*zip(*leaves), counts]]
    whole = pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "w3", "w4", "n"])
    batches = [whole.slice(i, size) for i in range(0, len(whole), size)]
    got = [tuple(x.values()) for b in collocations._subtree(5)(iter(batches)) for x in b.to_pylist()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items() if v >= 5)


def test_a_full_bit_map_only_lets_more_pass(monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 64)
    hashes = np.random.default_rng(7).integers(0, 2**63, 500).astype(np.uint64)
    assert collocations._in_map(np.full(8, 255, dtype=np.uint8), hashes).all()
    assert not collocations._in_map(np.zeros(8, dtype=np.uint8), hashes).any()
