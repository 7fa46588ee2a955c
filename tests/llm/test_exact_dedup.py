from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from proofline.llm import exact_dedup


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    return sorted(
        (d, max(groups[lowered(t)]), len(groups[lowered(t)]), d == max(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest())
        for d, t in rows
    )


def rows_of(df):
    return sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect())


CASES = [
    (0, None), (1, ""), (2, "Abc"), (3, "aBC"), (4, "abcabc"), (5, "abcabcabc"), (6, "ABCabcabc"), (7, "Ä"), (8, "ä"),
    (9, "x" * 50), (10, "x" * 49), (11, "X" * 50), (12, "abd"), (13, "abcabd" * 9), (14, "abcabd" * 8 + "abcabc"),
    (15, "\U0001f600" * 7), (16, "\U0001f600" * 7), (17, "İI"), (18, "İi"), (19, "\n\n"), (20, "\n\n"),
]


@pytest.mark.parametrize("options", [{}, {"block_chars": 3}, {"block_chars": 3, "hash_bits": 1}, {"hash_bits": 0}])
def test_groups_match_brute_force_with_small_blocks_and_colliding_hashes(documents, options):
    assert rows_of(exact_dedup.exact_groups(documents(CASES), **options)) == expected(CASES)


def test_random_texts_of_few_letters(documents):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abAB", k=rng.randint(0, 9)))) for i in range(300)]
    assert rows_of(exact_dedup.exact_groups(documents(rows), block_chars=2, hash_bits=3)) == expected(rows)


def test_repeated_rows_and_null_ids(documents):
    rows = [(5, "a"), (5, "a"), (4, "A"), (None, "a"), (None, "z"), (None, "Z"), (7, "q"), (7, "r")]
    found = exact_dedup.exact_groups(documents(rows)).collect()
    assert len(found) == len(rows)
    assert [(r.keep_id, r.group_size) for r in found if r.text_sha256 == hashlib.sha256(b"a").hexdigest()] == [(5, 4)] * 4
    assert sum(r.kept for r in found) == 4 and [r.doc_id for r in found if r.kept and r.keep_id == 5] == [5]


def test_kept_rows_are_whole_and_columns_may_clash(documents):
    rows = [(1, "One"), (2, "one"), (2, "one"), (3, None)]
    docs = documents(rows, extra=("name", "sha", "id", "_row", "h"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "one"), (3, None)]


def test_empty_table(documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0
    assert exact_dedup.drop_copies(documents([])).count() == 0
