from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from proofline.llm import mixing


def brute_targets(sizes):
    """Reshare the excess of capped sources by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped.update(over)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed, sources, n=400):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.paretovariate(1.2) * 5))), None, rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed,sources", [(1, ["a"]), (2, ["a", "B", "é", None]), (3, ["s0"] * 30 + ["s1", "s2", "s3", "\U0001f600", "￿"])])
def test_targets_words_and_bounds(documents, seed, sources):
    rows = corpus(seed, sources) + [(1000, None, None, "a"), (1001, " \t x\x0b", None, None)]
    size = {i: words(t) for i, t, *_ in rows}
    by_source, longest = defaultdict(int), defaultdict(int)
    for i, _, _, s in rows:
        by_source[s] += size[i]
        longest[s] = max(longest[s], size[i])
    want = brute_targets(by_source)
    found = {r.id: r for r in mixing.mix(documents(rows)).collect()}
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for i, _, _, s in rows:
        r = found[i]
        assert r["size"] == size[i] and r.source_size == by_source[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1
        taken[s] += r.copies * size[i]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.5 * longest[s] + 1e-6 * target + 1


def test_rates_meet_the_constraints_and_are_tilted(documents):
    found = mixing.mix(documents(corpus(7, ["a", "b", "c"], 600))).collect()
    given, wanted = defaultdict(float), defaultdict(float)
    for r in found:
        band = r["size"].bit_length()
        given[r.key, band] += r.rate * r["size"]
        wanted[r.key, band] += r.target / r.source_size * r["size"]
    for cell in wanted:
        assert given[cell] == pytest.approx(wanted[cell], rel=1e-4)


def test_reruns_and_layouts_agree(documents):
    docs = documents(corpus(4, ["a", "b", None]))
    as_set = lambda df: sorted((r.id, r.copies) for r in mixing.mix(df).collect())
    assert as_set(docs) == as_set(docs.repartition(5))


def test_mixed_rows_follow_their_copies(documents):
    rows = corpus(5, ["a", "b"], 60) + [(900, "r r r", None, "a")] * 2 + [(None, "n n", None, None)]
    docs = documents(rows, extra=("size", "key", "copies"))
    wanted = sorted((str(r.id), r.copies) for r in mixing.mix(docs).groupBy("id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "copies").collect() if r.copies)
    found = mixing.mixed(docs)
    assert found.schema == docs.schema
    assert sorted((str(r.doc_id), r["count"]) for r in found.groupBy("doc_id").count().collect()) == wanted


def test_empty_and_wordless_tables(documents):
    assert mixing.mix(documents([])).count() == 0
    found = mixing.mix(documents([(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r["size"], r.target) for r in found] == [(0, 0.0)] * 2
