from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from proofline.llm import bpe
from proofline.llm.shingles import exact_shingles

WORDS = {"en": "the of and thing with that was from over under", "de": "der die ßung ich über und nicht sehr doch auch"}


def corpus():
    rng, rows = random.Random(3), []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(20, 60))), lang, rng.choice(["a", "b", None])))
    rows += [(100 + i, rows[i][1].upper(), rows[i][2], "c") for i in range(10)]
    for i in range(10):
        words = (rows[20 + i][1] + " " + rows[30 + i][1]).split()
        rows += [(200 + i, " ".join(words), "en", "a"), (300 + i, " ".join([*words[:-1], "changed"]), "en", "b")]
    return rows + [(500, None, "en", "a"), (501, "", "de", "a"), (502, "12 34 ###", None, "b"), (503, "x" * 40_000, None, "b")]


def test_stages_keep_their_promises(documents, spark, tmp_path):
    docs = documents(corpus())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, now = {}, table
    for name, stage in cp.STAGES:
        now = cp.saved(stage(spark, now, str(tmp_path)), f"test-{name}")
        seen[name] = now.collect()
        if name != "bpe":
            assert now.columns == table.columns
    texts = {r.doc_id: r.text for r in table.collect()}
    first = {r.doc_id for r in seen["language_id"]}
    assert first == set(texts) - {500, 501, 502, 503}
    second = {r.doc_id for r in seen["exact_dedup"]}
    assert second == {max(d for d in first if texts[d].lower() == texts[e].lower()) for e in first}
    sets = {d: exact_shingles(texts[d]) for d in second}
    third = {r.doc_id for r in seen["near_dedup"]}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert not [1 for a in third for b in third if a < b and linked(a, b)]
    assert all(d in third or any(linked(d, e) for e in second if e < d) for d in second)
    assert {r.doc_id for r in seen["mixing"]} <= third and max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    tok = bpe.tokenizer(bpe.default_path())
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids)) for r in seen["mixing"])
    assert Counter((r.doc_id, r.n_tokens) for r in seen["bpe"]) == want
    assert Counter((r.doc_id, r.n_tokens) for r in cp.run(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_left(documents, spark, tmp_path, rows):
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_names(documents, spark, tmp_path):
    from pyspark.sql import functions as F

    clash = ["_row", "_p", "fit", "score", "lang_pred", "kept", "keep_id", "component_id", "n_shingles", "size", "taken", "target", "key", "level", "hash", "n_tokens", "a.b"]
    rows = [r for r in corpus()[:40] for _ in range(2)]
    docs = documents(rows).withColumns({c: F.lit(7) for c in clash})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = cp.saved(stage(spark, now, str(tmp_path)), f"test-{name}")
        assert now.columns == table.columns
        assert now.select(*[F.col(f"`{c}`") for c in clash]).distinct().collect() == [tuple([7] * len(clash))]
        if name in ("exact_dedup", "near_dedup"):
            assert max(Counter(r.text.lower() for r in now.collect()).values()) == 1 or name == "exact_dedup"
    assert cp.run(spark, str(tmp_path)).count() == now.count()
