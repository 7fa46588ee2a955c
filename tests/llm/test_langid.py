from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from proofline.llm import langid

WORDS = {"en": "the of and thing with that", "fr": "le les éaux que des était", "de": "der die ßung ich über"}


def corpus(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(2, 20))) + rng.choice(["", " 12!", "\n--"]), lang))
    return rows


def brute_grams(text):
    clean, letter = "", False
    for c in f" {text} ".lower():
        if c.isalpha():
            clean, letter = clean + c, True
        elif letter or not clean:
            clean, letter = clean + " ", False
    return Counter(clean[i:i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1) if clean[i:i + n].strip())


def test_predictions_match_brute_force_naive_bayes(documents):
    rows = corpus()
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            counts[lang] += brute_grams(text)
            docs[lang] += 1
    model = langid.train(documents(rows))
    assert model.languages == ("de", "en", "fr")
    table = {r.doc_id: r for r in langid.identify(documents(rows)).collect()}
    right = 0
    for i, text, lang in rows:
        grams = brute_grams(text)
        score = {
            name: math.log(docs[name] / sum(docs.values())) + sum(
                k * math.log((counts[name][g] + 0.5) / (sum(counts[name].values()) + 0.5 * langid.BUCKETS)) for g, k in grams.items()
            ) for name in counts
        }
        assert table[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        right += table[i].lang_pred == max(score, key=score.get)
        assert 0 <= table[i].score <= 1
    assert right >= 0.99 * len(rows)


def test_no_letters_nulls_and_unlabelled_rows(documents):
    rows = corpus(60) + [(500, None, "en"), (501, "", "en"), (502, "12 ### \U0001f600", "fr"), (503, "the thing", None), (None, "les éaux", "xx")]
    docs = documents(rows, extra=("lang_pred", "score", "_p", "_row"))
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and found[500].score == 0
    assert found[503].lang_pred == "en" and found[None].lang_pred == "fr" and not found[None].held_out
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {500, 501, 502}


def test_nothing_learned_and_empty(documents):
    assert [r.lang_pred for r in langid.identify(documents([(1, "abc")])).collect()] == ["und"]
    assert langid.identify(documents([])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(("a", "b"), rng.normal(size=(2, langid.BUCKETS)), np.zeros(2), np.zeros(2), np.ones(2))
    texts = ["x" * 10, "ab cd" * 400, "", "12"]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 250)
    pieces = model.predict(texts)
    assert whole[0][2:] == ["und", "und"] == pieces[0][2:] and whole[0][0] == pieces[0][0]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy_on_the_test_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{folder}/documents.parquet'").fetchall())
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pieces_lose_no_ngram(monkeypatch):
    """N-grams of a text cut into pieces of any size are those of the whole: letters, runs of blanks and capitals at the cuts included."""
    rng = random.Random(3)
    texts = ["", "a", " ", "ΑΣ ΑΣΑ", "İx", "12", *("".join(rng.choices("abÉΣ ßİ1\n", k=rng.randint(1, 60))) for _ in range(40))]
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "CHUNK_CHARS", size)
        sums, lettered = defaultdict(Counter), set()
        for buckets, owners, found in langid._in_parts(texts):
            lettered.update(found.tolist())
            for b, o in zip(buckets.tolist(), owners.tolist()):
                sums[o][b] += 1
        for i, text in enumerate(texts):
            buckets, _, found = langid._grams([text])
            assert sums[i] == Counter(buckets.tolist()) and found[0] == (i in lettered), (size, text)


def test_a_very_long_text_has_all_its_ngrams():
    text = "word Über " * 80_000
    parts = [len(b) for b, _, _ in langid._in_parts([text])]
    assert len(parts) > 1 and sum(parts) == sum(brute_grams(text).values())


def test_noise_and_unknown_languages_fit_none(documents):
    import random

    rng = random.Random(4)
    words = {"en": "the of and thing with that was from over under", "de": "der die und nicht sehr doch auch ich über ist"}
    clean = [(i, " ".join(rng.choices(words[lang].split(), k=rng.randint(1, 80))), lang, "s") for i in range(200) for lang in [rng.choice(["en", "de"])]]
    letters = lambda: "".join(rng.choices("bcdfgjklmpqvxyzжщф", k=rng.randint(2, 9)))
    noise = [(1000 + i, " ".join(letters() for _ in range(400)), None, "s") for i in range(5)] + [(1005, "x" * 40_000, None, "s"), (1006, "x" * 700_000, None, "s")]
    short = [(2000, "thing", None, "s"), (2001, "a", None, "s")]
    kept = {r.doc_id for r in langid.keep_identified(documents(clean + noise + short)).collect()}
    assert kept == {r[0] for r in clean + short}


def test_fit_against_sums_over_all_n_grams(documents):
    rows = [(i, t, "en", "s") for i, t in enumerate(["the one and the other", "one more of the same", "and so on and on", "all the rest of it"] * 5)]
    model = langid.train(documents(rows))
    learned = [r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    logs = np.concatenate([model.logs[0][langid._grams([t])[0]] for t in learned])
    assert np.isclose(model.usual[0], logs.mean()) and np.isclose(model.spread[0], logs.std())
    _, _, fits, grams = model.judge(["the other thing", ""])
    own = model.logs[0][langid._grams(["the other thing"])[0]]
    assert np.isclose(fits[0], (own.mean() - logs.mean()) / logs.std()) and grams == [len(own), 0] and fits[1] == 0.0
