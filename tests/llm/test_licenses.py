from __future__ import annotations

import random

import pytest

from proofline.llm import licenses as lic

FILLER = "erat onthe was that things and reation by over".split()


def names(text):
    return [r[0] for r in lic.notices(text)]


def test_every_template_is_found_exactly_inside_other_text():
    rng = random.Random(1)
    for i, t in enumerate(lic.templates()):
        around = [" ".join(rng.choices(FILLER, k=30)) for _ in range(2)]
        found = lic.notices(f"{around[0]}\n{t.text}\n{around[1]}")
        assert [r[0] for r in found] == [t.license] and found[0][7] == 1.0 and found[0][8] == found[0][9] == ""
        assert found[0][2] == 30 and found[0][3] == len(t.words), t


def test_changed_wording_is_reported():
    text = lic.NOTICES[3][1].replace("free of charge", "gratis").replace("without restriction", "without any restriction")
    (row,) = lic.notices(text)
    assert row[0] == "MIT" and 0.9 < row[7] < 1 and row[8] == "free of charge" and row[9] == "gratis any"
    assert 0 < row[5] < row[4] and row[6] == 1 - row[5] / row[4]


def test_wrapped_lines_and_several_notices():
    words = lic.NOTICES[1][1].split()
    wrapped = "\n".join(" # " + " ".join(words[i:i + 9]) for i in range(0, len(words), 9))
    assert names(wrapped) == ["Apache-2.0"]
    assert names(f"{lic.NOTICES[2][1]}\n{lic.NOTICES[0][1]}") == ["MIT", "Apache-2.0"]
    assert names("word " * 5000 + lic.NOTICES[2][1] + " word" * 5000) == ["MIT"]
    assert names(("a license of " * 900) + lic.NOTICES[0][1] + (" a license of" * 900)) == ["Apache-2.0"]


@pytest.mark.parametrize("text", [None, "", "\n", "A driving license is needed.", "no warranty talk here", "copyright 2020 by someone", "licensed " * 50])
def test_texts_without_notices(text):
    assert lic.notices(text) == []


def test_rows(documents):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (None, "Licensed under CC BY 4.0."), (2, None), (3, "none")]
    found = lic.scan(documents(rows, extra=("license", "template"))).collect()
    assert sorted((str(r.doc_id), r.license) for r in found) == [("1", "MIT"), ("1", "MIT"), ("None", "CC-BY-4.0")]
    assert lic.scan(documents([])).count() == 0


def test_scan_matches_the_plain_function_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, n[0], n[2]) for r in docs.select("doc_id", "text").collect() for n in lic.notices(r.text))
    assert sorted((r.doc_id, r.license, r.first_word) for r in lic.scan(docs).collect()) == want and want


def test_short_notices_in_long_blocks_are_found():
    """However much else a block holds, of however many words that do not compress, a short notice in it counts."""
    rng = random.Random(4)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    for t in [t for t in lic.templates() if len(t.words) <= 16]:
        for n in (30, 300):
            before, after = ([w if i % 80 else "copyright" for i, w in enumerate(rng.choices(noise, k=n))] for _ in range(2))
            assert names(" ".join([*before, t.text, *after])) == [t.license], (t, n)


def test_look_alikes_do_not_crowd_a_notice_out():
    """Words of all templates, out of order, make every template save bytes; the one that is worded there is still found."""
    scattered = [w for t in lic.templates() for w in reversed(t.text.split())][:500]
    for t in [t for t in lic.templates() if len(t.words) <= 16]:
        found = [r for r in lic.notices(" ".join([*scattered[:250], "x", t.text, "x", *scattered[250:]])) if r[2] == 251]
        assert [(r[0], r[7]) for r in found] == [(t.license, 1.0)], t


def test_every_copy_in_a_block_is_found():
    text = f"{lic.NOTICES[2][1]}\n" * 300
    assert [r[2] for r in lic.notices(text)] == list(range(0, 1500, 5))


@pytest.mark.parametrize("t", lic.templates()[-25:], ids=lambda t: t.text)
def test_letters_whose_lower_case_is_longer_hide_no_hint(t):
    assert names(f"İstanbul İzmir\n{t.text}\nx") == [t.license]


def every_template_compared(text):
    """The notices of a text without compression: of all templates confirmed on a stretch, the one with most words in order, fewest put in."""
    words, asked = lic.candidate_blocks(text)
    plain = [lic._plain(w) for w in words]
    out, free = [], [(begin, end, 0, len(plain)) for begin, end in asked]
    while free:
        begin, end, low, high = free.pop()
        best = None
        for i, t in enumerate(lic.templates()):
            told = lic.standing(t, plain, max(low, begin - len(t.words)), min(high, end + len(t.words)))
            if told and told[1] < end and told[2] > begin:
                best = max(filter(None, [best, (told[0] * len(t.words) - len(told[4]), -i, told)]), key=lambda b: b[:2])
        if best:
            score, i, told = best
            out.append((told[1], told[2], lic.templates()[-i].license, score))
            free += [(begin, told[1], low, told[1]), (told[2], end, told[2], high)]
    return sorted(out)


HINTED = "copyright license of the and software under permission use this terms version gpl free word any public".split()


def random_block(rng):
    words = []
    for _ in range(rng.randint(1, 4)):
        words += rng.choices(HINTED, k=rng.randint(0, 60))
        rate = rng.choice([0, 0, 0.03, 0.06])
        for word in rng.choice(lic.templates()).text.split():
            words += [word] if rng.random() >= rate else rng.choice([[], ["instead"], [word, "besides"]])
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words)


def test_compression_finds_what_comparing_every_template_finds():
    """Same notices at the same places on random blocks with look-alikes, each worded at least as well as the compared one."""
    rng, seen = random.Random(12), 0
    for _ in range(150):
        text = random_block(rng)
        got = [(r[2], r[2] + r[3], r[0], r[7] * len(lic.templates()[r[1]].words) - len(r[9].split())) for r in lic.notices(text)]
        want = every_template_compared(text)
        assert len(got) == len(want), text
        for (first, last, name, score), (first_2, last_2, name_2, score_2) in zip(got, want):
            assert name == name_2 and first < last_2 and first_2 < last and score >= score_2 - 1e-9, text
        seen += len(want)
    assert seen > 200


def test_the_ranking_by_saved_bytes_decides(monkeypatch):
    """With sizes drawn at random look-alikes win, so the result does come from the compressed sizes."""
    rng = random.Random(5)
    texts = [f"x\n{t.text}\ny" for t in lic.templates()]
    right = [names(t) for t in texts]
    assert right == [[t.license] for t in lic.templates()]
    monkeypatch.setattr(lic, "size_given", lambda words, template: rng.randint(1, 100_000))
    assert sum(names(t) != r for t, r in zip(texts, right)) >= 5


def test_a_notice_takes_its_words_from_look_alikes():
    text = " ".join(t.text for t in lic.templates() if t.license.startswith(("GPL", "AGPL", "LGPL", "CC-BY")))
    found = lic.notices(text)
    assert [r[0] for r in found] == [t.license for t in lic.templates() if t.license.startswith(("GPL", "AGPL", "LGPL", "CC-BY"))]
    assert all(a[2] + a[3] == b[2] for a, b in zip(found, found[1:])) and all(r[7] == 1 for r in found)


def test_work_grows_with_the_text_not_with_its_square():
    assert len(lic.notices(f"{lic.NOTICES[2][1]} {lic.NOTICES[0][1]} filler\n" * 2_000)) == 4_000
