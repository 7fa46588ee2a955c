from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from proofline.llm import bpe

TOK = bpe.tokenizer(bpe.default_path())
ALPHABETS = ["ab", "a", "aeiou", "thein", "ab \n", "a'st!", "1a.", "éèáe", "\U0001f600\U0001f44d‍a", "ΣσςİI", "<|endoftext|>", "the ", "!'s"]


def long_texts():
    rng = random.Random(6)
    return ["".join(rng.choices(a, k=rng.randint(150, 900))) for a in ALPHABETS for _ in range(6)] + ["x" * 1000, "na" * 500, "<|startoftext|>" * 60, "Á" * 300]


def test_joined_halves_equal_the_whole():
    encode = lambda t: bpe.encode_node(TOK, t)
    rng = random.Random(7)
    for text in long_texts():
        whole = encode(text)
        cut = rng.randint(1, len(text) - 1)
        joined = bpe.concatenate(encode, encode(text[:cut]), encode(text[cut:]), window=8)
        assert joined.ids == whole.ids and [tuple(s) for s in joined.spans] == whole.spans
        nodes = [encode(text[i:i + 37]) for i in range(0, len(text), 37)]
        assert bpe.join_tree(encode, nodes).ids == whole.ids


def expected(text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    decoded = TOK.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_digests_of_short_long_and_odd_texts(documents):
    texts = long_texts() + [None, "", " ", "Hello  World", "it's", "x" * 64, "x" * 65]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    found = bpe.encoded_digests(documents(rows, extra=("sha", "ids", "part")), leaf=64).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((key(tuple(r)) for r in found)) == sorted(key((d, *expected(t))) for d, t in rows)


def test_ids_and_decoded_text(documents):
    rows = [(1, "Hello brave world " * 20), (2, None), (3, "ok")]
    encoded = bpe.encode(documents(rows), leaf=100)
    for r in bpe.decode(encoded, "ids").collect():
        ids = TOK.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == TOK.decode(ids, skip_special_tokens=False)


def test_empty_table(documents):
    assert bpe.encoded_digests(documents([])).count() == 0


@pytest.mark.parametrize("n", [65, 128, 129, 1000])
def test_leaves_are_a_binary_tree(documents, n):
    found = bpe.encoded_digests(documents([(1, "ab" * n)]), leaf=64).first()
    assert tuple(found)[1:] == expected("ab" * n)


def test_words_equal_whole_texts(monkeypatch):
    path = bpe.default_path()
    assert bpe.Words.fits(path)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    words = bpe.Words(path)
    texts = long_texts() + ["", " ", "a \u0301b", "a\n\u0301", "x\u00a0y \u2003z", "<|endoftext|> a<|startoftext|>", "it's 'll"]
    rng = random.Random(11)
    texts += ["".join(rng.choices("aB'sT!,.1-<|>é\u0301 \n$e", k=rng.randint(1, 60))) for _ in range(400)]
    texts += ["a,b x<|endoftext|>y, Z!<|EndOfText|> a.<|startoftext|>", "It's, It'S !'s, a'!b", "J\u030c J,\u030c"]
    data, offsets = bpe._raw(pa.array(texts))
    for _ in range(2):
        for text, (ids, decoded, spans) in zip(texts, words.encode(data, offsets, spans=True)):
            want = TOK.encode(text, add_special_tokens=False)
            assert np.frombuffer(ids, "<u4").tolist() == want.ids and decoded.decode() == TOK.decode(want.ids, skip_special_tokens=False)
            assert [tuple(x) for x in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist()] == want.offsets


def test_words_with_clashing_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "scrambled", lambda x: x % np.uint64(3))
    data, offsets = bpe._raw(pa.array(["the cat the dog cat", "", "a cat", "éa the"]))
    begin, end = bpe._find_words(data, offsets)
    first, which = bpe._distinct(data, begin, end)
    raw = data.tobytes()
    assert [raw[begin[first[k]]:end[first[k]]] for k in which] == [raw[a:b] for a, b in zip(begin, end)] == "the cat the dog cat a cat éa the".encode().split()


def test_word_by_word_only_where_the_declaration_allows_it():
    declared = json.loads(TOK.to_str())
    assert bpe.drops_blanks(declared)
    token = declared["added_tokens"][0]
    for change in (
        {"added_tokens": [token | {"content": "two words"}]}, {"added_tokens": [token | {"lstrip": True}]}, {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
        {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"post_processor": {"type": "ByteLevel"}},
    ):
        assert not bpe.drops_blanks(declared | change)
    plain = declared | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "normalizer": None}
    assert bpe.drops_blanks(plain) and bpe.cuts_finer(declared) and not bpe.cuts_finer(plain)
    assert not bpe.cuts_finer(declared | {"added_tokens": [token | {"content": "a,b"}]})
