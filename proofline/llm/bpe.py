"""BPE encoding and decoding with a given tokenizer; long texts by tree concatenation.

A text of up to LEAF_CHARS is encoded as it is. A longer one is cut into equal leaves, wherever the cuts fall, and the leaves
are encoded in parallel. Neighbours are then concatenated up a binary tree: a window around the join is encoded, and grown
until its tokens agree with those of the left side over a run of RUN tokens before the join, and with those of the right side
after it (or until it reaches a side's far end). Left tokens, window tokens and right tokens meet inside such runs, where
every pair of neighbouring tokens was made by the tokenizer itself; a sequence of tokens is the encoding of its text
exactly if each pair is, so the result equals encoding the whole text.

A null text counts as empty and has no tokens. Equal long texts are encoded once. Repeated rows give repeated results;
null doc_ids are ordinary; an empty table gives an empty result. Executors read the tokenizer from ``path``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.shingles import _BASE, _INVERSE, _LOWER, _power, scrambled

#: Longest text, in code points, that is encoded in one piece.
LEAF_CHARS = 32_768
#: First window on either side of a join, and the run of tokens that must agree.
WINDOW = 64
RUN = 4
#: Bytes that are ASCII letters, and marks a word may be cut before: what is no letter, digit, blank or apostrophe.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"]] = True
#: Bytes of text worked on at once.
CHUNK_BYTES = 1 << 20
#: Words remembered by a task (twice as many while they are replaced), the longest one that is, and words encoded at once.
KNOWN_WORDS = 250_000
KNOWN_BYTES = 64
WORDS_AT_ONCE = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of this process, without padding or truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


class Node:
    """A text with its tokens; ``spans`` are the tokens' character positions."""

    __slots__ = ("text", "ids", "spans")

    def __init__(self, text: str, ids: list[int], spans: list[tuple[int, int]]):
        self.text, self.ids, self.spans = text, ids, spans


def encode_node(tok, text: str) -> Node:
    found = tok.encode(text, add_special_tokens=False)
    return Node(text, found.ids, found.offsets)


def _agree(a: Node, b: Node, shift: int, first: int, last: int) -> tuple[int, int] | None:
    """Where RUN tokens of ``a`` from index ``first`` up to ``last`` equal tokens of ``b``, whose positions are ``shift`` behind."""
    where: dict[tuple[int, int, int], int] = {}
    for j, ((s, e), t) in enumerate(zip(b.spans, b.ids)):
        where.setdefault((s + shift, e + shift, t), j)
    for i in range(first, last - RUN + 1):
        j = where.get((*a.spans[i], a.ids[i]))
        if j is not None and j + RUN <= len(b.ids) and all(
            b.ids[j + k] == a.ids[i + k] and (b.spans[j + k][0] + shift, b.spans[j + k][1] + shift) == tuple(a.spans[i + k]) for k in range(RUN)
        ):
            return i, j
    return None


def concatenate(encode: Callable[[str], Node], left: Node, right: Node, window: int = WINDOW) -> Node:
    """The encoding of left.text + right.text from those of its halves."""
    cut, text = len(left.text), left.text + right.text
    while True:
        a, b = max(0, cut - window), min(len(text), cut + window)
        middle = encode(text[a:b])
        first = next((i for i in range(len(left.ids) - 1, -1, -1) if left.spans[i][0] < a), -1) + 1
        ends = next((i for i, (_, e) in enumerate(right.spans) if e + cut > b), len(right.ids))
        before = (0, 0) if a == 0 else _agree(left, middle, a, first, len(left.ids))
        after = (len(right.ids), len(middle.ids)) if b == len(text) else _agree(right, middle, a - cut, 0, ends)
        if before and after and before[1] <= after[1]:
            (i, j), (k, m) = before, after
            spans = left.spans[:i] + [(s + a, e + a) for s, e in middle.spans[j:m]] + [(s + cut, e + cut) for s, e in right.spans[k:]]
            return Node(text, left.ids[:i] + middle.ids[j:m] + right.ids[k:], spans)
        window *= 2


def join_tree(encode: Callable[[str], Node], nodes: list[Node]) -> Node:
    """Neighbours are joined level by level until one node is left."""
    while len(nodes) > 1:
        pairs = [concatenate(encode, *nodes[i:i + 2]) for i in range(0, len(nodes) - 1, 2)]
        nodes = pairs + nodes[2 * len(pairs):]
    return nodes[0]


@functools.lru_cache(maxsize=4)
def _tokens(path: str) -> list[str]:
    tok = tokenizer(path)
    return [tok.id_to_token(i) for i in range(tok.get_vocab_size())]


def decode_ids(path: str, ids: list[int]) -> str:
    """The text of token ids. A tokenizer without a decoder puts its tokens in a row with blanks, which needs no library."""
    tok = tokenizer(path)
    if tok.decoder is None:
        tokens = _tokens(path)
        return " ".join([tokens[i] for i in ids])
    return tok.decode(ids, skip_special_tokens=False)


#: Patterns (fixed values of public tokenizers) of which no match holds a blank; what they do not match is dropped.
BLANK_FREE_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def drops_blanks(declared: dict) -> bool:
    """Whether a tokenizer, by its own declaration, makes the tokens of each word (between blanks and line feeds) from that word alone."""
    parts = lambda x, inner: x[inner] if x and x["type"] == "Sequence" else [x] if x else []
    first = (parts(declared.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    splits = first["type"] == "WhitespaceSplit" or (
        first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in BLANK_FREE_PATTERNS
    )
    plain = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
        for n in parts(declared.get("normalizer"), "normalizers")
    )
    whole = not any(set(t["content"]) & set(" \n") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in declared.get("added_tokens") or [])
    return splits and plain and whole and declared.get("post_processor") is None


def cuts_finer(declared: dict) -> bool:
    """Whether a word may also be cut before a punctuation mark (but an apostrophe) after a letter, and A-Z be lowered in words of ASCII alone."""
    parts = lambda x, inner: x[inner] if x and x["type"] == "Sequence" else [x] if x else []
    first = (parts(declared.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    lowers = any(n["type"] == "Lowercase" for n in parts(declared.get("normalizer"), "normalizers"))
    # A mark inside an added token's name must not be cut off; such names begin and end with one.
    marked = all(t["content"][:1] == "<" and t["content"][-1:] == ">" and t["content"].lower() == t["content"] for t in declared.get("added_tokens") or [])
    return drops_blanks(declared) and first["type"] == "Split" and lowers and marked


@functools.lru_cache(maxsize=4)
def _declared(path: str) -> dict:
    return json.loads(tokenizer(path).to_str())


def _find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word (between blanks and line feeds) of concatenated UTF-8 texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (data != 32) & (data != 10)
    edge = inside[1:] != inside[:-1]
    opens, closes = edge & inside[1:], edge & inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    split = bounds[inside[bounds] & inside[bounds + 1]]
    opens[split] = closes[split] = True
    return np.flatnonzero(opens), np.flatnonzero(closes)


def _cut_finer(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut before marks after letters, and their bytes with A-Z lowered in words of ASCII alone. What holds a ``<`` or ``>`` stays as it is."""
    high = np.concatenate(([0], np.cumsum((data >= 128) | (data == 60) | (data == 62))))
    plain = high[end] == high[begin]
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[begin[plain]] = 1
    np.add.at(change, end[plain], -1)
    inner = np.cumsum(change[:-1]).astype(bool)
    low = np.where(inner, _LOWER[data], data)
    letter = _LETTER[data]
    cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]] & inner[:-1] & inner[1:]) + 1
    begin, end = np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))
    return low, begin, end


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each distinct word, and for each word which of these it equals. Words are found equal by hash and compared byte by byte."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=total[1:])
    size = end - begin
    hashes = scrambled((total[end] - total[begin]) * _power("down", _INVERSE, len(data))[begin] + size.astype(np.uint64))
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = size == size[first[which]]
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))
    shift = np.repeat(np.where(same, begin[first[which]] - begin, 0), size)
    differs = data[at] != data[at + shift]
    same[np.repeat(np.arange(len(begin)), size)[differs]] = False
    # Words whose hash clashes with another word's stand for themselves.
    alone = np.flatnonzero(~same)
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate((first, alone)), which


class Words:
    """Encodes texts word by word with a bounded memory of each word's ids, decoded text and spans, for tokenizers that drop blanks.

    Such a tokenizer makes no token and no merge across a blank, so a text's ids are those of its words in a row; and if it has no decoder,
    its tokens are decoded with blanks between, word by word too. Each distinct word of a part of the input is looked up once.
    """

    def __init__(self, path: str):
        self.tok, self.path, self.finer = tokenizer(path), path, cuts_finer(_declared(path))
        self.known: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    @staticmethod
    def fits(path: str) -> bool:
        return drops_blanks(_declared(path)) and tokenizer(path).decoder is None

    def _encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Ids, decoded text and spans (in characters of the word); WORDS_AT_ONCE words go to the tokenizer as one text, whose tokens lie in one word each."""
        tokens = _tokens(self.path)
        parts = [[w.decode("utf-8", "surrogatepass") for w in words[i:i + WORDS_AT_ONCE]] for i in range(0, len(words), WORDS_AT_ONCE)]
        for part, e in zip(parts, self.tok.encode_batch([" ".join(part) for part in parts], add_special_tokens=False)):
            starts = np.cumsum([0, *[len(w) + 1 for w in part]])
            where = np.array(e.offsets, dtype="<i4").reshape(-1, 2)
            at = np.searchsorted(where[:, 0], starts)
            spans = (where - np.repeat(starts[:-1], np.diff(at))[:, None]).astype("<i4").tobytes()
            ids, names, at = np.array(e.ids, dtype="<u4").tobytes(), [tokens[i] for i in e.ids], at.tolist()
            for a, b in zip(at, at[1:]):
                yield ids[4 * a:4 * b], " ".join(names[a:b]).encode(), spans[8 * a:8 * b]

    def _look_up(self, words: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """The entries of distinct words; what was used lately is remembered."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        entries = [known.get(w) or older.get(w) for w in words]
        new = [i for i, e in enumerate(entries) if e is None]
        for i, entry in zip(new, self._encode_words([words[i] for i in new])):
            entries[i] = entry
        known.update((w, e) for w, e in zip(words, entries) if len(w) <= KNOWN_BYTES)
        return entries

    def encode(self, data: np.ndarray, offsets: np.ndarray, spans: bool = False) -> list[tuple[bytes, bytes, bytes | None]]:
        """Of each text ``data[offsets[i]:offsets[i + 1]]`` the ids as 32-bit little-endian integers, the decoded text, and the tokens' spans if wanted."""
        begin, end = _find_words(data, offsets)
        low, begin, end = _cut_finer(data, begin, end) if self.finer else (data, begin, end)
        first, which = _distinct(low, begin, end)
        raw = low.tobytes()
        entries = self._look_up([raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())])
        ids, decoded, silent = [e[0] for e in entries], [e[1] for e in entries], any(not e[1] for e in entries)
        bounds, order, out = np.searchsorted(begin, offsets).tolist(), which.tolist(), []
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if spans else None
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            own, place = order[a:b], None
            # A word without tokens (blanks of another kind) leaves no gap.
            shown = [k for k in own if decoded[k]] if silent else own
            if spans:
                inner = [entries[k][2] for k in own]
                shift = np.repeat(chars[begin[a:b]] - chars[offsets[i]], [len(x) // 8 for x in inner])
                place = (np.frombuffer(b"".join(inner), dtype="<i4").reshape(-1, 2) + shift[:, None]).astype("<i4").tobytes()
            out.append((b"".join([ids[k] for k in own]), b" ".join([decoded[k] for k in shown]), place))
        return out


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """The words this process remembers, from task to task."""
    return Words(path)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data if data is not None else b"", dtype=np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES."""
    begin, count = 0, len(offsets) - 1
    while begin < count:
        end = min(max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES))), count)
        yield begin, end
        begin = end


def _encode_column(path: str, texts: pa.Array) -> Iterator[tuple[int, list[tuple[bytes, bytes | None]]]]:
    """Rows at a time, and of each the ids and, where words give it on the way, the decoded text."""
    data, offsets = _raw(texts)
    words = _words(path) if Words.fits(path) else None
    for begin, end in _slices(offsets):
        if words:
            yield end - begin, [e[:2] for e in words.encode(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])]
        else:
            # Equal texts are encoded once.
            part = texts.slice(begin, end - begin).to_pylist()
            once = list(dict.fromkeys(part))
            found = tokenizer(path).encode_batch_fast(once, add_special_tokens=False)
            by_text = {t: (np.array(e.ids, dtype="<u4").tobytes(), None) for t, e in zip(once, found)}
            yield end - begin, [by_text[t] for t in part]


def _digest(path: str, ids: bytes, decoded: bytes | None = None) -> tuple[int, str, str]:
    if decoded is None:
        decoded = decode_ids(path, np.frombuffer(ids, dtype="<u4").tolist()).encode("utf-8", "surrogatepass")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _results(docs: DataFrame, doc_id: str, text: str, path: str, leaf: int, finish: Callable, kind: str) -> DataFrame:
    """doc_id and the columns of ``kind`` that ``finish(path, ids, decoded)`` makes of each text's ids, given as bytes, and its decoded text where known."""
    names = [c.split()[0] for c in kind.split(", ")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in kind.split(", ")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = rows.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for size, encoded in _encode_column(path, batch.column(1)):
                columns = [pa.array(c, t) for c, t in zip(zip(*[finish(path, *one) for one in encoded]), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), *columns], names=["doc_id", *names])
                at += size

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path) if Words.fits(path) else None
        for batch in batches:
            data, offsets = _raw(batch.column(2))
            for begin, end in _slices(offsets):
                rows = batch.slice(begin, end - begin)
                if words:
                    encoded = words.encode(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin], spans=True)
                    found = [(ids, spans) for ids, _, spans in encoded]
                else:
                    nodes = [encode_node(tokenizer(path), piece) for piece in rows.column(2).to_pylist()]
                    found = [(np.array(n.ids, dtype="<u4").tobytes(), np.array(n.spans, dtype="<i4").tobytes()) for n in nodes]
                yield pa.RecordBatch.from_arrays([
                    *rows.columns, pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()),
                ], names=["sha", "part", "piece", "ids", "spans"])

    def tree(group: pa.Table) -> pa.Table:
        tok = tokenizer(path)
        group = group.sort_by("part")
        nodes = [
            Node(p, np.frombuffer(i, dtype="<u4").tolist(), list(zip(*np.frombuffer(s, dtype="<i4").reshape(-1, 2).T.tolist())))
            for p, i, s in zip(*(group.column(c).to_pylist() for c in ("piece", "ids", "spans")))
        ]
        whole = join_tree(lambda t: encode_node(tok, t), nodes)
        return pa.table([pa.array([group.column("sha")[0].as_py()]), *[pa.array([c], t) for c, t in zip(finish(path, np.array(whole.ids, dtype="<u4").tobytes()), types)]], names=["sha", *names])

    is_long = F.char_length("text") > leaf
    direct = rows.where(~is_long).mapInArrow(short, f"doc_id {own}, {kind}")
    long = rows.where(is_long).withColumn("sha", F.sha2("text", 256))
    texts = long.groupBy("sha").agg(F.first("text").alias("text"))
    # As many leaves as a binary tree has, of one length but for the last.
    wide = F.expr(f"int(ceil(char_length(text) / pow(2, ceil(log2(char_length(text) / {leaf})))))")
    parts = F.expr("transform(sequence(0, int((char_length(text) - 1) div wide)), i -> struct(i AS part, substring(text, i * wide + 1, wide) AS piece))")
    cut = texts.withColumn("wide", wide).select("sha", F.explode(parts).alias("p")).select("sha", "p.part", "p.piece")
    encoded = cut.repartition("sha", "part").mapInArrow(leaves, "sha string, part int, piece string, ids binary, spans binary")
    joined = encoded.groupBy("sha").applyInArrow(tree, f"sha string, {kind}")
    return direct.unionByName(long.select("doc_id", "sha").join(joined, "sha").drop("sha"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id and the token ids of each whole text."""
    return _results(docs, doc_id, text, path or default_path(), leaf, lambda _, ids, decoded=None: (np.frombuffer(ids, dtype="<u4").tolist(),), "ids array<int>")


def encoded_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, the number of tokens, and SHA-256 of the ids (32-bit little-endian) and of the decoded text (UTF-8)."""
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _results(docs, doc_id, text, path or default_path(), leaf, _digest, kind)


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of their token ids; null ids give null."""
    place = path or default_path()

    @F.pandas_udf("string")
    def decoded(column):
        return column.map(lambda x: None if x is None else decode_ids(place, [int(i) for i in x]))

    return rows.withColumn(into, decoded(F.col(ids)))
