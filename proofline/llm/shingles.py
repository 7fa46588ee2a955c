"""Word shingle hashes of whole texts, vectorised over the raw UTF-8 bytes of many texts at once.

Words are runs of anything but space and \\t \\n \\v \\f \\r, with A-Z lower-cased. A text's shingles are its runs of five
words; a text of one to four words has one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes hashed at once. Longer texts are hashed in pieces that end between words.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([pow(_BASE, 2 * i + 3, 1 << 64) for i in range(WORDS)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64, kept per process for at most PIECE and the longest word so far."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of concatenated texts."""
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    inner = starts_of_texts[(starts_of_texts > 0) & (starts_of_texts < len(data))]
    opens[inner] = ~blank[inner]
    closes = np.zeros(len(data) + 1, dtype=bool)
    closes[1:-1] = ~blank[:-1] & blank[1:]
    closes[-1] = len(data) > 0 and not blank[-1]
    closes[inner] |= ~blank[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=total[1:])
    value = (total[end] - total[begin]) * _power("down", _INVERSE, len(data))[begin]
    return scrambled(value + (end - begin).astype(np.uint64)), begin


def _cuts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that do not end inside a word; ``bounds`` are the texts' starts and the end."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        if end < n:
            following = int(bounds[np.searchsorted(bounds, end)])
            while end < following and not _BLANK[data[end]]:
                ahead = np.flatnonzero(_BLANK[data[end:min(following, end + PIECE)]])
                end = end + int(ahead[0]) if len(ahead) else min(following, end + PIECE)
        yield at, min(end, n)
        at = end


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text ``data[offsets[i]:offsets[i + 1]]`` the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in _cuts(data, offsets):
        inside = offsets[(offsets > begin) & (offsets < end)] - begin
        value, place = _word_hashes(data[begin:end], inside)
        hashes.append(value)
        places.append(place + begin)
    words, where = np.concatenate(hashes), np.concatenate(places)
    first = np.searchsorted(where, offsets)
    padded = np.concatenate([words, np.zeros(WORDS - 1, np.uint64)])
    whole = np.zeros(len(words), dtype=np.uint64)
    for i in range(WORDS):
        whole += padded[i:i + len(words)] * _PLACES[i]
    whole = scrambled(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(whole[a:b - WORDS + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(scrambled(np.array([short], dtype=np.uint64)))
        else:
            out.append(words[:0])
    return out


def text_shingles(texts: list[str]) -> list[np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return shingles(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)


def exact_shingles(text: str | None) -> frozenset[bytes]:
    """The shingles themselves, for exact comparisons."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return frozenset([b" ".join(words)] if words else [])
    return frozenset(b" ".join(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1))
