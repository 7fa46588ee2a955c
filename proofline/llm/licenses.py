"""License notices in documents by conditional compression.

Words that hint at a license open a candidate block: their line, or a bounded stretch of a very long line, with
neighbouring hints in one block. Each template lays windows over the blocks, twice as wide as the longest notice of its wording
can be and overlapping by half, so that every such notice lies whole in one of them. A window in which too many of the template's words are
missing altogether is left out. The others are compressed alone and with the template as raw zstandard dictionary (both as
bare lower-case words), and the number of bytes the template saves is the window's rank. The largest saving is confirmed first: a template
stands there if nearly all of its words do, in order. Where one does, all templates are ranked once more by what they save on the very same
words, as windows of different templates are not, and the first of them to be confirmed is the notice; the exact differences (words missing from
it, words put in) are reported. It takes its words; windows that lose words to it are measured again without them. So a block may
hold several notices, look-alikes of a confirmed notice have nothing left to stand on, and however little a notice saves, it
has its turn: no saving is required and no rank is too low.

Every line of every whole text is read. A null or empty text has no notices, an empty table no rows. Repeated rows give repeated results;
rows without doc_id are ordinary. Other columns do not matter and may have any name. A very long text is read in one piece; the work
grows with the words around its hints. Equal savings go to the longer template, then to the earlier one, then to the earlier window.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import lowered

# Public notices and license texts.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
     "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
     "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
     "and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
     "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
MARKS = ("licen", "copyright", "warrant", "redistribut", "spdx", "permission", "public domain", "creative commons", "cc by", "cc0", "free software")
#: Words without a hint that may lie between two hints of a block, words kept around a hint on its line, and the longest block.
GAP, AROUND, LONGEST = 40, 30, 600
#: Share of a template's words that a block must have in order, and the most words put in between, per word of the template.
COVERED, PUT_IN = 0.85, 0.3
LEVEL = 19
RESULT = (
    "doc_id long, license string, template int, first_word long, n_words int, size_alone int, size_given int, "
    "saved_share double, covered double, missing string, put_in string"
)

_WORD = re.compile(r"[^\s]+")


def _plain(word: str) -> str:
    return word.lower().strip(".,;:()\"'“”‘’*#/<>[]!?")


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    words: tuple[str, ...]
    counts: Counter[str]


@functools.lru_cache(maxsize=1)
def templates() -> tuple[Template, ...]:
    named = [*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in NOTICES))]
    words = [tuple(_plain(w) for w in text.split()) for _, text in named]
    return tuple(Template(name, text, w, Counter(w)) for (name, text), w in zip(named, words))


@functools.lru_cache(maxsize=1)
def _compressors():
    import zstandard as z

    alone = z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    given = []
    for t in templates():
        raw = z.ZstdCompressionDict(_bare(t.words), dict_type=z.DICT_TYPE_RAWCONTENT)
        given.append(z.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
    return alone, given


def _bare(words: Sequence[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


def size_alone(words: Sequence[str]) -> int:
    """Compressed size of a window's bare words."""
    return len(_compressors()[0].compress(_bare(words)))


def size_given(words: Sequence[str], template: int) -> int:
    """Compressed size of a window's bare words by one who knows the template."""
    return len(_compressors()[1][template].compress(_bare(words)))


def candidate_blocks(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and the stretches of them around hints."""
    low = lowered(text)
    if not any(m in low for m in MARKS):
        return [], []
    found = list(_WORD.finditer(text))
    starts = [m.start() for m in found]
    hits = sorted({h for m in MARKS for h in _positions(low, m)})
    marked = sorted({max(0, bisect.bisect_right(starts, h) - 1) for h in hits})
    line = [0] * len(found)
    for i in range(1, len(found)):
        line[i] = line[i - 1] + ("\n" in text[found[i - 1].end():found[i].start()])
    spans: list[list[int]] = []
    for i in marked:
        begin = next((j + 1 for j in range(i - 1, max(-1, i - AROUND - 1), -1) if line[j] != line[i]), max(0, i - AROUND))
        end = next((j for j in range(i + 1, min(len(found), i + AROUND + 1)) if line[j] != line[i]), min(len(found), i + AROUND + 1))
        if spans and begin - spans[-1][1] <= GAP:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    return [f[0] for f in found], [(at, min(end, at + LONGEST)) for begin, end in spans for at in range(begin, end, LONGEST)]


def _positions(text: str, mark: str) -> Iterator[int]:
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def may_stand(template: Template, counts: Counter[str]) -> bool:
    """Whether words with these counts, in any order, could cover enough of the template: false only if ``wording`` could not."""
    return sum(min(n, counts[w]) for w, n in template.counts.items()) / len(template.words) >= COVERED


def wording(template: Template, words: list[str]) -> tuple[float, int, int, list[str], list[str]] | None:
    """Share of the template's words found in order, the span they take, and the words missing and put in."""
    same = [b for b in difflib.SequenceMatcher(None, template.words, words, autojunk=False).get_matching_blocks() if b.size]
    if not same:
        return None
    # Matches far from the rest of the notice are chance.
    main = max(range(len(same)), key=lambda i: same[i].size)
    low = high = main
    while low and same[low].b - same[low - 1].b - same[low - 1].size <= 8:
        low -= 1
    while high + 1 < len(same) and same[high + 1].b - same[high].b - same[high].size <= 8:
        high += 1
    same = same[low:high + 1]
    begin, end = same[0].b, same[-1].b + same[-1].size
    have = {i for b in same for i in range(b.a, b.a + b.size)}
    used = {i for b in same for i in range(b.b, b.b + b.size)}
    missing = [w for i, w in enumerate(template.words) if i not in have]
    return len(have) / len(template.words), begin, end, missing, [words[i] for i in range(begin, end) if i not in used]


def standing(t: Template, words: list[str], start: int, stop: int) -> tuple[float, int, int, list[str], list[str]] | None:
    """``wording`` of a confirmed notice within start to stop; None if there is none.

    What is not confirmed does not hide a notice before or after it.
    """
    stretches = [(start, stop)]
    while stretches:
        start, stop = stretches.pop()
        if not may_stand(t, Counter(words[start:stop])):
            continue
        told = wording(t, words[start:stop])
        if told is None:
            continue
        covered, first, last, missing, put_in = told[0], start + told[1], start + told[2], *told[3:]
        if covered >= COVERED and len(put_in) <= PUT_IN * len(t.words):
            return covered, first, last, missing, put_in
        stretches += [(last, stop), (start, first)]
    return None


def reach(t: Template) -> int:
    """The most words a confirmed notice of a template can take."""
    return math.floor(len(t.words) * (1 + PUT_IN))


def windows(words: list[str], asked: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(template, start, stop) of the windows over the blocks in which the template may stand.

    Windows lie on a grid of the template's reach and are two steps wide: each notice of it lies whole in one.
    """
    longest = max(reach(t) for t in templates())
    seen: set[tuple[int, int]] = set()
    for begin, end in asked:
        near = Counter(words[max(0, begin - longest):end + longest])
        for i, t in enumerate(templates()):
            if not may_stand(t, near):
                continue
            step = reach(t)
            for k in range(max(0, (begin - step) // step), (end + step) // step + 1):
                start, stop = k * step, min(len(words), (k + 2) * step)
                if start < stop and (i, k) not in seen and may_stand(t, Counter(words[start:stop])):
                    seen.add((i, k))
                    yield i, start, stop


class Taken:
    """Words of confirmed notices, as stretches in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []

    def add(self, start: int, stop: int) -> None:
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.stops.insert(at, stop)

    def left_of(self, start: int, stop: int) -> list[tuple[int, int]]:
        """What is left of a window."""
        out = []
        for at in range(bisect.bisect_right(self.stops, start), len(self.starts)):
            if self.starts[at] >= stop:
                break
            out.append((start, self.starts[at]))
            start = self.stops[at]
        return [(a, b) for a, b in [*out, (start, stop)] if a < b]


def settled(words: list[str], template: int, told: tuple, taken: Taken) -> tuple[int, int, int, tuple]:
    """(template, size alone, size given it, wording) of the notice on words where a template was confirmed.

    The words it may reach to are compressed with every template that may stand there, and the template with those words, so that words
    of either that the other lacks count; the first confirmed, by both sizes together, has it.
    """
    import zstandard as z

    first, last = told[1:3]
    room = reach(templates()[template])
    start, stop = next(s for s in taken.left_of(max(0, last - room), min(len(words), first + room)) if s[0] <= first < s[1])
    near, size = Counter(words[start:stop]), size_alone(words[start:stop])
    able = {i: size_given(words[start:stop], i) for i, t in enumerate(templates()) if may_stand(t, near)}
    seen = z.ZstdCompressionDict(_bare(words[start:stop]), dict_type=z.DICT_TYPE_RAWCONTENT)
    back = z.ZstdCompressor(level=LEVEL, dict_data=seen, write_content_size=False, write_checksum=False, write_dict_id=False)
    both = {i: given + len(back.compress(_bare(templates()[i].words))) for i, given in able.items()}
    for i in sorted(both, key=lambda i: (both[i], -len(templates()[i].words), i)):
        found = standing(templates()[i], words, start, stop)
        if found and found[1] < last and found[2] > first:
            return i, size, able[i], found
    return template, size, able[template], told


def notices(text: str | None) -> list[tuple]:
    """The rows of RESULT, without doc_id, of a text."""
    words, asked = candidate_blocks(text or "")
    if not asked:
        return []
    plain = [_plain(w) for w in words]
    heap: list[tuple] = []
    alone: dict[tuple[int, int], int] = {}

    def measure(i: int, start: int, stop: int) -> None:
        if (start, stop) not in alone:
            alone[start, stop] = size_alone(plain[start:stop])
        heapq.heappush(heap, (size_given(plain[start:stop], i) - alone[start, stop], -len(templates()[i].words), i, start, stop))

    for window in windows(plain, asked):
        measure(*window)
    begins, taken, out = [begin for begin, _ in asked], Taken(), []
    while heap:
        _, _, i, start, stop = heapq.heappop(heap)
        left = taken.left_of(start, stop)
        if left == [(start, stop)]:
            told = standing(templates()[i], plain, start, stop)
            if told is None:
                continue
            i_best, size, given, (covered, first, last, missing, put_in) = settled(plain, i, told, taken)
            taken.add(first, last)
            block = bisect.bisect_left(begins, last) - 1
            if block >= 0 and asked[block][1] > first:
                out.append((
                    templates()[i_best].license, i_best, first, last - first, size, given, 1 - given / size, covered, " ".join(missing), " ".join(put_in),
                ))
            left = taken.left_of(start, stop)
        for a, b in left:
            if may_stand(templates()[i], Counter(plain[a:b])):
                measure(i, a, b)
    return sorted(out, key=lambda r: (r[2], r[1]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice: see RESULT. Texts without any hint never leave the JVM."""
    low = F.lower(F.col(text))
    hinted = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in MARKS])
    rows = docs.where(hinted).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RESULT.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n in notices(t)]
            columns = list(zip(*found)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(read, RESULT)
