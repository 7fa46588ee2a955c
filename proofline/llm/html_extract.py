"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a row of blocks: text between the edges of block-level elements. A linear classifier over structure and text gives
each block log-odds of being content; its two costs (calling a block content, calling it boilerplate) are the capacities to the two
terminals. Neighbouring blocks, more so those in the same container, and the next block of a container after an
interruption are tied by smoothness edges. The minimum cut, found by maximum flow, is the cheapest labelling; blocks on the
source's side are content.

Elements and roles that name boilerplate count for all that is in them. What a class or id says against an element counts so too,
but only as weak evidence if the element turns out to wrap the page: see ``believed``. Names that tell a state of the page
(has-sidebar, comments-open) say nothing.

Whole pages are read; nothing is cut or capped. A null or empty page, and one without content, has an empty text.
Broken markup is read as a browser would, roughly: open elements end with their parents, unmatched ends are ignored,
unclosed comments and scripts swallow the rest. A tag that never ends outside its quotes ends at the next ``>``, and so do all
after it; without any ``>`` it is text. Line breaks are white space. Pages are read in one pass forward, with time that grows
with their length, nested and broken ones included. Each row is answered by itself, repeated rows alike; an empty table gives no
rows. A column ``text`` that the pages already have is replaced by the result; other columns stay, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import lowered

# Names of HTML elements, and words that site templates use in class and id.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img input wbr button label".split()) - {"wbr"}
SKIPPED = frozenset("script style textarea title template iframe object svg canvas noembed noframes audio video datalist".split())
#: Elements whose content is text as it stands.
VERBATIM = frozenset(("xmp",))
CLOSES_ITSELF = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select menu".split())
ROW_GROUPS = frozenset("tbody thead tfoot".split())
TAG_SCORES = {
    "nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -6.0, "menu": -7.0, "dialog": -6.0, "button": -6.0, "select": -6.0, "search": -6.0,
    "header": -5.0, "fieldset": -6.0, "label": -4.0, "noscript": -7.0, "article": 3.0, "main": 2.5,
}
HIDDEN = -7.0
ROLE_SCORES = {
    "navigation": -7.0, "banner": -5.0, "contentinfo": -7.0, "complementary": -7.0, "search": -6.0, "form": -6.0, "alert": -6.0,
    "dialog": -6.0, "menu": -7.0, "menubar": -7.0, "main": 2.5, "article": 3.0,
}
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr "
    "comment comments commentlist reply replies respond disqus discussion newsletter subscribe subscription signup signin login register "
    "share sharing social popup modal overlay paywall toast breadcrumb breadcrumbs pagination pager related recommended recommendations".split()
)
LAYOUT = frozenset(
    "nav navbar navigation topnav subnav menu menubar sidebar side aside rail widget widgets trending popular footer foot bottom copyright legal colophon "
    "header masthead topbar top logo branding notice notices notification notifications alert alerts disclaimer banner form search toolbar tabs toc crumbs tags "
    "skip hidden meta byline".split()
)
CONTENT = frozenset("article content contents post entry story main body text prose maincontent articlebody".split())
#: First and last words of a class or id that tells a state.
STATE_FIRST, STATE_LAST = frozenset("has with no without not".split()), frozenset("open opened closed enabled disabled free active inactive supported".split())
#: Words that leave a name of NEVER words what it is.
PLAIN = frozenset("list section area box block container wrapper wrap item form".split())
BLOCK_SCORES = {"p": 1.0, "pre": 1.0, "blockquote": 0.6, "h1": 1.0, "h2": 0.5, "h3": 0.5, "h4": 0.5, "li": -0.3, "figcaption": 0.3}
#: Weights of the classifier's other features, and of the smoothness edges.
BIAS, LINKS, LONG, MEDIUM, SHORT, SENTENCE, RIGHTS, WRAPPED = -0.5, -5.0, 1.5, 0.7, -1.0, 0.4, -2.5, -0.5
NEAR, SAME_CONTAINER, RESUMED = 0.3, 0.9, 0.6
SCALE = 1000

_DECLARED = r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_TAG = r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>%s)(?P<end>>|\Z)"
_QUOTED = re.compile(_DECLARED + _TAG % r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+""", re.S)
_UNQUOTED = re.compile(_DECLARED + _TAG % r"[^>]*+", re.S)
_UNTAGGED = re.compile(_DECLARED, re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: References by numbers of more digits than any code point has, with leading zeros apart.
_NUMBER = re.compile(r"&#0*+([0-9]++);?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE_END = (".", "!", "?", "…", "。", "！", "？", ".\"", ".”", "”", ":")


@dataclass(frozen=True, eq=False)
class Mark:
    """A container that class or id speak against (score below 0), or a content element, and the next such one around it."""

    number: int
    score: float
    #: Whether it or one around it is named as what is never content.
    named: bool
    outer: Mark | None


@dataclass
class Block:
    tag: str
    container: int
    inside: Mark | None
    #: Least and greatest score of the open elements by tag, role and content names, and the innermost marks against them.
    low: float = 0.0
    high: float = 0.0
    hints: list[Mark] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def structure(self, lows: dict[int, float]) -> float:
        """Structural log-odds, given the least score that counts for each mark; 0 if it and all around it are weak evidence."""
        low = min([self.low, *[lows[m.number] for m in self.hints]])
        return low if low < 0 else self.high + (WRAPPED if self.hints else 0.0)

    def text(self) -> str:
        """Decoded text, with runs of white space as one space."""
        raw = _NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", "".join(self.parts))
        return " ".join(html.unescape(raw).split())


@dataclass
class _Open:
    tag: str
    number: int
    low: float
    high: float
    link: bool
    hint: Mark | None
    inside: Mark | None
    #: Tag of the innermost block-level element (it may be this one), and the number of the element around that.
    home: str
    container: int


def _hint(tag: str, attributes: str) -> tuple[float, float, bool]:
    """Structural log-odds of an element by itself: by tag, role, content names and being hidden, then by names against it, and
    whether these name nothing but what is never content."""
    score, against, named, hidden = TAG_SCORES.get(tag, 0.0), 0.0, False, False
    if not attributes or tag in ("html", "body"):
        return score, against, named
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            tokens = [[w.lower() for w in _WORDS.findall(token)] for token in value.split()]
            tokens = [t for t in tokens if t and not (len(t) > 1 and (t[0] in STATE_FIRST or t[-1] in STATE_LAST))]
            words = {w for t in tokens for w in t}
            if words & NEVER:
                against = min(against, -7.0)
                named = named or any(NEVER.intersection(t) and NEVER.union(PLAIN).issuperset(t) for t in tokens)
            elif words & LAYOUT:
                against = min(against, -6.0) if not words & CONTENT else against
            elif words & CONTENT and score >= 0:
                score = max(score, 2.0)
        elif name == "role":
            found = ROLE_SCORES.get(value.strip().lower(), 0.0)
            score = min(score, found) if found < 0 or score < 0 else max(score, found)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return min(score, HIDDEN) if hidden else score, against, named


def _next_tag(page: str) -> Callable[[int], re.Match | None]:
    """A function from a place to the next markup. Once a tag's quotes never end, none is believed any more, so that no part of
    the page is searched to its end for many tags."""
    last, pattern = page.rfind(">"), _QUOTED

    def find(at: int) -> re.Match | None:
        nonlocal pattern
        if at > last:
            pattern = _UNTAGGED
        match = pattern.search(page, at)
        if match and pattern is not _UNTAGGED and match["tag"] and not match["end"]:
            pattern = _UNTAGGED if match.start() > last else _UNQUOTED
            match = pattern.search(page, match.start())
        return match

    return find


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold text, in order."""
    found: list[Block] = []
    stack = [_Open("", 0, 0.0, 0.0, False, None, None, "", 0)]
    places: dict[str, list[int]] = {}
    current: Block | None = None
    number = at = 0
    lower = None
    find = _next_tag(page)

    def innermost(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these, 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def pop_to(index: int) -> None:
        nonlocal current
        while len(stack) > index:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                current = None

    def put(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if current is None:
            if not text.strip():
                return
            current = Block(top.home, top.container, top.inside)
            found.append(current)
        current.low, current.high = min(current.low, top.low), max(current.high, top.high)
        if top.hint and top.hint not in current.hints[-1:]:
            current.hints.append(top.hint)
        current.parts.append(text)
        if top.link:
            current.linked += len(text.strip())

    while True:
        match = find(at)
        text = page[at:match.start()] if match else page[at:]
        if text:
            put(text)
        if not match:
            return [b for b in found if b.text()]
        at = match.end()
        tag = match["tag"] if match.re is not _UNTAGGED else None
        if tag is None:
            if match[0].startswith("<![CDATA["):
                put(html.escape(match[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, attributes = tag.lower(), match["attributes"]
        if match["close"]:
            index = innermost((tag,))
            if index:
                pop_to(index)
            elif tag == "p":
                current = None
            if tag in SPACED and current:
                current.parts.append(" ")
            continue
        if tag in SKIPPED or tag in VERBATIM:
            if attributes.rstrip().endswith("/") and tag == "svg":
                continue
            lower = lower if lower is not None else lowered(page)
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            if tag in VERBATIM:
                current = None
                put(html.escape(page[at:end if end >= 0 else len(page)], quote=False))
                current = None
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in BLOCK:
            if places.get("p") and tag not in ("option", "optgroup"):
                pop_to(places["p"][-1])
            current = None
        if tag in CLOSES_ITSELF:
            before = innermost(CLOSES_ITSELF[tag])
            if before > innermost(SCOPES - ROW_GROUPS if tag in ("tr", "td", "th") else SCOPES):
                pop_to(before)
        if tag in SPACED and current:
            current.parts.append(" ")
        if tag in VOID:
            continue
        number += 1
        top = stack[-1]
        score, against, named = _hint(tag, attributes)
        if tag == "header" and top.high > 0 and score == TAG_SCORES["header"]:
            score = 0.0
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(
            tag, number, min(top.low, score), max(top.high, score), top.link or tag == "a",
            Mark(number, against, named or top.hint is not None and top.hint.named, top.hint) if against < 0 else top.hint,
            Mark(number, score, False, top.inside) if score > 0 and not against and tag in BLOCK else top.inside,
            *((tag, top.number) if tag in BLOCK else (top.home, top.container)),
        ))


def log_odds(block: Block, text: str, lows: dict[int, float]) -> float:
    """The classifier: log-odds that a block is content; ``lows`` as ``believed`` gives them."""
    words, letters = text.count(" ") + 1, len(text)
    score = BIAS + block.structure(lows) + BLOCK_SCORES.get(block.tag, 0.0) + LINKS * min(1.0, block.linked / letters)
    score += LONG if words >= 25 else MEDIUM if words >= 10 else SHORT if words <= 3 and block.tag[0:1] != "h" else 0.0
    if text.endswith(_SENTENCE_END):
        score += SENTENCE
    if "©" in text:
        score += RIGHTS
    return score


def _chain(marks: list[Mark]) -> list[Mark]:
    """These marks and all around them, outer ones first."""
    every: dict[int, Mark] = {}
    for mark in marks:
        while mark and mark.number not in every:
            every[mark.number] = mark
            mark = mark.outer
    return [every[n] for n in sorted(every)]


def _held(marks: list[Mark], sizes: list[tuple[list[Mark], int]]) -> dict[int, int]:
    """How much each mark holds, given the innermost marks of each block and its size."""
    held = dict.fromkeys((m.number for m in marks), 0)
    for inner, size in sizes:
        for mark in inner[:1] if size else ():
            held[mark.number] += size
    for mark in reversed(marks):
        if mark.outer:
            held[mark.outer.number] += held[mark.number]
    return held


def believed(found: list[Block], texts: list[str]) -> dict[int, float]:
    """The least score that counts for each mark against an element: its own and those around it, less those of wrappers.

    Wrappers hold most of the text that would be content by everything but class and id, and either no content is left outside
    them, or one main, article or content element in them, with no name against it, holds most of that text by itself. Names of
    what is never content, such as comments, are believed whatever they hold.
    """
    marks = _chain([m for b in found for m in b.hints])

    def lows(weak: set[int]) -> dict[int, float]:
        out: dict[int, float] = {}
        for m in marks:
            out[m.number] = 0.0 if m.number in weak else min(m.score, out[m.outer.number] if m.outer else 0.0)
        return out

    if all(m.named for m in marks):
        return lows(set())
    free = lows({m.number for m in marks})
    sizes = [len(t) if log_odds(b, t, free) > 0 else 0 for b, t in zip(found, texts)]
    held = _held(marks, [(b.hints, s) for b, s in zip(found, sizes)])
    # Marks that hold more than half lie in each other: all are on the path from the outermost to the innermost of them.
    whole = sum(sizes)
    most = [m for m in marks if not m.named and 2 * held[m.number] > whole]
    path = _chain(most[-1:])
    depth = {m.number: i for i, m in enumerate(path, 1)}
    # A name that counts leaves nothing of a block. If the path's names count for nothing down to a depth, the blocks with all
    # their marks on that part are kept; so each block comes in at one depth, and stays.
    coming: list[list[int]] = [[] for _ in range(len(path) + 1)]
    for i, (block, size) in enumerate(zip(found, sizes)):
        if size and all(m.number in depth for m in block.hints):
            coming[max((depth[m.number] for m in block.hints), default=0)].append(i)
    kept, inside, weak = 0, _Sums([b.inside for b in found if b.inside]), 0
    following = dict(zip((m.number for m in most), [*most[1:], None]))
    own = [0] * (len(path) + 1)
    for at in range(len(path) + 1):
        for i in coming[at]:
            kept += sizes[i]
            if found[i].hints:
                own[depth[found[i].hints[0].number]] += sizes[i]
            if found[i].inside:
                inside.add(found[i].inside, sizes[i])
        mark = path[at - 1] if at else None
        if mark is None or mark.number not in following:
            continue
        # Where an inner one holds all that this one does, nothing is kept while its name counts.
        below = following[mark.number]
        if below and held[below.number] == held[mark.number]:
            continue
        if own[at] and (own[at] == kept or 2 * inside.most(mark.number) > kept):
            weak = at
    return lows({m.number for m in path[:weak]})


class _Sums:
    """Sums over content marks and all in them, while sizes are added: marks by number stand in the order of the page, each
    before those in it, so a sum is a range of a tree of partial sums."""

    def __init__(self, marks: list[Mark]):
        self.marks = _chain(marks)
        self.place = {m.number: i for i, m in enumerate(self.marks)}
        self.end = list(range(1, len(self.marks) + 1))
        self.up = [[self.place[m.outer.number] if m.outer else i for i, m in enumerate(self.marks)]]
        for i in reversed(range(len(self.marks))):
            self.end[self.up[0][i]] = max(self.end[self.up[0][i]], self.end[i])
        while len(self.marks) >> len(self.up):
            self.up.append([self.up[-1][i] for i in self.up[-1]])
        self.part = [0] * (len(self.marks) + 1)

    def add(self, mark: Mark, size: int) -> None:
        i = self.place[mark.number] + 1
        while i < len(self.part):
            self.part[i] += size
            i += i & -i

    def before(self, i: int) -> int:
        total = 0
        while i:
            total += self.part[i]
            i -= i & -i
        return total

    def most(self, number: int) -> int:
        """The sum of the one mark of a higher number that can hold more than half of all, 0 if there is none."""
        total, at = self.before(len(self.marks)), 0
        if not total:
            return 0
        # Whatever holds more than half holds the place where the sum passes one half.
        left = total // 2
        for step in reversed(range(len(self.marks).bit_length())):
            if at + (1 << step) < len(self.part) and self.part[at + (1 << step)] <= left:
                at += 1 << step
                left -= self.part[at]
        if self.marks[at].number <= number:
            return 0
        for up in reversed(self.up):
            if self.marks[up[at]].number > number:
                at = up[at]
        return self.before(self.end[at]) - self.before(at)


class Flow:
    """Maximum flow by blocking flows over level graphs; arcs in pairs, an arc's partner is its reverse."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def tie(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.head))
        self.out[b].append(len(self.head) + 1)
        self.head += (b, a)
        self.room += (there, back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for arc in self.out[a]:
                b = self.head[arc]
                if self.room[arc] > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate the network; which nodes are on the source's side of the minimum cut closest to the source."""
        head, room, out = self.head, self.room, self.out
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            begin, path, a = [0] * len(out), [], source
            while True:
                if a == sink:
                    least = min(room[arc] for arc in path)
                    keep = len(path)
                    for i in range(len(path) - 1, -1, -1):
                        room[path[i]] -= least
                        room[path[i] ^ 1] += least
                        if not room[path[i]]:
                            keep = i
                    a = head[path[keep] ^ 1]
                    del path[keep:]
                while begin[a] < len(out[a]):
                    arc = out[a][begin[a]]
                    if room[arc] > 0 and level[head[arc]] == level[a] + 1:
                        break
                    begin[a] += 1
                else:
                    if a == source:
                        break
                    level[a] = -1
                    a = head[path.pop() ^ 1]
                    continue
                path.append(arc)
                a = head[arc]


def label(found: list[Block], texts: list[str]) -> list[bool]:
    """Which blocks are content."""
    n = len(found)
    flow, last, lows = Flow(n + 2), {}, believed(found, texts)
    for i, (block, text) in enumerate(zip(found, texts)):
        odds = max(-30.0, min(30.0, log_odds(block, text, lows)))
        as_content, as_rest = math.log1p(math.exp(-odds)), math.log1p(math.exp(odds))
        # Cutting source -> block pays for calling it boilerplate, cutting block -> sink for calling it content.
        flow.tie(n, i, int(SCALE * as_rest))
        flow.tie(i, n + 1, int(SCALE * as_content))
        if i:
            tie = int(SCALE * (NEAR + (SAME_CONTAINER if found[i - 1].container == block.container else 0.0)))
            flow.tie(i - 1, i, tie, tie)
        before = last.get(block.container)
        if before is not None and before < i - 1:
            flow.tie(before, i, int(SCALE * RESUMED), int(SCALE * RESUMED))
        last[block.container] = i
    return flow.source_side(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    texts = [b.text() for b in found]
    return "\n".join(t for t, content in zip(texts, label(found, texts)) if content)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html column; other columns stay."""
    kept = [c for c in pages.columns if c not in (html_column, "text")]
    # Columns go by place, as names may hold dots.
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate([*kept, html_column])]
    schema = pages.select(*columns[:-1], F.lit("").alias("text")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    return pages.select(*columns).mapInArrow(read, schema).toDF(*kept, "text")
