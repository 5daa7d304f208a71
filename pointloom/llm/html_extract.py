"""Main text of web pages by union-free wrapper inference.

All pages of a host are aligned into a wrapper, a regular expression
without unions: tokens are tags and text; immediate repeats of a token sequence
become a repeated group ``( ... )+``, of which a single occurrence on another page
is a match; a mismatch of text becomes a slot, a mismatch of tags an optional group
``( ... )?``.  Tokens match in equal elements only, so templates of a host keep apart.  Each task folds its pages into one wrapper per host, then wrappers of
``FAN`` tasks at a time are folded into one until each host has one, so a host with
a third of all pages meets nowhere as pages.  The innermost element whose slots hold
most of the text that differs between pages is the host's main element.

Every page is then read whole.  Its tokens are aligned with its host's wrapper:
that tells where the main element starts and ends on this page, and which texts
are constants of the template, which are slots or repeats.  Page furniture (menus,
forms, adverts, comments ...) is known by tags and class words, as its texts vary
between pages too.  The main text is the blocks of the main element that are
neither; constants inside an article or main tag are part of it.  A page that the
wrapper does not match in half its tokens, or a host with one page, is read by
its article, main element or body.  Where a form or a listed class word stands
around the page's main text, or around all its text, it does not count as furniture.

Parameters: a wrapper keeps every node that at least ``rare`` of the host's pages
have (lossy counting: rarer ones may go, so that it stays bounded however many pages
and templates a host has; below 1 / ``rare`` pages nothing goes); repeats of up to
``repeat`` tokens are found; stretches without a common token that both sides have
once are aligned exactly up to ``CELLS`` pairs of tokens, and count as different
beyond.  Of a node's texts, the frequent ones are counted (Misra-Gries); a text of at
least ``MOSTLY`` of a node's pages, and of ``CONSTANT`` pages that are not copies, is a
constant.  Which of several equal alignments is found depends on how pages are dealt to
tasks.  Extraction has no bound.

Defined results: a null or empty html has the empty text; a null url belongs
to the host ''; repeated pages get equal results; unclosed or misnested tags
are closed as browsers do; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as htmllib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

RARE, REPEAT, CELLS = 0.02, 12, 250_000
#: Pages that are not copies, and share of all pages, on which a text must be the same to be a constant of the template.
CONSTANT, MOSTLY = 3, 0.8
#: Texts counted per node; a text of more than ``MOSTLY`` of the pages is among them whatever their order.
TEXTS = 8
#: Wrappers folded into one at a time; nodes a task holds before it writes its wrappers.
FAN, HELD = 32, 100_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|[^<]++|<",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SCOPE = {"article", "aside", "body", "div", "footer", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist", "object", "canvas", "audio", "video"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
FURNITURE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "respond", "reply", "replies", "discussion", "disqus", "pagination", "pager", "toolbar", "skip", "hidden"}
_CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is 'text', 'start' or 'end'; raw elements, comments and declarations are left out."""
    for m in _TOKEN.finditer(page):
        t = m.group()
        if m["name"]:
            yield ("end" if m["end"] else "start"), m["name"].lower(), m["attrs"]
        elif t[0] != "<" or t == "<":
            yield "text", "", t


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTR.findall(rest)} if "=" in rest else {}


def _cached(f):
    """``f(name, attributes, ...)`` with the answers for short attributes kept."""
    kept = functools.lru_cache(maxsize=8192)(f)
    return lambda name, rest, *more: kept(name, rest, *more) if len(rest) <= 128 else f(name, rest, *more)


@_cached
def _key(name: str, rest: str) -> str:
    a = _attributes(rest)
    return name + "".join(f"#{a[k]}" if k == "id" else f".{a[k]}" for k in ("class", "id") if k in a)


@_cached
def _furniture(name: str, rest: str, inside: bool, words_count: bool = True) -> bool:
    if (name in FURNITURE and (words_count or name not in ("form", "fieldset"))) or (name == "header" and not inside):
        return True
    if not rest:
        return False
    a = _attributes(rest)
    if a.get("role") in FURNITURE_ROLES or _HIDDEN.search(rest):
        return True
    if not words_count:
        return False
    words = re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}")
    return name not in ("body", "html", "main") and any(w in FURNITURE_WORDS for w in words) or (not inside and "header" in words)


class _Reader:
    """Open elements of a page, closed as browsers do; blocks of text with where they stand.

    Region bits of a block: 2 in a main tag, 4 in an article, 8 in the host's
    main element, 16 all its text is constant in the template.
    """

    def __init__(self, main: tuple[int, int] | None = None, constants: frozenset[int] = frozenset(), wraps: bool = False):
        self.main = main  # first and last token of the host's main element
        self.constants = constants
        self.wraps = wraps  # forms and class words count only inside the main text
        self.stack: list[tuple[str, bool, int]] = []  # name, furniture, region bits
        self.blocks: list[tuple[str, int]] = []
        self.buffer: list[str] = []
        self.fixed = True  # only constants in the buffer
        self.off = 0  # open furniture elements
        self.region = 0
        self.at = -1

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(htmllib.unescape("".join(self.buffer)).split())
            bits = self.region | 8 * self.inside() | 16 * self.fixed
            self.buffer, self.fixed = [], True
            if text:
                self.blocks.append((text, bits))

    def inside(self) -> bool:
        return self.main is not None and self.main[0] < self.at <= self.main[1]

    def pop(self, n: int) -> None:
        del_ = self.stack[n:]
        self.stack = self.stack[:n]
        self.off -= sum(f for _, f, _ in del_)
        self.region = self.stack[-1][2] if self.stack else 0

    def close(self, name: str, stops: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.pop(i)
                return
            if self.stack[i][0] in stops:
                return

    def read(self, page: list[tuple[str, str, str]]) -> list[tuple[str, int]]:
        for self.at, (kind, name, rest) in enumerate(page):
            if kind == "text":
                if not self.off:
                    self.buffer.append(rest)
                    self.fixed &= self.at in self.constants or rest.isspace()
                continue
            if name in BLOCK:
                self.flush()
            if kind == "end":
                self.close(name, SCOPE if name not in SCOPE else set())
                continue
            if name in VOID:
                continue
            if name in BLOCK:
                self.close("p", SCOPE)
            if name in _CLOSES_SAME:
                for x in ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,):
                    self.close(x, _CLOSES_SAME[name])
            furniture = _furniture(name, rest, bool(self.region & 6), not self.wraps or bool(self.region) or self.inside())
            bits = self.region
            if not self.off and not furniture:
                bits |= 4 * (name == "article" or "articlebody" in rest.lower()) | 2 * (name == "main" or _attributes(rest).get("role") == "main")
            self.stack.append((name, furniture, bits))
            self.off += furniture
            self.region = bits
        self.flush()
        return self.blocks


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The main text of one page, given its host's wrapper."""
    own = list(tokens(page or ""))
    main, constants = wrapper.match(own) if wrapper else (None, frozenset())
    strict = _chosen(_Reader(main, constants).read(own))
    if strict[1]:
        return strict[0]
    loose = _chosen(_Reader(main, constants, True).read(own))
    return loose[0] if loose[1] or not strict[0] else strict[0]


def _chosen(blocks: list[tuple[str, int]]) -> tuple[str, int]:
    """(text, the region bits it was taken by) of a page's blocks."""
    length = lambda own: sum(len(t) for t, _ in own)
    varying = [b for b in blocks if b[1] & 6 or not b[1] & 16]
    whole = length(varying or blocks)
    for bit in (8, 4, 2, 0):
        own = [b for b in varying if b[1] & bit or not bit] or [b for b in blocks if b[1] & bit or not bit]
        if own and (bit != 8 or length(own) >= 0.6 * whole):
            article = [b for b in own if b[1] & 4] or [b for b in own if b[1] & 2]
            if bit == 8 and length(article) >= 0.5 * length(own):
                own = article
            return " ".join(t for t, _ in own), bit
    return "", 0


class Node:
    """A token of a page, or a repeated group: its key, the element it stands in or closes, text, characters outside furniture, and first and last token."""

    __slots__ = ("key", "up", "text", "chars", "first", "last")

    def __init__(self, key, up: str, text: str | None, chars: int, first: int, last: int):
        self.key, self.up, self.text, self.chars, self.first, self.last = key, up, text, chars, first, last


def stream(page: list[tuple[str, str, str]], repeat: int = REPEAT) -> list[Node]:
    """The tokens of a page with repeats of up to ``repeat`` tokens collapsed; a repeated group's key is ('+', keys)."""
    out: list[Node] = []
    keys: list = []  # of ``out``
    ends: list[str] = []  # each key, or the last one of a group: both kinds of repeat end with the key that has just come
    off, off_name = 0, ""
    opened: list[tuple[str, str]] = [("", "")]  # name, key
    names: Counter = Counter()
    for at, (kind, name, rest) in enumerate(page):
        if kind == "text":
            text = " ".join(rest.split())
            if not text:
                continue
            if out and out[-1].key == "#text":
                out[-1].text += f" {text}"
                out[-1].chars += 0 if off else len(text)
                out[-1].last = at
                continue
            node = Node("#text", opened[-1][1], text, 0 if off else len(text), at, at)
        else:
            node = Node(f"/{name}" if kind == "end" else _key(name, rest) if rest else name, opened[-1][1], None, 0, at, at)
            if kind == "start" and name not in VOID:
                opened.append((name, node.key))
                names[name] += 1
            elif kind == "end" and names[name]:
                while True:
                    closed, node.up = opened.pop()
                    names[closed] -= 1
                    if closed == name:
                        break
            if kind == "start" and not off and name not in VOID and _furniture(name, rest, False):
                off, off_name = 1, name
            elif off and name == off_name:
                off += 1 if kind == "start" else -1
        out.append(node)
        last = node.key
        keys.append(last)
        recent = ends[-repeat:]
        ends.append(last)
        if last not in recent:
            continue
        for n in range(1, len(recent) + 1):
            if recent[-n] != last:
                continue
            k, tail = keys[-n - 1], keys[-n:]
            if k.__class__ is not str:
                if k[1] == tuple(tail):
                    out[-n - 1].chars += sum(x.chars for x in out[-n:])
                    out[-n - 1].last = at
                    del out[-n:], keys[-n:], ends[-n:]
                    break
            elif tail == keys[-2 * n : -n] and "#text" in tail:
                tail = tuple(tail)
                out[-2 * n :] = [Node(("+", tail), out[-2 * n].up, None, sum(x.chars for x in out[-2 * n :]), out[-2 * n].first, at)]
                keys[-2 * n :] = [("+", tail)]
                ends[-2 * n :] = [last]
                break
    return out


def _one_group(own: list[Node], group: tuple) -> Node:
    return Node(("+", group), own[0].up, None, sum(x.chars for x in own), own[0].first, own[-1].last)


def grouped(nodes: list, groups: set[tuple], join=_one_group) -> list:
    """Single occurrences of the repeated groups of other pages become groups too."""
    by_first: dict = {}
    for g in sorted(groups, key=lambda g: (-len(g), str(g))):
        by_first.setdefault(g[0], []).append(g)
    out, i = [], 0
    while i < len(nodes):
        for g in by_first.get(nodes[i].key, ()):
            own = nodes[i : i + len(g)]
            if len(own) == len(g) and all(x.key == k for x, k in zip(own, g)):
                out.append(join(own, g))
                i += len(g)
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places with equal keys, increasing in both: ends first, then keys that each side has once, then exactly."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= CELLS:
            for m in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks():
                out += [(a0 + m.a + k, b0 + m.b + k) for k in range(m.size)]
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {k: j for j, k in enumerate(b[b0:b1], b0) if once_b[k] == 1}
        both = [(i, place[k]) for i, k in enumerate(a[a0:a1], a0) if once_a[k] == 1 and k in place]
        i, j = a0, b0
        for x, y in _increasing(both):
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        if i > a0:
            todo.append((i, a1, j, b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence that increases in the second place too."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            last.append(n)
        else:
            tops[k], last[k] = y, n
        before[n] = last[k - 1] if k else -1
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Wrapper:
    """A union-free expression: keys with a constant text or a slot, optional or not; and the nodes of the main element."""

    def __init__(self, nodes: list[tuple], main: tuple[int, int] | None, repeat: int = REPEAT):
        self.nodes, self.main, self.repeat = nodes, main, repeat  # key, constant, optional, the element it stands in
        self.keys = [(n[3], n[0]) for n in nodes]
        self.groups = {k[1] for _, k in self.keys if isinstance(k, tuple)}

    def match(self, page: list[tuple[str, str, str]]) -> tuple[tuple[int, int] | None, frozenset[int]]:
        """(first and last token of the main element, tokens that are constants) of a page; (None, none) if it has another template."""
        own = grouped(stream(page, self.repeat), self.groups)
        pairs = align(self.keys, [(x.up, x.key) for x in own])
        if 2 * len(pairs) < len(own):
            return None, frozenset()
        place = dict(pairs)
        constants = frozenset(t for i, j in pairs if self.nodes[i][1] is not None and self.nodes[i][1] == _short(own[j].text) for t in range(own[j].first, own[j].last + 1))
        ends = [place.get(i) for i in self.main] if self.main else [None]
        return (own[ends[0]].first, own[ends[1]].last) if None not in ends else None, constants

    def dump(self) -> str:
        return json.dumps([self.nodes, self.main, self.repeat])

    @classmethod
    def load(cls, text: str) -> Wrapper:
        nodes, main, repeat = json.loads(text)
        return cls([(_tuples(k), *rest) for k, *rest in nodes], main and tuple(main), repeat)

    def __str__(self) -> str:
        def one(k) -> str:
            if isinstance(k, tuple):
                return "( " + " ".join(map(one, k[1])) + " )+"
            return "#slot" if k == "#text" else f"<{k}>"

        out, within = [], False
        for k, text, optional, _ in self.nodes:
            if optional != within:
                out.append("(" if optional else ")?")
                within = optional
            out.append(repr(text) if text is not None else one(k))
        return " ".join(out + [")?"] * within)


@functools.lru_cache(maxsize=64)
def _loaded(text: str) -> Wrapper:
    return Wrapper.load(text)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _short(text: str | None) -> str | None:
    """A text up to 64 characters as it is, a longer one by its length and 128 bits of its digest."""
    return text if text is None or len(text) <= 64 else f"\0{len(text)} {_digest(text)}"


def _length(short: str) -> int:
    return int(short[1:].split()[0]) if short[:1] == "\0" else len(short)


def _least(a: list[str], b: list[str]) -> list[str]:
    """The smallest different digests of two such lists: enough to tell whether there are ``CONSTANT``."""
    return a if len(a) == CONSTANT and b == a else sorted({*a, *b})[:CONSTANT]


class Part:
    """A node of a fold: key, the element it stands in, characters outside furniture and pages that have it, pages before it was first kept, frequent texts."""

    __slots__ = ("key", "up", "chars", "pages", "missed", "texts")

    def __init__(self, key, up: str, chars: int, pages: int, missed: int, texts: dict[str, list]):
        self.key, self.up, self.chars, self.pages, self.missed, self.texts = key, up, chars, pages, missed, texts

    def add(self, other: Part) -> None:
        self.chars += other.chars
        self.pages += other.pages
        self.missed += other.missed
        for t, (count, pages) in other.texts.items():
            own = self.texts.get(t)
            self.texts[t] = [own[0] + count, _least(own[1], pages)] if own else [count, pages]
        if len(self.texts) > TEXTS:
            less = sorted((n for n, _ in self.texts.values()), reverse=True)[TEXTS]
            self.texts = {t: [n - less, pages] for t, (n, pages) in self.texts.items() if n > less}

    def varying(self) -> int:
        """Characters outside furniture, but for those of a text that most of its pages share."""
        t, (n, _) = max(self.texts.items(), key=lambda x: (x[1][0], x[0]), default=("", (0, None)))
        return max(0, self.chars - n * _length(t)) if n >= MOSTLY * self.pages else self.chars

    def constant(self) -> str | None:
        for t, (n, pages) in self.texts.items():
            if n >= MOSTLY * self.pages and len(pages) >= CONSTANT:
                return t
        return None


def _parts_of_group(own: list[Part], group: tuple) -> Part:
    return Part(("+", group), own[0].up, sum(x.chars for x in own), max(x.pages for x in own), min(x.missed for x in own), {})


def _tuples(key):
    return ("+", tuple(map(_tuples, key[1]))) if isinstance(key, list) else key


class Fold:
    """What pages of a host have in common: their nodes in order, each with how often it came."""

    def __init__(self, nodes: list[Part], n: int, seen: list[str], rare: float = RARE):
        self.nodes, self.n, self.seen, self.rare = nodes, n, seen, rare  # seen: digests of up to CONSTANT different pages
        self.groups = {x.key[1] for x in nodes if isinstance(x.key, tuple)}
        self.places: dict[tuple, list[Part]] = {}  # the nodes that a page of these keys has
        self.due = n + math.ceil(1 / rare)

    @classmethod
    def of(cls, page: str, repeat: int = REPEAT, rare: float = RARE) -> Fold:
        name = _digest(page)
        own = stream(list(tokens(page)), repeat)
        return cls([Part(x.key, x.up, x.chars, 1, 0, {} if x.text is None else {_short(x.text): [1, [name]]}) for x in own], 1, [name], rare)

    def _group(self, groups: set[tuple]) -> None:
        """Take over repeated groups that another side knows."""
        if groups:
            self.nodes = grouped(self.nodes, groups, _parts_of_group)
            self.groups = {x.key[1] for x in self.nodes if isinstance(x.key, tuple)}
            self.places = {}

    def merge(self, other: Fold) -> None:
        mine, theirs = self.groups - other.groups, other.groups - self.groups
        other._group(mine)
        self._group(theirs)
        shape = tuple((x.up, x.key) for x in other.nodes) if other.n == 1 else None
        places = self.places.get(shape)
        if places is None:
            places = self._align(other)
            if shape:
                if len(self.places) >= 256:  # they only save aligning again
                    self.places = {}
                self.places[shape] = places
        else:
            for own, x in zip(places, other.nodes):
                own.add(x)
        self.n += other.n
        self.seen = _least(self.seen, other.seen)
        if self.n >= self.due:
            self.prune()

    def _align(self, other: Fold) -> list[Part]:
        out: list[Part] = []
        places: list[Part] = []
        here, there = int(self.rare * self.n), int(self.rare * other.n)
        i = j = 0
        for x, y in [*align([(w.up, w.key) for w in self.nodes], [(v.up, v.key) for v in other.nodes]), (len(self.nodes), len(other.nodes))]:
            for w in self.nodes[i:x]:
                w.missed += there
            for v in other.nodes[j:y]:
                v.missed += here
            out += self.nodes[i:x] + other.nodes[j:y]
            places += other.nodes[j:y]
            if x < len(self.nodes):
                self.nodes[x].add(other.nodes[y])
                out.append(self.nodes[x])
                places.append(self.nodes[x])
            i, j = x + 1, y + 1
        self.nodes = out
        self.groups |= other.groups
        return places

    def prune(self) -> None:
        """Drop nodes that fewer than ``rare`` of the pages can have had."""
        least = int(self.rare * self.n)
        kept = [x for x in self.nodes if x.pages + x.missed > least]
        if len(kept) < len(self.nodes):
            self.nodes, self.places = kept, {}
            self.groups = {x.key[1] for x in kept if isinstance(x.key, tuple)}
        self.due = self.n + math.ceil(1 / self.rare)

    def wrapper(self, repeat: int = REPEAT) -> Wrapper | None:
        """None for fewer than two different pages."""
        if len(self.seen) < 2:
            return None
        nodes, weighed = [], []
        for x in self.nodes:
            nodes.append((x.key, x.constant(), x.pages < self.n, x.up))
            weighed.append((x.key, None, x.varying()))
        return Wrapper(nodes, _main_element(weighed), repeat)

    def dump(self) -> str:
        return json.dumps([[[x.key, x.up, x.chars, x.pages, x.missed, x.texts] for x in self.nodes], self.n, self.seen, self.rare])

    @classmethod
    def load(cls, text: str) -> Fold:
        nodes, *rest = json.loads(text)
        return cls([Part(_tuples(k), *x) for k, *x in nodes], *rest)


def infer(pages: list[str], repeat: int = REPEAT) -> Wrapper | None:
    """The wrapper of pages of one host; None for fewer than two different pages."""
    folds = [Fold.of(p, repeat) for p in dict.fromkeys(pages)]
    for other in folds[1:]:
        folds[0].merge(other)
    return folds[0].wrapper(repeat) if folds else None


def _main_element(merged: list[tuple]) -> tuple[int, int] | None:
    """First and last node of the innermost element that holds most of the text that differs between pages."""
    total = sum(w[2] for w in merged)
    opened: list[tuple[str, int, int]] = []
    best, so_far = None, 0
    for i, (k, _, weight, *_) in enumerate(merged):
        so_far += weight
        if not isinstance(k, str) or k == "#text":
            continue
        name = re.split(r"[.#]", k.lstrip("/"))[0]
        if k[0] != "/":
            if name in SCOPE - {"html", "body", "li", "ul", "ol"}:
                opened.append((name, i, so_far))
            continue
        for j in range(len(opened) - 1, -1, -1):
            if opened[j][0] == name:
                _, start, before = opened[j]
                del opened[j:]
                if best is None and total and so_far - before >= 0.8 * total:
                    best = (start, i)  # the first to close is the innermost
                break
    return best


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, rare: float = RARE, repeat: int = REPEAT, fan: int = FAN, held: int = HELD) -> DataFrame:
    """(host, wrapper, expression) per host of which several pages are known: the wrapper as JSON and as a regular expression."""
    if fan < 2:
        raise ValueError("at least two wrappers must be folded into one")
    schema = "host string, part long, fold string"

    def rows(part: int, folds: dict[str, Fold]) -> Iterator[pa.RecordBatch]:
        for name, fold in folds.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([fold.dump()])], ["host", "part", "fold"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        folds: dict[str, Fold] = {}
        size = 0
        for batch in batches:
            for name, page in zip(batch.column(0), batch.column(1)):
                name, page = name.as_py(), Fold.of(page.as_py(), repeat, rare)
                fold = folds.get(name)
                if fold is None:
                    folds[name] = page
                    size += len(page.nodes)
                else:
                    before = len(fold.nodes)
                    fold.merge(page)
                    size += len(fold.nodes) - before
                if size > held:
                    yield from rows(part, folds)
                    folds, size = {}, 0
        yield from rows(part, folds)

    def folded(texts: list[str]) -> Fold:
        out = Fold.load(texts[0])
        for t in texts[1:]:
            out.merge(Fold.load(t))
        return out

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part, texts in zip(*batch.columns):
                yield from rows(part.as_py(), {name.as_py(): folded(texts.as_py())})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Fold.load(x.as_py()).wrapper(repeat) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w and w.dump() for w in found], pa.string()), pa.array([w and str(w) for w in found], pa.string())], ["host", "wrapper", "expression"])

    table = materialize(pages.filter("html is not null").select(host(F.col("url")).alias("host"), "html").mapInArrow(first, schema), "folds")
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan)
        key = F.floor(F.col("part") / fan).cast("long").alias("part")
        groups = table.groupBy("host", key).agg(F.array_sort(F.collect_list("fold")).alias("folds"))
        next_table = materialize(groups.mapInArrow(more, schema), "folds")
        discard(table)
        table = next_table
        if parts == 1:
            return table.select("host", "fold").mapInArrow(last, "host string, wrapper string, expression string").filter("wrapper is not null")


def extract_main_text(pages: DataFrame, **options) -> DataFrame:
    """Per row of ``pages``: page_id, url, text."""
    wrappers = materialize(infer_wrappers(pages, **options), "wrappers").select("host", "wrapper")
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h.as_py(), _loaded(w.as_py()) if w.is_valid else None) for h, w in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op3_html(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
