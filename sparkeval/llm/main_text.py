"""Main text of web pages: the maximum-scoring run of words and tags.

A word scores by its place, from 0 to 1 (a logistic model of the elements and class names around
it), and a tag below zero.  All weights come from labelled pages: tags start at how much more often
they stand outside articles than inside, and then learn from the runs that come out wrong.  Pages
without any name that tells an article have weights of their own, from labelled pages of that kind.
One scan finds the run of tokens with the greatest sum; words inside it that score 0 (an advert
within the article, say) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, labelled_pages

#: Fixed values of HTML: elements without an end, elements that do not break a line, elements whose
#: content is no text, those of them whose content holds no tags, and what a head may hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title".split())
RAW = frozenset("script style iframe textarea title".split())
FOREIGN = frozenset("svg math".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noframes style noscript script template".split())
#: Starts of these end an open paragraph; items end an open item of their kind.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd tr td th option".split())

#: A whole tag: quotes count after "=" only, and only if they close; nothing is given back, so time is linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: However many names around speak for an article, they count no more than this, so that one name
#: against it (an advert within an article) can outweigh them.
ENOUGH = 3.0
#: Labelled pages that the weights are learned from: a fixed number, the same at every size.
PAGES, SEED = 1500, 11
#: What every tag costs at least, and how tags learn: by so much at a wrong run, in so many turns.
LEAST, RATE, TURNS = 0.02, 0.05, 12
#: A name (or element) that a page without names does not have tells an article from this weight on.
TELLING = 1.0


@lru_cache(maxsize=20_000)
def features(tag: str, attributes: str) -> tuple[str, ...]:
    """Names of an element: its tag, its class and id words, its role."""
    out = set() if tag in INLINE and tag != "a" or tag in ("div", "html", "body") else {tag}
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or "display:none" in value.replace(" ", "") or name == "aria-hidden" and "true" in value:
                out.add(".hidden")
            elif name == "role":
                out.add(f"@{value.strip(chr(34) + chr(39)).lower()}")
            elif name in ("class", "id"):
                for w in NAME.findall(value):
                    w = w.lower()
                    out.add("." + (w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w))
    return tuple(sorted(out))


class Markup:
    """The tags and comments of a page, one after another."""

    def __init__(self, page: str):
        self.page, self.tag = page, TAG

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" of an end tag, tag, attributes) of the first from ``at`` on; a comment has no tag.

        A tag that the page does not close goes on to the page's end.
        """
        page = self.page
        while (at := page.find("<", at)) >= 0:
            sign = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                return at, len(page) if end < 0 else end + 3, "", "", ""
            if sign in "!?" and sign or sign == "/" and not page[at + 2 : at + 3].isalpha():
                end = page.find(">", at)
                return at, len(page) if end < 0 else end + 1, "", "", ""
            if not (sign == "/" or sign.isascii() and sign.isalpha()):
                at += 1
                continue
            m = self.tag.match(page, at)
            if m is None and page.find(">", at) >= 0:
                self.tag = PLAIN_TAG  # quotes hide every ">" that is left: from here on they count for nothing
                m = self.tag.match(page, at)
            if m is None:
                return at, len(page), "", "", ""
            return at, m.end(), m[1], m[2].lower(), m[3]
        return None


def _raw_end(page: str, tag: str, at: int) -> int:
    """Raw text ends at its own end tag alone, whatever looks like a tag before it, else with the page."""
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
    return len(page) if end is None else end.end()


def _silent_ends(page: str) -> dict[int, int]:
    """Of each silent element that is not raw and has an end tag of its own: after its start tag, after its end tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SILENT - RAW}
    marks, at = Markup(page), 0
    while m := marks.after(at):
        _, at, closes, tag, attributes = m
        if tag in opened:
            if tag == "select" and opened[tag] and not closes:
                opened[tag].clear()  # a select within a select ends it
            if not closes:
                if not (tag in FOREIGN and attributes.endswith("/")):
                    opened[tag].append(at)
            elif opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in RAW and not closes and not (opened["svg"] or opened["math"]):
            at = _raw_end(page, tag, at)
    return ends


class Element:
    """An open element: its names, what it stands in, what a model says of it and all around it, the
    words in it, and whether it wraps the page, so that its names tell nothing against an article."""

    __slots__ = ("names", "parent", "sums", "words", "wraps")

    def __init__(self, names: tuple[str, ...], parent: Element | None, wraps: bool):
        self.names, self.parent, self.sums, self.words, self.wraps = names, parent, None, 0, wraps

    def around(self) -> Iterator[str]:
        e = self
        while e is not None:
            yield from e.names
            e = e.parent


class Stack:
    """The open elements; every step takes constant time, over the whole page."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.walls: list[int] = []  # elements that no start tag but their own kind closes

    def top(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE and tag not in ("p", "td", "th"):
            self.walls.append(len(self.tags))
        self.elements.append(Element(names, self.top(), tag in ("html", "body")))
        self.tags.append(tag)

    def cut(self, k: int) -> None:
        """Close everything from place ``k`` on."""
        while len(self.tags) > k:
            self.places[self.tags.pop()].pop()
            self.elements.pop()
        while self.walls and self.walls[-1] >= k:
            self.walls.pop()

    def close(self, tag: str) -> None:
        """An end tag."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def give_way(self, tag: str) -> None:
        """A start tag ends an open paragraph, or an open item of its kind."""
        kinds = ("p",) if tag in ENDS_P else (tag, "td", "th") if tag == "tr" else (tag,)
        k = max((self.places[x][-1] for x in kinds if self.places.get(x)), default=-1)
        if k >= 0 and k >= (self.walls[-1] if self.walls else -1):
            self.cut(k)


def tokens(page: str) -> Iterator[tuple[str, str, Element | None]]:
    """(kind, value, element): kind is "text", "inline" or "block"; value is text or a tag; the
    element is the one around a text, or that a start tag opens.

    A head ends at its end tag, or at the first text or tag that a head may not hold.
    """
    stack, marks = Stack(), Markup(page)
    at, head, ends = 0, False, None
    while m := marks.after(at):
        start, end, closes, tag, attributes = m
        if start > at and not (head and page[at:start].isspace()):
            head = False
            yield "text", page[at:start], stack.top()
        at = end
        if not tag:
            continue
        if tag == "head":
            head = not closes
            continue
        if head:
            if closes and tag not in ("body", "html", "br") or tag in IN_HEAD - SILENT:
                if tag == "noframes" and not closes:
                    at = _raw_end(page, tag, at)
                continue
            head = tag in IN_HEAD
        kind = "inline" if tag in INLINE else "block"
        if closes:
            stack.close(tag)
            yield kind, f"/{tag}", None
            continue
        if tag in RAW:
            at = _raw_end(page, tag, at)
            continue
        if tag in SILENT:
            if not (tag in FOREIGN and attributes.endswith("/")):
                ends = _silent_ends(page) if ends is None else ends
                at = ends.get(at, at)  # without an end tag, only its start goes
            continue
        if tag in ENDS_P or tag in ITEMS:
            stack.give_way(tag)
        if tag not in VOID:
            stack.push(tag, features(tag, attributes.strip("/ \t\n\r\f")))
        yield kind, tag, None if tag in VOID else stack.top()
    if at < len(page) and not (head and page[at:].isspace()):
        yield "text", page[at:], stack.top()


class Weights:
    """``of`` names of elements, of tags; places need ``bias`` besides."""

    def __init__(self, bias: float, of: dict[str, float], tags: dict[str, float], unknown: float):
        self.bias, self.of, self.tags, self.unknown = bias, of, tags, unknown
        self._sums: dict[tuple[str, ...], tuple[float, float]] = {}

    def _element(self, names: tuple[str, ...]) -> tuple[float, float]:
        """What an element's names say for and against."""
        if (s := self._sums.get(names)) is None:
            known = [self.of.get(f, 0.0) for f in names]
            s = sum(x for x in known if x > 0), sum(x for x in known if x < 0)
            if len(self._sums) < 50_000:
                self._sums[names] = s
        return s

    def see_wrappers(self, seen: list[tuple[str, str, Element | None]]) -> None:
        """Mark the elements that wrap the page: a menu, form or advert does not hold the article.

        These are html and body, and each that holds most of the page's words and, within it, the
        element with nothing against it that most speaks for an article: the innermost that has half
        the words of the largest such.  Where no name tells one, those that hold nearly all words.
        """
        opened = [e for kind, _, e in seen if kind != "text" and e is not None]  # parents come first
        total = 0
        for kind, value, e in seen:
            if kind == "text" and e is not None:
                n = len(value.split())
                e.words += n
                total += n
        for e in reversed(opened):
            if e.parent is not None:
                e.parent.words += e.words
        telling = [e for e in opened if e.words and (s := self._element(e.names))[0] > 0 == s[1]]
        if telling:
            most = max(e.words for e in telling)
            e = [e for e in telling if 2 * e.words >= most][-1].parent
            while e is not None:
                e.wraps |= 2 * e.words >= total
                e = e.parent
        else:
            for e in opened:
                e.wraps |= bool(total) and 10 * e.words >= 9 * total and self._element(e.names)[0] == 0

    def place(self, element: Element | None) -> float:
        """Score of one word there: 0 outside articles, 1 where all speaks for one."""
        new, e = [], element
        while e is not None and e.sums is None:
            new.append(e)
            e = e.parent
        speak, against = (0.0, 0.0) if e is None else e.sums
        for e in reversed(new):
            a, b = self._element(e.names)
            if e.wraps:
                b = 0.0
            speak, against = speak + a, against + b
            e.sums = speak, against
        return max(0.0, math.tanh((self.bias + min(ENOUGH, speak) + against) / 2))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Where the run of the greatest sum starts and ends, in one scan; the first and shortest such
    run, and an empty one if no score is above zero."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, k
        run += score
        if run > best:
            best, span = run, (begin, k + 1)
    return span


def _sequence(seen: Iterable[tuple[str, str, Element | None]], w: Weights) -> list[tuple[str, str, int, float]]:
    """(tag or "", text, number of words, score of one word) of each token."""
    out = []
    for kind, value, element in seen:
        if kind == "text":
            text = html.unescape(value) if "&" in value else value
            n = len(text.split())
            out.append(("", text, n, w.place(element) if n else 0.0))
        else:
            out.append((value, "" if kind == "inline" else " ", 0, 0.0))
    return out


def _scores(sequence: list[tuple[str, str, int, float]], tags: dict[str, float], unknown: float) -> list[float]:
    return [tags.get(tag, unknown) if tag else n * place for tag, _, n, place in sequence]


def _text(run: list[tuple[str, str, int, float]]) -> str:
    return " ".join("".join(text for _, text, n, place in run if place > 0 or not n).split())


@dataclass
class Model:
    """Weights for pages with a name that tells an article, those names, and weights for other pages."""

    named: Weights
    telling: frozenset[str]
    plain: Weights

    def of(self, seen: list[tuple[str, str, Element | None]]) -> Weights:
        tells = any(k != "text" and e is not None and not self.telling.isdisjoint(e.names) for k, _, e in seen)
        return self.named if tells else self.plain


def extract(page: str | None, model: Model, scan: bool = True) -> str:
    """The main text; empty if no run of tokens scores above zero.  Without ``scan``, the whole page
    is the run."""
    if not page:
        return ""
    seen = list(tokens(page))
    w = model.of(seen)
    w.see_wrappers(seen)
    sequence = _sequence(seen, w)
    a, b = best_run(_scores(sequence, w.tags, w.unknown)) if scan else (0, len(sequence))
    return _text(sequence[a:b])


Labelled = list[labelled_pages.Piece]


def wanted(pieces: Labelled) -> str:
    """The article of a labelled page."""
    return " ".join(" ".join(t for _, t, label in pieces if label == 1).split())


def _labels(pieces: Labelled) -> Iterator[tuple[str, str, Element | None, int | None]]:
    """Tokens of a labelled page, and the label of the piece that each stands in."""
    page = "".join(m for m, _, _ in pieces)
    ends = np.cumsum([len(m) for m, _, _ in pieces])
    at = 0
    for kind, value, element in tokens(page):
        at = page.index(value if kind == "text" else f"<{value}", at)
        yield kind, value, element, pieces[int(np.searchsorted(ends, at, "right"))][2]


def _places(made: list[Labelled]) -> tuple[float, dict[str, float]]:
    """Bias and weights of names: a logistic model of the labels of texts."""
    places: Counter = Counter()  # of (names around with their counts, label)
    for pieces in made:
        for kind, value, element, label in _labels(pieces):
            if kind == "text" and label is not None and value.strip():
                places[tuple(sorted(Counter(element.around() if element else ()).items())), label] += 1
    names = sorted({f for r, _ in places for f, _ in r})
    column = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(places), len(names) + 1))
    x[:, -1] = 1
    for i, (r, _) in enumerate(places):
        for f, v in r:
            x[i, column[f]] = v
    y, n_of, theta = np.array([label for _, label in places], float), np.array(list(places.values()), float), np.zeros(len(names) + 1)
    mean_square = np.zeros_like(theta)
    for _ in range(400):
        speak = x[:, :-1] @ theta[:-1].clip(0)
        raw = theta[-1] + np.minimum(speak, ENOUGH) + x[:, :-1] @ theta[:-1].clip(None, 0)
        error = n_of * (1 / (1 + np.exp(-raw)) - y) / n_of.sum()
        # names that speak for the article learn from places where they are not too many already
        slope = np.append(np.where(theta[:-1] > 0, x[:, :-1].T @ (error * (speak < ENOUGH)), x[:, :-1].T @ error), error.sum()) + 1e-4 * theta
        mean_square = 0.9 * mean_square + 0.1 * slope**2
        theta -= 0.1 * slope / (np.sqrt(mean_square) + 1e-8)
    return float(theta[-1]), dict(zip(names, theta[:-1].tolist(), strict=True))


def _tags(made: list[Labelled], bias: float, of: dict[str, float]) -> dict[str, float]:
    """Weights of tags, all below zero: log odds, then a structured perceptron over the runs."""
    inside, outside = Counter(), Counter()
    pages = []  # sequence, where the article's first and last words are, its text
    for pieces in made:
        labels = [label for *_, label in _labels(pieces)]
        sequence = _sequence(tokens("".join(m for m, _, _ in pieces)), Weights(bias, of, {}, 0.0))
        article = [k for k, label in enumerate(labels) if label == 1 and sequence[k][2]]
        first, last = article[0], article[-1] + 1
        for k, (tag, *_) in enumerate(sequence):
            if tag:
                (inside if first <= k < last else outside)[tag] += 1
        pages.append((sequence, first, last, wanted(pieces)))
    w = {t: -max(LEAST, 0.5 * math.log((outside[t] / max(1, outside.total()) + 1e-3) / (inside[t] / max(1, inside.total()) + 1e-3))) for t in sorted({*inside, *outside})}
    total, turns = dict.fromkeys(w, 0.0), 0
    for turn in range(TURNS):
        for sequence, first, last, text in pages:
            a, b = best_run(_scores(sequence, w, -LEAST))
            if _text(sequence[a:b]) != text:
                for (x, y), sign in (((first, last), RATE), ((a, b), -RATE)):
                    for tag, *_ in sequence[x:y]:
                        if tag:
                            w[tag] = min(-LEAST, w[tag] + sign)
        if turn >= TURNS // 2:  # the mean of the later turns is steadier than the last
            turns += 1
            for t in w:
                total[t] += w[t]
    return {t: v / turns for t, v in total.items()}


def _weights(made: list[Labelled]) -> Weights:
    bias, of = _places(made)
    return Weights(bias, of, _tags(made, bias, of), -LEAST)


@lru_cache(maxsize=4)
def learned(seed: int = SEED, n: int = PAGES) -> Model:
    """Weights from ``n`` labelled pages with names, and from a third as many without."""
    named, plain = _weights(labelled_pages.pages(seed, n)), _weights(labelled_pages.pages(seed + 1, n // 3, plain=True))
    telling = frozenset(f for f, v in named.of.items() if v > TELLING and f not in plain.of)
    return Model(named, telling, plain)


def _extract(batches, w: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p, w) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without a main text, give an empty text; repeated rows and null
    ids or urls stay; other columns are ignored.  The weights are a few hundred numbers.
    """
    w = learned()
    w.named._sums.clear()
    w.plain._sums.clear()
    rows = pages.selectExpr("cast(page_id as long) as page_id", "url", "html")
    return common.map_batches(rows, lambda b: _extract(b, w), "page_id long, url string, text string, n_chars long")
