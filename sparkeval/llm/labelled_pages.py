"""Labelled web pages, made from a seed: the training set of the main-text extractor.

A page is a list of (html, text, label): label 1 for blocks of the article, 0 for the rest, None
for markup alone.  The layouts mix named and anonymous containers, nested and unclosed markup;
plain pages have no class names, and ``div`` for every telling element.
"""

from __future__ import annotations

import random
import re

#: Class names of each part of a page.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb topnav main-menu nav-links tabs".split(),
    "header": "header masthead site-header page-header top-bar logo banner site-title".split(),
    "footer": "footer site-footer page-footer copyright colophon legal bottom".split(),
    "sidebar": "sidebar widget rail side-column right-col aside related recommended trending popular-posts more-stories".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal overlay paywall disclaimer newsletter-popup".split(),
    "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner-ad ad-container adsbox".split(),
    "form": "form newsletter subscribe signup login search search-box contact-form poll".split(),
    "comment": "comment comments comment-list comment-body reader-comments discussion replies reply disqus respond user-comments".split(),
    "share": "share social social-share share-buttons tags pagination pager byline-links".split(),
}
MAIN = "article content post entry story main article-body post-content entry-content story-body text article-text page-content".split()
TAGS = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "ins"], "form": ["form"], "comment": ["section", "div", "ul"], "share": ["div", "ul"]}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search"}

Piece = tuple[str, str, int | None]
#: What a page without names lacks.
TELLING = re.compile(r"<(/?)(?:nav|header|footer|aside|article|main|section|form)\b")
NAMED = re.compile(r' (?:class|id|role)="[^"]*"')


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("bcdfglmnprstv") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4))) for _ in range(3000)]

    def say(self, least: int, most: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(least, most))).capitalize() + self.r.choice(["", ".", ".", "!"])

    def attributes(self, kind: str, names: list[str], always: bool) -> str:
        r, out = self.r, []
        if always or r.random() < 0.5:
            out.append(f'{r.choice(["class", "class", "id"])}="{" ".join(r.sample(names, r.randint(1, 2)))}"')
        if kind in ROLES and r.random() < 0.2:
            out.append(f'role="{ROLES[kind]}"')
        if r.random() < 0.15:
            out.append('data-x="1 > 0"')
        return "".join(f" {x}" for x in out)

    def part(self, kind: str) -> list[Piece]:
        """A part that is not the article."""
        r = self.r
        tag = r.choice(TAGS[kind])
        out: list[Piece] = [(f"<{tag}{self.attributes(kind, NAMES[kind], tag in ('div', 'ul', 'section', 'ins') or kind in ('notice', 'advert', 'comment', 'share'))}>", "", None)]
        if kind in ("menu", "share") or kind in ("sidebar", "footer") and r.random() < 0.4:
            inner = "li" if tag == "ul" or r.random() < 0.6 else "div"
            if inner == "li" and tag != "ul":
                out.append(("<ul>", "", None))
            for _ in range(r.randint(2, 8)):
                t = self.say(1, 3)
                out.append((f'<{inner}><a href="/{t[:4]}">{t}</a></{inner}>', t, 0))
            if inner == "li" and tag != "ul":
                out.append(("</ul>", "", None))
        elif kind == "form":
            t = self.say(1, 8)
            out.append((f"<label>{t}</label><input name=q><button>Go</button>", t + " Go", 0))
            if r.random() < 0.4:
                t = self.say(5, 25)
                out.append((f"<p>{t}</p>", t, 0))
        elif kind == "comment":
            for _ in range(r.randint(1, 6)):
                t = self.say(3, 60)
                inner = r.choice(["p", "div", "li", "blockquote"])
                extra = f' class="{r.choice(NAMES["comment"])}"' if r.random() < 0.5 else ""
                out.append((f"<{inner}{extra}>{t}</{inner}>", t, 0))
        else:
            for _ in range(r.randint(1, 3)):
                t = self.say(2, 30)
                out.append((r.choice(["{}", "<p>{}</p>", "<h3>{}</h3>", "<a href=#>{}</a>", "<div>{}</div>", "<span>{}</span>"]).format(t), t, 0))
        out.append((f"</{tag}>", "", None))
        return out

    def article(self) -> list[Piece]:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "section"])
        out: list[Piece] = [(f"<{tag}{self.attributes('main', MAIN, tag in ('div', 'section'))}>", "", None)]
        close = [f"</{tag}>"]
        while r.random() < 0.35:
            inner = r.choice(["div", "section"])
            out.append((f'<{inner} class="{r.choice(MAIN)}">', "", None))
            close.append(f"</{inner}>")
        if r.random() < 0.8:
            t, form = self.say(2, 12), r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"])
            out.append((form.format(t), t, 1))
        for _ in range(r.randint(1, 14)):
            t = self.say(1, 70)
            form = r.choice(["<p>{}</p>"] * 9 + ["<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "{}<br>", "<div>{}</div>"])
            out.append((form.format(t.replace(" ", " <a href=/x>", 1) + "</a>" if r.random() < 0.15 and " " in t else t), t, 1))
            if r.random() < 0.06:
                out += self.part(r.choice(["advert", "share", "sidebar", "form", "notice"]))
        return out + [("".join(reversed(close)), "", None)]

    def page(self, plain: bool = False) -> list[Piece]:
        if plain:
            return [(NAMED.sub("", TELLING.sub(r"<\1div", markup)), text, label) for markup, text, label in self.page()]
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.5]
        after = [k for k in ("share", "comment", "advert", "sidebar", "form", "menu", "notice", "footer") if r.random() < 0.5]
        r.shuffle(before)
        out: list[Piece] = [("<!DOCTYPE html><html><head><title>" + self.say(2, 8) + "</title><style>p{a:b}</style><script>var t='</p>';</script></head><body>", "", None)]
        if r.random() < 0.3:
            out.append((f'<div class="{r.choice(["page", "wrapper", "container", "site", "layout"])}">', "", None))
        for k in before:
            out += self.part(k) + [("<!-- x -->", "", None)] * (r.random() < 0.2)
        out += self.article()
        for k in after:
            out += self.part(k)
        return out + [("</body></html>" if r.random() < 0.9 else "", "", None)]


def pages(seed: int, n: int, plain: bool = False) -> list[list[Piece]]:
    maker = Maker(seed)
    return [maker.page(plain) for _ in range(n)]
