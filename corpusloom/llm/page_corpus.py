"""Labelled pages to train the extractor on: drawn from a seeded grammar of page layouts.

Each page is a list of leaf texts with a mark whether they belong to the article; the mark-up around
them follows the habits of web pages: semantic elements or div with telling class names, with menus,
headers, notices, adverts, forms, side bars, comments and footers before, inside and after the article.
"""

from __future__ import annotations

import random

#: Class names by what they stand for. Fixed values.
NAMES = {
    "main": "content article post entry story main body text page-content article-body post-content entry-content".split(),
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav links tabs pagination".split(),
    "header": "header masthead top site-header banner-top logo branding".split(),
    "footer": "footer site-footer bottom copyright legal foot".split(),
    "side": "sidebar side widget related popular trending recommended more-stories rail".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal overlay newsletter-popup".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner-ad adsbox promotion".split(),
    "form": "search login signup subscribe newsletter contact-form".split(),
    "comments": "comments comment comment-list replies discussion responses reader-comments".split(),
    "share": "share social sharing share-bar follow".split(),
}
SYLLABLES = "an ar be ca che ción de der die do ein en er es est eur ge gen he in ing ion is it ja la le lich lo ma ment mo na ne no on or ou pe que ra re ri ro sa se ss st ta te th ti to tra un ung ur ve".split()


class Grammar:
    """Draws pages; the same seed draws the same pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.marks: list[bool] = []

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        out[0] = out[0].capitalize()
        return " ".join(out)

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.words(1, 18) + self.r.choice("....!?") for _ in range(self.r.randint(least, most)))

    def leaf(self, tag: str, text: str, main: bool, link: bool = False) -> str:
        self.marks.append(main)
        r = self.r
        if link:
            text = f'<a href="/{r.randint(1, 99)}">{text}</a>'
        elif r.random() < 0.15:
            text = f"<b>{text}</b>" if r.random() < 0.5 else f"<b>{text}<br>"
        end = f"</{tag}>" if tag != "p" or r.random() < 0.85 else ""
        return f"<{tag}>{text}{end}"

    def box(self, kind: str, tags: list[str], inner: str, plain: float = 0.0) -> str:
        r = self.r
        tag = r.choice(tags)
        if tag in ("div", "ul", "section", "span") or r.random() < 0.4:
            attribute = "" if r.random() < plain else f' {r.choice(["class", "class", "id"])}="{r.choice(NAMES[kind])}"'
        else:
            attribute = ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu(self) -> str:
        items = "".join(self.leaf("li", self.words(1, 3), False, link=True) for _ in range(self.r.randint(3, 8)))
        return self.box("menu", ["nav", "nav", "div"], f"<ul>{items}</ul>")

    def other(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.menu()
        if kind == "advert":
            if r.random() < 0.5:  # text right inside the box
                self.marks.append(False)
                return self.box("advert", ["div", "aside"] if r.random() < 0.2 else ["div"], self.sentences(1, 3))
            return self.box("advert", ["div"], self.leaf("p", self.sentences(1, 4), False, r.random() < 0.5))
        if kind == "header":
            return self.box("header", ["header", "div"], self.leaf(r.choice(["h1", "h2", "p", "div"]), self.words(1, 5), False, r.random() < 0.5) + (self.menu() if r.random() < 0.4 else ""))
        if kind == "footer":
            self.marks.append(False)
            text = r.choice(["&copy; ", "© 2020 ", "Copyright ", ""]) + r.choice(["www.example.org &middot; ", "", "All rights reserved. "]) + self.sentences(1, 3)
            return self.box("footer", ["footer", "footer", "div"], text if r.random() < 0.6 else f"<p>{text}</p>")
        if kind == "side":
            items = "".join(self.leaf(r.choice(["li", "p", "h3"]), self.sentences(1, 2) if r.random() < 0.5 else self.words(2, 9), False, r.random() < 0.6) for _ in range(r.randint(2, 6)))
            return self.box("side", ["aside", "aside", "div"], items)
        if kind == "notice":
            return self.box("notice", ["div", "section"], self.leaf("p", self.sentences(1, 3), False) + self.leaf("button", self.words(1, 2), False))
        if kind == "form":
            return f"<form>{self.leaf('p', self.sentences(1, 2), False)}<input name=q>{self.leaf('button', self.words(1, 2), False)}</form>"
        if kind == "share":
            return self.box("share", ["div", "ul"], "".join(self.leaf("li", self.words(1, 1), False, True) for _ in range(r.randint(2, 4))))
        items = "".join(f"<li>{self.leaf('p', self.sentences(1, 4), False)}</li>" for _ in range(r.randint(1, 5)))
        return self.box("comments", ["section", "div"], self.leaf("h3", self.words(1, 2), False) + f"<ol>{items}</ol>")

    def article(self) -> str:
        r = self.r
        out = [self.leaf("h1", self.words(2, 12) if r.random() < 0.8 else self.sentences(1, 2), True)] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 6, 8, 12])):
            x = r.random()
            if x < 0.72:
                out.append(self.leaf("p", self.sentences(1, 1) if r.random() < 0.25 else self.sentences(2, 14), True))
            elif x < 0.8:
                out.append(self.leaf("h2", self.words(1, 8), True))
            elif x < 0.87:
                items = "".join(self.leaf("li", self.words(1, 12), True) for _ in range(r.randint(1, 5)))
                out.append(f"<ul>{items}</ul>" if r.random() < 0.6 else f"<ol>{items}</ol>")
            elif x < 0.91:
                out.append(self.leaf("blockquote", self.sentences(1, 4), True))
            elif x < 0.93:
                out.append("<table><tr>" + "".join(self.leaf("td", self.words(1, 3), True) for _ in range(4)) + "</tr></table>")
            else:
                out.append(self.other(r.choice(["advert", "side", "share", "notice", "form"])))
        if r.random() < 0.15:
            out.append(self.other("comments"))
        inner = "".join(out)
        if r.random() < 0.7:
            inner = f"<article>{inner}</article>" if r.random() < 0.7 else f"<main>{inner}</main>"
        else:
            inner = self.box("main", ["div", "div", "section"], inner)
        return inner if r.random() < 0.7 else f"<main>{inner}</main>" if r.random() < 0.5 else f'<div class="wrapper">{inner}</div>'

    def page(self) -> tuple[str, list[bool]]:
        """A page's mark-up and the marks of its leaf blocks in page order."""
        r = self.r
        self.marks = []
        head = f'<head><meta charset="utf-8">{self.leaf("title", self.words(2, 10), False)}<style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        before = "".join(self.other(k) for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < {"menu": 0.75, "advert": 0.5}.get(k, 0.3))
        middle = self.article()
        after = "".join(self.other(k) for k in ("share", "comments", "side", "advert", "form", "footer") if r.random() < (0.8 if k == "footer" else 0.25))
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{before}{middle}{after}{end}", self.marks


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """n pages with marks."""
    g = Grammar(seed)
    return [g.page() for _ in range(n)]
