"""The labelled table for HTML extraction: small pages of several layouts, each block marked as article (+) or not (-).

A layout is written once, with its marks; what stands in its places (texts of
some words, links, names of boxes) is drawn by a seed. So the tree sees the
same places with long and short texts, in boxes that are named, named oddly or
not named at all.
"""

from __future__ import annotations

import random

_WORDS = "river stone light window garden early market slowly people old water evening letter road because other small seen north children found number open never paper again between table morning winter house sound green".split()
_NAMED = {
    "menu": "menu navbar main-nav topmenu site-navigation breadcrumb".split(),
    "side": "sidebar widget related-posts promo recommended rail-teaser".split(),
    "foot": "footer site-footer bottom copyright legal imprint".split(),
    "advert": "ad advert banner sponsored ad-slot promoted".split(),
    "note": "cookie-notice consent newsletter popup modal login-box".split(),
    "talk": "comments reader-opinions respond discussion replies commentlist".split(),
    "share": "share social toolbar share-buttons tags byline-box".split(),
    "body": "content post-body entry article-body story text".split(),
    "odd": ["x1q _b7", "c-42 grid", "row col-8", "layout left", "wrap inner", ""],
}
#: Names of article elements that sound like furniture.
_MISLEADING = ['class="post tags-news social"', 'id="form-w2"', 'class="share-price menu-review"', 'class="ad-free login-story"', "", ""]


class _Page:
    """Builds a page and its marks block by block."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.marks = rng, [], ""

    def prose(self, low: int, high: int) -> str:
        words = [self.rng.choice(_WORDS) for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize() + self.rng.choice(["."] * 8 + ["!", "?"])

    def label(self) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(1, 3))).capitalize()

    def link(self) -> str:
        return f'<a href="/{self.rng.randint(1, 99)}">{self.label()}</a>'

    def raw(self, text: str) -> _Page:
        self.html.append(text)
        return self

    def open(self, tag: str, kind: str | None = None) -> _Page:
        name = self.rng.choice(_NAMED[kind]) if kind else ""
        key = self.rng.choice(["class", "class", "id"])
        return self.raw(f'<{tag} {key}="{name}">' if name else f"<{tag}>")

    def close(self, tag: str) -> _Page:
        return self.raw(f"</{tag}>")

    def block(self, text: str, mark: str, tag: str = "p") -> _Page:
        self.marks += mark
        return self.raw(f"<{tag}>{text}</{tag}>")

    def links(self, n: int, tag: str = "li") -> _Page:
        for _ in range(n):
            self.block(self.link(), "-", tag)
        return self

    def linked_line(self) -> _Page:
        return self.block(" | ".join(self.link() for _ in range(self.rng.randint(2, 5))), "-", self.rng.choice(["p", "div"]))

    def legal(self) -> _Page:
        said = self.rng.choice(["&copy; 2021 " + self.label(), "Copyright 2019 by " + self.label() + ". All rights reserved.", "(c) 2020 " + self.label(), "&copy; " + self.label() + ". " + self.prose(4, 16)])
        return self.block(said, "-", self.rng.choice(["p", "div"]))

    def article(self, paragraphs: int, heading: bool = True) -> _Page:
        """A heading and paragraphs, some of them short, with links, lists, quotes and subheadings."""
        if heading:
            self.block(self.prose(2, 8).rstrip("."), "+", "h1")
        for k in range(paragraphs):
            kind = self.rng.random()
            if kind < 0.5 or k == 0:
                self.block(self.prose(18, 60), "+")
            elif kind < 0.62:
                self.block(self.prose(2, 8), "+")
            elif kind < 0.74:
                self.block(f"{self.prose(6, 20)} {self.link()} {self.prose(3, 20)}", "+")
            elif kind < 0.82:
                self.block(self.label(), "+", "h2").block(self.prose(10, 40), "+")
            elif kind < 0.92:
                self.raw("<ul>")
                for _ in range(self.rng.randint(2, 4)):
                    self.block(self.prose(2, 9).rstrip("."), "+", "li")
                self.raw("</ul>").block(self.prose(12, 30), "+")
            else:
                self.block(self.prose(6, 25), "+", "blockquote").block(self.prose(12, 30), "+")
        return self


def _semantic(p: _Page) -> None:
    p.open("nav").raw("<ul>").links(p.rng.randint(2, 6)).raw("</ul>").close("nav")
    if p.rng.random() < 0.6:
        p.open("div", "advert").block(p.prose(3, 20), "-", "div").close("div")
    p.raw("<article>")
    if p.rng.random() < 0.3:
        title = p.prose(2, 8)
        p.block(title, "+", "h1").block(title, "+")
    else:
        p.article(p.rng.randint(1, 6))
    if p.rng.random() < 0.6:  # an article may say so itself
        p.block(p.rng.choice(["All rights reserved.", "Copyright " + p.prose(3, 8)]), "+")
    p.raw("</article>")
    if p.rng.random() < 0.5:
        p.raw("<aside>").block(p.label(), "-", "h3").block(p.prose(5, 25), "-").raw("</aside>")
    p.raw("<footer>").legal().raw("</footer>")


def _named_boxes(p: _Page) -> None:
    p.open("div", "menu").links(p.rng.randint(2, 5), "div").close("div")
    p.open("div", "body").article(p.rng.randint(2, 6)).close("div")
    p.open("div", "side").block(p.label(), "-", "h3").block(p.prose(6, 25), "-").close("div")
    if p.rng.random() < 0.6:
        p.open("div", "talk").block(p.prose(6, 30), "-").block(p.prose(3, 12), "-").close("div")
    p.open("div", "foot").legal().close("div")


def _odd_boxes(p: _Page) -> None:
    p.open("div", "odd").linked_line().close("div")
    p.open("div", "odd").article(p.rng.randint(3, 7)).close("div")
    p.open("div", "odd").block(p.label(), "-", "h3").links(p.rng.randint(2, 5), "p").close("div")
    p.open("div", "odd").legal().close("div")


def _flat(p: _Page) -> None:
    if p.rng.random() < 0.7:
        p.linked_line()
    p.article(p.rng.randint(2, 6), p.rng.random() < 0.7)
    if p.rng.random() < 0.6:
        p.block(p.prose(2, 7), "+")
    if p.rng.random() < 0.4:
        p.linked_line()
    if p.rng.random() < 0.6:
        p.legal()


def _misleading(p: _Page) -> None:
    p.open("div", "menu").links(p.rng.randint(1, 4), "div").close("div")
    p.raw(f"<article {p.rng.choice(_MISLEADING)}>").article(p.rng.randint(1, 5))
    if p.rng.random() < 0.5:
        p.block(p.rng.choice(["All rights reserved.", "Copyright " + p.prose(3, 8)]), "+")
    p.raw("</article>").open("div", "odd").block(p.prose(5, 25), "-").close("div")
    p.legal()


def _talk(p: _Page) -> None:
    p.raw("<header>").block(p.label(), "-", "h1").block(p.prose(3, 8), "-").raw("</header><main>")
    p.article(p.rng.randint(2, 5))
    p.open("section", "talk").block(p.label(), "-", "h3")
    for _ in range(p.rng.randint(1, 4)):
        p.block(p.prose(5, 40), "-")
    p.close("section").raw("</main>")
    if p.rng.random() < 0.5:
        p.open("section", "odd").block(p.prose(8, 40), "-").close("section")
    p.legal()


def _overlays(p: _Page) -> None:
    p.open("div", "note").block(p.prose(8, 30), "-").block(p.label(), "-", "div").close("div")
    p.raw("<form>").block(p.label(), "-", "label").raw("<br>").block(p.prose(4, 14), "-").raw("</form>")
    p.marks = p.marks[:-2] + "--"
    p.raw("<article>").article(p.rng.randint(2, 4))
    p.open("div", "share").block(p.label(), "-", "div").close("div")
    p.article(1, heading=False)
    p.open("div", "advert").block(p.prose(4, 20), "-", "div").close("div").raw("</article>")
    p.open("div", "side").links(p.rng.randint(2, 4), "p").close("div")


def _single(p: _Page) -> None:
    if p.rng.random() < 0.5:
        p.raw("<article>").block(p.prose(1, 30), "+").raw("</article>")
    else:
        p.article(p.rng.randint(1, 3), p.rng.random() < 0.5)


def _teasers(p: _Page) -> None:
    p.linked_line().raw("<div>").article(p.rng.randint(3, 6)).raw("</div><div>")
    for _ in range(p.rng.randint(1, 4)):
        p.block(p.link(), "-", "h3").block(f"{p.label()} {p.link()}", "-")
    p.raw("</div>").legal()


def _cells(p: _Page) -> None:
    p.raw("<table><tr>").raw("<td>").links(p.rng.randint(2, 5), "div").raw("</td><td>")
    p.article(p.rng.randint(3, 6)).raw("</td></tr></table>").linked_line()


def _sections(p: _Page) -> None:
    outer = p.rng.choice(["article", "main", "div", "div"])
    p.open("nav" if p.rng.random() < 0.5 else "div", "menu").links(p.rng.randint(2, 5), "div").raw("</div></nav>")
    p.raw(f"<{outer}>").block(p.prose(2, 8).rstrip("."), "+", "h1")
    for _ in range(p.rng.randint(2, 4)):
        inner = p.rng.choice(["section", "div"])
        p.raw(f"<{inner}>").block(p.label(), "+", "h2").article(p.rng.randint(1, 4), heading=False).raw(f"</{inner}>")
    if p.rng.random() < 0.5:
        p.raw("<figure><img src=x>").block(p.prose(3, 12), "+", "figcaption").raw("</figure>")
    p.raw(f"</{outer}>").open("div", "odd").linked_line().close("div").legal()


def _long_sides(p: _Page) -> None:
    if p.rng.random() < 0.6:
        p.raw("<nav><ul>").links(p.rng.randint(2, 6)).raw("</ul></nav>")
    p.open("div", "advert" if p.rng.random() < 0.7 else "odd").block(p.prose(40, 90), "-").close("div")
    p.raw("<article>").block(p.label(), "+", "h1").block(p.prose(5, 40), "+").raw("</article>")
    p.raw("<aside>").block(p.prose(50, 120), "-").block(p.prose(30, 80), "-").raw("</aside>")
    p.open("section", "talk").block(p.prose(30, 90), "-").block(p.prose(30, 90), "-").close("section")
    p.raw("<footer>").block(p.prose(10, 60), "-").raw("</footer>")


def _single_boxes(p: _Page) -> None:
    p.raw("<div>").linked_line().raw("</div><div>").block(p.prose(2, 8).rstrip("."), "+", "h1").raw("<div>")
    for _ in range(p.rng.randint(3, 8)):
        p.raw("<div>").block(p.prose(*p.rng.choice([(15, 50), (15, 50), (3, 9)])), "+", p.rng.choice(["p", "div", "span"])).raw("</div>")
    p.raw("</div></div><div>")
    if p.rng.random() < 0.5:
        p.links(p.rng.randint(1, 4), "div")
    p.legal().raw("</div>")


def _linked_article(p: _Page) -> None:
    p.raw("<nav>").links(3, "span").raw("</nav>")
    p.marks = p.marks[:-3] + "-"
    p.raw("<article>").block(p.label(), "+", "h1").block(p.link(), "+")
    for _ in range(p.rng.randint(1, 4)):
        p.block(f"{p.link()} {p.prose(1, 12)}", "+", p.rng.choice(["p", "li"]))
    p.block(p.prose(3, 30), "+").raw("</article>")
    if p.rng.random() < 0.5:
        p.open("div", "odd").block(p.prose(5, 50), "-").close("div")
    p.raw("<footer>").legal().raw("</footer>")


LAYOUTS = (_sections, _long_sides, _single_boxes, _linked_article, _semantic, _named_boxes, _odd_boxes, _flat, _misleading, _talk, _overlays, _single, _teasers, _cells)
#: Pages of each layout.
EACH = 30


def labelled(each: int = EACH, first: int = 0) -> list[tuple[int, str, str]]:
    """(layout, page, marks) for ``each`` seeds of every layout."""
    out = []
    for k, layout in enumerate(LAYOUTS):
        for seed in range(first, first + each):
            page = _Page(random.Random(1000 * k + seed))
            layout(page)
            out.append((k, "<body>" + "".join(page.html) + "</body>", page.marks))
    return out
