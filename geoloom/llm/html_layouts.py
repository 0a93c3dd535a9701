"""Labelled pages in made-up words, in layouts of several families, to train and measure page extraction.

Names of classes and ids help in some pages, say nothing in others, and mislead in a few.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Labelled pages that training reads, at most.
LABELLED_PAGES = 1_200
SEED = 7
FAMILIES = ("semantic", "named", "blog", "table", "bare", "soup", "forum")

_SYLLABLES = ("ka", "lo", "min", "ter", "su", "van", "di", "rel", "po", "shen", "ur", "gat", "ö", "né", "wi", "bra")


class _Page:
    """One page in the making; ``own`` gathers the texts of the article's blocks."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.own: list[str] = []
        #: How often a container's name says what it is for.
        self.telling = rng.choice((1.0, 1.0, 0.5, 0.0))
        #: How much of the article isn't prose.
        self.odd = rng.choice((0.0, 0.0, 0.0, 0.1, 0.9))

    def words(self, low: int, high: int, end: str = ".", keep: bool = False) -> str:
        word = lambda: "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))
        text = " ".join(word() for _ in range(self.rng.randint(low, high))).capitalize() + end
        if keep:
            self.own.append(text)
        return text

    def some(self, low: int, high: int, make) -> str:
        return "".join(make() for _ in range(self.rng.randint(low, high)))

    def open(self, tag: str, *names: str) -> str:
        """A start tag with one of the names, or with one that says nothing."""
        name = self.rng.choice(names) if names and self.rng.random() < self.telling else self.rng.choice(("box", "wrap", "inner", "c" + str(self.rng.randint(1, 99)), "row", "panel", ""))
        if not name:
            return f"<{tag}>"
        return f"<{tag}" + self.rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name}-wrap"', f' class="x {name}"')) + ">"

    def links(self, tag: str = "ul") -> str:
        if tag == "p":
            return "<p>" + self.rng.choice((" | ", " · ", " ")).join(f'<a href="/x">{self.words(1, 3, "")}</a>' for _ in range(self.rng.randint(2, 8))) + "</p>"
        return f"<{tag}>" + self.some(2, 8, lambda: f'<li><a href="/x">{self.words(1, 3, "")}</a></li>') + f"</{tag}>"

    def menu(self) -> str:
        inside = self.links(self.rng.choice(("ul", "ul", "p")))
        return self.rng.choice((f"<nav>{inside}</nav>", f"{self.open('div', 'menu', 'nav', 'navigation', 'breadcrumb', 'breadcrumbs', 'toolbar')}{inside}</div>"))

    def top(self) -> str:
        inside = self.rng.choice((self.words(1, 3, ""), f"<h1>{self.words(1, 3, '')}</h1><p>{self.words(3, 8)}</p>", self.menu(), f"<p><a href='/'>{self.words(1, 3, '')}</a></p><p>{self.words(2, 8)}</p>"))
        return self.rng.choice((f"<header>{inside}</header>", f"{self.open('div', 'header', 'masthead', 'banner')}{inside}</div>"))

    def bottom(self) -> str:
        line = self.rng.choice(("&copy; ", "Copyright ", "&copy; 2024 ")) + self.words(1, 4, "") + self.rng.choice((" &middot; ", " | ", ". ")) + self.words(2, 9)
        inside = self.rng.choice((line, f"<p>{line}</p>{self.links()}", f"<p>{self.words(4, 14)}</p><p>{line}</p>", f"<p>{self.words(4, 14)}</p><p>{self.words(4, 14)}</p>"))
        return self.rng.choice((f"<footer>{inside}</footer>", f"{self.open('div', 'footer', 'copyright', 'legal', 'colophon')}{inside}</div>"))

    def advert(self) -> str:
        inside = self.rng.choice((self.words(3, 20), f"<p>{self.words(4, 20)}</p>", f'<a href="/x">{self.words(2, 6, "")}</a>'))
        return f"<div class=\"{self.rng.choice(('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'ad-slot'))}\">{inside}</div>"

    def notice(self) -> str:
        inside = self.rng.choice((self.words(4, 20), f"<p>{self.words(6, 25)}</p><button>{self.words(1, 2, '')}</button>"))
        return f"<div class=\"{self.rng.choice(('cookie', 'cookies', 'consent', 'cookie-notice', 'notice', 'alert', 'popup', 'modal'))}\">{inside}</div>"

    def aside(self) -> str:
        inside = self.rng.choice((f"<h3>{self.words(1, 4, '')}</h3>{self.links()}", f"<p>{self.words(5, 25)}</p>", f"<h2>{self.words(2, 5, '')}</h2><p>{self.words(5, 25)}</p><p>{self.words(5, 25)}</p>"))
        return self.rng.choice((f"<aside>{inside}</aside>", f"{self.open('div', 'sidebar', 'widget', 'related', 'recommended', 'aside')}{inside}</div>"))

    def form(self) -> str:
        return f"{self.open('form', 'search', 'login', 'subscribe', 'newsletter', 'signup')}<label>{self.words(1, 4, '')}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2, '')}</button></form>"

    def comments(self) -> str:
        """Readers' comments; their names tell, as nothing else would."""
        list_of, each = self.rng.choice((("ol", "li"), ("div", "div"), ("section", "div")))
        name = self.rng.choice(("comments", "commentlist", "comment-list", "replies", "discussion", "respond"))
        one = lambda: f"<{each} class=\"{self.rng.choice(('comment', 'reply', 'comment-body', 'box'))}\"><b>{self.words(1, 2, '')}</b><p>{self.words(5, 40)}</p></{each}>"
        heading = self.rng.choice(("", f"<h3>{self.words(1, 3, '')}</h3>"))
        return (heading if list_of == "ol" else "") + f'<{list_of} {self.rng.choice(("class", "id"))}="{name}">' + ("" if list_of == "ol" else heading) + self.some(1, 5, one) + f"</{list_of}>"

    def share(self) -> str:
        return f"<div class=\"{self.rng.choice(('share', 'social', 'tags', 'pagination', 'pager', 'post-tags'))}\">{self.links(self.rng.choice(('ul', 'p')))}</div>"

    def junk(self) -> str:
        """Text of an article that isn't prose: signs between words, or one word again and again."""
        word = self.words(1, 1, "")
        text = self.rng.choice((" | ", " · ", " ### ", "&amp;&amp; ")).join(self.words(1, 2, self.rng.choice(("", "", "."))) for _ in range(self.rng.randint(2, 40)))
        if self.rng.random() < 0.3:
            text = " ".join([word] * self.rng.randint(3, 60))
        self.own.append(text.replace("&amp;", "&"))
        return f"<p>{text}</p>"

    def paragraph(self) -> str:
        rng, kind = self.rng, self.rng.random()
        if rng.random() < self.odd:
            return self.junk()
        if kind < 0.52:
            return f"<p>{self.words(*rng.choice(((1, 5), (8, 60), (30, 160))), keep=True)}</p>"
        if kind < 0.6:
            return f"<p><b>{self.words(5, 60, keep=True)}<br>"
        if kind < 0.7:
            return f"<{(h := rng.choice(('h2', 'h3')))}>{self.words(1, 8, '', True)}</{h}>"
        if kind < 0.76:
            return "<ul>" + self.some(2, 5, lambda: f"<li>{self.words(2, 20, rng.choice(('', '.')), True)}</li>") + "</ul>"
        if kind < 0.82:
            a, b, c = self.words(2, 20, ""), self.words(1, 4, ""), self.words(3, 30)
            self.own.append(f"{a} {b} {c}")
            return f'<p>{a} <a href="/y">{b}</a> {c}</p>'
        if kind < 0.85:
            return f"<blockquote><p>{self.words(5, 40, keep=True)}</p></blockquote>"
        if kind < 0.88:
            return "<table>" + self.some(2, 3, lambda: f"<tr><td>{self.words(1, 3, '', True)}</td><td>{self.words(1, 3, '', True)}</td></tr>") + "</table>"
        if kind < 0.93:
            # A name that misleads, around text that is the article's.
            name = rng.choice(("social-care", "header-text", "share-price", "comment-on-law", "ad-hoc", "related-work", "menu-of-the-day", "notice-of-intent", "c7"))
            return f'<div class="{name}"><p>{self.words(8, 60, keep=True)}</p></div>'
        if kind < 0.95:
            return f"<section>{self.open('div')}<p>{self.words(8, 60, keep=True)}</p></div></section>"
        return rng.choice((self.advert, self.aside, self.form, self.share, self.notice))()

    def body(self, least: int = 0) -> str:
        return "".join(self.paragraph() for _ in range(max(least, self.rng.choice((0, 1, 2, 4, 8, 14)))))

    def heading(self, *tags: str) -> str:
        tag = self.rng.choice(tags or ("h1",))
        return f"<{tag}>{self.words(2, 14, self.rng.choice(('', '.')), True)}</{tag}>"

    def around(self, inside: str) -> str:
        before = "".join(x() for x in self.rng.sample((self.menu, self.top, self.advert, self.notice, self.form, self.share, self.aside), self.rng.randint(0, 5)))
        after = "".join(x() for x in self.rng.sample((self.aside, self.comments, self.bottom, self.form, self.share, self.advert), self.rng.randint(0, 4)))
        return before + inside + after + self.rng.choice((self.bottom(), self.bottom(), ""))

    # The families. ------------------------------------------------------------------------------

    def semantic(self) -> str:
        if self.rng.random() < 0.08:
            return self.rng.choice(("<article>", "<main>")) + self.body(1)
        heading = self.heading()
        if self.rng.random() < 0.35:
            heading = f"<header>{heading}{self.rng.choice(('', f'<p>{self.words(8, 25, keep=True)}</p>'))}</header>"
        opening, closing = self.rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>")))
        return self.around(opening + heading + self.body() + self.rng.choice(("", "", "", self.comments())) + closing)

    def named(self) -> str:
        name = self.rng.choice(("content", "post-body", "entry", "story", "article-text", "main", "main-content"))
        return self.around(f'<div class="{name}">' + self.heading("h1", "h1", "h2") + self.body() + "</div>")

    def blog(self) -> str:
        post = f"<div class=\"{self.rng.choice(('hentry', 'post', 'entry', 'type-post'))}\">" + self.heading("h1", "h2").replace(">", ' class="post-title">', 1) + self.body(1) + "</div>"
        side = f'<div id="{self.rng.choice(("secondary", "sidebar"))}">' + self.some(1, 3, lambda: f'<div class="{self.rng.choice(("widget", "textwidget", "widget-area"))}"><h3>{self.words(1, 3, "")}</h3>{self.links()}</div>') + "</div>"
        inside = f'<div id="{self.rng.choice(("primary", "content", "wrapper"))}">' + post + self.rng.choice(("", self.comments())) + "</div>"
        return f'<div id="page">{self.top()}{self.rng.choice(("", self.menu()))}{inside}{side}{self.bottom()}</div>'

    def table(self) -> str:
        menu = f"<td width=150>{self.links(self.rng.choice(('ul', 'p')))}</td>"
        side = self.rng.choice(("", f"<td><p>{self.words(3, 12)}</p>{self.links('p')}</td>"))
        top = self.rng.choice(("", f"<tr><td colspan=3>{self.words(1, 4, '')}</td></tr>"))
        body = f"<td>{self.heading('h1', 'h2', 'b')}{self.body(2)}</td>"
        cells = menu + body + side if self.rng.random() < 0.7 else body + menu
        return f"<table>{top}<tr>{cells}</tr><tr><td colspan=3>&copy; {self.words(1, 4, '')} {self.words(1, 6)}</td></tr></table>"

    def bare(self) -> str:
        if self.rng.random() < 0.35:
            return self.words(2, 120, keep=True) + self.some(0, 2, lambda: f"<p>{self.words(6, 60, keep=True)}</p>")
        text = self.words(8, 90, keep=True) if self.rng.random() < 0.4 else self.heading() + self.rng.choice(("", self.words(8, 90, keep=True)))
        rest = self.body(0 if self.rng.random() < 0.4 else 2)
        return self.rng.choice(("", self.links("p"))) + text + rest + self.rng.choice(("", f"<hr>{self.bottom()}", f"<hr><address>&copy; {self.words(1, 5, '')}</address>"))

    def soup(self) -> str:
        self.telling = 0.0
        depth = self.rng.randint(1, 5)
        text = self.heading("h1", "h2", "h1") + self.body(2)
        return "<div>" + self.menu() + self.rng.choice(("", self.top())) + "<div class=c1>" * depth + text + "</div>" * depth + self.rng.choice(("", self.aside())) + self.bottom() + "</div>"

    def forum(self) -> str:
        """A question or topic with the readers' answers below it."""
        text = self.heading("h1", "h2") + f'<div class="{self.rng.choice(("post", "topic", "question", "message-body", "c3"))}">' + self.body(1) + "</div>"
        return self.rng.choice(("", self.menu())) + self.open("div", "thread", "topic", "container") + text + self.comments() + "</div>" + self.rng.choice(("", self.form())) + self.bottom()


def labelled_pages(seed: int = SEED, most: int = LABELLED_PAGES, families: tuple[str, ...] = FAMILIES) -> Iterator[tuple[str, list[str]]]:
    """Pages of the families, each with the texts of its article's blocks."""
    rng = random.Random(seed)
    for k in range(most):
        page = _Page(rng)
        # Marked-up pages are the commonest: every other one, where they are among the families.
        family = "semantic" if "semantic" in families and k % 2 else families[k // 2 % len(families)] if "semantic" in families else families[k % len(families)]
        body = getattr(page, family)()
        # Most pages are titled as their article, often with the site's name.
        title = rng.choice((page.own[0], page.own[0], page.own[0] + " | " + page.words(1, 3, ""), page.words(2, 9))) if page.own else page.words(2, 9)
        head = f"<title>{title}</title>" if rng.random() < 0.8 else ""
        yield f"<!DOCTYPE html><html><head>{head}<script>var a='</p>';</script></head><body>{body}</body></html>", page.own
