"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

Each block has features of its ancestors (tags, words of their classes and ids, the two innermost that
say what they are for), of its text (length, links, ends, signs, likeness to the page's title), of its
neighbours, and of its place: inside or outside the densest element, the one that holds most of the page's
running text, and before or after that text. So a page whose names say nothing, or mislead, is still read
by its text. The field has two labels, article and the rest, and is trained by gradient ascent on the
regularised log-likelihood of labelled pages; pages are decoded by Viterbi. Training reads at most
``most`` labelled pages, on the driver; without pages of one's own, labelled pages are made by
``html_layouts.labelled_pages``, from a seed, in layouts of several families.

Defined results: a null or empty page has the text "". Repeated rows each give a row; null ids and urls
are returned as they are. Pages of any size and depth are read whole, one at a time, in linear time. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import parts, ship
from geoloom.llm.html_blocks import Block, Element, blocks, title_of
from geoloom.llm.html_layouts import LABELLED_PAGES, SEED, labelled_pages

ROUNDS, RATE, DECAY = 120, 0.2, 1e-3

# Tags, and beginnings of words in classes and ids, that say what an element is for.
PURPOSE_TAGS = frozenset("article main nav header footer aside form figure figcaption table button dialog address details section blockquote".split())
PURPOSE_WORDS = (
    "article content main body post entry story text hentry primary secondary title headline byline meta author date "
    "nav menu breadcrumb header masthead banner footer colophon sidebar aside widget related recommended "
    "ad ads advert sponsor promo cookie consent notice alert popup modal subscri newsletter "
    "share sharing social comment repl respond discussion disqus form search login signup toolbar tags pagination pager copyright legal"
).split()
#: Purposes whose text doesn't count as running text when the densest element is looked for.
BESIDE = frozenset("nav menu header footer masthead colophon aside sidebar widget form button dialog ad ads advert sponsor promo cookie consent notice alert popup modal comment repl respond discussion copyright legal".split())
_PURPOSE = re.compile("^(?:" + "|".join(sorted((w if len(w) > 3 else f"{w}$" for w in PURPOSE_WORDS), key=len, reverse=True)) + ")")


_MARKED = frozenset({"in:article"})


def _grade(x: float, *steps: float) -> int:
    return sum(x >= s for s in steps)


def _purposes(element: Element | None) -> tuple[frozenset[str], str, str]:
    """Names of what stands around a block, and the two innermost purposes; kept with each element."""
    chain = []
    for at in element.around() if element else ():
        if at.notes is not None:
            break
        chain.append(at)
    known = (frozenset(), "none", "none")
    if element is not None and (not chain or chain[-1].parent is not None):
        known = (chain[-1].parent if chain else element).notes
    for at in reversed(chain):
        found, inner, outer = known
        new, said = {f"in:{at.tag}"}, [at.tag] if at.tag in PURPOSE_TAGS else []
        for word in at.names:
            if m := _PURPOSE.match(word):
                new.add(f"named:{m[0]}")
                said.append(m[0])
        for word in said:
            inner, outer = word, inner
        known = at.notes = (found if new <= found else found | new, inner, outer)
    return known


def _dense(page: list[Block], running: list[int]) -> tuple[list[bool], int, int]:
    """Which blocks are in the densest element, and the first and last block of running text in it."""
    weight: dict[int, int] = {}
    total = sum(running)
    if not total:
        return [False] * len(page), len(page), -1
    # Each element's own text, then carried up: elements are met from the inside once each.
    order: list[Element] = []
    seen: set[int] = set()
    for block, size in zip(page, running, strict=True):
        path = []
        for at in block.within.around() if block.within else ():
            if id(at) in seen:
                break
            seen.add(id(at))
            path.append(at)
        order += reversed(path)
        if block.within is not None:
            weight[id(block.within)] = weight.get(id(block.within), 0) + size
    top: Element | None = None
    for at in reversed(order):
        if at.parent is not None:
            weight[id(at.parent)] = weight.get(id(at.parent), 0) + weight.get(id(at), 0)
        if top is None and weight.get(id(at), 0) >= 0.6 * total:
            top = at
    # Paragraphs themselves are no containers.
    while top is not None and top.tag in ("p", "li", "blockquote", "h1", "h2", "h3", "b", "i", "pre"):
        top = top.parent
    inside: dict[int, bool] = {}
    for at in order:
        inside[id(at)] = at is top or (at.parent is not None and inside[id(at.parent)])
    held = [top is None or (b.within is not None and inside[id(b.within)]) for b in page]
    good = [k for k, (h, size) in enumerate(zip(held, running, strict=True)) if h and size]
    return held, good[0] if good else len(page), good[-1] if good else -1


def features(page: list[Block], title: str = "") -> list[list[str]]:
    """The names of each block's features."""
    lengths = [_grade(len(b.text), 15, 40, 100, 300) for b in page]
    shares = [_grade(b.linked / len(b.text), 0.2, 0.6, 0.95) for b in page]
    plain = [len(b.text) if shares[k] == 0 and _purposes(b.within)[1] not in BESIDE else 0 for k, b in enumerate(page)]
    running = [n if n >= 60 else 0 for n in plain]
    if not any(running):
        running = plain
    held, first, last = _dense(page, running)
    title = title.lower()
    marked = any(_MARKED <= _purposes(b.within)[0] for b in page)
    out = []
    for k, block in enumerate(page):
        around, inner, outer = _purposes(block.within)
        own = block.within.tag if block.within else "none"
        text, length, share = block.text, lengths[k], shares[k]
        place = "within" if first <= k <= last else "before" if k < first else "after"
        found = {"all", *around, f"inner:{inner}", f"inner:{inner},outer:{outer}", f"own:{own}"}
        found |= {f"length:{length}", f"links:{share}", f"length:{length},own:{own}", f"links:{share},inner:{inner}"}
        found |= {f"dense:{held[k]},place:{place}", f"dense:{held[k]},length:{length},links:{share}", f"place:{place},own:{own}", f"dense:{held[k]},own:{own},place:{place}"}
        found.add(f"blocks:{_grade(len(page), 2, 3, 6)},place:{place},links:{share}")
        if marked:
            article = _MARKED <= around
            found |= {f"article:{article}", f"article:{article},inner:{inner}", f"article:{article},place:{place}"}
        found.add(f"ends:{text[-1] in '.!?…。\"”’:'}")
        found.add(f"next:{lengths[k + 1]},{shares[k + 1]}" if k + 1 < len(page) else "next:none")
        found.add(f"prior:{lengths[k - 1]},{shares[k - 1]}" if k else "prior:none")
        if title and len(text) >= 3 and text.lower() in title:
            found |= {"title", f"title,own:{own}", f"title,place:{place}"}
        if "©" in text or "copyright" in text[:400].lower():
            found.add("copyright")
        if "|" in text or "·" in text or "»" in text:
            found.add("divider")
        out.append(sorted(found))
    return out


class Field(NamedTuple):
    """Weights of a trained field: ``emit`` (features, 2), ``move`` (2, 2), ``start`` (2)."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def labels(self, page: list[Block], title: str = "") -> list[bool]:
        """The most probable labels (article or not), by Viterbi."""
        if not page:
            return []
        scores = [self.emit[[self.names[f] for f in own if f in self.names]].sum(axis=0).tolist() for own in features(page, title)]
        (aa, ab), (ba, bb) = self.move.tolist()
        x, y = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back: list[tuple[int, int]] = []
        for u, v in scores[1:]:
            back.append((int(y + ba > x + aa), int(y + bb > x + ab)))
            x, y = max(x + aa, y + ba) + u, max(x + ab, y + bb) + v
        now = int(y > x)
        path = [now]
        for step in reversed(back):
            now = step[now]
            path.append(now)
        return [bool(z) for z in reversed(path)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(labelled: Iterable[tuple[str, list[str]]], most: int = LABELLED_PAGES, rounds: int = ROUNDS) -> Field:
    """A field from pages (html, the texts of the blocks that are the article); at most ``most`` pages are read."""
    pages = [(p, set(own), t) for p, own, t in ((blocks(html), own, title_of(html)) for html, own in islice(labelled, most)) if p]
    named = [features(p, t) for p, _, t in pages]
    names = {f: k for k, f in enumerate(sorted({f for page in named for own in page for f in own}))}
    longest, n = max(len(p) for p, _, _ in pages), len(pages)
    given = np.zeros((n, longest, len(names)), dtype=np.float32)
    gold = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for k, ((page, own, _), found) in enumerate(zip(pages, named, strict=True)):
        real[k, : len(page)] = True
        gold[k, : len(page)] = [b.text in own for b in page]
        for t, some in enumerate(found):
            given[k, t, [names[f] for f in some]] = 1
    sure = np.eye(2)[gold] * real[..., None]
    steps = real[:, 1:]
    moved = (sure[:, :-1, :, None] * sure[:, 1:, None, :] * steps[..., None, None]).sum(axis=(0, 1))
    flat = given.reshape(-1, len(names))
    weights = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for turn in range(1, rounds + 1):
        emit, move, start = weights
        score = (flat @ emit.astype(np.float32)).astype(float).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            step = _logsum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = _logsum(ahead[:, -1], 1)[:, None, None]
        chance = np.exp(ahead + behind - total) * real[..., None]
        pair = ahead[:, :-1, :, None] + move + (score + behind)[:, 1:, None, :] - total[..., None]
        pair = np.exp(np.where(steps[..., None, None], pair, -np.inf))
        slope = [
            flat.T @ (sure - chance).reshape(-1, 2).astype(np.float32) / n,
            (moved - pair.sum(axis=(0, 1))) / n,
            (sure[:, 0] - chance[:, 0]).sum(axis=0) / n,
        ]
        for k in range(3):
            g = slope[k] - DECAY * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] + RATE * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
    return Field(names, *weights)


@lru_cache(maxsize=2)
def built_in_field(seed: int = SEED, most: int = LABELLED_PAGES) -> Field:
    return train(labelled_pages(seed, most), most)


def main_text(html: str | None, field: Field) -> str:
    """The blocks that are the article, in page order, with an empty line between."""
    page = blocks(html)
    return "\n\n".join(b.text for b, good in zip(page, field.labels(page, title_of(html)), strict=True) if good)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and the main text of every page."""
    spark = ship(pages.sparkSession)
    model = spark.sparkContext.broadcast(field or built_in_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "html"):
                texts = [main_text(x, model.value) for x in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
