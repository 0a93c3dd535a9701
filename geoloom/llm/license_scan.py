"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts are read as words: runs of letters and digits, ASCII lower-cased, anything else in ASCII parts
them. Each template's hashes of ``GRAM`` words are winnowed (the least of every ``WINNOW`` in a row) into an
inverted index, which is as large as the templates and sent to the workers. A text's winnowed hashes
look up templates and the diagonals of the hits; hits near one diagonal make a candidate, which a
local alignment in a band around the diagonal checks word by word. Alignments of different diagonals are
chained where they run on in text and template at most REACH words apart. A shared run of
GRAM + WINNOW - 1 words always gives a hit. Matches that cover enough of their template are reported, from
the first word of a chain to its last.

Defined results: a null or empty text, or one shorter than a hash, matches nothing and gives no rows.
Repeated rows each give their rows; a null id is returned as it is. Texts are read whole. A match inside
a longer match is left out; of those of equal length, the one with more matched words, then the first by name. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Words, parts, ship, text_bytes, window_hashes, within
from geoloom.llm.license_texts import TEMPLATES

GRAM, WINNOW = 3, 2
#: Words that an alignment may drift from its diagonal.
BAND = 12
#: Words of a text between two alignments that belong to one match, at most.
REACH = 400
#: Share of a template's words that a match must have.
COVERAGE = 0.8
_MATCH, _MISS, _GAP = 2, -1, -1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20


class Match(NamedTuple):
    """Words ``begin`` to ``end`` of a text hold ``matched`` words of the template, in order."""

    name: str
    begin: int
    end: int
    matched: int
    coverage: float


def folded(texts: pa.Array) -> Words:
    raw, rows = text_bytes(texts)
    return Words(_FOLD[raw], rows)


def winnowed(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that winnowing keeps: the last least one of every WINNOW in a row of one text."""
    grams = window_hashes(hashes, GRAM)
    own = within(words, GRAM)
    kept = np.zeros(len(grams), dtype=bool)
    after = np.append(own[1:], False)
    # Windows of two: the lesser of neighbours, the later if equal; a lone hash stands for itself.
    left, right = np.flatnonzero(own & after), np.flatnonzero(own & after) + 1
    kept[np.where(grams[right] <= grams[left], right, left)] = True
    before = np.append(False, own[:-1]) if len(own) else own
    kept |= own & ~after & ~before
    return np.flatnonzero(kept)


class Index:
    """Templates and their winnowed hashes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = folded(pa.array([templates[n] for n in self.names], pa.string()))
        self.hashes = self.words.hashes()
        at = winnowed(self.words, self.hashes)
        self.keys = window_hashes(self.hashes, GRAM)[at]
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[by], at[by]
        self.owner = np.searchsorted(self.words.first, self.places, side="right") - 1
        self.places = self.places - self.words.first[:-1][self.owner]

    def template(self, k: int) -> np.ndarray:
        return self.hashes[self.words.first[k] : self.words.first[k + 1]]


class Local(NamedTuple):
    """A local alignment: words begin to end of the text, first to last of the template, matched words."""

    begin: int
    end: int
    first: int
    last: int
    matched: int


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> Local:
    """The best local alignment near the diagonal text = template + shift.

    Cells (template i, text i + shift + d) with -band <= d <= band; a match scores 2, a miss or gap -1.
    """
    width = 2 * band + 1
    score = np.zeros(width, dtype=np.int64)
    #: Of the alignment that ends in each cell: first text word, first template word, matched words.
    state = np.zeros((3, width), dtype=np.int64)
    top, best = 0, Local(0, 0, 0, 0, 0)
    offsets = np.arange(width) - band
    places = np.arange(width)
    for i in range(max(0, -shift - band), min(len(template), len(text) - shift + band)):
        at = i + shift + offsets
        inside = (at >= 0) & (at < len(text))
        equal = np.zeros(width, dtype=bool)
        equal[inside] = text[at[inside]] == template[i]
        fresh = score <= 0
        new = np.where(fresh, 0, score) + np.where(equal, _MATCH, _MISS)
        own = np.where(fresh, np.stack([at, np.full(width, i), np.zeros(width, dtype=np.int64)]), state)
        own[2] += equal
        # A template word without a text word comes from the cell one to the right.
        skip = np.append(score[1:], -1) + _GAP
        take = skip > new
        new, own = np.where(take, skip, new), np.where(take, np.roll(state, -1, axis=1), own)
        # Text words without a template word run from left to right in the row.
        reach = np.maximum.accumulate(new - _GAP * places) + _GAP * places
        if (reach > new).any():
            source = np.maximum.accumulate(np.where(reach == new, places, 0))
            own, new = own[:, source], reach
        score, state = np.where(inside, new, -1), own
        k = int(score.argmax())
        if score[k] > top:
            top, best = int(score[k]), Local(int(own[0, k]), int(at[k]) + 1, int(own[1, k]), i + 1, int(own[2, k]))
    return best


def _free(low: int, high: int, taken: list[Local]) -> list[tuple[int, int]]:
    """What of the words low to high no alignment takes."""
    todo = [(low, high)]
    for x in taken:
        todo = [piece for a, b in todo for piece in ((a, min(b, x.begin)), (max(a, x.end), b)) if piece[0] < piece[1]]
    return todo


def chained(pieces: list[Local], words: int, coverage: float, reach: int = REACH) -> list[Local]:
    """Chains of local alignments that run on in text and template and together cover enough of the template.

    Neighbours in a chain are at most ``reach`` text words apart. The chain that matches most is taken first
    (ties: the earlier), then the next of what is left.
    """
    out: list[Local] = []
    left = sorted(set(pieces))
    while left:
        total = [x.matched for x in left]
        prior = [-1] * len(left)
        for k, x in enumerate(left):
            for j in range(k - 1, -1, -1):
                y = left[j]
                if x.begin - y.begin > reach + words + BAND:
                    break
                # Ends may run into each other by chance matches; words that both have count once.
                common = max(0, y.end - x.begin, y.last - x.first)
                if x.begin - y.end <= reach and y.begin < x.begin and y.first < x.first and y.end < x.end and y.last < x.last and common < x.matched and total[j] + x.matched - common > total[k]:
                    total[k], prior[k] = total[j] + x.matched - common, j
        k = max(range(len(left)), key=lambda n: (total[n], -left[n].begin))
        if total[k] < coverage * words:
            break
        end, last, matched = left[k].end, left[k].last, min(total[k], words)
        while prior[k] >= 0:
            k = prior[k]
        chain = Local(left[k].begin, end, left[k].first, last, matched)
        out.append(chain)
        left = [x for x in left if x.end <= chain.begin or x.begin >= chain.end]
    return out


def aligned(text: np.ndarray, template: np.ndarray, shifts: list[int], coverage: float) -> list[tuple[int, int, int]]:
    """Begin, end and matched words of the template's matches near the diagonals; they don't overlap.

    What lies left and right of a match is aligned again, so copies inside one band are all found. Then these
    and other local alignments in what is left are chained, so that words put in or left out between them
    don't part a match.
    """
    found: list[Local] = []
    for shift in shifts:
        todo = _free(max(0, shift - BAND), min(len(text), shift + len(template) + BAND), found)
        while todo:
            a, b = todo.pop()
            if b - a < coverage * len(template):
                continue
            best = align(text[a:b], template, shift - a)
            if best.matched >= coverage * len(template):
                found.append(best._replace(begin=a + best.begin, end=a + best.end))
                todo += [(a, a + best.begin), (a + best.end, b)]
    if len(template) >= 2 * GRAM and len(shifts) > 1 and shifts[-1] - shifts[0] > BAND // 2:
        pieces = list(found)
        last = None
        for shift in shifts:
            # Diagonals next to one that was aligned have the same alignment in their band.
            if last is not None and shift - last <= BAND // 2:
                continue
            last = shift
            todo = _free(max(0, shift - BAND), min(len(text), shift + len(template) + BAND), found)
            while todo:
                a, b = todo.pop()
                if b - a >= GRAM and (best := align(text[a:b], template, shift - a)).matched >= GRAM:
                    pieces.append(best._replace(begin=a + best.begin, end=a + best.end))
                    todo += [(a, a + best.begin), (a + best.end, b)]
        found = chained(pieces, len(template), coverage)
    return sorted((x.begin, x.end, x.matched) for x in found)


def matches(words: Words, index: Index, coverage: float = COVERAGE) -> list[list[Match]]:
    """The matches of each text, in text order."""
    hashes = words.hashes()
    places = winnowed(words, hashes)
    keys = window_hashes(hashes, GRAM)[places]
    low, high = np.searchsorted(index.keys, keys, side="left"), np.searchsorted(index.keys, keys, side="right")
    hit = np.flatnonzero(high > low)
    found: list[list[Match]] = [[] for _ in range(len(words.counts))]
    seeds: dict[tuple[int, int], set[int]] = {}
    for k in hit.tolist():
        own = int(np.searchsorted(words.first, places[k], side="right")) - 1
        for x in range(low[k], high[k]):
            seeds.setdefault((own, int(index.owner[x])), set()).add(int(places[k] - words.first[own] - index.places[x]))
    for (own, k), diagonals in seeds.items():
        text, template = hashes[words.first[own] : words.first[own + 1]], index.template(k)
        for begin, end, matched in aligned(text, template, sorted(diagonals), coverage):
            found[own].append(Match(index.names[k], begin, end, matched, matched / len(template)))
    for own, all_of in enumerate(found):
        all_of.sort(key=lambda m: (m.begin - m.end, -m.matched, m.name))
        kept: list[Match] = []
        for m in all_of:
            if not any(x.begin <= m.begin and m.end <= x.end for x in kept):
                kept.append(m)
        found[own] = sorted(kept, key=lambda m: (m.begin, m.name))
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """id, license, coverage, matched_words, begin_byte, end_byte (of the text's UTF-8) and matched_text of every match."""
    spark = ship(docs.sparkSession)
    index = spark.sparkContext.broadcast(Index(templates or TEMPLATES))
    names = ["id", "license", "coverage", "matched_words", "begin_byte", "end_byte", "matched_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                raw, rows = text_bytes(part.column("text"))
                words = Words(_FOLD[raw], rows)
                out, place = [], []
                for k, own in enumerate(matches(words, index.value, coverage)):
                    for m in own:
                        x, y = words.starts[words.first[k] + m.begin], words.ends[words.first[k] + m.end - 1]
                        place.append(k)
                        out.append((m.name, m.coverage, m.matched, int(x - rows[k]), int(y - rows[k]), raw[x:y].tobytes().decode(errors="replace")))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([part.column("id").take(pa.array(place, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, matched_words bigint, begin_byte bigint, end_byte bigint, matched_text string")
