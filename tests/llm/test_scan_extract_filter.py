"""License scans, main text of pages and URL filters."""

import html
import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import html_extract, html_layouts, license_scan, url_filter
from geoloom.llm.html_blocks import blocks, title_of
from geoloom.llm.license_texts import TEMPLATES
from geoloom.llm.queries import QUERIES

# --- licenses -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index():
    return license_scan.Index(TEMPLATES)


def found(index, text, **how):
    return license_scan.matches(license_scan.folded(pa.array([text])), index, **how)[0]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template(index, name):
    words = TEMPLATES[name].split()
    rng = random.Random(len(words))
    around = "lorem ipsum dolor "
    assert [(m.name, m.coverage) for m in found(index, around + TEMPLATES[name] + " " + around)] == [(name, 1.0)]
    if len(words) > 20:
        k = rng.randrange(8, len(words) - 8)
        for changed in (words[:k] + words[k + 2 :], [*words[:k], "some", "more", *words[k:]], [*words[:k], "other", *words[k + 1 :]]):
            (m,) = found(index, around + " ".join(changed))
            assert m.name == name and m.coverage >= 0.9 and m.begin == 3


def plain_alignment(text, template):
    """Best local score over the whole table."""
    best, row = 0, np.zeros(len(template) + 1, dtype=int)
    for x in text:
        new = np.zeros_like(row)
        for j, y in enumerate(template, 1):
            new[j] = max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_band_holds_what_the_whole_table_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        template = rng.integers(0, 50, 30).astype(np.uint64)
        text = template.copy().tolist()
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(0, len(text)))
            text[k : k + int(rng.integers(0, 2))] = [999] * int(rng.integers(0, 3))
        text = np.array([777] * 4 + text + [778] * 4, dtype=np.uint64)
        begin, end, _, _, matched = license_scan.align(text, template, 4)
        inside = text[begin:end]
        # What was found scores as much as the best of the whole table.
        assert plain_alignment(inside, template) == plain_alignment(text, template)
        assert matched <= min(len(inside), len(template))


@pytest.mark.parametrize("more", [13, 30, 200])
@pytest.mark.parametrize("name", ["MIT", "ISC"])
def test_words_put_in_dont_part_a_match(index, name, more):
    words = TEMPLATES[name].split()
    for k in (20, len(words) // 2):
        text = "start here " + " ".join([*words[:k], *(f"x{j}" for j in range(more)), *words[k:]]) + " the end"
        (m,) = found(index, text)
        assert m.name == name and m.coverage >= 0.97 and m.begin == 2
        assert m.end == len(license_scan.folded(pa.array([text]))) - 2
    # Two copies, one of them parted twice, are two matches.
    parted = [*words[:30], *["y"] * more, *words[30:60], *["z"] * more, *words[60:]]
    both = found(index, " ".join([*words, "between", *parted]))
    assert [x.name for x in both] == [name, name] and both[0].end <= both[1].begin


def plain_chain(text, template, coverage):
    """Whether a longest common subsequence of the whole text covers the template."""
    row = [0] * (len(template) + 1)
    for x in text:
        new = [0]
        for j, y in enumerate(template, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[j - 1]))
        row = new
    return row[-1] >= coverage * len(template)


def test_matches_are_those_of_a_whole_comparison():
    """Texts of a template with words changed, put in and left out, in runs that leave seeds; words of others don't repeat."""
    rng = random.Random(9)
    template = [f"w{j}" for j in range(60)]
    index = license_scan.Index({"t": " ".join(template)})
    kinds = set()
    for _ in range(150):
        words, left = [], rng.choice((0.0, 0.1, 0.3))
        for j in range(0, 60, 6):
            words += [] if rng.random() < left else template[j : j + 6]
            words += [f"n{rng.randrange(10**6)}" for _ in range(rng.choice((0, 0, 0, 2, 20, 60)))]
        want = plain_chain(words, template, 0.8)
        kinds.add(want)
        assert [m.name for m in found(index, " ".join(words))] == (["t"] if want else []), words
    assert kinds == {True, False}


def test_ties_go_to_the_first_name():
    index = license_scan.Index({"b": "one two three four five six seven", "a": "one two three four five six seven"})
    assert [m.name for m in found(index, "zero one two three four five six seven eight")] == ["a"]


def test_scan_rows(spark, index):
    rows = [(1, "Intro.\nReleased under the MIT License. é end"), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (1, "no license here at all"), (4, "word " * 30_000 + TEMPLATES["ISC"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as id", "'y' as license")
    got = {(r.id, r.license): r for r in license_scan.scan(df).collect()}
    assert set(got) == {(1, "notice:MIT"), (None, "notice:CC-BY-NC-4.0"), (4, "ISC")}
    assert got[1, "notice:MIT"].matched_text == "Released under the MIT License" and got[1, "notice:MIT"].begin_byte == 7
    assert license_scan.scan(df.limit(0)).collect() == []


def test_every_notice_of_the_test_tables(spark, sf_dir):
    notice = {"notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "notice:MIT": "Released under the MIT License.", "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    folder = sf_dir.replace("sf0.001", "sf0.01")
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for n, t in notice.items() if t in r.text}
    assert {(r.doc_id, r.license) for r in QUERIES["op8_licenses"](spark, folder).collect()} == want and want


# --- pages --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return html_extract.built_in_field()


def block_f1(field, families, seed=12345, most=140):
    right = wrong = missed = 0
    for page, own in html_layouts.labelled_pages(seed, most, families):
        found_blocks = blocks(page)
        got = field.labels(found_blocks, title_of(page))
        for block, good in zip(found_blocks, got, strict=True):
            right += good and block.text in own
            wrong += good and block.text not in own
            missed += not good and block.text in own
    return 2 * right / (2 * right + wrong + missed)


def test_held_out_pages(field):
    assert all(block_f1(field, (family,)) >= 0.95 for family in html_layouts.FAMILIES)


@pytest.mark.parametrize("family, least", [("blog", 0.9), ("table", 0.8), ("bare", 0.9), ("soup", 0.9), ("forum", 0.9)])
def test_layouts_that_training_never_saw(family, least):
    others = tuple(x for x in html_layouts.FAMILIES if x != family)
    assert block_f1(html_extract.train(html_layouts.labelled_pages(7, 600, others), 600), (family,)) >= least


BRIDGE = "The council met on Monday to talk about the new bridge, which is to open in the spring."


@pytest.mark.parametrize(
    "page, want",
    [
        ('<title>Garden notes</title><div id="primary"><div class="hentry"><h2 class="post-title">Garden notes</h2><p>The beans came up early this year, and I have been tying them to canes.</p></div>'
         '<ol class="commentlist"><li><p>Lovely post, thanks.</p></li></ol></div><div id="secondary"><h3>Archives</h3><ul><li><a href=x>May</a></li><li><a href=y>June</a></li></ul></div>',
         ["Garden notes", "The beans came up early this year, and I have been tying them to canes."]),
        ("<html><body>Plain text that stands in the body, with nothing around it at all.</body></html>", ["Plain text that stands in the body, with nothing around it at all."]),
        (f"<table><tr><td><a href=a>Home</a> <a href=b>News</a> <a href=c>Contact</a></td></tr><tr><td><h1>A title</h1><p>{BRIDGE}</p><p>Nobody spoke against it, and the vote was unanimous.</p></td></tr>"
         "<tr><td>Copyright 2020 The Town Paper</td></tr></table>", ["A title", BRIDGE, "Nobody spoke against it, and the vote was unanimous."]),
        (f"<article><header><h1>The title of it</h1></header><p>{BRIDGE}</p></article>", ["The title of it", BRIDGE]),
        (f'<article><h1>Care</h1><p>{BRIDGE}</p><div class="social-care"><p>Social care takes the largest part of it, and it will grow again.</p></div></article>',
         ["Care", BRIDGE, "Social care takes the largest part of it, and it will grow again."]),
        ("<article><h1>Mass</h1><p>The relation is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in all frames of reference.</p></article>", ["Mass", "The relation is E=m in all frames of reference."]),
    ],
)
def test_other_layouts(field, page, want):
    assert html_extract.main_text(page, field).split("\n\n") == want


def test_deep_and_long_pages_take_linear_time(field):
    began = time.perf_counter()
    html_extract.main_text("<div>x" * 100_000, field)
    html_extract.main_text("<article>" + f"<p>{BRIDGE}</p>" * 20_000 + "</article>", field)
    assert time.perf_counter() - began < 40


def test_viterbi_is_the_best_path(field):
    import itertools

    page = blocks("<nav><a href=x>a</a></nav><article><h1>T</h1><p>Some words here.</p></article><footer>&copy; x</footer>")
    scores = [field.emit[[field.names[f] for f in own if f in field.names]].sum(axis=0) for own in html_extract.features(page)]
    value = lambda path: field.start[path[0]] + sum(s[k] for s, k in zip(scores, path, strict=True)) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False))
    assert [bool(x) for x in max(itertools.product((0, 1), repeat=len(page)), key=value)] == field.labels(page)


def test_training_takes_own_pages():
    pages = [(f"<div><p>menu{k}</p></div><section><p>body text {k}.</p></section>", [f"body text {k}."]) for k in range(40)]
    own = html_extract.train(pages, rounds=60)
    assert html_extract.main_text("<div><p>menu</p></div><section><p>other words.</p></section>", own) == "other words."


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>x = "<p>no</p>";</script></head><body>
<header><div class="logo">Site name</div><nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div>
<main><article><h1>A &amp; B&nbsp;&#8212; title</h1><p>First   paragraph <b>with
bold</b> words&period;<p>Second, without an end tag.<div class="advert">Buy this now</div><ul><li>One point of the list.<li>Two</ul>
<!-- comment --><form class="newsletter"><label>Subscribe</label><input></form><p>Last one.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like this a lot.</p></div></section></main>
<aside class="sidebar"><h2>Related</h2><ul><li><a href="/r">Other story</a></ul></aside><footer>&copy; Site name &middot; All rights reserved.</footer></body>"""


def test_a_page(field):
    got = html_extract.main_text(PAGE, field).split("\n\n")
    assert got == ["A & B — title", "First paragraph with bold words.", "Second, without an end tag.", "One point of the list.", "Two", "Last one."]


@pytest.mark.parametrize("page", [None, "", "  ", "<", "<p", "<!--", "<script>", "</p></div>", "<article>", "a < b & c &amp", "<p class=\"x>never closed " * 50, "<div>" * 3000])
def test_broken_pages_dont_break(field, page):
    html_extract.main_text(page, field)


def test_pages_of_the_test_tables(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[^>]+>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", inside)]
        want[r.page_id] = (r.url, "\n\n".join(x for x in texts if x))
    got = {r.page_id: (r.url, r.text) for r in QUERIES["op9_main_text"](spark, sf_dir).collect()}
    assert got == want


def test_page_rows(spark, field):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>Text of it all.</p></article>"), (1, None, "")], "page_id bigint, url string, html string").selectExpr("*", "1 as id", "2 as text")
    got = sorted((tuple(r) for r in html_extract.extract(df, field).collect()), key=repr)
    assert got == sorted([(1, None, ""), (None, "u", "Text of it all."), (1, None, "")], key=repr)
    assert html_extract.extract(df.limit(0), field).collect() == []


# --- urls ---------------------------------------------------------------------------------------

DAY = datetime(2024, 1, 1)


def verdict(url, at, entries):
    """The same rules, entry by entry."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", url or "")
    if not m or at is None:
        return False, None
    host, path = m[1].lower().rstrip("."), "/".join(x for x in m[2].lower().split("/") if x)
    whole = host + ("/" + path if path else "")
    state = {}
    order = {"lift": 0, "allow": 1, "block": 2}
    for kind, value, action, dated in sorted((e for e in entries if None not in e and e[2] in order), key=lambda e: (e[3], order[e[2]])):
        if dated <= at:
            state[kind[0] + ":" + value.lower().strip().rstrip("/")] = action
    hits = [k for k, a in state.items() if a != "lift" and ((k[0] == "d" and (host == k[2:] or host.endswith("." + k[2:]))) or (k[0] == "p" and (whole == k[2:] or whole.startswith(k[2:] + "/"))))]
    best = max(hits, key=lambda k: (len(k), k), default=None)
    return best is not None and state[best] == "block", best


def test_filter_is_entry_by_entry(spark):
    rng = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "aa.com", "A.COM"]
    paths = ["", "/", "/p", "/p/q", "/p/q/r.html?z=1#f", "/pp"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u@'])}{h}{rng.choice(['', ':80', '.'])}{p}" for h in hosts for p in paths] + [None, "", "no url", "http://", "ftp://b.org/p/"]
    entries = [(rng.choice(["domain", "prefix"]), v, rng.choice(["block", "allow", "lift"]), DAY + timedelta(days=rng.choice([0, 1, 40, 200, 700]))) for v in ["a.com", "x.a.com", "b.org", "A.com/p", "a.com/p/q/", "b.org/", "com"] * 4]
    entries += [(None, "a.com", "block", DAY), ("domain", None, "block", DAY), ("domain", "b.org", None, DAY), ("domain", "b.org", "odd", DAY), ("domain", "b.org", "block", None)]
    captures = [(k, u, None if rng.random() < 0.05 else DAY + timedelta(days=rng.choice([-3, 0, 1, 39, 40, 41, 300, 900]), hours=rng.choice([0, 5]))) for k, u in enumerate(urls * 4)]
    captures += [captures[0], (None, "http://a.com/", DAY)]
    left = spark.createDataFrame(captures, "page_id bigint, url string, fetched timestamp").selectExpr("*", "'x' as id", "'y' as key", "'z' as rule")
    right = spark.createDataFrame(entries, "kind string, value string, action string, dated timestamp")
    for span in (url_filter.SPAN, 3600 * 24 * 7):
        got = {(r.id, r.url, r.fetched): (r.blocked, r.rule) for r in url_filter.evaluate(left, right, span=span).collect()}
        assert got == {(i, u, t): verdict(u, t, entries) for i, u, t in captures}
    assert url_filter.evaluate(left.limit(0), right).collect() == []
    assert not any(r.blocked for r in url_filter.evaluate(left, right.limit(0)).collect())
