"""Substring dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import common
from geoloom.llm import substring_dedup as s
from geoloom.llm.common import Words, text_bytes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width):
    first = {}
    cut = [(d, words_of(t)) for d, t in rows]
    for d, w in cut:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in s.substring_dedup(df, **how).collect()), key=repr)


@pytest.mark.parametrize("most", [1, 2_000])
def test_awkward_rows(docs, rows, most):
    want = brute([(r[0], r[1]) for r in rows], 50)
    assert got(docs, most=most) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_that_repeat_a_lot(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice(["a", "b", "cc"]) for _ in range(40)] for _ in range(5)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            w += x[rng.randint(0, 20) :][: rng.randint(1, 30)]
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (3, 2_000):
        assert got(df, width=7, gram=3, most=most) == brute(rows, 7)


def test_copies_near_copies_and_one_id_a_thousand_times(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    base = [word() for _ in range(150)]
    rows = [(d, " ".join(base)) for d in range(50, 150)] + [(7, " ".join(base[10:130]))] * 1000
    for d in range(200, 320):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(150)] = word()
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 50)
    for most in (2, 2_000):
        assert got(df, most=most) == want


def test_long_texts_come_in_slices(spark, monkeypatch):
    """Chunks of 512 bytes in the driver's own functions, as workers have the module's."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(4000)) + " " + "x" * 5000 + " end"
    monkeypatch.setattr(common, "CHUNK_BYTES", 512)
    whole = words_of(text)
    seen, at = [], []
    for words, base, _ in common.sliced(pa.array([text]), 49):
        raw = words.raw.tobytes().decode()
        seen[base:] = [raw[x:y] for x, y in zip(words.starts, words.ends, strict=True)]
        own, sizes, _ = s.super_kmers(words, 50, 8)
        at += [base + x + k for x, n in zip(own.tolist(), sizes.tolist(), strict=True) for k in range(n)]
    assert seen == whole and at == list(range(len(whole) - 49))


def test_long_run_of_one_minimiser():
    words = Words(*text_bytes(pa.array(["a " * 1000])))
    at, sizes, mm = s.super_kmers(words, 50, 8)
    assert sizes.sum() == 951 and sizes.max() == s.LONGEST and len(set(mm.tolist())) == 1
    assert np.array_equal(at, np.cumsum(sizes) - sizes)


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 7, 43, 64):
        assert np.array_equal(s.sliding_least(x, width), [x[i : i + width].min() for i in range(len(x) - width + 1)])


def test_empty_table(no_docs):
    assert got(no_docs) == []
