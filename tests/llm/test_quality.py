"""Quality counts against brute force, and verdicts on planted junk and clean text."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import quality as q
from geoloom.llm.queries import QUERIES


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, None if k % 3 else 0) for k in range(50)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


def test_counts(docs, rows, labels):
    got = q.quality(docs, labels).collect()
    want = []
    for r in rows:
        counts = brute(r[1])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((r[0], *counts, failed))
    assert sorted(((g.id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got), key=repr) == sorted(want, key=repr)
    assert not any(g.kept and g.base_failed for g in got)


def test_score_is_the_mean_log_ratio(docs, rows, labels):
    weight = q.weights(docs, labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic and r.doc_id is not None}
    raw, target = Counter(), Counter()

    def cut(text):
        data = " ".join(re.findall(r"[^\x20\x09-\x0D]+", text or "")).encode()
        out = []
        for i in range(len(data) - 3):
            out.append((int.from_bytes(data[i : i + 4], "big") * 0x9E3779B97F4A7C15 % 2**64) >> 48)
        return out

    for r in rows:
        raw.update(cut(r[1]))
        if r[0] in good:
            target.update(cut(r[1]))
    n = 1 << q.BUCKET_BITS
    a, b = np.array([target[k] for k in range(n)], dtype=float), np.array([raw[k] for k in range(n)], dtype=float)
    want = np.log((a + 0.5) / (a.sum() + n / 2)) - np.log((b + 0.5) / (b.sum() + n / 2))
    assert np.allclose(weight, want)
    got = {(r.id, r.n_words): r.score for r in q.quality(docs, labels).collect()}
    for r in rows:
        own = cut(r[1])
        assert got[r[0], brute(r[1])[0]] == pytest.approx(np.mean([want[k] for k in own]) if own else 0, abs=1e-9)


def test_kept_rows_are_those_of_the_verdict(docs, labels):
    kept = q.select_kept(docs, labels)
    assert kept.columns == docs.columns
    want = sorted((r.id, r.n_words) for r in q.quality(docs, labels).where("kept").collect() if r.id is not None)
    assert sorted((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in kept.collect() if r.doc_id is not None) == want


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "on", "ou", "re", "st"]) for _ in range(rng.randint(1, 4)))
    clean = lambda: " ".join(word() for _ in range(200))
    junk = [lambda: " | ".join(word() for _ in range(200)), lambda: " ".join(word() + rng.choice(["###", "$$$", "%%%"]) for _ in range(200)), lambda: " ".join(word().upper() + "!!" for _ in range(200))]
    rows = [(k, clean(), 1) for k in range(400)] + [(1000 + k, junk[k % 3](), 0) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows if i % 2], "doc_id bigint, quality int, toxic int")
    got = {r.id: r.kept for r in q.quality(docs, labels).collect()}
    assert all(got[i] == bool(g) for i, _, g in rows)
    assert all(r.kept for r in q.quality(docs, labels.limit(0)).where("id < 1000").collect())


def test_held_out_accuracy_on_the_test_tables(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    got = QUERIES["op7_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert all(good) and sum(bad) <= 0.05 * len(bad)


def test_empty_table(no_docs, labels):
    assert q.quality(no_docs, labels).collect() == []
    assert q.select_kept(no_docs, labels).collect() == []
