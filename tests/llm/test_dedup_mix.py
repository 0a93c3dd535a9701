"""Exact dedup, SimHash groups and mixing against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from geoloom.llm import common, exact_dedup, mixing, simhash
from geoloom.llm.queries import QUERIES


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1] or ""].append(r[0])
    return out


def largest(ids):
    return max((i for i in ids if i is not None), default=None)


def test_exact_decisions(docs, rows):
    want = set()
    for ids in groups(rows).values():
        want |= {(i, largest(ids), len(ids), i == largest(ids)) for i in ids}
    got = [tuple(r) for r in exact_dedup.decide(docs).select("id", "keep_id", "group_size", "kept").collect()]
    assert set(got) == want
    # Only rows that repeat id and text are one.
    assert len(got) == len({(r[0], r[1] or "") for r in rows})


def test_query_tells_the_texts_of_one_id_apart(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (None, None), (None, "b"), (3, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in QUERIES["op4_exact_dedup"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(1, sha("a")): (1, 1, True), (1, sha("b")): (2, 4, False), (2, sha("b")): (2, 4, True), (None, sha("b")): (2, 4, False), (None, sha("")): (3, 2, False), (3, sha("")): (3, 2, True)}


@pytest.mark.parametrize("sent", [0, 50_000])
def test_exact_rows_that_stay(docs, rows, sent):
    got = exact_dedup.deduplicate(docs, most_sent=sent)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted(((largest(ids), t) for t, ids in groups(rows).items()), key=repr)


def test_prefixes_that_agree(spark):
    rows = [(1, "a" * 100 + "x"), (2, "a" * 100 + "y"), (3, "a" * 100 + "x")]
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.decide(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    f = np.array(prints, dtype=np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2):
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(f))]


def test_simhash_of_awkward_rows(docs, rows):
    prints = [fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], p, c) for r, p, c in zip(rows, prints, components(prints, [r[0] for r in rows]), strict=True)), key=repr)
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == want


def planted(n, seed):
    """Fingerprints in chains and dense clusters, with differences in every segment."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        out.append(x)
        for _ in range(int(rng.integers(0, 12))):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("crowded", [0, 2, 48])
def test_no_link_is_lost(spark, crowded):
    prints = planted(60, 9)
    # One bucket that shares two segments and holds every third segment of few bits.
    prints = sorted({*prints, *((5 << 42) | b for b in range(64)), *(b << 44 | 77 for b in range(40))})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash.links(df, crowded).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got == want
    one = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash.links(df, crowded, distance=1).collect()}
    assert one == {x for x in want if int.bit_count(min(x) ^ max(x)) <= 1}


def test_candidates_are_not_sent_through_the_driver(spark):
    """Of a few fingerprints too, the plan that ran deals out both sides: Spark can't tell how many probes there will be."""
    links = simhash.links(spark.createDataFrame([(simhash._signed(p),) for p in planted(40, 3)], "fp bigint").distinct())
    assert links.collect()
    ran = links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in ran and "BroadcastHashJoin" not in ran


def test_more_distance_is_refused(spark):
    with pytest.raises(ValueError, match="distances"):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), distance=3)


def test_fingerprints_of_long_texts(monkeypatch):
    """Chunks of 300 bytes, so that a text comes in many slices; white space at its end makes an empty last one."""
    words = [f"w{k * k % 97}" for k in range(900)]
    texts = [" ".join(words), " ".join(words) + " " * 700, "\n".join(words[:250]) + " one", "Ab " * 400]
    monkeypatch.setattr(common, "CHUNK_BYTES", 300)
    for text in texts:
        for shingle in (1, 3, 5):
            own = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
            hashes = [xxhash.xxh64_intdigest(" ".join(own[k : k + shingle]).encode(), 42) for k in range(len(own) - shingle + 1)]
            want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
            assert simhash.fingerprints_of(pa.array([text]), shingle).tolist() == [want]


def test_long_chain_is_one_component(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1002), (1001, 1002)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[1002] == got[1001] == 1000


def test_simhash_rows_that_stay(docs, rows):
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    prints = [fingerprint(r[1]) for r in rows]
    least = components(prints, [r[0] for r in rows])
    want = {(r[0], r[1]) for r, c in zip(rows, least, strict=True) if r[0] == c}
    assert {(r.doc_id, r.text) for r in got.collect()} == want


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


def hashed(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_mixing(docs, rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
    weight = {s: n**0.5 for s, n in size.items()}
    total = sum(size.values())
    want = []
    for r in rows:
        name = "null" if r[0] is None else r[0]
        rate = weight[r[3]] / sum(weight.values()) * total / size[r[3]]
        for copy in range(1, poisson(hashed(f"42:draw:{name}") / 2**52, rate) + 1):
            want.append((hashed(f"42:place:{name}:{copy}"), r[0], copy, r[1]))
    for most_sent in (0, mixing.MOST_SENT):
        got = [(r.mix_key, r.doc_id, r.copy_no, r.text) for r in mixing.mix(docs, most_sent=most_sent).collect()]
        assert [g[0] for g in got] == sorted(g[0] for g in got)
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_given_weights_and_large_rates(spark):
    rows = [(k, "x" * 10, "a") for k in range(300)] + [(1000, "x" * 10, "b"), (1001, "x", "c"), (1002, "", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(r.source for r in mixing.mix(df, weights={"a": 1.0, "b": 1.0, "unknown": 5.0, "c": 0.0}).collect())
    # One document stands for half of all: about 150 copies; the other source is halved.
    assert set(got) == {"a", "b"} and 100 < got["b"] / 2 < 210 and 90 < got["a"] < 220


def test_empty_tables(no_docs):
    assert exact_dedup.decide(no_docs).collect() == []
    assert exact_dedup.deduplicate(no_docs).collect() == []
    assert simhash.near_groups(no_docs).collect() == []
    assert mixing.mix(no_docs).collect() == []


@pytest.mark.parametrize("name", ["op3_mix_sources", "op4_exact_dedup", "op10_url_filter"])
def test_same_rows_as_sql(spark, sf_dir, name):
    import duckdb

    from geoloom.llm.queries import ORACLE

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), c.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(order).collect()), key=repr) == sorted((tuple(r[want.columns.index(x)] for x in order) for r in want.fetchall()), key=repr)


def test_contract_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf_dir).collect()}
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.values())
    assert all(int(got[r.doc_id].fingerprint, 16) == fingerprint(r.text) for r in docs)


def test_steps_of_large_rates(spark):
    """A rate of a million takes some ten thousand terms, which add up to the distribution's."""
    rates = spark.createDataFrame([("a", 1e6), ("b", 3.5), ("c", 700.0)], "source string, rate double")
    steps = defaultdict(list)
    for r in mixing.poisson_steps(rates).collect():
        steps[r.source].append((r.copies, r.low))
    assert 10_000 < len(steps["a"]) < 30_000
    for source, rate in (("a", 1e6), ("b", 3.5), ("c", 700.0)):
        got = sorted(steps[source])
        for (k, low), (_, high) in zip(got[::37], got[1::37], strict=False):
            assert math.isclose(high - low, math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)), rel_tol=1e-6, abs_tol=1e-14)
