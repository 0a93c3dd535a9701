"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the hashes of the text's
3-word shingles. Fingerprints are linked if they differ in 2 bits or fewer; groups are the connected
components of the links.

Candidates come from the pigeonring principle: with the bits in a ring of 3 segments and 2
differences in all, some segment starts a chain whose running differences stay within 2/3 for each
segment so far: none in the first, 1 in the first two, 2 in all three. The first two steps of the
chain are an equality join: each fingerprint is indexed by the bits of two neighbouring segments, and
probes with these bits and with each single zero of the second segment set. The third step is the full
Hamming check. A bucket with many fingerprints (a large group of near copies) is split again by chains
over its last segment, so no bucket ever joins more than 2 ** 11 fingerprints to one probe.

Equal fingerprints are one vertex, so copies never make pairs; a vertex has at most 2,080 links.
Components are found by large-star and small-star steps over checkpointed tables.

Defined results: a null text is empty; a text without words has fingerprint 0, linked like any other.
A text of one or two words has one shingle, the whole. Repeated rows each give a row. A row with a
null id keeps its fingerprint, and its component's id is that of the other rows, or null without any.
Other columns are not looked at by ``near_groups``; ``deduplicate`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Words, parts, shared_folder, ship, sliced, text_bytes

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Ring of segments, for at most 2 differences: first bit and number of bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints in a bucket from which on its last segment is chained as well.
CROWDED = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _totals(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many hashes have each bit set, and how many hashes there are."""
    packed, starts, ends = words.packed()
    counts = words.counts
    shingles = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(at[-1]) + np.repeat(words.first[:-1] - at[:-1], shingles)
    last = first + np.repeat(np.minimum(counts, shingle), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(packed[x:y], SEED) for x, y in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), dtype=np.uint64, count=len(first))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(shingles)
    totals = np.zeros((len(counts), 64), dtype=np.int64)
    if len(some):
        totals[some] = np.add.reduceat(bits, at[some], axis=0, dtype=np.int64)
    return totals, shingles


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers; a long text is added up in slices."""
    lower = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((held := text_bytes(texts))[1].astype(np.int64)), pa.py_buffer(_LOWER[held[0]])])
    totals, shingles = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for words, base, _ in sliced(lower, shingle - 1):
        if base and len(words) < shingle:
            # Nothing but the words that the slice before has as well.
            continue
        own = _totals(words, shingle)
        totals, shingles = totals + own[0], shingles + own[1]
    return np.packbits(2 * totals > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's bits as a bigint) and text_key (a 64-bit hash of the text) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.record_batch([part.column("id"), pa.array(fingerprints_of(part.column("text"), shingle).view(np.int64)), part.column("text_key")], names=["id", "fp", "text_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint, text_key bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(*spans: tuple[int, int]) -> int:
    return _signed(sum(((1 << n) - 1) << at for at, n in spans))


def _masked(*spans: tuple[int, int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_mask(*spans)).cast("bigint"))


def _probes(same: list[tuple[int, int]], near: tuple[int, int] | None) -> Column:
    """The bits of both, and those with each one zero of ``near`` set."""
    base = _masked(*same, *([near] if near else []))
    if near is None:
        return F.array(base)
    bits = [F.lit(_signed(1 << b)).cast("bigint") for b in range(near[0], near[0] + near[1])]
    return F.array_compact(F.array(base, *[F.when(F.col("fp").bitwiseAND(b) == 0, base.bitwiseOR(b)) for b in bits]))


def _halves(span: tuple[int, int]) -> list[tuple[int, int]]:
    return [(span[0], span[1] // 2), (span[0] + span[1] // 2, span[1] - span[1] // 2)]


def _thirds(span: tuple[int, int]) -> list[tuple[int, int]]:
    n = span[1] // 3
    return [(span[0], n), (span[0] + n, n), (span[0] + 2 * n, span[1] - 2 * n)]


def _keyed(rows: DataFrame, keys: list[tuple[int, Column]]) -> DataFrame:
    """A row for each chain and key: chain, key, fp."""

    def named(chain: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(chain).alias("chain"), x.alias("key")))

    lists = [named(c, k) for c, k in keys]
    return rows.select("fp", F.explode(F.concat(*lists)).alias("_k")).select("_k.chain", "_k.key", "fp")


def _paired(index: DataFrame, probes: DataFrame, distance: int) -> DataFrame:
    """Pairs a < b of an indexed and a probing fingerprint within the distance.

    Spark takes either side for no larger than the fingerprints that it is made from, of which each gives up to
    some 70 rows; by that guess it would send one whole through the driver. So both are dealt out, always.
    """
    both = index.withColumnRenamed("fp", "a").hint("merge").join(probes.withColumnRenamed("fp", "b").hint("merge"), ["chain", "key"])
    near = both.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(distinct: DataFrame, crowded: int = CROWDED, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at most ``distance`` bits apart, each once; 2 is the most."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the segments serve distances up to {DISTANCE}")
    shared_folder(distinct.sparkSession)
    ring = [(SEGMENTS[i], SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]) for i in range(3)]
    index = _keyed(distinct, [(i, F.array(_masked(s, t))) for i, (s, t, _) in enumerate(ring)])
    probes = _keyed(distinct, [(i, _probes([s], t)) for i, (s, t, _) in enumerate(ring)])
    full = index.groupBy("chain", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("chain", "key").checkpoint()
    if full.isEmpty():
        return _paired(index, probes, distance).distinct()
    thin = _paired(index.join(full, ["chain", "key"], "left_anti"), probes, distance)

    # Crowded buckets: chains over the last segment too. Their rows keep only the fingerprints concerned.
    again_index, again_probes = [], []
    for i, (s, t, u) in enumerate(ring):
        own = full.where(F.col("chain") == i).select(F.col("key").alias("own"))
        inside = distinct.withColumn("own", _masked(s, t)).join(own, "own", "left_semi").select("fp")
        reach = distinct.select("fp", F.explode(_probes([s], t)).alias("own")).join(own, "own", "left_semi").select("fp", F.col("own").alias("_own"))
        thirds, halves = _thirds(u), _halves(u)
        # Both segments equal: 2 differences left in the last one.
        chains = [(10 * i + 100 + j, [s, t, thirds[j]], thirds[(j + 1) % 3]) for j in range(3)]
        again_index.append(_keyed(inside, [(c, F.array(_masked(*same, near))) for c, same, near in chains]))
        again_probes.append(_keyed(inside, [(c, _probes(same, near)) for c, same, near in chains]))
        # One difference in the second segment: 1 left, so half of the last one is equal.
        again_index.append(_keyed(inside, [(10 * i + 105 + j, F.array(_masked(s, t, half))) for j, half in enumerate(halves)]))
        flipped = reach.where(F.col("_own") != _masked(s, t))
        again_probes.append(_keyed(flipped, [(10 * i + 105 + j, F.array(F.col("_own").bitwiseOR(_masked(half)))) for j, half in enumerate(halves)]))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return thin.unionByName(_paired(union(again_index), union(again_probes), distance)).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node in ``edges`` (a, b), by alternating stars."""
    shared_folder(edges.sparkSession)
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node go to its smallest neighbour, or to itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("root").alias("a"), "b").where("a < b").distinct()
        # Small star: a node and its neighbours below go to the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(down, "b")
        now = small.select("root", F.explode(F.array("a", "b")).alias("b")).where("root < b").select(F.col("root").alias("a"), "b").distinct().checkpoint()
        # In the end the edges are one star for each component, and stay so.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
    raise RuntimeError(f"components are not found after {rounds} rounds")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """id, text_key, fp and component_id (the smallest id of the group) of every row."""
    shared_folder(docs.sparkSession)
    prints = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    vertices = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(vertices.select("fp"), crowded, distance)).select(F.col("node").alias("fp"), "root")
    placed = vertices.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A key of its own form makes the join deal out both sides anew, so that Spark can split a large group.
    turned = F.bitwise_not("root").alias("turned")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(turned, "component_id")
    classes = placed.withColumn("turned", F.bitwise_not("root")).join(named, "turned").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "text_key", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows that hold their group's smallest id; rows that repeat its id and text stay with it."""
    groups = near_groups(docs, id_col, text_col, shingle=shingle, distance=distance)
    kept = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (F.xxhash64(docs[text_col]) == kept["__key"]), "left_semi")
