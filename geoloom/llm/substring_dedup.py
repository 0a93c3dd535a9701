"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Each window has a minimiser, the smallest hash
of its runs of ``gram`` words; equal windows have equal minimisers. Consecutive windows that share
their minimiser form a super-k-mer, a packed string of words.

1. One pass lists each text's super-k-mers: minimiser, a 128-bit digest of the string, place. Of equal
   whole texts only the smallest document goes on; the others lose all words of their windows.
2. Minimisers of a single text can't hold a window of another and are left out. Equal strings of a
   minimiser are counted as one, with their smallest document (map-side aggregation). Any other
   document that holds the string loses all of it.
3. What is left to compare are the different strings of a minimiser, each of its smallest document alone.
   They travel packed to the minimiser's bucket, where windows are ranked by sorting, doubling the
   ranked length from 1 word to ``width``, on exact word numbers. A window's smallest document is found so.
4. The strings of a minimiser with more than ``most`` of them are dealt out again: they are the texts of
   another run of these steps, with other hashes and a longer ``gram``. The third run's ``gram`` is a
   window itself, so that a bucket of any size is split, and equal windows still meet.
5. Words covered by a window that also starts in a document with a smaller id are removed.

Defined results: a null text has no words; documents with fewer words than a window lose none. Windows
are judged on the input. A row with a null id is compared with none and loses nothing. Rows that repeat
an id are parts of one document: they take nothing from each other and each gives a row. Windows that a
document repeats by itself stay. A text longer than two chunks is cut in slices that share the words of
a window, and comes out the same. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Words, mixed, parts, shared_folder, ship, sliced, text_bytes, window_hashes, within

#: Words of a window, and of the runs that a minimiser is taken of.
WIDTH, GRAM = 50, 8
#: Different strings that a minimiser's bucket holds; with more of them it is dealt out again.
MOST = 2_048
#: Windows of one super-k-mer; a longer run of windows makes several.
LONGEST = 64
#: Packed text of the groups that a bucket's task sorts at once.
SORTED_BYTES = 4 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(words: Words, width: int, gram: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer; a window is named by its first word."""
    none = np.zeros(0, dtype=np.int64)
    windows = np.flatnonzero(within(words, width))
    if not len(windows):
        return none, none, none
    grams = window_hashes(words.hashes(), gram)
    if level:
        grams = mixed(grams ^ np.uint64(level))
    least = mixed(sliding_least(grams, width - gram + 1))[windows].view(np.int64)
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (windows[1:] != windows[:-1] + 1)
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(windows)))
    pieces = -(-sizes // LONGEST)
    if (pieces > 1).any():
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(begins, pieces) + LONGEST * step
        sizes = np.minimum(LONGEST, np.repeat(sizes, pieces) - LONGEST * step)
    # A document's first windows follow another's last, so a run never crosses documents.
    return windows[begins], sizes, least[begins]


def _owners(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, side="right") - 1


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _cut(docs: DataFrame, width: int, gram: int, level: int) -> DataFrame:
    """id, row, print (a number of the whole text), n_words, and each super-k-mer's mm, high and low (its digest), at and n (words)."""
    fields = ["mm", "high", "low", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                raw, ends = text_bytes(part.column("text"))
                prints = [xxhash.xxh3_128_digest(memoryview(raw[x:y])) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                found, owners, total = [], [], 0
                for words, base, _ in sliced(part.column("text"), width - 1):
                    at, sizes, mm = super_kmers(words, width, gram, level)
                    owner = _owners(words, at)
                    packed, starts, stops = words.packed()
                    spans = zip(starts[at].tolist(), stops[at + sizes + width - 2].tolist(), strict=True)
                    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(packed[x:y]) for x, y in spans]), dtype=np.int64).reshape(-1, 2)
                    found.append((mm, halves[:, 0], halves[:, 1], at - words.first[:-1][owner] + base, sizes + width - 1))
                    owners.append(owner)
                    total = words.counts + base
                bounds = np.searchsorted(np.concatenate(owners), np.arange(part.num_rows + 1))
                lists = [_lists(np.ascontiguousarray(np.concatenate(x)), bounds) for x in zip(*found, strict=True)]
                yield pa.record_batch([part.column("id"), part.column("row"), pa.array(prints, pa.binary()), pa.array(total.astype(np.int64)), *lists], names=["id", "row", "print", "n_words", *fields])

    rows = docs.select("id", "row", "text").where("id is not null")
    return rows.mapInArrow(run, "id bigint, row bigint, print binary, n_words bigint, " + ", ".join(f"{x} array<bigint>" for x in fields))


def _strings(asked: DataFrame, width: int, gram: int, level: int) -> DataFrame:
    """mm, id, row, at, kmer: the packed strings of the super-k-mers that begin at the places in ``asked``."""
    names = ["mm", "id", "row", "at", "kmer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in parts(batch.filter(batch.column("asked").is_valid())):
                # Rows come sorted, so that a row that is there a thousand times is cut once.
                keys = list(zip(part.column("id").to_pylist(), part.column("row").to_pylist(), strict=True))
                fresh = [k != b for k, b in zip(keys, [last, *keys], strict=False)]
                last = keys[-1]
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                wanted = [np.sort(x.values.to_numpy()) for x in part.column("asked")]
                for words, base, _ in sliced(part.column("text"), width - 1):
                    at, sizes, mm = super_kmers(words, width, gram, level)
                    owner = _owners(words, at)
                    place = at - words.first[:-1][owner] + base
                    bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                    chosen = np.concatenate([np.isin(place[x:y], own) for x, y, own in zip(bounds[:-1], bounds[1:], wanted, strict=True)])
                    at, sizes, mm, owner, place = (x[chosen] for x in (at, sizes, mm, owner, place))
                    packed, starts, stops = words.packed()
                    begin, end = starts[at], stops[at + sizes + width - 2]
                    for x in range(0, len(at), 4096):
                        own = slice(x, x + 4096)
                        rows = pa.array(owner[own])
                        kmers = pa.array([packed[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)], pa.binary()).cast(pa.string())
                        yield pa.record_batch([pa.array(mm[own]), part.column("id").take(rows), part.column("row").take(rows), pa.array(place[own]), kmers], names=names)

    return asked.mapInArrow(run, "mm bigint, id bigint, row bigint, at bigint, kmer string")


def window_ranks(kmers: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window, equal for equal windows alone, and the strings' first windows (n + 1)."""
    known: dict[str, int] = {}
    number: list[int] = []
    counts = []
    for kmer in kmers:
        own = kmer.split(" ")
        number += [known.setdefault(w, len(known)) for w in own]
        counts.append(len(own))
    rank = np.array(number, dtype=np.int64)
    length = 1
    while length < width:
        step = min(length, width - length)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        length += step
    counts = np.array(counts)
    begins = np.cumsum(counts) - counts
    windows = counts - width + 1
    at = np.concatenate([[0], np.cumsum(windows)])
    return rank[np.arange(at[-1]) + np.repeat(begins - at[:-1], windows)], at


def _covered(windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words that ascending windows cover; windows next to each other make one."""
    new = np.ones(len(windows), dtype=bool)
    new[1:] = windows[1:] > windows[:-1] + width
    last = np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)
    return windows[new], windows[last] + width


def _bucket(mm: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray, kmers: list[str], width: int) -> list[tuple]:
    """id, row, start, end of the words that whole groups of a minimiser remove."""
    # Equal strings of a group are one, with its smallest document; a group with one string needs no windows.
    strings: dict[tuple, int] = {}
    which = np.array([strings.setdefault(x, len(strings)) for x in zip(mm.tolist(), kmers, strict=True)])
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    group = np.array([m for m, _ in strings])
    values, place, several = np.unique(group, return_inverse=True, return_counts=True)
    mixed_up = several[place] > 1
    out = []
    texts = [k for _, k in strings]
    best: dict[int, np.ndarray] = {}
    picked = np.flatnonzero(mixed_up)
    if len(picked):
        rank, first = window_ranks([texts[k] for k in picked], width)
        document = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(document, rank, np.repeat(least[picked], np.diff(first)))
        best = {int(k): document[rank[x:y]] for k, x, y in zip(picked, first[:-1], first[1:], strict=True)}
    for k, (s, d, r, a) in enumerate(zip(which.tolist(), ids.tolist(), rows.tolist(), at.tolist(), strict=True)):
        if s in best:
            gone = np.flatnonzero(best[s] < d)
            if len(gone):
                out += [(d, r, a + int(x), a + int(y)) for x, y in zip(*_covered(gone, width), strict=True)]
        elif least[s] < d:
            out.append((d, r, a, a + kmers[k].count(" ") + 1))
    return out


def _sorted_buckets(kmers: DataFrame, width: int) -> DataFrame:
    """id, row, start, end from super-k-mers that come sorted by minimiser."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        column = lambda name: rows.column(name).to_numpy()
        found = _bucket(column("mm"), column("id"), column("row"), column("at"), rows.column("kmer").to_pylist(), width)
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], names=["id", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in parts(batch, "kmer", SORTED_BYTES):
                held.append(part)
                size += part.nbytes
                mm = part.column("mm").to_numpy()
                cut = int(np.searchsorted(mm, mm[-1]))
                if size >= SORTED_BYTES and cut:
                    # The last minimiser may go on in the next rows.
                    held[-1] = part.slice(0, cut)
                    yield spans(held)
                    held = [part.slice(cut)]
                    size = held[0].nbytes
        if held:
            yield spans(held)

    return kmers.mapInArrow(run, "id bigint, row bigint, start bigint, end bigint")


def _with(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what ``lists`` has for them. Always this join, so that whole texts are dealt out once."""
    return docs.join(lists.hint("merge"), ["id", "row"], "left")


def removed_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST, level: int = 0) -> DataFrame:
    """id, row, start, end: words that go, counted from 0 in each row; spans may overlap. ``docs``: id, row, text."""
    shared_folder(docs.sparkSession)
    cut = _cut(docs, width, gram, level).checkpoint()
    # Equal whole texts. Keys of a form of their own make joins deal out both sides anew, so that Spark can split a hot one.
    several = cut.groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("final")).where("first < final")
    copies = cut.select("id", "row", "n_words", F.struct("print").alias("key")).join(several.select(F.struct("print").alias("key"), "first"), "key").where("id > first").select("id", "row", "n_words").distinct()
    each = cut.select("id", "row", F.xxhash64("print").alias("text"), F.explode(F.arrays_zip("mm", "high", "low", "at", "n")).alias("k")).select("id", "row", "text", "k.*")
    shared = each.groupBy("mm").agg(F.min("text").alias("one"), F.max("text").alias("other")).where("one < other")
    turned = F.bitwise_not("mm").alias("turned")
    met = each.select("id", "row", turned, "high", "low", "at", "n").join(shared.select(turned), "turned").withColumn("mm", F.bitwise_not("turned"))
    met = met.join(copies.select("id", "row"), ["id", "row"], "left_anti").select("mm", "high", "low", "id", "row", "at", "n").checkpoint()

    strings = met.groupBy("mm", "high", "low").agg(F.min("id").alias("least"), F.max("id").alias("top"))
    buckets = strings.groupBy("mm").agg(F.count("*").alias("strings"), F.min("least").alias("least"), F.max("least").alias("top")).where("strings > 1 and least < top").select("mm", (F.col("strings") > most).alias("hot"))
    key = F.struct("mm", "high", "low").alias("key")
    held = met.select(key, "id", "row", "at", "n")
    whole = held.join(strings.where("least < top").select(key, "least"), "key").where("least < id").select("id", "row", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
    whole = whole.unionByName(copies.where(F.col("n_words") >= width).select("id", "row", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))

    mixed_up = strings.select(turned, "high", "low", "least").join(buckets.select(turned, "hot"), "turned")
    mixed_up = mixed_up.select(F.struct(F.bitwise_not("turned").alias("mm"), "high", "low").alias("key"), "least", "hot")
    asked = held.join(mixed_up, "key").where("id = least")
    listed = lambda which: _with(docs, asked.where(which).groupBy("id", "row").agg(F.collect_set("at").alias("asked")))
    packed = _strings(listed("not hot"), width, gram, level)
    spans = whole.unionByName(_sorted_buckets(packed.repartition("mm").sortWithinPartitions("mm"), width))
    if gram == width or buckets.where("hot").isEmpty():
        return spans
    again = _strings(listed("hot"), width, gram, level).select("id", F.col("row").alias("own"), "at", F.xxhash64("row", "at").alias("row"), F.col("kmer").alias("text")).checkpoint()
    found = removed_spans(again.select("id", "row", "text"), width, width if level else (gram + width) // 2, most, level + 1)
    found = found.join(again.drop("text"), ["id", "row"]).select("id", F.col("own").alias("row"), (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"))
    return spans.unionByName(found)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row.

    ``id_col`` is an integer column.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    gone = removed_spans(rows, width, gram, most).groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                lists = part.column("gone")
                spans = [(k, lists[k].values.field("start").to_numpy(), lists[k].values.field("end").to_numpy()) for k in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist()]
                texts, total, n_removed = [[] for _ in range(part.num_rows)], 0, np.zeros(part.num_rows, dtype=np.int64)
                for words, base, _ in sliced(part.column("text"), 0):
                    packed, starts, ends = words.packed()
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for k, start, end in spans:
                        x, y = words.first[k], words.first[k + 1]
                        np.add.at(change, np.clip(start - base, 0, y - x) + x, 1)
                        np.add.at(change, np.clip(end - base, 0, y - x) + x, -1)
                    kept = np.cumsum(change[:-1]) == 0
                    for k, (x, y) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                        own = np.flatnonzero(kept[x:y]) + x
                        n_removed[k] += y - x - len(own)
                        # Neighbours that stay are taken as one run.
                        new = np.flatnonzero(np.diff(own, prepend=-2) > 1)
                        begins, lasts = own[new], own[np.append(new[1:], len(own)) - 1] if len(own) else own
                        texts[k] += [packed[a:b] for a, b in zip(starts[begins].tolist(), ends[lasts].tolist(), strict=True)]
                    total = words.counts + base
                kept_text = pa.array([b" ".join(x) for x in texts], pa.binary()).cast(pa.string())
                yield pa.record_batch([part.column("id"), pa.array(total.astype(np.int64)), pa.array(n_removed), kept_text], names=["id", "n_words", "n_removed", "kept_text"])

    return _with(rows, gone).mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept_text string")
