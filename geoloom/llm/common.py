"""Shared pieces: tables, and words of Arrow text columns as numpy arrays.

Words are runs of ``[^\\x20\\x09-\\x0D]``. All of these bytes are ASCII, so a word boundary can be
found on UTF-8 bytes, and whole batches are cut without a loop over documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from geoloom import shipping
from geoloom.shipping import shared_folder

__all__ = ["Words", "mixed", "parts", "shared_folder", "ship", "sliced", "table", "text_bytes", "window_hashes", "within"]

#: Text that is handled at once in a worker; a longer text is handled alone, whole.
CHUNK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Bytes of a batch that goes to a worker; a longer row goes alone. Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64MB")


def ship(spark: SparkSession) -> SparkSession:
    """As ``shipping.ship``, with smaller batches where the session leaves Spark's limit as it is."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT[0]) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return shipping.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, each of one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes, one row after another, and the n + 1 places where rows begin; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    held = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(held) + 1 + held.offset)[held.offset :]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(held) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


class Words:
    """Words of several texts: ``starts`` and ``ends`` in ``raw``, and ``first``, each text's first word (n + 1)."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray):
        self.raw, self.rows = raw, rows
        n = len(raw)
        separator = _SEPARATOR[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[rows] = True
        word = ~separator
        begins, stops = word.copy(), word.copy()
        if n:
            begins[1:] &= separator[:-1] | edge[1:n]
            stops[:-1] &= separator[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, rows)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Words with one space after each, and each word's start and end in there."""
        lengths = self.ends - self.starts
        to = np.cumsum(lengths + 1)
        starts = to - lengths - 1
        out = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
        keep = ~_SEPARATOR[self.raw]
        inside = np.ones(len(out), dtype=bool)
        inside[to - 1] = False
        out[inside] = self.raw[keep]
        return out.tobytes(), starts, to - 1

    def hashes(self) -> np.ndarray:
        """64 bits a word, from its bytes alone."""
        return span_hashes(self.raw, self.starts, self.ends)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for lengths up to two chunks."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1), base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = held
    return held[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (in order, apart), from running sums modulo 2 ** 64, a slice at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + CHUNK_BYTES, side="right"))
        if to <= at:
            # One long span: the sums of its slices, each moved to its place.
            total = 0
            for x in range(base, int(ends[at]), CHUNK_BYTES):
                own = raw[x : min(int(ends[at]), x + CHUNK_BYTES)].astype(np.uint64) + np.uint64(1)
                total += int((own * powers(_BASE, len(own))).sum(dtype=np.uint64)) * pow(_BASE, x - base, 1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        n = int(ends[to - 1]) - base
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw[base : base + n].astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        own = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[own]) * powers(_INVERSE, n + 1)[own]
        at = to
    return mixed(out ^ (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mixed(out)


def within(words: Words, width: int) -> np.ndarray:
    """Which of the runs of ``width`` words that begin at each word end in the same text."""
    n = len(words)
    last = np.repeat(words.first[1:], words.counts)
    return (np.arange(n) + width <= last)[: max(0, n - width + 1)]


def sliced(texts: pa.Array, overlap: int) -> Iterator[tuple[Words, int, bool]]:
    """Words of the texts, the place in its text of the first word, and whether the texts end there.

    A single text longer than two chunks comes in slices; each but the first begins with the last
    ``overlap`` words of the one before. Several texts come whole, at once.
    """
    raw, rows = text_bytes(texts)
    if len(rows) != 2 or len(raw) <= 2 * CHUNK_BYTES:
        yield Words(raw, rows), 0, True
        return
    at, base, size = 0, 0, CHUNK_BYTES
    while True:
        to = min(len(raw), at + size)
        while to < len(raw) and not _SEPARATOR[raw[to]]:
            gaps = _SEPARATOR[raw[to : to + CHUNK_BYTES]]
            to += int(gaps.argmax()) if gaps.any() else len(gaps)
        words = Words(raw[at:to], np.array([0, to - at]))
        if to < len(raw) and len(words) <= overlap:
            size *= 2
            continue
        yield words, base, to == len(raw)
        if to == len(raw):
            return
        step = len(words) - overlap
        base += step
        at = at + int(words.starts[step]) if overlap else to
        size = CHUNK_BYTES
