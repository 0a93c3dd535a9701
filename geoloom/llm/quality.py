"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Every text's n-grams of bytes (over its words, joined by one space) are hashed to a fixed number of
buckets. Two multinomials with additive smoothing are counted: one over a bounded number of trusted
rows (the target), one over all rows (the raw corpus). A document's score is the mean over its
n-grams of log(target / raw); it is kept if no base rule failed and the score reaches the threshold.

The counts of the raw corpus cover every document. Weights have one number for each bucket, whatever
the input, so sending them to the workers is bounded.

Defined results: a null or empty text has no words and fails the base rules. Texts shorter than an
n-gram score 0. Without trusted rows the ratio is 0 everywhere and only the base rules decide.
Repeated rows each give a row; a null id is returned as it is. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Words, mixed, parts, ship, text_bytes, window_hashes, within

#: Bytes of an n-gram, and buckets as a power of two.
GRAM, BUCKET_BITS = 4, 16
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Nats an n-gram. Running text scores near 0, whatever its language has in the corpus; junk far below.
THRESHOLD = -0.5
#: At most so many trusted rows are used, those with the smallest hashes of their ids.
TRUSTED_ROWS = 20_000
#: Base rules.
LEAST_WORDS, REPEATED_PERCENT = 50, 50

#: Columns that a text is measured by.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and the places where each text's n-grams begin (n + 1)."""
    packed, starts, ends = words.packed()
    raw = np.frombuffer(packed, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(raw) - GRAM + 1)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        value = (value << np.uint64(8)) | raw[j : j + n]
    bucket = ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    some = words.counts > 0
    begin, end = np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int64)
    begin[some], end[some] = starts[words.first[:-1][some]], ends[words.first[1:][some] - 1]
    sizes = np.maximum(0, end - begin - GRAM + 1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(at[-1]) + np.repeat(begin - at[:-1], sizes)
    return bucket[place], at


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def bucket_counts(docs: DataFrame, trusted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """bucket, raw, target: n-grams of all rows, and of the rows whose id is in ``trusted`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BUCKET_BITS, dtype=np.int64), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for part in parts(batch):
                found, at = grams(Words(*text_bytes(part.column("text"))))
                raw += np.bincount(found, minlength=len(raw))
                good = np.isin(np.array(part.column("id").fill_null(-(1 << 62))), trusted)
                if good.any():
                    target += np.bincount(found[np.repeat(good, np.diff(at))], minlength=len(raw))
        some = np.flatnonzero(raw)
        for x in range(0, len(some), 8192):
            own = some[x : x + 8192]
            yield pa.record_batch([pa.array(own), pa.array(raw[own]), pa.array(target[own])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(target / raw) of each bucket. ``labels``: id_col, quality, toxic; trusted is quality 1 and not toxic."""
    ship(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    ids = [r.id for r in good.orderBy(F.xxhash64("id"), "id").limit(trusted_rows).collect()]
    rows = bucket_counts(docs, np.sort(np.array(ids, dtype=np.int64)), id_col, text_col).collect()
    raw, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(1 << BUCKET_BITS)
    share = lambda x: np.log(x + SMOOTHING) - np.log(x.sum() + SMOOTHING * len(x))
    return share(target) - share(raw)


def repeated_words(words: Words) -> np.ndarray:
    """For each text, its words inside windows of 3 words that the text has twice or more."""
    hashes = window_hashes(words.hashes(), 3)
    owner = words.owner()
    valid = np.flatnonzero(within(words, 3))
    key = mixed(hashes[valid] + owner[valid].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    by = np.argsort(key, kind="stable")
    place = valid[by]
    same = (key[by][1:] == key[by][:-1]) & (owner[place][1:] == owner[place][:-1])
    twice = np.zeros(len(by), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words) + 2, dtype=bool)
    for j in range(3):
        covered[place[twice] + j] = True
    return _sums(covered[: len(words)].astype(np.int64), words.first)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measured(texts: pa.Array, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and the score of each text."""
    raw, rows = text_bytes(texts)
    words = Words(raw, rows)
    found, at = grams(words)
    points = (raw & 0xC0) != 0x80
    gaps = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    data = raw.tobytes()
    sizes = np.diff(at)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _sums((points & ~gaps).astype(np.int64), rows),
        "n_symbols": _sums(_SYMBOL[raw].astype(np.int64), rows),
        "n_dup_lines": np.array([repeated_lines(data[x:y]) for x, y in zip(rows[:-1], rows[1:], strict=True)], dtype=np.int64),
        "n_repeat_words": repeated_words(words),
        # Each text's weights are summed by themselves, so that a score doesn't depend on a text's neighbours.
        "score": np.array([weight[found[x:y]].sum() for x, y in zip(at[:-1], at[1:], strict=True)]) / np.maximum(1, sizes),
    }


def _weigh(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, trusted_rows: int):
    spark = ship(docs.sparkSession)
    return spark.sparkContext.broadcast(weights(docs, labels, id_col, text_col, trusted_rows))


def _verdict(threshold: float) -> tuple[F.Column, F.Column]:
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words")
    return failed, ~failed & (F.col("score") >= F.lit(float(threshold)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept for every row."""
    weight = _weigh(docs, labels, id_col, text_col, trusted_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = measured(part.column("text"), weight.value)
                yield pa.record_batch([part.column("id"), *[pa.array(found[x]) for x in MEASURES]], names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{x} bigint" for x in MEASURES[:-1]) + ", score double")
    failed, kept = _verdict(threshold)
    return rows.select("*", failed.alias("base_failed"), kept.alias("kept"))


def select_kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The rows that are kept, with all their columns; one pass over them, without a join."""
    weight = _weigh(docs, labels, id_col, text_col, trusted_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text_col):
                found = measured(part.column(text_col), weight.value)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEATED_PERCENT * found["n_words"])
                yield part.filter(pa.array(~failed & (found["score"] >= threshold)))

    return docs.mapInArrow(run, docs.schema)
