"""Exact dedup by progressive refinement.

Rows are grouped by length, then by a hash of a prefix, then by a hash of the whole text. Each level
sees only rows whose group at the level before had another row. Groups are counted with map-side
aggregation, so one group of copies may hold any share of the rows. Whole texts are hashed where they
are read, of rows whose length and prefix pass a bit filter of the groups that are left, so no text is
dealt out for a decision. What the filter lets through by chance is alone with its whole hash.

Defined results: a null text counts as empty. A null id is a value of its own and smaller than any
other. Of equal texts the row with the largest id stays; rows that repeat id and text make one row
in the decisions, and count each in group_size. An empty table gives no rows. Other columns are not
looked at by ``decide``; ``deduplicate`` returns them as they are (of rows that repeat the id that
stays, any one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import shared_folder

#: Characters that the second level hashes.
PREFIX = 64
#: Bits of the filter, as a power of two: 2 MB whatever the input. A fuller one only lets more through.
FILTER_BITS = 24
#: Rows to remove up to which they are sent to every task (about 120 bytes each); more are joined by shuffle.
MOST_SENT = 50_000

_KEYS = ["id", "size", "head"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("size"), F.xxhash64(F.substring(text, 1, prefix)).alias("head"))


def candidates(rows: DataFrame) -> DataFrame:
    """size, head of the groups that have another row after the first two levels."""
    heads = rows.groupBy("size", "head").agg(F.count("*").alias("n"))
    # Lengths are joined by a key of its own form, so that both sides are dealt out anew and a hot one can be split.
    lengths = heads.groupBy("size").agg(F.sum("n").alias("n")).where("n > 1").select(F.struct("size").alias("key"))
    return heads.withColumn("key", F.struct("size")).join(lengths, "key", "left_semi").where("n > 1").select("size", "head")


def _filter(groups: DataFrame) -> DataFrame:
    """One row with the filter's words, in which each group has set its bit."""
    slot = F.xxhash64("size", "head").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    set_bits = groups.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64(size, head) & {63} as int))").alias("bits"))
    zeros = groups.sparkSession.range(1 << FILTER_BITS - 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("_filter"))


def _passes() -> Column:
    word = f"get(_filter, cast(shiftright(xxhash64(size, head) & {(1 << FILTER_BITS) - 1}L, 6) as int))"
    return F.expr(f"shiftrightunsigned({word}, cast(xxhash64(size, head) & 63 as int)) & 1 = 1")


def _decided(docs: DataFrame, id_col: str, text_col: str, prefix: int, every: bool) -> DataFrame:
    """As ``decide``, with times, the rows that have this id and text."""
    rows = _keyed(docs, id_col, text_col, prefix)
    flagged = rows.join(F.broadcast(_filter(candidates(rows))))
    whole = F.sha2("text", 256)
    left = flagged.where(_passes()).select(*_KEYS, whole.alias("digest")).groupBy(*_KEYS, "digest").agg(F.count("*").alias("times"))
    groups = left.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size"))
    groups = groups.select(F.struct("digest").alias("key"), "keep_id", "group_size")
    shared = left.withColumn("key", F.struct("digest")).join(groups, "key").drop("key").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    one = F.lit(1).cast("bigint")
    alone = flagged.where(~_passes()).select(*_KEYS, (whole if every else F.lit(None).cast("string")).alias("digest"), one.alias("times"), F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"))
    return shared.unionByName(alone)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, every: bool = False) -> DataFrame:
    """One row for each id and text: id, size, head, digest, keep_id, group_size, kept.

    digest is the SHA-256 of the whole text; null where an earlier level told the text apart, unless
    ``every`` is set.
    """
    return _decided(docs, id_col, text_col, prefix, every).drop("times")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows that stay, with all their columns. Rows that go are named by narrow keys and joined away."""
    shared_folder(docs.sparkSession)
    marks = _decided(docs, id_col, text_col, prefix, False).where("not kept or times > 1").select(*[F.col(c).alias(f"__{c}") for c in (*_KEYS, "digest", "kept")]).checkpoint()
    text = F.coalesce(F.col(text_col), F.lit(""))

    def same(found: DataFrame) -> Column:
        near = docs[id_col].eqNullSafe(found["__id"]) & (F.octet_length(text) == found["__size"]) & (F.xxhash64(F.substring(text, 1, prefix)) == found["__head"])
        return near & (F.sha2(text, 256) == found["__digest"])

    sent = lambda found: F.broadcast(found) if found.count() <= most_sent else found
    going = sent(marks)
    stay = docs.join(going, same(going), "left_anti")
    repeated = marks.where("__kept")
    if repeated.isEmpty():
        return stay
    again = sent(repeated)
    one = docs.join(again, same(again)).dropDuplicates(["__id", "__digest"]).select(*[docs[c] for c in docs.columns])
    return stay.unionByName(one)
