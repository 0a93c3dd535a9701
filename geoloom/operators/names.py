"""Looking up names: cleaned, by weighted edits, by segments, ranked by BM25."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import clean_name, tokens, weighted_edit_distance, within_edits
from geoloom.sources.model import Dataset

# The tags that hold names, the tiers of the lookup and BM25's constants.
NAME_KEYS = ("name", "name:zh")
NEAR, FAR, CANDIDATES = 3, 5, 5
K1, B = 1.2, 0.75


def node_names(ds: Dataset) -> DataFrame:
    """id, name (as it is) of all named nodes."""
    return ds.node_tags.where(F.col("k").isin(*NAME_KEYS)).select(F.col("node_id").alias("id"), F.col("v").alias("name"))


def way_names(ds: Dataset) -> DataFrame:
    return ds.way_tags.where(F.col("k").isin(*NAME_KEYS)).select(F.col("way_id").alias("id"), F.col("v").alias("name"))


def cleaned(names: DataFrame) -> DataFrame:
    """clean_name, id: each id once under each of its cleaned names."""
    return names.select(clean_name(F.col("name")).alias("clean_name"), "id").distinct()


def name_index(names: DataFrame) -> DataFrame:
    """clean_name, ids (sorted)."""
    return cleaned(names).groupBy("clean_name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def edit_matches(words: DataFrame, text: str, most: int) -> DataFrame:
    """clean_name, distance of the words (``clean_name``) at most ``most`` weighted edits away; near and long first."""
    own = F.lit(text)
    near = words.where(within_edits(F.col("clean_name"), own, most))
    return near.withColumn("distance", weighted_edit_distance(F.col("clean_name"), own)).orderBy("distance", F.desc(F.length("clean_name")), "clean_name")


def similar(names: DataFrame, text: str, most: int | None = None, num: int | None = CANDIDATES) -> DataFrame:
    """clean_name, distance: the name itself if there is one, else those within 3 edits, else within 5.

    ``most`` sets one radius in place of the two; ``num`` None means all.
    """
    spark = names.sparkSession
    own = spark.range(1).select(clean_name(F.lit(text)).alias("own"))
    far = FAR if most is None else most
    words = cleaned(names).select("clean_name").distinct()
    # One row of a literal: the optimizer folds it, and levenshtein stops at the threshold.
    near = words.crossJoin(F.broadcast(own)).where((F.col("clean_name") == F.col("own")) | within_edits(F.col("clean_name"), F.col("own"), far))
    near = near.select("clean_name", weighted_edit_distance(F.col("clean_name"), F.col("own")).alias("distance"))
    least = near.agg(F.min("distance").alias("least"))
    tier = F.when(F.col("least") == 0, 0).when((F.col("least") <= NEAR) & F.lit(most is None), NEAR).otherwise(far)
    found = near.crossJoin(F.broadcast(least)).where(F.col("distance") <= tier).drop("least")
    found = found.orderBy("distance", F.desc(F.length("clean_name")), "clean_name")
    return found if num is None else found.limit(num)


def segments(text: str) -> list[str]:
    """The text's tokens in order, as the default tokenizer cuts them."""
    import regex

    out: list[str] = []
    for word in regex.findall(r"[\p{Han}]+|[\p{L}\p{N}--\p{Han}]+", text, regex.V1):
        out += [word[k : k + 2] for k in range(len(word) - 1)] if regex.fullmatch(r"[\p{Han}]{2,}", word) else [word]
    return out


def like_segments(names: DataFrame, parts: list[str]) -> DataFrame:
    """name: distinct names that hold all parts in this order."""
    escaped = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in parts]
    return names.where(F.col("name").like("%" + "%".join(escaped) + "%")).select("name").distinct()


def is_a(ds: Dataset, text: str, parts: list[str] | None = None) -> DataFrame:
    """id, latitude, longitude, name of visible nodes whose name holds the text's parts or is within 5 edits."""
    known = node_names(ds)
    found = like_segments(known, segments(text) if parts is None else parts)
    found = found.unionByName(similar(known, text, most=FAR, num=None).select(F.col("clean_name").alias("name"))).distinct()
    found = found.withColumn("clean_name", clean_name(F.col("name")))
    ids = cleaned(known).join(found, "clean_name")
    return ds.nodes.where("visible").select("id", "latitude", "longitude").join(ids, "id").select("id", "latitude", "longitude", "name").distinct()


def bm25(names: DataFrame, text: str, tokenize: Callable[[Column], Column] = tokens, full_names_only: bool = False) -> DataFrame:
    """name, score of every distinct name that shares a token with the text.

    idf = ln((N - df + 0.5) / (df + 0.5)), which may be negative; tf is a share of the name's tokens; the
    mean length is cut to a whole number. ``full_names_only`` counts only tokens that are names themselves.
    """
    docs = names.select("name").distinct().withColumn("tokens", tokenize(F.col("name"))).where("size(tokens) > 0")
    docs = docs.withColumn("length", F.size("tokens"))
    totals = docs.agg(F.count("*").alias("n"), F.floor(F.sum("length") / F.count("*")).alias("mean"))
    query = names.sparkSession.range(1).select(F.explode(F.array_distinct(tokenize(F.lit(text)))).alias("token"))
    if full_names_only:
        query = query.join(names.select(F.col("name").alias("token")).distinct(), "token", "left_semi")
    terms = docs.select("name", "length", F.explode("tokens").alias("token")).join(F.broadcast(query), "token")
    terms = terms.groupBy("name", "length", "token").agg(F.count("*").alias("freq"))
    frequency = terms.groupBy("token").agg(F.count("*").alias("df"))
    joined = terms.join(frequency, "token").crossJoin(F.broadcast(totals))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("freq") / F.col("length")
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.groupBy("name").agg(F.sum(weight).alias("score"))


def most_similar(names: DataFrame, text: str, num: int = 1) -> DataFrame:
    """clean_name, score, distance, ids: similar names with the best BM25 score first, then the nearest.

    A cleaned name scores what the best of its names does; 0 without a common token.
    """
    near = similar(names, text)
    scored = bm25(names, text).groupBy(clean_name(F.col("name")).alias("clean_name")).agg(F.max("score").alias("score"))
    ranked = near.join(scored, "clean_name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = ranked.orderBy(F.desc("score"), "distance", "clean_name").limit(num)
    found = best.join(name_index(names), "clean_name")
    return found.select("clean_name", "score", "distance", "ids").orderBy(F.desc("score"), "distance", "clean_name")


def _display(tags: DataFrame, key: str) -> DataFrame:
    named = tags.where(F.col("k").startswith("name"))
    return named.groupBy(F.col(key).alias("_named")).agg(F.min_by("v", F.struct("k", "v")).alias("_name"))


def with_names(rows: DataFrame, tags: DataFrame, key: str, id_col: str, name_col: str) -> DataFrame:
    shown = _display(tags.join(rows.select(F.col(id_col).alias(key)).distinct(), key, "left_semi"), key)
    found = rows.join(shown, rows[id_col] == shown["_named"], "left")
    return found.withColumn(name_col, F.coalesce("_name", F.lit(""))).drop("_named", "_name")


def with_node_names(ds: Dataset, rows: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """The rows with one name for each node: the value of its first key that begins with "name", or ""."""
    return with_names(rows, ds.node_tags, "node_id", id_col, name_col)


def with_way_names(ds: Dataset, rows: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    return with_names(rows, ds.way_tags, "way_id", id_col, name_col)
