"""URL filters by a temporal list join.

A list is a history of dated entries: from its date on, an entry blocks or allows a domain (with its
subdomains) or a path prefix, or lifts what was said before. Entries become validity intervals. Every
capture is held against the entries that were active when it was fetched; the most specific decides.

A capture asks for each of its host's suffixes and its path's prefixes (as many as it has labels and
segments), so the join is an equality join on the asked key and a span of time, and Spark splits it
where a host is skewed. The as-of condition then picks the interval. JVM functions only.

Defined results: a null url, or one without a host, asks for nothing and is not blocked; nor is a
capture without a time. Entries without a key, date or known action are passed over. Of entries with
the same key and date, "block" wins over "allow", and "allow" over "lift". Captures that repeat id,
url and time make one row. Without a list nothing is blocked. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one span of time; an interval is listed in each span that it touches.
SPAN = 30 * 86400


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (null: still valid) from entries (kind, value, action, dated).

    ``kind`` is "domain" or "prefix"; a key is the kind's first letter, a colon and the value in lower case
    without a slash at its end.
    """
    known = F.array_position(F.array(F.lit("lift"), F.lit("allow"), F.lit("block")), F.col("action"))
    value = F.regexp_replace(F.lower(F.trim("value")), "/+$", "")
    rows = entries.select(F.concat(F.substring("kind", 1, 1), F.lit(":"), value).alias("key"), "action", F.col("dated").alias("valid_from"), known.alias("_rank"))
    rows = rows.where("key is not null and valid_from is not null and _rank > 0")
    # One entry for each key and date, then each lasts until the key's next.
    rows = rows.groupBy("key", "valid_from").agg(F.max_by("action", "_rank").alias("action"))
    after = Window.partitionBy("key").orderBy("valid_from")
    return rows.withColumn("valid_to", F.lead("valid_from").over(after)).where("action <> 'lift'")


def host_of(url: Column) -> Column:
    """The host, lower-cased, without user, port or a dot at its end; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def asked_keys(url: Column) -> Column:
    """An array of the keys that a url asks for: d:suffix of each suffix of the host, p:host/path of each prefix."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.filter(F.split(F.lower(path_of(url)), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments)),
        lambda k: F.concat_ws("/", F.concat(F.lit("p:"), host_of(url)), F.when(k > 0, F.array_join(F.slice(segments, 1, k), "/"))),
    )
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(suffixes, prefixes)))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", span: int = SPAN) -> DataFrame:
    """id, url, fetched, blocked, rule, valid_from, valid_to of every capture; rule is the key that decided, or null."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    bin_of = lambda t: F.floor(F.unix_seconds(t) / span)
    listed = intervals(entries)
    # An open interval lasts to the last capture.
    last = rows.agg(F.max(bin_of(F.col("fetched"))).alias("_last"))
    begin, end = bin_of(F.col("valid_from")), F.coalesce(bin_of(F.col("valid_to")), F.col("_last"))
    listed = listed.join(F.broadcast(last)).where(begin <= F.col("_last"))
    listed = listed.withColumn("bin", F.explode(F.sequence(begin, F.greatest(begin, F.least(end, F.col("_last")))))).drop("_last")
    asked = rows.select("*", bin_of(F.col("fetched")).alias("bin"), F.explode_outer(asked_keys(F.col("url"))).alias("key"))
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    found = asked.join(listed.withColumnRenamed("key", "rule").withColumnRenamed("bin", "_bin"), (F.col("key") == F.col("rule")) & (F.col("bin") == F.col("_bin")) & active, "left")
    # Longer keys are more specific; of equally long ones, a path's before a domain's.
    best = F.max_by(F.struct("action", "rule", "valid_from", "valid_to"), F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule")))
    return found.groupBy("id", "url", "fetched").agg(best.alias("_best")).select(
        "id", "url", "fetched", F.coalesce(F.col("_best.action") == "block", F.lit(False)).alias("blocked"), "_best.rule", "_best.valid_from", "_best.valid_to"
    )
