"""The queries of this package, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, exact_dedup, html_extract, license_scan, mixing, pii, simhash, substring_dedup, url_filter
from geoloom.llm import quality as quality_rules
from geoloom.llm.common import table

#: Folder of public vocabulary files; the same place on every worker.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: Key of the surrogates; a deployment sets its own.
PII_KEY = os.environ.get("PII_KEY", "surrogates for the test tables")

#: The dated list that op10 applies: kind, value, action, date.
URL_LIST = [
    ("domain", "casino-win.example.com", "block", "2023-11-01"),
    ("domain", "free-bets.example.com", "block", "2024-02-10"),
    ("domain", "free-bets.example.com", "lift", "2024-05-01"),
    ("domain", "free-bets.example.com", "block", "2024-09-15"),
    ("domain", "cheap-pills.example.com", "block", "2024-01-20"),
    ("prefix", "www.cheap-pills.example.com/de", "allow", "2024-06-01"),
    ("domain", "ads-track.example.com", "block", "2024-03-01"),
    ("domain", "spam-farm.example.com", "block", "2023-06-01"),
    ("domain", "spam-farm.example.com", "lift", "2024-10-01"),
    ("domain", "adult-x.example.net", "block", "2022-01-01"),
    ("domain", "blog.adult-x.example.net", "allow", "2024-07-01"),
    ("domain", "blog.adult-x.example.net", "block", "2024-08-01"),
    ("domain", "tionsh.example.com", "block", "2024-04-01"),
    ("domain", "tionsh.example.com", "lift", "2024-04-15"),
    ("prefix", "blog.tionsh.example.com/fr/", "block", "2024-03-10"),
    ("prefix", "tionble.example.org/en", "block", "2024-11-01"),
    ("prefix", "tionble.example.org/en", "allow", "2024-11-01"),
    ("domain", "example.org", "allow", "2024-01-01"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, how many go as repeats, and the digest of those that stay."""
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a time of fetching in 2024, which the table lacks, from their id."""
    return table(spark, sf_dir, "pages").withColumn("fetched", F.expr("timestamp_seconds(1704067200 + 60 * (page_id * 7919 % 527040))"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), os.path.join(TOKENIZERS, "word_bpe_49k.json"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of all documents, dealt out by mix_key."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, the one that stays in its stead, and the digest of its text."""
    decided = exact_dedup.decide(table(spark, sf_dir, "documents"), every=True)
    return decided.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY.encode()).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a license template, its coverage and span."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page at its time of fetching, and the entry that decided."""
    entries = spark.createDataFrame(URL_LIST, "kind string, value string, action string, dated string").withColumn("dated", F.to_timestamp("dated"))
    return url_filter.evaluate(captures(spark, sf_dir), entries).withColumnRenamed("id", "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_main_text": op9_main_text,
    "op10_url_filter": op10_url_filter,
}

_LIST_SQL = ", ".join(f"('{kind}', '{value}', '{action}', timestamp '{dated} 00:00:00')" for kind, value, action, dated in URL_LIST)

ORACLE: dict[str, str] = {
    "op10_url_filter": f"""
with list(kind, value, action, dated) as (values {_LIST_SQL}),
one as (select kind, rtrim(lower(value), '/') as value, dated, max_by(action, case action when 'block' then 3 when 'allow' then 2 else 1 end) as action from list group by 1, 2, 3),
spans as (select *, lead(dated) over (partition by kind, value order by dated) as until from one),
caps as (select page_id, url, make_timestamp((1704067200 + 60 * (page_id * 7919 % 527040)) * 1000000) as fetched,
  lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) as path from pages),
hits as (select c.*, s.* from caps c left join spans s on s.action <> 'lift' and s.dated <= c.fetched and (s.until is null or c.fetched < s.until)
  and ((s.kind = 'domain' and (c.host = s.value or ends_with(c.host, '.' || s.value)))
    or (s.kind = 'prefix' and (c.host || c.path = s.value or starts_with(c.host || c.path, s.value || '/'))))),
best as (select *, row_number() over (partition by page_id, url, fetched order by length(value) desc nulls last, kind desc) as place from hits)
select page_id, url, fetched, coalesce(action = 'block', false) as blocked, substr(kind, 1, 1) || ':' || value as rule, dated as valid_from, until as valid_to from best where place = 1
""",
    "op3_mix_sources": """
with sizes as (select source, sum(length(coalesce(text, ''))) as size from documents group by source having sum(length(coalesce(text, ''))) > 0),
rates as (select source, pow(size::double, 0.5) / (select sum(pow(size::double, 0.5)) from sizes) * (select sum(size) from sizes) / size as rate from sizes),
terms as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as copies from rates),
p as (select source, copies, exp(copies * ln(rate) - rate - coalesce((select sum(ln(x)) from range(1, copies + 1) r(x)), 0)) as p from terms),
steps as (select source, copies, coalesce(sum(p) over (partition by source order by copies rows between unbounded preceding and 1 preceding), 0) as low, p from p),
drawn as (select d.*, ('0x' || substr(md5('42:draw:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496e0 as u from documents d),
counted as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, max(s.copies) as n
  from drawn d join steps s on d.source is not distinct from s.source and s.low <= d.u and s.p > 2.220446049250313e-16 group by all)
select doc_id, text, lang, source, n_chars, copy_no,
  ('0x' || substr(md5('42:place:' || coalesce(doc_id::varchar, 'null') || ':' || copy_no::varchar), 1, 13))::bigint as mix_key
from (select *, unnest(range(1, n + 1)) as copy_no from counted where n > 0)
""",
    "op4_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""",
}
