"""Changeset files: XML with a commit's nodes and ways, or a rollback's targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo

SCHEMA = """_operation string,
node array<struct<_id: bigint, _lat: double, _lon: double, tag: array<struct<_k: string, _v: string>>>>,
way array<struct<_id: bigint, nd: array<struct<_ref: bigint>>, tag: array<struct<_k: string, _v: string>>>>,
relation array<struct<_id: bigint>>,
target array<struct<_id: bigint, _created_at_from: string, _created_at_to: string>>"""


@dataclass(frozen=True)
class Change:
    """One file. nodes: file_id, latitude, longitude. tags: file_id, k, v. way_nodes: file_id, ref, sequence_id."""

    operation: str
    nodes: DataFrame
    node_tags: DataFrame
    ways: DataFrame
    way_nodes: DataFrame
    way_tags: DataFrame
    targets: DataFrame


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each changeset element; the schema is given, as inference takes a lone child for a struct."""
    return spark.read.format("xml").option("rowTag", "changeset").schema(SCHEMA).load(path)


def parsed(documents: DataFrame) -> dict[str, DataFrame]:
    """The parts of documents as tables (keyed by operation as well); sequences count from 1."""
    node = documents.select("_operation", F.explode("node").alias("n"))
    way = documents.select("_operation", F.explode("way").alias("w"))
    tag = lambda rows, x: rows.select("_operation", F.col(f"{x}._id").alias("file_id"), F.explode(f"{x}.tag").alias("t")).select("_operation", "file_id", F.col("t._k").alias("k"), F.col("t._v").alias("v"))
    refs = way.select("_operation", F.col("w._id").alias("file_id"), F.posexplode("w.nd").alias("p", "nd"))
    target = documents.select("_operation", F.explode("target").alias("t"))
    return {
        "nodes": node.select("_operation", F.col("n._id").alias("file_id"), geo.fixed_of(F.col("n._lat")).alias("latitude"), geo.fixed_of(F.col("n._lon")).alias("longitude")),
        "node_tags": tag(node, "n"),
        "ways": way.select("_operation", F.col("w._id").alias("file_id")),
        "way_nodes": refs.select("_operation", "file_id", F.col("nd._ref").alias("ref"), (F.col("p") + 1).cast("bigint").alias("sequence_id")),
        "way_tags": tag(way, "w"),
        "targets": target.select("_operation", F.col("t._id").alias("id"), F.col("t._created_at_from").alias("since"), F.col("t._created_at_to").alias("until")),
    }


def read_change(spark: SparkSession, path: str) -> Change:
    """One file's change; raises ValueError unless it has one changeset, with a known operation and no relation."""
    documents = read_documents(spark, path)
    heads = documents.select("_operation", F.coalesce(F.size("relation"), F.lit(0)).alias("relations")).limit(2).collect()
    if len(heads) != 1 or heads[0][0] not in ("commit", "rollback"):
        raise ValueError(f"{path}: one changeset with operation commit or rollback is expected")
    if heads[0].relations > 0:
        raise ValueError(f"{path}: relations can't be changed")
    tables = {k: v.drop("_operation") for k, v in parsed(documents).items()}
    return Change(operation=heads[0][0], **tables)
