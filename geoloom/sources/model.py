"""The data model: ten tables of a road-network snapshot."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "nodes": "id bigint, latitude bigint, longitude bigint, changeset_id bigint, visible boolean, timestamp timestamp, tile bigint, version bigint",
    "node_tags": "node_id bigint, k string, v string",
    "ways": "id bigint, changeset_id bigint, timestamp timestamp, visible boolean, version bigint",
    "way_nodes": "id bigint, node_id bigint, sequence_id bigint",
    "way_tags": "way_id bigint, k string, v string",
    "relations": "relation_id bigint, changeset bigint, timestamp timestamp, visible boolean, version bigint",
    "relation_tags": "id bigint, k string, v string",
    "relation_members": "relation_id bigint, member_type string, member_id bigint, member_role string, sequence_id bigint",
    "changesets": "id bigint, user_id bigint, created_at timestamp, min_lat bigint, max_lat bigint, min_lon bigint, max_lon bigint, closed_at timestamp, num_changes int",
    "changesets_dependence": "id bigint, dep_id bigint",
}


@dataclass(frozen=True)
class Dataset:
    """An immutable snapshot; changes make another."""

    nodes: DataFrame
    node_tags: DataFrame
    ways: DataFrame
    way_nodes: DataFrame
    way_tags: DataFrame
    relations: DataFrame
    relation_tags: DataFrame
    relation_members: DataFrame
    changesets: DataFrame
    changesets_dependence: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_tables(self, **tables: DataFrame) -> Dataset:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def read(spark: SparkSession, folder: str) -> Dataset:
    """A snapshot from Parquet, one folder a table; the schemas are given, not inferred."""
    return Dataset(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str]) -> Dataset:
    """A snapshot from a database with the tables' stock names."""
    stock = {n: n if n.startswith("changesets") else f"current_{n}" for n in SCHEMAS}
    return Dataset(**{name: spark.read.jdbc(url, stock[name], properties=properties) for name in SCHEMAS})


def write(snapshot: Dataset, folder: str, mode: str = "errorifexists") -> None:
    """A new version of all tables; a reader of the folder before sees none of it."""
    for name, df in snapshot.tables().items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def empty(spark: SparkSession) -> Dataset:
    return Dataset(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def of_rows(spark: SparkSession, **tables: list[tuple]) -> Dataset:
    """A small snapshot from rows, for tests."""
    return empty(spark).with_tables(**{name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in tables.items()})
