"""Tables derived from a snapshot, kept as Parquet; after a change only those it touches are written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import layers, names, routing
from geoloom.operators.changes import changed_parts
from geoloom.sources.model import Dataset


def relation_parents(ds: Dataset) -> DataFrame:
    """relation_id, parent."""
    inner = ds.relation_members.where("member_type = 'Relation'")
    return inner.select(F.col("member_id").alias("relation_id"), F.col("relation_id").alias("parent")).distinct()


def node_places(ds: Dataset) -> DataFrame:
    return ds.nodes.where("visible").select("id", "latitude", "longitude")


#: Each table's maker, and the part of a snapshot whose change makes it stale; None: nothing but a rebuild.
TABLES: dict[str, tuple[Callable[[Dataset], DataFrame], str | None]] = {
    "node_names": (lambda ds: names.name_index(names.node_names(ds)), "node_names"),
    "way_names": (lambda ds: names.name_index(names.way_names(ds)), "way_names"),
    "route_edges": (routing.edges, "routing"),
    "node_places": (node_places, "node_places"),
    "relation_parents": (relation_parents, None),
}


def write(ds: Dataset, folder: str, only: set[str] | None = None) -> list[str]:
    """Write the tables (or some of them); their names."""
    chosen = [n for n in TABLES if only is None or n in only]
    for name in chosen:
        TABLES[name][0](ds).write.mode("overwrite").parquet(f"{folder}/{name}")
    return chosen


def refresh(before: Dataset, after: Dataset, folder: str) -> list[str]:
    """Write those tables that the change between two snapshots makes stale; their names."""
    changed = changed_parts(before, after)
    return write(after, folder, {n for n, (_, part) in TABLES.items() if part and changed[part]})


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"{name} is not a derived table")
    return spark.read.parquet(f"{folder}/{name}")


def write_layers(shown: DataFrame, folder: str) -> None:
    """A map's layers, by layer."""
    shown.write.mode("overwrite").partitionBy("layer").parquet(folder)


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(layers.COLUMNS).parquet(folder)


def write_geojson(shown: DataFrame, folder: str) -> None:
    """A GeoJSON feature a line."""
    layers.geojson_lines(shown).write.mode("overwrite").text(folder)
