"""Changesets over immutable snapshots: commit makes a new one, rollback one without some changes."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators.ways import nearest_nodes_join
from geoloom.shipping import shared_folder
from geoloom.sources.changeset_xml import Change, read_change
from geoloom.sources.model import Dataset

# A node nearer than this is the same, and changesets that can't be taken back.
SAME_NODE_M = 5.0
ORIGINAL = (-1, 1)


def next_changeset_id(ds: Dataset) -> int:
    top = ds.changesets.agg(F.max("id")).first()[0]
    return abs(top or 0) + 1


def merge_nodes(ds: Dataset, nodes: DataFrame) -> DataFrame:
    """file_id, latitude, longitude, near_id, metres, merged, node_id of a commit's nodes (file_id, latitude, longitude).

    A node within 5 m of its nearest visible node is that node. The others get ids above all that there
    are, in the order of their file ids; they are held against the nodes before the commit alone.
    """
    seen = ds.nodes.where("visible")
    near = nearest_nodes_join(seen.select("id", "latitude", "longitude"), nodes.select(F.col("file_id").alias("q"), "latitude", "longitude"), 1)
    at = seen.select(F.col("id").alias("near_id"), F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    found = nodes.join(near.select(F.col("q").alias("file_id"), F.col("id").alias("near_id")), "file_id", "left").join(at, "near_id", "left")
    deg = geo.degrees_of
    found = found.withColumn("metres", geo.sphere_m(deg("latitude"), deg("longitude"), deg("y"), deg("x")))
    found = found.withColumn("merged", F.coalesce(F.col("metres") < SAME_NODE_M, F.lit(False)))
    top = ds.nodes.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("top"))
    # A file's new nodes are numbered in one place: a commit is as small as a file that one person sends.
    rank = F.sum(F.when(F.col("merged"), 0).otherwise(1)).over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0))
    numbered = found.withColumn("rank", rank).crossJoin(F.broadcast(top))
    new_id = F.when(F.col("merged"), F.col("near_id")).otherwise(F.col("top") + F.col("rank"))
    return numbered.select("file_id", "latitude", "longitude", "near_id", "metres", "merged", new_id.alias("node_id"))


def commit(ds: Dataset, change: Change, at: datetime, changeset_id: int | None = None) -> Dataset:
    """The snapshot with a commit's nodes and ways; raises ValueError if a way needs a node that the file lacks."""
    own = next_changeset_id(ds) if changeset_id is None else changeset_id
    shared_folder(ds.spark)
    missing = change.way_nodes.join(change.nodes.select(F.col("file_id").alias("ref")), "ref", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"way {missing[0].file_id} needs node {missing[0].ref}, which the file lacks")
    mapped = merge_nodes(ds, change.nodes).checkpoint()
    fresh, key = mapped.where("not merged"), F.lit(own).cast("bigint")
    stamp = F.lit(at).cast("timestamp")
    one = F.lit(1).cast("bigint")
    nodes = fresh.select(F.col("node_id").alias("id"), "latitude", "longitude", key.alias("changeset_id"), F.lit(True).alias("visible"), stamp.alias("timestamp"), F.lit(0).cast("bigint").alias("tile"), one.alias("version"))
    node_tags = change.node_tags.join(fresh.select("file_id", "node_id"), "file_id").select("node_id", "k", "v")
    top = ds.ways.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("top"))
    way_ids = change.ways.withColumn("rank", F.row_number().over(Window.orderBy("file_id"))).crossJoin(F.broadcast(top)).select("file_id", (F.col("top") + F.col("rank")).alias("way_id"))
    ways = way_ids.select(F.col("way_id").alias("id"), key.alias("changeset_id"), stamp.alias("timestamp"), F.lit(True).alias("visible"), one.alias("version"))
    way_tags = change.way_tags.join(way_ids, "file_id").select("way_id", "k", "v")
    refs = change.way_nodes.join(way_ids, "file_id").join(mapped.select(F.col("file_id").alias("ref"), "node_id"), "ref").select(F.col("way_id").alias("id"), "node_id", "sequence_id")
    number = change.nodes.select("file_id").unionByName(change.ways.select("file_id")).agg(F.count("*").cast("int").alias("num_changes"))
    world = [F.lit(x).cast("bigint").alias(n) for n, x in (("min_lat", -900000000), ("max_lat", 900000000), ("min_lon", -1800000000), ("max_lon", 1800000000))]
    row = number.select(key.alias("id"), F.lit(-1).cast("bigint").alias("user_id"), stamp.alias("created_at"), *world, stamp.alias("closed_at"), "num_changes")
    # One dependence a changeset: on the changeset of the first node that was there already.
    first = mapped.where("merged").orderBy("file_id").limit(1).select(F.col("near_id").alias("id"))
    depends = ds.nodes.join(F.broadcast(first), "id").select(key.alias("id"), F.col("changeset_id").alias("dep_id"))
    depends = depends.join(ds.changesets_dependence.select("id"), "id", "left_anti")
    new = dict(nodes=nodes, node_tags=node_tags, ways=ways, way_nodes=refs, way_tags=way_tags, changesets=row, changesets_dependence=depends)
    return ds.with_tables(**{name: getattr(ds, name).unionByName(df) for name, df in new.items()})


def in_range(ds: Dataset, since: str, until: str) -> DataFrame:
    """Changesets made in a range of time, both ends included; "now" is the present."""
    moment = lambda x: F.current_timestamp() if x == "now" else F.to_timestamp(F.lit(x))
    return ds.changesets.where(F.col("created_at").between(moment(since), moment(until)))


def targets_of(ds: Dataset, targets: DataFrame) -> DataFrame:
    """id of the changesets that a rollback (id, since, until) names, singly or by range."""
    moment = lambda c: F.when(F.col(c) == "now", F.current_timestamp()).otherwise(F.to_timestamp(c))
    ranges = targets.where("since is not null").select(moment("since").alias("a"), moment("until").alias("b"))
    ranged = ds.changesets.join(F.broadcast(ranges), F.col("created_at").between(F.col("a"), F.col("b"))).select("id")
    return targets.where("id is not null").select("id").unionByName(ranged).distinct()


def violations(ds: Dataset, targets: DataFrame) -> DataFrame:
    """id, dep_id: changesets that stay but depend on one in ``targets`` (id)."""
    ids = targets.select("id").distinct()
    on_gone = ds.changesets_dependence.join(ids.withColumnRenamed("id", "dep_id"), "dep_id", "left_semi")
    return on_gone.join(ids, "id", "left_anti").select("id", "dep_id").distinct()


def without(ds: Dataset, targets: DataFrame) -> Dataset:
    """The snapshot without the nodes, ways and records of some changesets (id)."""
    ids = targets.select("id").distinct()
    own = ids.withColumnRenamed("id", "changeset_id")
    nodes, ways = ds.nodes.join(own, "changeset_id", "left_semi").select("id"), ds.ways.join(own, "changeset_id", "left_semi").select("id")
    gone = lambda df, keys, key: df.join(keys.withColumnRenamed("id", key), key, "left_anti").select(*df.columns)
    return ds.with_tables(
        nodes=gone(ds.nodes, nodes, "id"),
        node_tags=gone(ds.node_tags, nodes, "node_id"),
        ways=gone(ds.ways, ways, "id"),
        way_nodes=gone(ds.way_nodes, ways, "id"),
        way_tags=gone(ds.way_tags, ways, "way_id"),
        changesets=gone(ds.changesets, ids, "id"),
        changesets_dependence=gone(ds.changesets_dependence, ids, "id"),
    )


def rollback(ds: Dataset, targets: DataFrame) -> Dataset:
    """The snapshot without the changesets that ``targets`` (id, since, until) names.

    Unknown ids are passed over. Raises ValueError if an original changeset is named, or one that another
    depends on which stays.
    """
    named = targets_of(ds, targets)
    if named.where(F.col("id").isin(*ORIGINAL)).limit(1).collect():
        raise ValueError("an original changeset can't be rolled back")
    stays = violations(ds, named).orderBy("dep_id", "id").limit(1).collect()
    if stays:
        raise ValueError(f"changeset {stays[0].dep_id} can't be rolled back without {stays[0].id}")
    return without(ds, named)


def apply(ds: Dataset, change: Change, at: datetime) -> tuple[Dataset, int]:
    """The snapshot after one change, and the change's id."""
    own = next_changeset_id(ds)
    return (commit(ds, change, at, own) if change.operation == "commit" else rollback(ds, change.targets)), own


def apply_files(ds: Dataset, paths: Iterable[str], at: datetime) -> tuple[Dataset, list[int]]:
    """Files in order, each on the snapshot that the one before left."""
    ids = []
    for path in paths:
        ds, own = apply(ds, read_change(ds.spark, path), at)
        ids.append(own)
    return ds, ids


def changed_parts(before: Dataset, after: Dataset) -> dict[str, bool]:
    """Which derived tables a change touches: routing, node_names, way_names, node_places."""
    differs = lambda a, b: not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()
    named = lambda df: df.where(F.col("k").startswith("name"))
    return {
        "routing": differs(before.way_nodes, after.way_nodes),
        "node_names": differs(named(before.node_tags), named(after.node_tags)),
        "way_names": differs(named(before.way_tags), named(after.way_tags)),
        "node_places": differs(before.nodes.select("id", "latitude", "longitude"), after.nodes.select("id", "latitude", "longitude")),
    }
