"""Ways and nodes: membership, polylines, nearest neighbours, the nearest way."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import names
from geoloom.shipping import shared_folder
from geoloom.sources.model import Dataset

#: The least cell of a nearest-neighbour join, in fixed-point units, and the largest whose squares fit a bigint.
LEAST_CELL, BIGINT_CELL = 1_000, 1_000_000_000
#: More than it takes from the least cell to one that holds the world.
_ROUNDS = 32


def node_ways(ds: Dataset, node_id: int) -> DataFrame:
    """way_id, way_name of the distinct ways through a node."""
    found = ds.way_nodes.where(F.col("node_id") == node_id).select(F.col("id").alias("way_id")).distinct()
    return names.with_way_names(ds, found, "way_id", "way_name").orderBy("way_id")


def intersections(ds: Dataset) -> DataFrame:
    """node_id, ways, is_intersection of every node on a way: more than one distinct way."""
    found = ds.way_nodes.groupBy("node_id").agg(F.count_distinct("id").alias("ways"))
    return found.withColumn("is_intersection", F.col("ways") > 1)


def node_on_way_by_name(ds: Dataset, text: str) -> DataFrame:
    """node_id of the best name match: its first id that lies on a way, else its last."""
    ids = names.most_similar(names.node_names(ds), text).select(F.posexplode("ids").alias("place", "node_id"))
    used = ds.way_nodes.select("node_id").join(ids.select("node_id"), "node_id", "left_semi").distinct().withColumn("used", F.lit(True))
    ranked = ids.join(used, "node_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return ranked.orderBy(F.desc("used"), F.when(F.col("used"), F.col("place")).otherwise(-F.col("place"))).limit(1).select("node_id")


def ways_of_node(ds: Dataset, node: DataFrame) -> DataFrame:
    """node_id, node_name, way_id, way_name, is_intersection for the one node in ``node`` (node_id)."""
    held = ds.way_nodes.select(F.col("id").alias("way_id"), "node_id").join(F.broadcast(node), "node_id").distinct()
    held = held.withColumn("is_intersection", F.count("*").over(Window.partitionBy("node_id")) > 1)
    found = names.with_way_names(ds, held, "way_id", "way_name")
    return names.with_node_names(ds, found, "node_id", "node_name").select("node_id", "node_name", "way_id", "way_name", "is_intersection")


def nodes_in_order(ds: Dataset, way_id: int) -> DataFrame:
    """way_id, sequence_id, node_id, latitude, longitude; a node that isn't visible has no place."""
    held = ds.way_nodes.where(F.col("id") == way_id)
    return _placed(ds, held).orderBy("sequence_id", "node_id")


def _placed(ds: Dataset, held: DataFrame) -> DataFrame:
    seen = ds.nodes.where("visible").select(F.col("id").alias("node_id"), "latitude", "longitude")
    return held.join(seen, "node_id", "left").select(F.col("id").alias("way_id"), "sequence_id", "node_id", "latitude", "longitude")


def segments_by_name(ds: Dataset, text: str) -> DataFrame:
    """clean_name, way_id, sequence_id, node_id, latitude, longitude of the best match's ways."""
    ids = names.most_similar(names.way_names(ds), text).select("clean_name", F.explode("ids").alias("id"))
    held = ds.way_nodes.join(ids.select("id"), "id")
    return _placed(ds, held).join(ids.withColumnRenamed("id", "way_id"), "way_id").select("clean_name", "way_id", "sequence_id", "node_id", "latitude", "longitude").orderBy("way_id", "sequence_id")


def polylines(ds: Dataset) -> DataFrame:
    """way_id, node_ids (an array in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence_id", "node_id")))
    return ds.way_nodes.groupBy(F.col("id").alias("way_id")).agg(F.transform(ordered, lambda x: x["node_id"]).alias("node_ids"))


def polyline_lengths(ds: Dataset) -> DataFrame:
    """way_id, nodes, metres (spherical, between neighbours that are both visible)."""
    order = Window.partitionBy("way_id").orderBy("sequence_id")
    rows = _placed(ds, ds.way_nodes).where("latitude is not null").withColumn("lat", geo.degrees_of("latitude")).withColumn("lon", geo.degrees_of("longitude"))
    rows = rows.withColumn("lat2", F.lead("lat").over(order)).withColumn("lon2", F.lead("lon").over(order))
    step = geo.sphere_m("lat", "lon", "lat2", "lon2")
    return rows.groupBy("way_id").agg(F.count("*").alias("nodes"), F.coalesce(F.sum(step), F.lit(0.0)).alias("metres"))


def _squared(dy: Column, dx: Column, wide: bool) -> Column:
    """dy * dy + dx * dx; as a decimal where places may lie half a world apart, which a bigint doesn't hold."""
    if wide:
        dy, dx = dy.cast("decimal(11,0)"), dx.cast("decimal(11,0)")
    return dy * dy + dx * dx


def nearest_nodes(nodes: DataFrame, lat: float, lon: float, k: int = 1) -> DataFrame:
    """rank, id, latitude, longitude, dist (fixed-point units) of the k nearest nodes to a place in degrees."""
    y, x = int(lat * geo.COORD_SCALE), int(lon * geo.COORD_SCALE)
    dy, dx = F.col("latitude") - F.lit(y).cast("bigint"), F.col("longitude") - F.lit(x).cast("bigint")
    top = nodes.withColumn("d2", _squared(dy, dx, True)).orderBy("d2", "id").limit(k)
    rank = F.row_number().over(Window.orderBy("d2", "id"))
    return top.select(rank.alias("rank"), "id", "latitude", "longitude", F.sqrt(F.col("d2").cast("double")).alias("dist"))


def nearest_nodes_join(nodes: DataFrame, queries: DataFrame, k: int = 1, cell: int | None = None) -> DataFrame:
    """q, rank, id, dist: the k nearest nodes to each query (q, latitude, longitude), fixed-point.

    Both sides meet in cells, the queries in the nine around theirs, so whatever is nearer than a cell's
    width is found by an equality join. Queries with fewer than k of those go on with cells four times as wide.
    Each round is checkpointed, as the next refers to it twice. The first cell is one that would hold k nodes if they were spread evenly over their extent.
    """
    spark = shared_folder(nodes.sparkSession)
    extent = nodes.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude") for f in (F.min, F.max)]).first()
    if not (total := extent.n):
        return spark.createDataFrame([], "q bigint, rank int, id bigint, dist double")
    wanted = min(k, total)
    if cell is None:
        area = (extent.max_latitude - extent.min_latitude) * (extent.max_longitude - extent.min_longitude)
        cell = max(LEAST_CELL, int((area * 2 * wanted / total) ** 0.5))
    points = nodes.select("id", F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = queries.select("q", F.col("latitude").alias("qy"), F.col("longitude").alias("qx")).where("qy is not null and qx is not null")
    by_rank = Window.partitionBy("q").orderBy("d2", "id")
    done: list[DataFrame] = []
    for _ in range(_ROUNDS):
        into = lambda c, w=cell: F.floor(F.col(c) / w)
        asked = left.select("*", into("qy").alias("cy"), into("qx").alias("cx"), F.explode(steps).alias("s"))
        asked = asked.withColumn("cy", F.col("cy") + F.col("s.a")).withColumn("cx", F.col("cx") + F.col("s.b")).drop("s")
        met = asked.join(points.withColumns({"cy": into("y"), "cx": into("x")}), ["cy", "cx"])
        # Places that meet are less than two cells apart either way.
        d2 = _squared(F.col("qy") - F.col("y"), F.col("qx") - F.col("x"), cell > BIGINT_CELL)
        near = met.withColumn("d2", d2).where(F.col("d2") <= F.lit(Decimal(cell) * cell))
        near = near.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= wanted).select("q", "rank", "id", F.sqrt(F.col("d2").cast("double")).alias("dist")).checkpoint()
        full = near.where(F.col("rank") == wanted).select("q")
        done.append(near.join(full, "q", "left_semi"))
        left = left.join(full, "q", "left_anti").checkpoint()
        if left.isEmpty():
            break
        cell *= 4
    else:
        raise RuntimeError(f"some places have no {wanted} nearest nodes after {_ROUNDS} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("q", "rank", "id", "dist")


def distance_to_polyline(points: DataFrame, keys: list[str], nearest: bool = False) -> DataFrame:
    """keys, metres: from the place (y, x) to the polyline of its rows (sequence_id, latitude, longitude); all fixed-point.

    The height over the first segment beside which the place lies (the least of those if ``nearest``); if
    there is none, the nearer of the two ends. Segments of no length are passed over.
    """
    order = Window.partitionBy(*keys).orderBy("sequence_id")
    rows = points.withColumns({"y2": F.lead("latitude").over(order), "x2": F.lead("longitude").over(order), "place": F.row_number().over(order)})
    deg = geo.degrees_of
    here, there = geo.sphere_m(deg("y"), deg("x"), deg("latitude"), deg("longitude")), geo.sphere_m(deg("y"), deg("x"), deg("y2"), deg("x2"))
    base = geo.sphere_m(deg("latitude"), deg("longitude"), deg("y2"), deg("x2"))
    moved = (F.col("latitude") != F.col("y2")) | (F.col("longitude") != F.col("x2"))
    beside = moved & geo.beside_segment("y", "x", "latitude", "longitude", "y2", "x2")
    rows = rows.withColumns({"here": here, "height": F.when(beside, geo.triangle_height(here, there, base))})
    first = F.min("height") if nearest else F.min_by("height", F.when(F.col("height").isNotNull(), F.col("place")))
    ends = F.least(F.min_by("here", "place"), F.max_by("here", "place"))
    return rows.groupBy(*keys).agg(F.coalesce(first, ends).alias("metres"))


def nearest_way(ds: Dataset, lat: float, lon: float, neighbours: int = 15, around: int = 8, nearest_segment: bool = False) -> DataFrame:
    """way_id, metres, way_name of the way nearest to a place.

    Ways through the nearest visible nodes are measured on a window of nodes around the nearest of them.
    """
    seen = ds.nodes.where("visible").select("id", "latitude", "longitude")
    close = nearest_nodes(seen, lat, lon, neighbours).select(F.col("id").alias("node_id"), "rank")
    middle = ds.way_nodes.join(F.broadcast(close), "node_id").groupBy("id").agg(F.min_by("sequence_id", F.struct("rank", "sequence_id")).alias("middle"))
    middle = middle.withColumn("low", F.greatest(F.col("middle") - around, F.lit(1)))
    inside = ds.way_nodes.join(middle, "id").where(F.col("sequence_id").between(F.col("low"), F.col("low") + 2 * around))
    rows = inside.join(seen.withColumnRenamed("id", "node_id"), "node_id")
    rows = rows.withColumns({"y": F.lit(int(lat * geo.COORD_SCALE)).cast("bigint"), "x": F.lit(int(lon * geo.COORD_SCALE)).cast("bigint")})
    measured = distance_to_polyline(rows, ["id"], nearest_segment).withColumnRenamed("id", "way_id")
    best = measured.orderBy("metres", "way_id").limit(1)
    return names.with_way_names(ds, best, "way_id", "way_name").select("way_id", "metres", "way_name")
