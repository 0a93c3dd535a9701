"""Layers of a map as one tidy table: layer, feature_id, seq, lat, lon (degrees)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.sources.model import Dataset

# The border around what is shown, and height to width.
BORDER, HEIGHT, WIDTH = 0.1, 9.0, 16.0
COLUMNS = "layer string, feature_id bigint, seq int, lat double, lon double"


def points(nodes: DataFrame, layer: str) -> DataFrame:
    """A layer of distinct points from nodes (id, latitude, longitude)."""
    deg = geo.degrees_of
    return nodes.select(F.lit(layer).alias("layer"), F.col("id").alias("feature_id"), F.lit(0).alias("seq"), deg("latitude").alias("lat"), deg("longitude").alias("lon")).distinct()


def lines(ds: Dataset, ways: DataFrame, layer: str) -> DataFrame:
    """A layer of the polylines of ways (way_id); nodes that aren't visible are left out."""
    held = ds.way_nodes.join(ways.select(F.col("way_id").alias("id")).distinct(), "id", "left_semi")
    seen = ds.nodes.where("visible").select(F.col("id").alias("node_id"), "latitude", "longitude")
    deg = geo.degrees_of
    return held.join(seen, "node_id").select(F.lit(layer).alias("layer"), F.col("id").alias("feature_id"), F.col("sequence_id").cast("int").alias("seq"), deg("latitude").alias("lat"), deg("longitude").alias("lon"))


def bounds(shown: DataFrame, circle: tuple[float, float, float] | None = None) -> DataFrame:
    """min_lat, min_lon, max_lat, max_lon around a layer table's places and a circle (lat, lon, radius in degrees).

    A tenth is added on each side, then the shorter side grows to nine by sixteen.
    """
    box = shown.agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d"))
    if circle:
        lat, lon, r = circle
        for name, pick, edge in (("a", F.least, lat - r), ("b", F.least, lon - r), ("c", F.greatest, lat + r), ("d", F.greatest, lon + r)):
            box = box.withColumn(name, pick(F.col(name), F.lit(edge)))
    high, wide = F.col("c") - F.col("a"), F.col("d") - F.col("b")
    box = box.select((F.col("a") - high * BORDER).alias("a"), (F.col("b") - wide * BORDER).alias("b"), (F.col("c") + high * BORDER).alias("c"), (F.col("d") + wide * BORDER).alias("d"))
    more_wide = F.greatest(F.lit(0.0), (F.col("c") - F.col("a")) / HEIGHT * WIDTH - (F.col("d") - F.col("b"))) / 2
    more_high = F.greatest(F.lit(0.0), (F.col("d") - F.col("b")) / WIDTH * HEIGHT - (F.col("c") - F.col("a"))) / 2
    return box.select((F.col("a") - more_high).alias("min_lat"), (F.col("b") - more_wide).alias("min_lon"), (F.col("c") + more_high).alias("max_lat"), (F.col("d") + more_wide).alias("max_lon"))


def _inside(rows: DataFrame, box: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(box.limit(1))).where(geo.in_box("lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon")).drop("min_lat", "min_lon", "max_lat", "max_lon")


def sample(rows: DataFrame, key: str, num: int | None = None, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows if there are fewer than twice ``num``, else max(num, the share) of them, by a hash of the key."""
    total = rows.count()
    if num is not None and total // num <= 1:
        return rows
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(max(num or 0, int(total * ratio)))


def background_points(ds: Dataset, box: DataFrame, num: int | None = None, ratio: float = 1.0) -> DataFrame:
    """The layer of tagged nodes inside bounds, visible or not."""
    tagged = ds.nodes.join(ds.node_tags, ds.nodes["id"] == ds.node_tags["node_id"], "left_semi")
    found = _inside(points(tagged, "background_points"), box)
    return found if num is None and ratio >= 1 else sample(found, "feature_id", num, ratio)


def clipped_lines(rows: DataFrame, box: DataFrame, num: int | None = None, ratio: float = 1.0) -> DataFrame:
    """A line layer without the vertices outside bounds; lines without any left are gone. Whole lines are sampled as points are."""
    found = _inside(rows, box)
    if num is None and ratio >= 1:
        return found
    return found.join(sample(found.select("feature_id").distinct(), "feature_id", num, ratio), "feature_id", "left_semi")


def report(shown: DataFrame) -> DataFrame:
    """layer, features, places, segments of a layer table."""
    each = shown.groupBy("layer", "feature_id").agg(F.count("*").alias("n"))
    return each.groupBy("layer").agg(F.count("*").alias("features"), F.sum("n").alias("places"), F.sum(F.col("n") - 1).alias("segments"))


def geojson_lines(shown: DataFrame) -> DataFrame:
    """value: a GeoJSON feature for each point and polyline of a layer table."""
    place = lambda x: F.array(x["lon"], x["lat"])
    path = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    each = shown.groupBy("layer", "feature_id").agg(path.alias("p"))
    props = F.struct(F.col("layer"), F.col("feature_id").alias("id"))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Point").alias("type"), place(F.element_at("p", 1)).alias("coordinates")).alias("geometry")))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("LineString").alias("type"), F.transform("p", place).alias("coordinates")).alias("geometry")))
    return each.select(F.when(F.size("p") == 1, point).otherwise(line).alias("value"))
