"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the adapted test tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.text import clean_name
from geoloom.operators import changes, layers, names, poi, region, routing, ways
from geoloom.sources import aliases, changeset_xml
from geoloom.sources.fixture import dataset
from geoloom.sources.model import Dataset

ORIGIN = (31.2, 121.4)
ENDS = ((31.0, 121.2), (31.3, 121.5))
BOX = (31.0, 31.1, 121.1, 121.25)
RADIUS_M, CIRCLE_M = 10_000, 5_000
WORD, NAME = "blue gizm", "blue anvl"
NODE, WAY, WAY_NAME = 7, 42, "Road 4211"
WORDS = ["加油站", "宾馆", "大学", "地铁", "美食", "unknown"]
TARGETS = [3, 5, 11]
RANGE = ("2024-01-05T00:00:00Z", "2024-01-09T12:00:00Z")
_HERE = os.path.dirname(os.path.abspath(__file__))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Dataset], DataFrame]) -> Callable[[Dataset], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(dataset(spark, sf_dir))
    return f


def metres(name: str, places: int = 3) -> F.Column:
    return F.round(F.col(name), places).alias(name)


@query
def poi_within_radius(ds: Dataset) -> DataFrame:
    return poi.within_radius(ds, "PROMO", *ORIGIN, RADIUS_M).select("id", metres("dis"), "latitude", "longitude")


@query
def poi_type_canonical(ds: Dataset) -> DataFrame:
    words = ds.spark.createDataFrame([(w,) for w in WORDS], "alias string")
    return poi.canonical_types(words, aliases.aliases(ds.spark))


@query
def node_ways(ds: Dataset) -> DataFrame:
    return ways.node_ways(ds, NODE)


@query
def node_ways_by_name(ds: Dataset) -> DataFrame:
    return ways.ways_of_node(ds, ways.node_on_way_by_name(ds, NAME))


@query
def node_ways_by_place(ds: Dataset) -> DataFrame:
    near = ways.nearest_nodes(ds.nodes.where("visible"), *ORIGIN, 1).select(F.col("id").alias("node_id"))
    return ways.ways_of_node(ds, near)


@query
def intersections(ds: Dataset) -> DataFrame:
    return ways.intersections(ds)


@query
def way_nodes_ordered(ds: Dataset) -> DataFrame:
    return ways.nodes_in_order(ds, WAY)


@query
def way_segments_by_name(ds: Dataset) -> DataFrame:
    return ways.segments_by_name(ds, WAY_NAME)


@query
def way_polylines(ds: Dataset) -> DataFrame:
    return ways.polylines(ds).select("way_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


@query
def way_polyline_length(ds: Dataset) -> DataFrame:
    return ways.polyline_lengths(ds).select("way_id", "nodes", metres("metres", 2))


@query
def knn_nodes(ds: Dataset) -> DataFrame:
    return ways.nearest_nodes(ds.nodes.where("visible"), *ORIGIN, 15).select("rank", "id", "latitude", "longitude", metres("dist"))


@query
def nearest_way(ds: Dataset) -> DataFrame:
    return ways.nearest_way(ds, *ORIGIN).select("way_id", metres("metres"), "way_name")


@query
def middle_poi(ds: Dataset) -> DataFrame:
    return poi.middle(ds, "PROMO", *ENDS, diff_tolerate=0.5).select("id", "name", "latitude", "longitude", metres("d1"), metres("d2"))


@query
def middle_poi_ordered(ds: Dataset) -> DataFrame:
    return poi.middle(ds, "PROMO", *ENDS, diff_tolerate=0.5, order_sensitive=True).select("id", "name", "latitude", "longitude", metres("d1"), metres("d2"))


@query
def poi_pair_topk(ds: Dataset) -> DataFrame:
    return poi.pair_topk(ds, "PROMO", "SMALL", *ORIGIN).select("id1", "name1", "id2", "name2", metres("total"))


@query
def poi_pair_topk_ordered(ds: Dataset) -> DataFrame:
    return poi.pair_topk(ds, "PROMO", "SMALL", *ORIGIN, order_sensitive=True).select("id1", "name1", "id2", "name2", metres("total"))


@query
def max_cover_circle(ds: Dataset) -> DataFrame:
    return poi.fullest_circle(ds, "PROMO", CIRCLE_M, precise=True).select(metres("latitude", 6), metres("longitude", 6), "total", "covered")


@query
def approx_max_cover(ds: Dataset) -> DataFrame:
    return poi.fullest_circle(ds, "PROMO", CIRCLE_M).select(metres("latitude", 6), metres("longitude", 6), "total", "covered")


@query
def clean_names(ds: Dataset) -> DataFrame:
    return names.node_names(ds).select("id", "name", clean_name(F.col("name")).alias("clean_name"))


@query
def name_index(ds: Dataset) -> DataFrame:
    return names.name_index(names.node_names(ds)).select("clean_name", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query
def edit_distance_matches(ds: Dataset) -> DataFrame:
    words = names.cleaned(names.node_names(ds)).select("clean_name").distinct()
    return names.edit_matches(words, clean_text(WORD), 5)


def clean_text(text: str) -> str:
    return text.replace(" ", "")


@query
def fuzzy_lookup_tiered(ds: Dataset) -> DataFrame:
    return names.similar(names.node_names(ds), WORD)


@query
def name_like_segments(ds: Dataset) -> DataFrame:
    return names.like_segments(names.node_names(ds), names.segments("blue Brand 2"))


@query
def bm25_scores(ds: Dataset) -> DataFrame:
    return names.bm25(names.node_names(ds), "blue gizmo Brand").select("name", F.round("score", 9).alias("score"))


@query
def most_similar_name(ds: Dataset) -> DataFrame:
    found = names.most_similar(names.node_names(ds), NAME, 3)
    return found.select("clean_name", F.round("score", 9).alias("score"), "distance", F.size("ids").alias("n_ids"))


@query
def poi_by_name_nearby(ds: Dataset) -> DataFrame:
    return poi.by_name_nearby(ds, "blue gizmo", *ORIGIN).select("id", "latitude", "longitude", "name", metres("metres"))


@query
def node_display_name(ds: Dataset) -> DataFrame:
    return names.with_node_names(ds, ds.nodes.select("id"))


@query
def route_edges(ds: Dataset) -> DataFrame:
    return routing.edges(ds)


@query
def routable_nodes(ds: Dataset) -> DataFrame:
    return routing.routable(ds, "bike")


@query
def route_snap(ds: Dataset) -> DataFrame:
    return routing.snap(ds, "car", *ORIGIN).select("id", metres("dist"))


@query
def shortest_route(ds: Dataset) -> DataFrame:
    return routing.shortest(ds, "car", *ENDS).select("status", metres("cost", 2))


@query
def shortest_route_path(ds: Dataset) -> DataFrame:
    return routing.with_places(ds, routing.shortest(ds, "walk", *ENDS))


@query
def bbox_nodes(ds: Dataset) -> DataFrame:
    return region.nodes_in(ds, BOX).select("id", "latitude", "longitude", "visible")


@query
def bbox_ways(ds: Dataset) -> DataFrame:
    return region.ways_in(ds, BOX).select("way_id", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


@query
def bbox_relations(ds: Dataset) -> DataFrame:
    return region.relations_in(ds, BOX)


@query
def bbox_members(ds: Dataset) -> DataFrame:
    return region.members_in(ds, BOX)


@query
def relation_ancestors(ds: Dataset) -> DataFrame:
    """From every direct way member."""
    return region.ancestors(ds, ds.relation_members.where("member_type = 'Way'").select("relation_id"))


@query
def osm_xml_lines(ds: Dataset) -> DataFrame:
    return region.xml_lines(ds, BOX).where("kind in (1, 2)")


@query
def osm_xml_file(ds: Dataset) -> DataFrame:
    """The whole file: head, nodes, ways, relations and end; ``osm_xml_lines`` has the kinds that its SQL has."""
    return region.xml_lines(ds, BOX)


def new_nodes(ds: Dataset) -> DataFrame:
    """A made-up commit: nodes beside existing ones, every third of them a few metres off, the others far."""
    near = ds.nodes.where("id < 60")
    off = F.expr("if(id % 3 = 0, 100, 4000 + id)").cast("bigint")
    return near.select((F.col("id") + 1).alias("file_id"), (F.col("latitude") + off).alias("latitude"), (F.col("longitude") - off).alias("longitude"))


@query
def knn_batch(ds: Dataset) -> DataFrame:
    asked = new_nodes(ds).withColumnRenamed("file_id", "q")
    return ways.nearest_nodes_join(ds.nodes.where("visible").select("id", "latitude", "longitude"), asked, 3).select("q", "rank", "id", metres("dist"))


@query
def commit_node_merge(ds: Dataset) -> DataFrame:
    return changes.merge_nodes(ds, new_nodes(ds)).select("file_id", "near_id", metres("metres", 2), "merged")


@query
def commit_new_ids(ds: Dataset) -> DataFrame:
    return changes.merge_nodes(ds, new_nodes(ds)).select("file_id", "node_id")


@query
def dependency_violations(ds: Dataset) -> DataFrame:
    return changes.violations(ds, ds.spark.createDataFrame([(x,) for x in TARGETS], "id bigint"))


@query
def rollback_survivors(ds: Dataset) -> DataFrame:
    left = changes.without(ds, ds.spark.createDataFrame([(x,) for x in TARGETS], "id bigint")).tables()
    first = {"nodes": "id", "node_tags": "node_id", "ways": "id", "way_nodes": "node_id", "way_tags": "way_id", "changesets": "id", "changesets_dependence": "dep_id"}
    counted = [left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(key).alias("checksum")) for t, key in first.items()]
    out = counted[0]
    for each in counted[1:]:
        out = out.unionByName(each)
    return out


@query
def changesets_in_range(ds: Dataset) -> DataFrame:
    return changes.in_range(ds, *RANGE).select("id", "created_at")


@query
def node_names_of_key(ds: Dataset) -> DataFrame:
    return ds.node_tags.where(F.col("k").startswith("name")).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("values"))


def _shown(ds: Dataset) -> DataFrame:
    """The points, and every line's places in the map's bounds."""
    near = layers.points(poi.within_radius(ds, "PROMO", *ORIGIN, RADIUS_M), "target_points")
    ways = layers.lines(ds, ds.ways.select(F.col("id").alias("way_id")), "target_lines")
    return near.unionByName(layers.clipped_lines(ways, layers.bounds(near, (*ORIGIN, 0.05))))


@query
def map_bounds(ds: Dataset) -> DataFrame:
    box = layers.bounds(layers.points(poi.within_radius(ds, "PROMO", *ORIGIN, RADIUS_M), "target_points"), (*ORIGIN, 0.05))
    return box.select(*[F.round(c, 9).alias(c) for c in box.columns])


@query
def map_report(ds: Dataset) -> DataFrame:
    return layers.report(_shown(ds))


def _bounds(ds: Dataset) -> DataFrame:
    return ds.spark.createDataFrame([(BOX[0], BOX[2], BOX[1], BOX[3])], "min_lat double, min_lon double, max_lat double, max_lon double")


@query
def background_points(ds: Dataset) -> DataFrame:
    return layers.background_points(ds, _bounds(ds)).select("feature_id", "lat", "lon")


@query
def clipped_lines(ds: Dataset) -> DataFrame:
    rows = layers.lines(ds, ds.ways.select(F.col("id").alias("way_id")), "background_lines")
    return layers.clipped_lines(rows, _bounds(ds)).groupBy("feature_id").agg(F.count("*").alias("places"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def map_geojson(ds: Dataset) -> DataFrame:
    return layers.geojson_lines(_shown(ds))


@query
def distances(ds: Dataset) -> DataFrame:
    deg = geo.degrees_of
    return ds.nodes.select("id", F.round(geo.sphere_m(deg("latitude"), deg("longitude"), *ORIGIN), 3).alias("sphere"), F.round(geo.planar_m(deg("latitude"), deg("longitude"), *ORIGIN), 3).alias("planar"))


def xml_changeset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a document that is beside this module."""
    change = changeset_xml.read_change(spark, os.path.join(_HERE, "example_commit.xml"))
    return change.nodes.join(change.node_tags.groupBy("file_id").agg(F.count("*").alias("tags")), "file_id", "left")


QUERIES["xml_changeset_parse"] = xml_changeset_parse
