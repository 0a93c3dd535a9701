"""What lies in a bounding box: nodes, ways, relations with all their ancestors, and the file of them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.shipping import shared_folder
from geoloom.sources.model import Dataset

#: Rounds after which what is known is stored anew, so that plans stay short.
STORED = 16

Box = tuple[float, float, float, float]


def _fixed(box: Box) -> list[Column]:
    """min_lat, max_lat, min_lon, max_lon as fixed-point numbers, cut off towards zero."""
    return [F.lit(int(x * geo.COORD_SCALE)).cast("bigint") for x in box]


def nodes_in(ds: Dataset, box: Box) -> DataFrame:
    """Nodes in the box, borders included, visible or not."""
    return ds.nodes.where(geo.in_box("latitude", "longitude", *_fixed(box)))


def way_nodes_in(ds: Dataset, box: Box) -> DataFrame:
    return ds.way_nodes.join(nodes_in(ds, box).select(F.col("id").alias("node_id")), "node_id", "left_semi")


def ways_in(ds: Dataset, box: Box) -> DataFrame:
    """way_id, node_ids: ways with a node in the box, and those of their nodes, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("sequence_id", "node_id")))
    held = way_nodes_in(ds, box).groupBy("id").agg(F.transform(ordered, lambda x: x["node_id"]).alias("node_ids"))
    known = ds.ways.select("id").distinct()
    return held.join(known, "id", "left_semi").withColumnRenamed("id", "way_id")


def direct_members(ds: Dataset, box: Box) -> DataFrame:
    """Members that are nodes in the box or ways with a node in it."""
    nodes = nodes_in(ds, box).select(F.col("id").alias("member_id"))
    ways = way_nodes_in(ds, box).select(F.col("id").alias("member_id")).distinct()
    m = ds.relation_members
    return m.where("member_type = 'Node'").join(nodes, "member_id", "left_semi").unionByName(m.where("member_type = 'Way'").join(ways, "member_id", "left_semi"))


def ancestors(ds: Dataset, start: DataFrame) -> DataFrame:
    """relation_id, level: relations above those in ``start`` (relation_id) and themselves, by the fewest steps.

    Each round joins the newest with their parents and drops what is known, so cycles end.
    """
    shared_folder(ds.spark)
    parents = ds.relation_members.where("member_type = 'Relation'").select(F.col("member_id").alias("relation_id"), F.col("relation_id").alias("parent")).distinct().checkpoint()
    known = newest = start.select("relation_id").distinct().withColumn("level", F.lit(0)).checkpoint()
    for level in count(1):
        found = parents.join(newest.select("relation_id"), "relation_id").select(F.col("parent").alias("relation_id")).distinct()
        newest = found.join(known, "relation_id", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)
        if level % STORED == 0:
            known = known.checkpoint()


def relations_in(ds: Dataset, box: Box) -> DataFrame:
    """relation_id, level of relations with a direct member, and of all above them."""
    return ancestors(ds, direct_members(ds, box).select("relation_id"))


def members_in(ds: Dataset, box: Box, relations: DataFrame | None = None) -> DataFrame:
    """Members to export: direct ones, and relations that are exported themselves."""
    relations = relations_in(ds, box) if relations is None else relations
    ids = relations.select("relation_id")
    inner = ds.relation_members.where("member_type = 'Relation'").join(ids, "relation_id", "left_semi").join(ids.withColumnRenamed("relation_id", "member_id"), "member_id", "left_semi")
    return direct_members(ds, box).unionByName(inner)


# --- the file -----------------------------------------------------------------------------------


def quoted(value: Column) -> Column:
    """The value as an attribute, escaped."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _attributes(**values: Column) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), quoted(v)) for k, v in values.items()])


def _stamp(t: str) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _children(rows: DataFrame, key: str, order: Column, line: Column) -> DataFrame:
    """key, lines: each parent's lines in order."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]).alias("lines"))


def _element(rows: DataFrame, name: str, key: str, header: Column, children: list[DataFrame], kind: int) -> DataFrame:
    """kind, id, line, text: an element's lines, with its children one tab further in."""
    found = rows.select(F.col(key).alias("id"), header.alias("header"))
    lists = []
    for k, child in enumerate(children):
        own = child.withColumnRenamed("_key", f"_k{k}").withColumnRenamed("lines", f"_l{k}")
        found = found.join(own, found["id"] == own[f"_k{k}"], "left")
        lists.append(F.coalesce(F.col(f"_l{k}"), F.array().cast("array<string>")))
    inner = F.concat(*lists)
    whole = F.concat(F.array(F.concat(F.lit(f"\t<{name} "), F.col("header"), F.lit(">"))), F.transform(inner, lambda x: F.concat(F.lit("\t\t"), x)), F.array(F.lit(f"\t</{name}>")))
    lines = F.when(F.size(inner) == 0, F.array(F.concat(F.lit(f"\t<{name} "), F.col("header"), F.lit("/>")))).otherwise(whole)
    return found.select(F.lit(kind).alias("kind"), "id", F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("bigint"))


def xml_lines(ds: Dataset, box: Box) -> DataFrame:
    """kind, id, line, text: the region's file, to be read in this order; 0 is the head, 4 the end."""
    spark = ds.spark
    tag = lambda rows, key: _children(rows, key, F.struct("k", "v"), F.concat(F.lit("<tag "), _attributes(k=F.col("k"), v=F.col("v")), F.lit("/>")))
    deg = geo.degrees_of
    nodes, held, relations = nodes_in(ds, box), way_nodes_in(ds, box), relations_in(ds, box)
    ids = nodes.select(F.col("id").alias("node_id"))
    node_head = _attributes(id=F.col("id"), lat=F.format_string("%.7f", deg("latitude")), lon=F.format_string("%.7f", deg("longitude")), visible=F.col("visible"), version=F.col("version"), changeset=F.col("changeset_id"), timestamp=_stamp("timestamp"))
    node_lines = _element(nodes, "node", "id", node_head, [tag(ds.node_tags.join(ids, "node_id", "left_semi"), "node_id")], 1)
    way_ids = held.select("id").distinct()
    refs = _children(held, "id", F.struct("sequence_id", "node_id"), F.concat(F.lit("<nd "), _attributes(ref=F.col("node_id")), F.lit("/>")))
    way_head = _attributes(id=F.col("id"), visible=F.col("visible"), version=F.col("version"), changeset=F.col("changeset_id"), timestamp=_stamp("timestamp"))
    way_tags = ds.way_tags.join(way_ids.withColumnRenamed("id", "way_id"), "way_id", "left_semi")
    way_lines = _element(ds.ways.join(way_ids, "id", "left_semi"), "way", "id", way_head, [refs, tag(way_tags, "way_id")], 2)
    chosen = relations.select("relation_id")
    members = members_in(ds, box, relations)
    member = _children(members, "relation_id", F.struct("sequence_id", "member_type", "member_id"), F.concat(F.lit("<member "), _attributes(type=F.col("member_type"), ref=F.col("member_id"), role=F.col("member_role")), F.lit("/>")))
    relation_head = _attributes(id=F.col("relation_id"), visible=F.col("visible"), version=F.col("version"), changeset=F.col("changeset"), timestamp=_stamp("timestamp"))
    relation_tags = ds.relation_tags.join(chosen.withColumnRenamed("relation_id", "id"), "id", "left_semi")
    relation_lines = _element(ds.relations.join(chosen, "relation_id", "left_semi"), "relation", "relation_id", relation_head, [member, tag(relation_tags, "id")], 3)
    lo_lat, hi_lat, lo_lon, hi_lon = box
    head = [
        "<?xml version='1.0' encoding='UTF-8'?>",
        "<osm version='0.6' generator='geoloom'>",
        f'\t<bound minlon="{lo_lon}" minlat="{lo_lat}" maxlon="{hi_lon}" maxlat="{hi_lat}"/>',
    ]
    frame = spark.createDataFrame([*[(0, 0, k, x) for k, x in enumerate(head)], (4, 0, 0, "</osm>")], "kind int, id bigint, line bigint, text string")
    return frame.unionByName(node_lines).unionByName(way_lines).unionByName(relation_lines)


def write_xml(ds: Dataset, box: Box, folder: str) -> None:
    """The file's lines as text files whose names sort in reading order."""
    xml_lines(ds, box).sort("kind", "id", "line").select("text").write.mode("overwrite").text(folder)

