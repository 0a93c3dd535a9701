"""Searches for points of interest: by radius, in pairs, half-way, in the fullest circle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import names
from geoloom.shipping import ship
from geoloom.sources.model import Dataset

#: Points from which on the fullest circle is sampled unless asked to be exact, and about how many a sample has.
SAMPLE_FROM, SAMPLE_TO = 15_000, 10_000
#: Samples that are tried; the best stays.
SAMPLES = 4
#: Centres, about, that one task sweeps at once.
PART = 1024
_BEST = pa.schema([("total", pa.int64()), ("i", pa.int64()), ("lat_i", pa.float64()), ("lon_i", pa.float64()), ("toward", pa.float64())])


def canonical_type(ds: Dataset, aliases: DataFrame, word: str) -> DataFrame:
    """The type's name for a word (one row, one column ``poitype``), or none if it is unknown."""
    return aliases.where(F.col("alias") == word).select("poitype")


def canonical_types(words: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias, poitype (null if unknown) for a table of words (``alias``)."""
    return words.join(aliases, "alias", "left")


def of_type(ds: Dataset, poitype: str | DataFrame) -> DataFrame:
    """Nodes with the type's tag: id, latitude, longitude, lat, lon."""
    tags = ds.node_tags.where("k = 'poitype'")
    if isinstance(poitype, str):
        tags = tags.where(F.col("v") == poitype)
    else:
        tags = tags.join(F.broadcast(poitype.limit(1)), F.col("v") == F.col("poitype"), "left_semi")
    found = ds.nodes.join(tags, ds.nodes["id"] == tags["node_id"], "left_semi")
    return found.select("id", "latitude", "longitude", geo.degrees_of("latitude").alias("lat"), geo.degrees_of("longitude").alias("lon"))


def within_radius(ds: Dataset, poitype: str, lat: float, lon: float, metres: float) -> DataFrame:
    """id, dis (planar metres, below the radius), latitude, longitude; nearest first."""
    # The box is implied by the distance; on fixed-point columns it reaches the scan.
    reach = int(metres / geo.PLANAR_M_PER_DEGREE * geo.COORD_SCALE) + 2
    y, x = int(lat * geo.COORD_SCALE), int(lon * geo.COORD_SCALE)
    near = ds.with_tables(nodes=ds.nodes.where(geo.in_box("latitude", "longitude", F.lit(y - reach), F.lit(y + reach), F.lit(x - reach), F.lit(x + reach))))
    found = of_type(near, poitype).withColumn("dis", geo.planar_m("lat", "lon", lat, lon))
    return found.where(F.col("dis") < metres).select("id", "dis", "latitude", "longitude").orderBy("dis", "id")


def middle(ds: Dataset, poitype: str, first: tuple[float, float], second: tuple[float, float], sum_tolerate: float = 0.2, diff_tolerate: float = 0.1, order_sensitive: bool = False, num: int = 5) -> DataFrame:
    """id, name, latitude, longitude, d1, d2 of points about half-way, those nearest to the midpoint first.

    Planar distances are held against a spherical budget; with ``order_sensitive`` the second is nearer.
    """
    (y1, x1), (y2, x2) = first, second
    budget = geo.sphere_m(y1, x1, y2, x2) * (1 + sum_tolerate)
    found = of_type(ds, poitype).select("*", geo.planar_m("lat", "lon", y1, x1).alias("d1"), geo.planar_m("lat", "lon", y2, x2).alias("d2"))
    found = found.where((F.col("d1") + F.col("d2") < budget) & (F.abs(F.col("d1") - F.col("d2")) < F.least("d1", "d2") * diff_tolerate))
    if order_sensitive:
        found = found.where("d1 > d2")
    aside = geo.planar_degrees("lat", "lon", (y1 + y2) / 2, (x1 + x2) / 2)
    best = found.withColumn("aside", aside).orderBy("aside", "id").limit(num)
    return names.with_node_names(ds, best).select("id", "name", "latitude", "longitude", "d1", "d2", "aside").orderBy("aside", "id").drop("aside")


def _height(reach: float) -> float:
    """The height of a row of cells, in degrees, for points that are at most ``reach`` metres apart."""
    return max(1e-4, reach / geo.SPHERE_M_PER_DEGREE * (1 + 1e-9) + 1e-9)


def _cells(points: DataFrame, lat: str, lon: str, high: float, around: bool = False) -> DataFrame:
    """The points with the cell that each is in (cy, cx), or with a row for each of the cells around as well.

    Rows of cells are as high as told. A row's cells divide the circle of longitude evenly and are as wide
    as two points of the row or its neighbours can be apart, so points that near meet in adjoining cells.
    """
    if high >= 90:
        return points.withColumn("cy", F.lit(0).cast("bigint")).withColumn("cx", F.lit(0).cast("bigint"))
    row = F.floor((F.col(lat) + 90) / high)
    # The largest latitude of the row and the two beside it.
    edge = F.least(F.lit(90.0), F.greatest(F.abs((F.col("cy") - 1) * high - 90), F.abs((F.col("cy") + 2) * high - 90)))
    ratio = F.sin(F.radians(F.lit(high / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    wide = F.when(ratio < 1, F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9)).otherwise(F.lit(360.0))
    cells = F.greatest(F.floor(360 / wide), F.lit(1)).cast("bigint")
    cell = F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / (360 / F.col("n"))).cast("bigint")
    if not around:
        return points.withColumn("cy", row).withColumn("n", cells).withColumn("cx", F.pmod(cell, F.col("n"))).drop("n")
    near = points.withColumn("cy", F.explode(F.array(*[row + k for k in (-1, 0, 1)]))).withColumn("n", cells)
    return near.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(cell + k, F.col("n")) for k in (-1, 0, 1)])))).drop("n")


def _meeting(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs of points (lat1, lon1) and (lat2, lon2) in degrees: all that are at most ``reach`` metres apart, and some more."""
    high = _height(reach)
    if high >= 90:
        return left.crossJoin(right)
    return _cells(left, "lat1", "lon1", high, around=True).join(_cells(right, "lat2", "lon2", high), ["cy", "cx"]).drop("cy", "cx")


def pair_topk(ds: Dataset, first_type: str, second_type: str, lat: float, lon: float, order_sensitive: bool = False, num: int = 5) -> DataFrame:
    """id1, id2, total and the points' names and places: the cheapest pairs of one of each type.

    A pair costs the way between the two and that from the origin to the first (or to the nearer).
    No total is below either point's distance from the origin. So the num-th best total among the
    nearest of each side bounds what can matter, and only points within it are paired, where they meet
    in cells as wide as the way that the bound leaves between two points.
    """
    m = max(8, num + 1)

    def side(poitype: str, n: str) -> DataFrame:
        found = of_type(ds, poitype)
        return found.select(F.col("id").alias(f"id{n}"), F.col("lat").alias(f"lat{n}"), F.col("lon").alias(f"lon{n}"), geo.sphere_m("lat", "lon", lat, lon).alias(f"o{n}"))

    start = F.col("o1") if order_sensitive else F.least("o1", "o2")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.where("id1 <> id2").withColumn("total", geo.sphere_m("lat1", "lon1", "lat2", "lon2") + start).orderBy("total", "id1", "id2").limit(num)

    one, two = side(first_type, "1"), side(second_type, "2")
    nearest = lambda df, n: df.orderBy(f"o{n}", f"id{n}").limit(m)
    seeds = best(nearest(one, "1").crossJoin(nearest(two, "2")))
    known = seeds.agg(F.when(F.count("*") >= num, F.max("total")).alias("bound")).first().bound
    if known is None:
        # So few pairs that all of each side's nearest are all there are, or one side is a point or two.
        top = best(one.crossJoin(two))
    else:
        bound = known + 1e-3
        least = [df.agg(F.min(f"o{n}").alias("o")).first().o for df, n in ((one, "1"), (two, "2"))]
        reach = bound - (least[0] if order_sensitive else min(least))
        top = best(_meeting(one.where(F.col("o1") <= bound), two.where(F.col("o2") <= bound), reach))
    named = names.with_node_names(ds, names.with_node_names(ds, top, "id1", "name1"), "id2", "name2")
    return named.select("id1", "name1", "lat1", "lon1", "id2", "name2", "lat2", "lon2", "total").orderBy("total", "id1", "id2")


def _neighbours(points: DataFrame, metres: float) -> DataFrame:
    """cy, cx, part, id, lat, lon, centre: each point once as a centre, and in every part of the cells around its own.

    A cell's centres are dealt out to parts of about PART, and each part has all points that are at most
    ``metres`` away from one of its centres: so every neighbour of a centre is in one place with it.
    """
    high = _height(metres)
    own = _cells(points.dropna(), "lat", "lon", high).withColumnsRenamed({"cy": "oy", "cx": "ox"})
    held = own.groupBy(F.col("oy").alias("cy"), F.col("ox").alias("cx")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    near = _cells(own, "lat", "lon", high, around=True).join(held, ["cy", "cx"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    centre = (F.col("cy") == F.col("oy")) & (F.col("cx") == F.col("ox")) & (F.col("part") == F.pmod(F.xxhash64("id"), F.col("parts")))
    return near.select("cy", "cx", "part", "id", "lat", "lon", centre.alias("centre"))


def _fullest(part: pa.Table, metres: float) -> pa.Table:
    """total, i, lat_i, lon_i, toward of the fullest circle through one of the part's centres; no row if none has neighbours.

    Around a centre, every neighbour within the diameter opens and closes an arc of centres; as many
    circles lie over an angle as arcs are open there: those opened so far, less those closed before.
    """
    ids, lat, lon, centre = (part.column(c).to_numpy() for c in ("id", "lat", "lon", "centre"))
    order = np.lexsort((ids, lat))
    ids, lat, lon, centre = ids[order], lat[order], lon[order], centre[order]
    up, across = np.sin(np.radians(lat)), np.cos(np.radians(lat))
    reach = _height(2 * metres)
    least = np.cos(min(np.pi, 2 * metres / geo.EARTH_RADIUS_M)) - 1e-9
    low, high = np.searchsorted(lat, lat - reach, side="left"), np.searchsorted(lat, lat + reach, side="right")
    best = None
    for k in np.flatnonzero(centre).tolist():
        span = slice(low[k], high[k])
        cosine = up[k] * up[span] + across[k] * across[span] * np.cos(np.radians(lon[k] - lon[span]))
        near = np.flatnonzero((cosine >= least) & (ids[span] != ids[k]))
        d = geo.EARTH_RADIUS_M * np.arccos(np.clip(cosine[near], -1.0, 1.0))
        within = d <= 2 * metres
        near, d = near[within] + low[k], d[within]
        if not len(near) or best and len(near) + 1 < best[0]:
            continue
        phi = np.arccos(np.minimum(1.0, d / (2 * metres)))
        back = np.arctan2(lon[k] - lon[near], lat[k] - lat[near])
        opens, closes = back - phi, np.sort(back + phi)
        over = np.arange(2, len(near) + 2) - np.searchsorted(closes, np.sort(opens), side="left")
        total = int(over.max())
        if best and (total, -ids[k]) <= (best[0], -best[1]):
            continue
        first = np.lexsort((ids[near], opens))[over.argmax()]
        toward = np.arctan2(lon[near[first]] - lon[k], lat[near[first]] - lat[k]) - phi[first]
        best = (total, int(ids[k]), float(lat[k]), float(lon[k]), float(toward))
    return pa.Table.from_pylist([dict(zip(_BEST.names, best, strict=True))] if best else [], _BEST)


def _sweep(points: DataFrame, metres: float) -> DataFrame:
    """The circle with the most points as one row: latitude, longitude (degrees), total; none without neighbours.

    Only points travel: pairs and arcs are made and counted where a part's points are, a centre at a time.
    """
    ship(points.sparkSession)
    found = _neighbours(points, 2 * metres).groupBy("cy", "cx", "part").applyInArrow(lambda part: _fullest(part, metres), "total bigint, i bigint, lat_i double, lon_i double, toward double")
    step = geo.degrees_of_metres(F.lit(float(metres)))
    top = found.orderBy(F.desc("total"), "i").limit(1)
    return top.select((F.col("lat_i") + step * F.cos("toward")).alias("latitude"), (F.col("lon_i") + step * F.sin("toward")).alias("longitude"), "total")


def fullest_circle(ds: Dataset, poitype: str, metres: float, precise: bool = False, seed: int = 0) -> DataFrame:
    """latitude, longitude, total, covered: the circle of that radius with the most points of a type.

    ``total`` is the sweep's count, ``covered`` that of points within the radius by planar distance. If no
    two points are near, all but ``covered`` are -1. Above SAMPLE_FROM points, unless ``precise``, the best of
    some samples by hash is returned, with its total scaled up.
    """
    points = of_type(ds, poitype).select("id", "lat", "lon")
    n = 0 if precise else points.count()
    if n > SAMPLE_FROM:
        one_of = round(n / SAMPLE_TO)
        tried = None
        for k in range(SAMPLES):
            drawn = points.where(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(one_of)) == 0)
            found = _sweep(drawn, metres).withColumn("total", F.col("total") * one_of)
            tried = found if tried is None else tried.unionByName(found)
        found = tried.orderBy(F.desc("total"), "latitude", "longitude").limit(1)
    else:
        found = _sweep(points, metres)
    none = found.sparkSession.range(1).select(F.lit(-1.0).alias("latitude"), F.lit(-1.0).alias("longitude"), F.lit(-1).cast("bigint").alias("total"))
    best = found.unionByName(none).orderBy(F.desc("total")).limit(1)
    inside = points.crossJoin(F.broadcast(best)).where(geo.planar_m("lat", "lon", F.col("latitude"), F.col("longitude")) < metres).agg(F.count("*").alias("covered"))
    return best.crossJoin(inside)


def by_name_nearby(ds: Dataset, text: str, lat: float, lon: float, num: int = 10) -> DataFrame:
    """id, latitude, longitude, name, metres of nodes whose name is like the text, nearest first."""
    found = names.is_a(ds, text).withColumn("metres", geo.sphere_m(geo.degrees_of("latitude"), geo.degrees_of("longitude"), lat, lon))
    return found.orderBy("metres", "id", "name").limit(num)

