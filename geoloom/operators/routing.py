"""Routes by car, bike and on foot over a weighted graph made of the ways."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators.ways import nearest_nodes
from geoloom.shipping import shared_folder, ship
from geoloom.sources.model import Dataset

# Classes of ways that count as another, the classes open to each mode, and the weights.
CLASS_OF = {
    "primary_link": "primary",
    "trunk": "primary",
    "trunk_link": "primary",
    "secondary_link": "secondary",
    "tertiary": "secondary",
    "tertiary_link": "secondary",
    "residential": "unclassified",
    "minor": "unclassified",
    "steps": "footway",
    "driveway": "service",
    "pedestrian": "footway",
    "bridleway": "cycleway",
    "track": "cycleway",
    "arcade": "footway",
    "canal": "river",
    "riverbank": "river",
    "lake": "river",
    "light_rail": "railway",
}
OPEN_TO = {
    "bike": "arbitrarygate primary secondary tertiary unclassified minor cycleway residential track service".split(),
    "car": "arbitrarygate motorway trunk primary secondary tertiary unclassified minor residential service".split(),
}
OPEN_TO["walk"] = [*OPEN_TO["bike"], "footway", "steps"]
WEIGHT = {
    "arbitrarygate": {"car": 9223372036854775807, "bike": 9223372036854775807, "walk": 9223372036854775807},
    "motorway": {"car": 10},
    "trunk": {"car": 10, "bike": 0.05},
    "primary": {"car": 2, "bike": 0.3, "walk": 1},
    "secondary": {"car": 1.5, "bike": 1, "walk": 1},
    "tertiary": {"car": 1, "bike": 1, "walk": 1},
    "unclassified": {"car": 1, "bike": 1, "walk": 1},
    "minor": {"car": 1, "bike": 1, "walk": 1},
    "bikeway": {"bike": 3, "walk": 0.2},
    "residential": {"car": 0.7, "bike": 3, "walk": 1},
    "track": {"car": 1, "bike": 1, "walk": 1},
    "service": {"car": 1, "bike": 1, "walk": 1},
    "bridleway": {"bike": 0.8, "walk": 1},
    "walkway": {"bike": 0.2, "walk": 1},
    "steps": {"walk": 1, "bike": 0.3},
}
MODES = ("car", "bike", "walk")

#: Edges up to which a search runs in one task; larger graphs are relaxed by joins.
LOCAL_EDGES = 5_000_000
_ROUNDS = 100_000


def _literal(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def class_of(highway: Column) -> Column:
    """The class that a way's own counts as; one step only."""
    return F.coalesce(F.element_at(_literal(CLASS_OF), highway), highway)


def weights_table() -> dict[tuple[str, str], float]:
    """The weight of each mode and class that is open to it; without an entry it is 0."""
    return {(mode, kind): float(WEIGHT.get(kind, {}).get(mode, 0)) for mode in MODES for kind in OPEN_TO[mode]}


def edges(ds: Dataset, modes: tuple[str, ...] = MODES) -> DataFrame:
    """mode, src, dst, weight: neighbours on a way, once for each direction that is open.

    Ways run backwards unless ``oneway`` is "yes", and always on foot. Of several ways between the same
    nodes the smallest way id gives the weight. Edges of weight 0 can't be used and are left out.
    """
    tags = ds.way_tags.where(F.col("k").isin("highway", "oneway")).groupBy("way_id")
    tags = tags.agg(F.max(F.when(F.col("k") == "highway", F.col("v"))).alias("highway"), F.max(F.when(F.col("k") == "oneway", F.col("v"))).alias("oneway"))
    known = tags.join(ds.ways.select(F.col("id").alias("way_id")), "way_id", "left_semi").withColumn("kind", class_of(F.col("highway")))
    weight = weights_table()
    open_modes = [
        F.when(F.col("kind").isin([k for m, k in weight if m == mode and weight[m, k] > 0]), F.struct(F.lit(mode).alias("mode"), F.element_at(_literal({k: w for (m, k), w in weight.items() if m == mode}), F.col("kind")).alias("weight")))
        for mode in modes
    ]
    usable = known.select("way_id", "oneway", F.explode(F.array_compact(F.array(*open_modes))).alias("m")).select("way_id", "oneway", "m.*")
    order = Window.partitionBy("id").orderBy("sequence_id")
    steps = ds.way_nodes.select(F.col("id").alias("way_id"), F.col("node_id").alias("src"), F.lead("node_id").over(order).alias("dst")).where("dst is not null")
    directed = steps.join(usable, "way_id")
    back = (F.coalesce("oneway", F.lit("")) != "yes") | (F.col("mode") == "walk")
    both = F.array_compact(F.array(F.struct("src", "dst"), F.when(back, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    rows = directed.select("mode", "weight", "way_id", F.explode(both).alias("e"))
    return rows.groupBy("mode", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.min_by("weight", "way_id").alias("weight"))


def routable(ds: Dataset, mode: str, usable: DataFrame | None = None) -> DataFrame:
    """id, latitude, longitude of visible nodes with a usable way out; ``usable`` saves making the mode's edges again."""
    out = (edges(ds, (mode,)) if usable is None else usable).select(F.col("src").alias("id")).distinct()
    return ds.nodes.where("visible").select("id", "latitude", "longitude").join(out, "id", "left_semi")


def snap(ds: Dataset, mode: str, lat: float, lon: float, usable: DataFrame | None = None) -> DataFrame:
    """id, dist of the routable node nearest to a place."""
    return nearest_nodes(routable(ds, mode, usable), lat, lon, 1).select("id", "dist")


def measured_edges(ds: Dataset, mode: str, usable: DataFrame | None = None) -> DataFrame:
    """src, dst, metres, cost (metres over weight) between visible nodes."""
    at = ds.nodes.where("visible").select("id", geo.degrees_of("latitude").alias("lat"), geo.degrees_of("longitude").alias("lon"))
    a = at.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = at.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = (edges(ds, (mode,)) if usable is None else usable).join(a, "src").join(b, "dst").withColumn("metres", geo.sphere_m("lat1", "lon1", "lat2", "lon2"))
    return rows.select("src", "dst", "metres", (F.col("metres") / F.col("weight")).alias("cost"))


_RESULT = "status string, metres double, cost double, path array<bigint>"


def _search(frames: Iterator[pd.DataFrame], start: int, goal: int) -> Iterator[pd.DataFrame]:
    """The cheapest path in a graph that one task holds."""
    graph: dict[int, list[tuple[int, float, float]]] = {}
    for frame in frames:
        for src, dst, metres, cost in frame[["src", "dst", "metres", "cost"]].itertuples(index=False):
            graph.setdefault(src, []).append((dst, metres, cost))
    best, came, heap, closed = {start: 0.0}, {start: (None, 0.0)}, [(0.0, start)], set()
    while heap:
        cost, at = heapq.heappop(heap)
        if at in closed:
            continue
        closed.add(at)
        if at == goal:
            path, metres = [], 0.0
            while at is not None:
                path.append(at)
                at, step = came[at]
                metres += step
            yield pd.DataFrame({"status": ["success"], "metres": [metres], "cost": [cost], "path": [path[::-1]]})
            return
        for to, metres, more in graph.get(at, ()):
            if to not in best or cost + more < best[to]:
                best[to], came[to] = cost + more, (at, metres)
                heapq.heappush(heap, (cost + more, to))
    yield pd.DataFrame({"status": ["fail at middle"], "metres": [-1.0], "cost": [-1.0], "path": [[]]})


def distances(graph: DataFrame, start: int) -> DataFrame:
    """node, cost, metres, via: the cheapest cost from ``start`` to every node, by relaxing the frontier.

    Each round joins the nodes whose cost fell with their edges; the table is checkpointed every round,
    so the plan stays short and a lost executor costs a round.
    """
    spark = shared_folder(graph.sparkSession)
    graph = graph.select("src", "dst", "cost", "metres").checkpoint()
    kind = graph.schema["src"].dataType.simpleString()
    known = spark.createDataFrame([(start, 0.0, 0.0, None)], f"node {kind}, cost double, metres double, via {kind}")
    frontier = known
    for _ in range(_ROUNDS):
        step = graph.join(frontier.select(F.col("node").alias("src"), F.col("cost").alias("c0"), F.col("metres").alias("m0")), "src")
        reached = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("c0") + F.col("cost")).alias("cost"), (F.col("m0") + F.col("metres")).alias("metres"), F.col("src").alias("via"))).alias("best"))
        merged = known.join(reached, "node", "full").select(
            "node",
            F.when(F.col("cost").isNull() | (F.col("best.cost") < F.col("cost")), F.col("best")).otherwise(F.struct("cost", "metres", "via")).alias("b"),
            (F.col("cost").isNull() | F.coalesce(F.col("best.cost") < F.col("cost"), F.lit(False))).alias("fell"),
        ).select("node", "b.cost", "b.metres", "b.via", "fell").checkpoint()
        frontier, known = merged.where("fell").drop("fell"), merged.drop("fell")
        if frontier.isEmpty():
            return known
    raise RuntimeError("costs still fall")


def _path(known: DataFrame, goal: int) -> list[int]:
    """The nodes on the way to ``goal``; one lookup a hop, which only a found route needs."""
    path, at = [], goal
    while at is not None:
        path.append(at)
        row = known.where(F.col("node") == at).select("via").first()
        at = row.via if row else None
    return path[::-1]


def shortest(ds: Dataset, mode: str, start: tuple[float, float], goal: tuple[float, float], local_edges: int = LOCAL_EDGES) -> DataFrame:
    """status, metres, cost, path of the cheapest route between two places, snapped to routable nodes.

    status is "success", "fail at beginning" (no routable node) or "fail at middle" (no route). The search
    runs in one task if the graph was counted to fit, else by joins over the whole cluster.
    """
    spark = shared_folder(ship(ds.spark))
    usable = edges(ds, (mode,)).checkpoint()
    first, last = (snap(ds, mode, *place, usable).first() for place in (start, goal))
    if first is None or last is None:
        return spark.createDataFrame([("fail at beginning", -1.0, -1.0, [])], _RESULT)
    if first.id == last.id:
        return spark.createDataFrame([("success", 0.0, 0.0, [first.id])], _RESULT)
    graph = measured_edges(ds, mode, usable)
    if usable.count() <= local_edges:
        a, b = first.id, last.id
        return graph.repartition(1).mapInPandas(lambda frames: _search(frames, a, b), _RESULT)
    known = distances(graph, first.id)
    end = known.where(F.col("node") == last.id).first()
    if end is None:
        return spark.createDataFrame([("fail at middle", -1.0, -1.0, [])], _RESULT)
    return spark.createDataFrame([("success", end.metres, end.cost, _path(known, last.id))], _RESULT)


def with_places(ds: Dataset, route: DataFrame) -> DataFrame:
    """place, node_id, latitude, longitude of a route's path, in order."""
    nodes = route.select(F.posexplode("path").alias("place", "node_id"))
    seen = ds.nodes.where("visible").select(F.col("id").alias("node_id"), "latitude", "longitude")
    return nodes.join(seen, "node_id").select("place", "node_id", "latitude", "longitude").orderBy("place")
