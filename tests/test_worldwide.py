"""Places half a world apart, across the date line and near the poles."""

import math
import random

import pytest

from geoloom import shipping
from geoloom.operators import layers, poi, ways

NODES = "id bigint, latitude bigint, longitude bigint"


def fixed(*places):
    return [(k, int(lat * 1e7), int(lon * 1e7)) for k, (lat, lon) in enumerate(places)]


def test_nearest_node_half_a_world_away(spark):
    nodes = spark.createDataFrame(fixed((0, 170), (0, -169), (89, 10)), NODES)
    got = [(r.rank, r.id) for r in ways.nearest_nodes(nodes, 0.0, -170.0, 3).collect()]
    assert got == [(1, 1), (2, 2), (3, 0)]


def test_nearest_nodes_of_far_places(spark):
    rng = random.Random(3)
    # Nine in ten nodes lie in a millionth of the extent.
    places = [(rng.uniform(31.2, 31.20018), rng.uniform(121.4, 121.40036)) for _ in range(270)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(30)]
    nodes = fixed(*places)
    asked = fixed((0, 170), (31.2001, 121.4001), (-88, -179.9), (60, 0))
    queries = spark.createDataFrame(asked, "q bigint, latitude bigint, longitude bigint")
    got = sorted((r.q, r.rank, r.id) for r in ways.nearest_nodes_join(spark.createDataFrame(nodes, NODES), queries, 3).collect())
    want = []
    for q, y, x in asked:
        best = sorted(((y - b) ** 2 + (x - c) ** 2, a) for a, b, c in nodes)[:3]
        want += [(q, k, a) for k, (_, a) in enumerate(best, 1)]
    assert got == sorted(want)
    one = ways.nearest_nodes_join(spark.createDataFrame([(7, 0, 0)], NODES), spark.createDataFrame([(1, 0, 1_700_000_000)], "q bigint, latitude bigint, longitude bigint"))
    assert [(r.id, r.dist) for r in one.collect()] == [(7, 1.7e9)]


@pytest.mark.parametrize("reach", [300_000.0, 2_000_000.0, 9_000_000.0])
def test_near_points_meet(spark, reach):
    rng = random.Random(5)
    place = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    one = [(k, *place()) for k in range(120)] + [(900, 89.9, 10.0), (901, -89.99, -170.0), (902, 0.0, 180.0)]
    two = [(k, *place()) for k in range(120)] + [(900, 89.95, -171.0), (901, -89.9, 11.0), (902, 0.1, -180.0)]
    met = poi._meeting(spark.createDataFrame(one, "id1 int, lat1 double, lon1 double"), spark.createDataFrame(two, "id2 int, lat2 double, lon2 double"), reach)
    got = [(r.id1, r.id2) for r in met.collect()]
    assert len(got) == len(set(got))

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        return 6370996.81 * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(a[2] - b[2])))))

    assert {(a[0], b[0]) for a in one for b in two if metres(a, b) <= reach} <= set(got)


def test_lines_are_sampled_whole(spark):
    rows = spark.createDataFrame([("l", f, s, 0.5, 0.5) for f in range(40) for s in range(3)], "layer string, feature_id bigint, seq int, lat double, lon double")
    box = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "min_lat double, min_lon double, max_lat double, max_lon double")
    got = layers.clipped_lines(rows, box, num=10, ratio=0.5).collect()
    assert len({r.feature_id for r in got}) == 20 and len(got) == 60


class _Context:
    master = "spark://host:7077"

    class _jsc:
        @staticmethod
        def sc():
            return _Context

    @staticmethod
    def getCheckpointDir():
        return _Context

    @staticmethod
    def isEmpty():
        return True


class _Session:
    sparkContext = _Context

    class conf:
        @staticmethod
        def get(_, other):
            return other


def test_several_machines_need_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shipping.shared_folder(_Session)
