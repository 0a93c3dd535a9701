"""Distances, geometry and names against cases worked out by hand."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.text import clean_name, tokens, weighted_edit_distance, within_edits
from geoloom.operators import names, ways
from geoloom.sources.model import of_rows

WORDS = ["".join(x) for n in range(4) for x in itertools.product("abc", repeat=n)]


def weighted(a: str, b: str) -> int:
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (0 if x == y else 1.5)))
        row = new
    return math.floor(row[-1] + 0.5)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "metres"), [((32.060255, 118.796877), (39.904211, 116.407395), 898211.279), ((30.8754122, 120.3469386), (30.8754122, 120.4469386), 9543.691)])
def test_sphere(spark, a, b, metres):
    assert one(spark, geo.sphere_m(*a, *b)) == pytest.approx(metres, abs=0.01)


def test_sphere_of_the_same_place_is_zero(spark):
    assert one(spark, geo.sphere_m(31.1, 121.3, 31.1, 121.3)) == pytest.approx(0, abs=0.2)


def test_planar_and_scales(spark):
    assert one(spark, geo.planar_m(31.0, 121.0, 31.0, 122.0)) == pytest.approx(111195)
    assert one(spark, geo.fixed_of(F.lit(-1.99999999))) == -19999999
    assert one(spark, geo.any_degrees(F.lit(312000000))) == pytest.approx(31.2)
    assert one(spark, geo.any_degrees(F.lit(31.2))) == pytest.approx(31.2)
    assert one(spark, geo.degrees_of_metres(F.lit(geo.SPHERE_M_PER_DEGREE))) == pytest.approx(1)


def test_triangle(spark):
    assert one(spark, geo.triangle_height(F.lit(3.0), F.lit(4.0), F.lit(5.0))) == pytest.approx(2.4)
    assert one(spark, geo.triangle_height(F.lit(3.0), F.lit(3.0), F.lit(0.0))) is None


def test_edit_distance_matches_a_table_on_all_short_words(spark):
    pairs = [(a, b) for a in WORDS for b in WORDS]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.d for r in rows.withColumn("d", weighted_edit_distance(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): weighted(a, b) for a, b in pairs}
    near = {(r.a, r.b) for r in rows.where(within_edits(F.col("a"), F.col("b"), 2)).collect()}
    assert near == {p for p in pairs if weighted(*p) <= 2}


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_rounded_distance_keeps_the_triangle_inequality(a, b, c):
    assert weighted(a, c) <= weighted(a, b) + weighted(b, c)


def test_edit_distance_of_null(spark):
    assert one(spark, weighted_edit_distance(F.lit(None).cast("string"), F.lit("a"))) is None


def test_range_query_example(spark):
    words = spark.createDataFrame([(w,) for w in ("apple", "applela", "pinapple", "ahhle", "pear")], "clean_name string")
    got = [(r.distance, r.clean_name) for r in names.edit_matches(words, "apple", 3).collect()]
    assert got == [(0, "apple"), (2, "applela"), (3, "pinapple"), (3, "ahhle")]


def test_clean_and_tokens(spark):
    assert one(spark, clean_name(F.lit("人民广场 (北)（x）"))) == "人民广场北x"
    assert one(spark, tokens(F.lit("人民广场 north-gate 2"))) == ["人民", "民广", "广场", "north", "gate", "2"]
    assert names.segments("人民广场 north-gate 2") == ["人民", "民广", "广场", "north", "gate", "2"]
    assert one(spark, tokens(F.lit(""))) == []


def test_tiers(spark):
    known = spark.createDataFrame([(1, "abcd"), (2, "abcdxxx"), (3, "zzzzabcdzz")], "id bigint, name string")
    found = lambda text: [(r.clean_name, r.distance) for r in names.similar(known, text).collect()]
    assert found("ab cd") == [("abcd", 0)]
    assert found("abcdx") == [("abcd", 1), ("abcdxxx", 2)]
    assert found("abcdxxxyyyy") == [("abcdxxx", 4)]
    assert found("nothing like it at all") == []


def line(spark, places, y, x):
    rows = [(1, k, a, b, y, x) for k, (a, b) in enumerate(places, 1)]
    return spark.createDataFrame(rows, "id bigint, sequence_id bigint, latitude bigint, longitude bigint, y bigint, x bigint")


def test_polyline_takes_the_first_segment_beside_the_place(spark):
    # The place lies beside the first segment, far off, and close to the third.
    places = [(0, 0), (0, 100000), (90000, 100000), (90000, 0)]
    rows = line(spark, places, 80000, 50000)
    first = ways.distance_to_polyline(rows, ["id"]).first().metres
    nearest = ways.distance_to_polyline(rows, ["id"], nearest=True).first().metres
    assert first == pytest.approx(80000 / 1e7 * geo.SPHERE_M_PER_DEGREE, rel=1e-3)
    assert nearest == pytest.approx(10000 / 1e7 * geo.SPHERE_M_PER_DEGREE, rel=1e-3)


def test_polyline_ends_and_repeated_vertices(spark):
    rows = line(spark, [(0, 0), (0, 0), (0, 100000)], 0, 200000)
    assert ways.distance_to_polyline(rows, ["id"]).first().metres == pytest.approx(100000 / 1e7 * geo.SPHERE_M_PER_DEGREE, rel=1e-3)
    rows = line(spark, [(0, 5)], 0, 0)
    assert ways.distance_to_polyline(rows, ["id"]).first().metres is not None


@settings(max_examples=3, deadline=None)
@given(st.data())
def test_nearest_nodes_join_is_brute_force(spark, data):
    place = st.tuples(st.integers(-50_000, 50_000), st.integers(-50_000, 50_000))
    nodes = data.draw(st.lists(place, min_size=1, max_size=30))
    asked = data.draw(st.lists(place, min_size=1, max_size=6))
    k = data.draw(st.integers(1, 4))
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(nodes)], "id bigint, latitude bigint, longitude bigint")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "q bigint, latitude bigint, longitude bigint")
    got = sorted((r.q, r.rank, r.id) for r in ways.nearest_nodes_join(left, right, k).collect())
    want = []
    for q, (y, x) in enumerate(asked):
        best = sorted(((a - y) ** 2 + (b - x) ** 2, i) for i, (a, b) in enumerate(nodes))[:k]
        want += [(q, n, i) for n, (_, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_nearest_nodes_join_of_nothing(spark):
    ds = of_rows(spark)
    empty = spark.createDataFrame([], "q bigint, latitude bigint, longitude bigint")
    assert ways.nearest_nodes_join(ds.nodes, empty, 2).count() == 0
