"""Queries over whole tables against brute force on a small network."""

import json
from collections import Counter

import pytest

from geoloom.operators import region
from geoloom.plans import queries as q
from geoloom.sources.model import of_rows

from test_operators import T, node

AT = {1: (310_500_000, 1_211_500_000), 2: (310_600_000, 1_212_000_000), 3: (330_000_000, 1_212_000_000), 4: (312_000_000, 1_214_000_000), 5: (312_010_000, 1_214_010_000)}
WAYS = {5: [1, 2, 3], 2500: [3, 2, 1], 600_000: [4, 5], 700_000: [3]}


@pytest.fixture(scope="module")
def ds(spark):
    return of_rows(
        spark,
        nodes=[node(i, *p) for i, p in AT.items()],
        node_tags=[(4, "poitype", "PROMO")],
        ways=[(w, 2, T, True, 1) for w in WAYS],
        way_nodes=[(w, n, k) for w, held in WAYS.items() for k, n in enumerate(held, 1)],
        relations=[(r, 2, T, True, 1) for r in (7, 8, 9)],
        relation_tags=[(8, "name", "a & b")],
        relation_members=[(7, "Way", 2500, "street", 1), (8, "Relation", 7, "", 1), (9, "Way", 700_000, "", 1)],
    )


def test_all_lines_are_clipped(ds):
    lo_lat, hi_lat, lo_lon, hi_lon = q.BOX
    inside = {n for n, (y, x) in AT.items() if lo_lat <= y / 1e7 <= hi_lat and lo_lon <= x / 1e7 <= hi_lon}
    places = {w: [k for k, n in enumerate(held, 1) if n in inside] for w, held in WAYS.items()}
    got = {tuple(r) for r in q.clipped_lines(ds).collect()}
    assert got == {(w, len(k), k[0], k[-1]) for w, k in places.items() if k} and 2500 in {r[0] for r in got}


def test_shown_lines(ds):
    assert {tuple(r) for r in q.map_report(ds).collect()} == {("target_points", 1, 1, 0), ("target_lines", 1, 2, 1)}
    shown = [json.loads(r.value)["properties"] for r in q.map_geojson(ds).collect()]
    assert Counter((x["layer"], x["id"]) for x in shown) == {("target_points", 4): 1, ("target_lines", 600_000): 1}


def test_ancestors_of_all_way_members(ds):
    assert {tuple(r) for r in q.relation_ancestors(ds).collect()} == {(7, 0), (8, 1), (9, 0)}


def test_whole_file(ds):
    got = [r.text for r in q.osm_xml_file(ds).orderBy("kind", "id", "line").collect()]
    lo_lat, hi_lat, lo_lon, hi_lon = q.BOX
    stamp = 'timestamp="2016-01-01T00:00:00Z"'
    rest = f'visible="true" version="1" changeset="2" {stamp}'
    want = ["<?xml version='1.0' encoding='UTF-8'?>", "<osm version='0.6' generator='geoloom'>", f'\t<bound minlon="{lo_lon}" minlat="{lo_lat}" maxlon="{hi_lon}" maxlat="{hi_lat}"/>']
    inside = [n for n, (y, x) in AT.items() if lo_lat <= y / 1e7 <= hi_lat and lo_lon <= x / 1e7 <= hi_lon]
    want += [f'\t<node id="{n}" lat="{AT[n][0] / 1e7:.7f}" lon="{AT[n][1] / 1e7:.7f}" {rest}/>' for n in inside]
    for w, held in WAYS.items():
        if set(held) & set(inside):
            want += [f'\t<way id="{w}" {rest}>', *[f'\t\t<nd ref="{n}"/>' for n in held if n in inside], "\t</way>"]
    want += [f'\t<relation id="7" {rest}>', '\t\t<member type="Way" ref="2500" role="street"/>', "\t</relation>"]
    want += [f'\t<relation id="8" {rest}>', '\t\t<member type="Relation" ref="7" role=""/>', '\t\t<tag k="name" v="a &amp; b"/>', "\t</relation>", "</osm>"]
    assert got == want


def test_chain_of_many_relations(spark):
    ds = of_rows(spark, relation_members=[(k + 1, "Relation", k, "", 1) for k in range(1, 104)])
    got = {tuple(r) for r in region.ancestors(ds, spark.createDataFrame([(1,)], "relation_id bigint")).collect()}
    assert got == {(k, k - 1) for k in range(1, 105)}
