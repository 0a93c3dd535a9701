"""Plans that the operators rely on: filters and columns reach the scan, and nothing pairs everything."""

import re

import pytest

from geoloom.operators import poi, region, ways
from geoloom.sources import model
from geoloom.sources.model import of_rows

from test_operators import T, node


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snapshot") / "v0")
    rows = [node(i, 310_000_000 + i * 1000, 1_210_000_000 + i * 1000) for i in range(50)]
    model.write(of_rows(spark, nodes=rows, node_tags=[(i, "poitype", "a") for i in range(50)], ways=[(1, 2, T, True, 1)], way_nodes=[(1, i, i) for i in range(50)]), folder)
    return model.read(spark, folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table):
    return [x for x in plan(df).split("\n") if "FileScan" in x and f"/{table}]" in x]


def test_radius_reaches_the_scan(stored):
    (scan,) = scans(poi.within_radius(stored, "a", 31.0, 121.0, 500), "nodes")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(latitude,", scan)
    assert "ReadSchema: struct<id:bigint,latitude:bigint,longitude:bigint>" in scan


def test_box_reaches_the_scan(stored):
    for scan in scans(region.ways_in(stored, (31.0, 31.1, 121.0, 121.1)), "nodes"):
        assert "GreaterThanOrEqual(latitude," in scan and "visible" not in scan


def test_top_k_is_partial_before_it_is_final(stored):
    assert "TakeOrderedAndProject" in plan(ways.nearest_nodes(stored.nodes.where("visible"), 31.0, 121.0, 3))


def test_distance_join_is_an_equality_join(stored):
    text = plan(poi._neighbours(poi.of_type(stored, "a").select("id", "lat", "lon"), 100))
    assert re.search(r"(SortMergeJoin|HashJoin) \[cy", text) and "CartesianProduct" not in text
