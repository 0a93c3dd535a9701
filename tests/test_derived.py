"""Derived tables are refreshed where a change touches them."""

import json

import pytest

from geoloom.operators import changes, layers
from geoloom.plans import derived

from test_operators import T, base, commit_file


def test_refresh_after_a_commit(spark, tmp_path):
    before = base(spark)
    folder = str(tmp_path / "derived")
    assert derived.write(before, folder) == list(derived.TABLES)
    after, _ = changes.apply_files(before, [commit_file(tmp_path / "a.xml", [(1, 31.5, 121.0)])], T)
    assert derived.refresh(before, after, folder) == ["node_names", "node_places"]
    assert [r.clean_name for r in derived.read(spark, folder, "node_names").collect()] == ["new1"]
    assert derived.read(spark, folder, "node_places").count() == 2
    with pytest.raises(ValueError, match="derived"):
        derived.read(spark, folder, "other")


def test_layers_round_trip(spark, tmp_path):
    shown = layers.points(base(spark).nodes, "target_points")
    derived.write_layers(shown, str(tmp_path / "l"))
    assert [tuple(r) for r in derived.read_layers(spark, str(tmp_path / "l")).select(*shown.columns).collect()] == [tuple(r) for r in shown.collect()]
    derived.write_geojson(shown, str(tmp_path / "g"))
    (feature,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert feature["geometry"] == {"type": "Point", "coordinates": [121.0, 31.0]}
