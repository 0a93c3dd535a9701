"""Searches, routes, regions and changesets on small networks."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoloom.operators import changes, layers, poi, region, routing, ways
from geoloom.sources import aliases, changeset_xml, model
from geoloom.sources.model import of_rows

T = datetime(2016, 1, 1)
R = 6370996.81


def sphere(a, b):
    (y1, x1), (y2, x2) = ((math.radians(v / 1e7) for v in p) for p in (a, b))
    return R * math.acos(max(-1, min(1, math.sin(y1) * math.sin(y2) + math.cos(y1) * math.cos(y2) * math.cos(x1 - x2))))


def node(i, y, x, changeset=2, visible=True):
    return (i, y, x, changeset, visible, T, 0, 1)


def places(n, seed, spread=400_000):
    rng = random.Random(seed)
    return {i: (312_000_000 + rng.randrange(spread), 1_214_000_000 + rng.randrange(spread)) for i in range(1, n + 1)}


def poi_set(spark, n, seed, kinds=("a", "b")):
    at = places(n, seed)
    kind = {i: kinds[i % len(kinds)] for i in at}
    return at, kind, of_rows(spark, nodes=[node(i, *p) for i, p in at.items()], node_tags=[(i, "poitype", kind[i]) for i in at] + [(i, "name", f"n{i}") for i in at])


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("kinds", [("a", "b"), ("a", "a")])
def test_pairs_are_brute_force(spark, ordered, kinds):
    at, kind, ds = poi_set(spark, 60, 3, kinds)
    origin = (31.21, 121.42)
    fixed = (312_100_000, 1_214_200_000)
    want = []
    for i in at:
        for j in at:
            if i != j and kind[i] == kinds[0] and kind[j] == kinds[1]:
                start = sphere(fixed, at[i]) if ordered else min(sphere(fixed, at[i]), sphere(fixed, at[j]))
                want.append((round(sphere(at[i], at[j]) + start, 3), i, j))
    got = [(round(r.total, 3), r.id1, r.id2) for r in poi.pair_topk(ds, *kinds, *origin, order_sensitive=ordered).collect()]
    assert got == sorted(want)[:5]


def test_pairs_of_few_points(spark):
    ds = of_rows(spark, nodes=[node(1, 312_000_000, 1_214_000_000), node(2, 312_100_000, 1_214_000_000)], node_tags=[(1, "poitype", "a"), (2, "poitype", "b")])
    assert [(r.id1, r.id2, r.name1) for r in poi.pair_topk(ds, "a", "b", 31.2, 121.4).collect()] == [(1, 2, "")]
    assert poi.pair_topk(ds, "a", "none", 31.2, 121.4).count() == 0


def test_fullest_circle(spark):
    near = [(312_000_000, 1_214_000_000), (312_000_500, 1_214_000_300), (312_000_200, 1_214_000_900)]
    ds = of_rows(spark, nodes=[node(i, *p) for i, p in enumerate(near, 1)] + [node(9, 320_000_000, 1_230_000_000)], node_tags=[(i, "poitype", "a") for i in (1, 2, 3, 9)])
    best = poi.fullest_circle(ds, "a", 100).first()
    # The circle passes through a point, and the recount is planar and strict.
    assert best.total == 3 and 1 <= best.covered <= 3
    lone = poi.fullest_circle(ds.with_tables(nodes=ds.nodes.where("id = 9")), "a", 100).first()
    assert (lone.latitude, lone.longitude, lone.total, lone.covered) == (-1, -1, -1, 0)


def test_sampled_circle_scales_its_count(spark, monkeypatch):
    monkeypatch.setattr(poi, "SAMPLE_FROM", 10)
    monkeypatch.setattr(poi, "SAMPLE_TO", 15)
    at, _, ds = poi_set(spark, 40, 5, ("a",))
    best = poi.fullest_circle(ds, "a", 20_000).first()
    assert best.total >= 2 and best.covered > 0


def test_radius_is_strict_and_sorted(spark):
    ds = of_rows(spark, nodes=[node(1, 310_000_000, 1_210_000_000), node(2, 310_100_000, 1_210_000_000), node(3, 310_000_000, 1_210_000_100, visible=False)], node_tags=[(i, "poitype", "a") for i in (1, 2, 3)])
    got = [r.id for r in poi.within_radius(ds, "a", 31.0, 121.0, 0.01 * 111195).collect()]
    assert got == [1, 3]


def test_aliases(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x y  z\n\nq\ny2 y\n")
    assert {(r.alias, r.poitype) for r in aliases.read_aliases(spark, str(tmp_path / "a.txt")).collect()} == {("x", "x"), ("y", "x"), ("z", "x"), ("q", "q"), ("y2", "y2")}
    ds = of_rows(spark)
    assert [r.poitype for r in poi.canonical_type(ds, aliases.aliases(spark), "加油").collect()] == ["加油加气站"]


# --- routes -------------------------------------------------------------------------------------


def street_net(spark, n=40, seed=11):
    rng = random.Random(seed)
    at = places(n, seed)
    streets, tags = [], []
    for w in range(1, 50):
        streets += [(w, rng.randrange(1, n + 1), k) for k in range(1, rng.randint(2, 5))]
        tags.append((w, "highway", rng.choice(["motorway", "primary", "secondary", "residential", "footway", "canal", "trunk", "cycleway"])))
        if rng.random() < 0.4:
            tags.append((w, "oneway", rng.choice(["yes", "-1", "no"])))
    ds = of_rows(spark, nodes=[node(i, *p) for i, p in at.items()], ways=[(w, 2, T, True, 1) for w in range(1, 50)], way_nodes=streets, way_tags=tags)
    return at, streets, tags, ds


def graph_of(at, streets, tags, mode):
    table = routing.weights_table()
    tag = {(w, k): v for w, k, v in tags}
    edges = {}
    for w in sorted({w for w, _, _ in streets}):
        kind = tag.get((w, "highway"), "")
        weight = table.get((mode, routing.CLASS_OF.get(kind, kind)), 0)
        path = [n for _, n, _ in sorted((s for s in streets if s[0] == w), key=lambda s: s[2])]
        for a, b in zip(path, path[1:], strict=False):
            if weight > 0:
                edges.setdefault((a, b), weight)
                if tag.get((w, "oneway")) != "yes" or mode == "walk":
                    edges.setdefault((b, a), weight)
    return edges


@pytest.mark.parametrize("mode", routing.MODES)
def test_edges(spark, mode):
    at, streets, tags, ds = street_net(spark)
    got = {(r.src, r.dst): r.weight for r in routing.edges(ds, (mode,)).collect()}
    assert got == graph_of(at, streets, tags, mode)


def cheapest(at, edges, start):
    best = {start: 0.0}
    for _ in at:
        for (a, b), w in edges.items():
            if a in best and best[a] + sphere(at[a], at[b]) / w < best.get(b, math.inf) - 1e-9:
                best[b] = best[a] + sphere(at[a], at[b]) / w
    return best


def test_both_searches_are_dijkstra(spark):
    at, streets, tags, ds = street_net(spark)
    edges = graph_of(at, streets, tags, "walk")
    first = min(a for a, _ in edges)
    want = cheapest(at, edges, first)
    known = routing.distances(routing.measured_edges(ds, "walk"), first)
    got = {r.node: r.cost for r in known.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    goal = max((k for k in want if k in {a for a, _ in edges}), key=want.get)
    ends = [(at[k][0] / 1e7, at[k][1] / 1e7) for k in (first, goal)]
    local, wide = (routing.shortest(ds, "walk", *ends, local_edges=n).first() for n in (10_000, 0))
    assert local.status == wide.status == "success"
    assert local.cost == pytest.approx(wide.cost) == pytest.approx(want[goal], abs=1e-3)
    for path in (local.path, wide.path):
        assert path[0] == first and path[-1] == goal and all(p in edges for p in zip(path, path[1:], strict=False))


def test_route_statuses(spark):
    two = [node(1, 310_000_000, 1_210_000_000), node(2, 310_001_000, 1_210_000_000), node(3, 310_000_000, 1_220_000_000), node(4, 310_001_000, 1_220_000_000)]
    ds = of_rows(spark, nodes=two, ways=[(1, 2, T, True, 1), (2, 2, T, True, 1)], way_nodes=[(1, 1, 1), (1, 2, 2), (2, 3, 1), (2, 4, 2)], way_tags=[(1, "highway", "primary"), (2, "highway", "primary")])
    status = lambda ds, a, b: tuple(routing.shortest(ds, "car", a, b).first())[:2]
    assert status(ds, (31.0, 121.0), (31.0, 122.0)) == ("fail at middle", -1)
    assert status(ds, (31.0, 121.0), (31.0, 121.0)) == ("success", 0)
    assert status(of_rows(spark), (31.0, 121.0), (31.0, 121.0)) == ("fail at beginning", -1)


# --- regions ------------------------------------------------------------------------------------


def test_region_with_a_cycle_of_relations(spark):
    ds = of_rows(
        spark,
        nodes=[node(1, 310_000_000, 1_210_000_000), node(2, 330_000_000, 1_210_000_000)],
        ways=[(5, 2, T, True, 1)], way_nodes=[(5, 1, 1), (5, 2, 2)], way_tags=[(5, "name", 'a "b" <c>')],
        relations=[(r, 2, T, True, 1) for r in (7, 8, 9)],
        relation_members=[(7, "Way", 5, "", 1), (8, "Relation", 7, "", 1), (9, "Relation", 8, "", 1), (7, "Relation", 9, "", 2)],
    )
    box = (30.9, 31.1, 120.9, 121.1)
    assert {(r.relation_id, r.level) for r in region.relations_in(ds, box).collect()} == {(7, 0), (8, 1), (9, 2)}
    text = "\n".join(r.text for r in region.xml_lines(ds, box).orderBy("kind", "id", "line").collect())
    assert '<nd ref="1"/>' in text and 'ref="2"' not in text and "&lt;c&gt;" in text and "a &quot;b&quot;" in text
    import xml.etree.ElementTree as E

    root = E.fromstring(text.split("\n", 1)[1])
    assert [x.tag for x in root] == ["bound", "node", "way", "relation", "relation", "relation"]
    assert {m.get("ref") for m in root[3]} == {"5", "9"}


def test_region_file(spark, tmp_path):
    ds = of_rows(spark, nodes=[node(1, 310_000_000, 1_210_000_000)])
    region.write_xml(ds, (30.9, 31.1, 120.9, 121.1), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert any('lat="31.0000000"' in x for x in lines) and "</osm>" in lines


# --- changesets ---------------------------------------------------------------------------------


def commit_file(path, nodes, ways=(), extra=""):
    body = "".join(f'<node id="{i}" lat="{y}" lon="{x}"><tag k="name" v="new{i}"/></node>' for i, y, x in nodes)
    body += "".join(f'<way id="{w}">' + "".join(f'<nd ref="{n}"/>' for n in refs) + "</way>" for w, refs in ways)
    path.write_text(f'<?xml version="1.0" encoding="UTF-8"?><changeset operation="commit">{body}{extra}</changeset>')
    return str(path)


def base(spark):
    return of_rows(spark, nodes=[node(10, 310_000_000, 1_210_000_000, changeset=4)], ways=[(3, 4, T, True, 1)], way_nodes=[(3, 10, 1)], changesets=[(4, -1, T, 0, 0, 0, 0, T, 1)])


def rows_of(ds):
    return {name: sorted(map(tuple, df.collect()), key=repr) for name, df in ds.tables().items()}


def test_commit_merges_near_nodes_and_rollback_undoes_it(spark, tmp_path):
    ds = base(spark)
    file = commit_file(tmp_path / "a.xml", [(1, 31.00001, 121.0), (2, 31.2, 121.2)], [(1, [1, 2])])
    after, ids = changes.apply_files(ds, [file], T)
    assert ids == [5]
    got = rows_of(after)
    assert [r[0] for r in got["nodes"]] == [10, 11]
    assert got["way_nodes"] == [(3, 10, 1), (4, 10, 1), (4, 11, 2)]
    assert got["node_tags"] == [(11, "name", "new2")]
    assert got["changesets_dependence"] == [(5, 4)]
    assert got["changesets"][-1][-1] == 3
    assert changes.changed_parts(ds, after) == {"routing": True, "node_names": True, "way_names": False, "node_places": True}
    back = changes.rollback(after, spark.createDataFrame([(5, None, None), (99, None, None)], "id bigint, since string, until string"))
    assert rows_of(back) == rows_of(ds)
    with pytest.raises(ValueError, match="without 5"):
        changes.rollback(after, spark.createDataFrame([(4, None, None)], "id bigint, since string, until string"))
    with pytest.raises(ValueError, match="original"):
        changes.rollback(after.with_tables(changesets=after.changesets.withColumn("id", F.lit(1).cast("bigint"))), spark.createDataFrame([(1, None, None)], "id bigint, since string, until string"))


def test_rollback_by_time(spark, tmp_path):
    after, _ = changes.apply_files(base(spark), [commit_file(tmp_path / "a.xml", [(1, 31.5, 121.0)])], datetime(2016, 3, 1))
    (tmp_path / "r.xml").write_text('<?xml version="1.0"?><changeset operation="rollback"><!-- no --><target created_at_from="2016-02-01T00:00:00Z" created_at_to="now"/></changeset>')
    back, ids = changes.apply_files(after, [str(tmp_path / "r.xml")], T)
    assert ids == [6] and rows_of(back) == rows_of(base(spark))


def test_bad_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        changes.apply_files(base(spark), [commit_file(tmp_path / "a.xml", [(1, 31.5, 121.0)], [(1, [1, 7])])], T)
    with pytest.raises(ValueError, match="relations"):
        changeset_xml.read_change(spark, commit_file(tmp_path / "b.xml", [(1, 31.5, 121.0)], extra='<relation id="1"/>'))
    (tmp_path / "c.xml").write_text('<?xml version="1.0"?><changeset operation="other"></changeset>')
    with pytest.raises(ValueError, match="operation"):
        changeset_xml.read_change(spark, str(tmp_path / "c.xml"))


def test_snapshot_round_trip_and_stream(spark, tmp_path):
    from geoloom.streaming import changes as stream

    folder = str(tmp_path / "versions")
    stream.publish(base(spark), folder, -1)
    (tmp_path / "in").mkdir()
    commit_file(tmp_path / "in" / "a.xml", [(1, 31.5, 121.0)])
    commit_file(tmp_path / "in" / "b.xml", [(1, 31.6, 121.0)])
    stream.run(spark, str(tmp_path / "in"), folder, str(tmp_path / "state")).awaitTermination(120)
    got = stream.latest(spark, folder)
    assert sorted(r.id for r in got.nodes.collect()) == [10, 11, 12]
    assert sorted(r.id for r in got.changesets.collect()) == [4, 5, 6]
    assert got.nodes.schema == model.read(spark, f"{folder}/version=-1").nodes.schema


# --- layers -------------------------------------------------------------------------------------


def test_layers(spark):
    at, _, ds = poi_set(spark, 30, 8)
    shown = layers.points(ds.nodes, "target_points")
    box = layers.bounds(shown).first()
    assert (box.max_lat - box.min_lat) / (box.max_lon - box.min_lon) == pytest.approx(9 / 16)
    assert all(box.min_lat <= y / 1e7 <= box.max_lat and box.min_lon <= x / 1e7 <= box.max_lon for y, x in at.values())
    assert layers.background_points(ds, layers.bounds(shown), num=10, ratio=0.7).count() == 21
    assert layers.background_points(ds, layers.bounds(shown), num=20, ratio=0.7).count() == 30
    assert layers.report(shown).first().places == 30
    assert layers.geojson_lines(shown).count() == 30


def test_polyline_with_hidden_node(spark):
    ds = of_rows(spark, nodes=[node(1, 310_000_000, 1_210_000_000), node(2, 310_000_000, 1_211_000_000, visible=False)], way_nodes=[(1, 1, 1), (1, 2, 2)])
    got = ways.nodes_in_order(ds, 1).collect()
    assert [(r.node_id, r.latitude) for r in got] == [(1, 310_000_000), (2, None)]
    assert ways.polyline_lengths(ds).first().metres == 0


def test_results_in_batches(spark, tmp_path):
    from geoloom.sources import results

    rows = spark.range(10)
    assert [len(b) for b in results.batches(rows, 4)] == [4, 4, 2]
    results.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10
