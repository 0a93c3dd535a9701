"""The same questions in DuckDB's SQL, on the same Parquet tables."""

from __future__ import annotations

from geoloom.operators import routing
from geoloom.plans import queries as q
from geoloom.sources.aliases import POI_TYPE_LINES
from geoloom.sources.fixture import with_tables

_R = 6370996.81
_LAT, _LON = q.ORIGIN


def _num(x: float) -> str:
    return f"{x!r}e0"


def sphere(lat1, lon1, lat2, lon2) -> str:
    lat1, lon1, lat2, lon2 = (_num(x) if isinstance(x, float) else x for x in (lat1, lon1, lat2, lon2))
    cosine = f"sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon1} - {lon2}))"
    # Not least and greatest: they pass over a null.
    return f"({_R}e0 * acos(case when {cosine} > 1 then 1e0 when {cosine} < -1 then -1e0 else {cosine} end))"


def planar(lat1, lon1, lat2, lon2, scale: str = " * 111195") -> str:
    lat1, lon1, lat2, lon2 = (_num(x) if isinstance(x, float) else x for x in (lat1, lon1, lat2, lon2))
    return f"(sqrt(pow({lon1} - {lon2}, 2) + pow({lat1} - {lat2}, 2)){scale})"


def _poi(poitype: str) -> str:
    return f"select id, latitude, longitude, latitude / 1e7 as lat, longitude / 1e7 as lon from nodes where id in (select node_id from node_tags where k = 'poitype' and v = '{poitype}')"


_SHOWN = "select node_id, min_by(v, k || chr(1) || v) as name from node_tags where starts_with(k, 'name') group by 1"
_WAY_SHOWN = "select way_id, min_by(v, k || chr(1) || v) as name from way_tags where starts_with(k, 'name') group by 1"
_CLEAN = "regexp_replace({0}, '[()（） ]', '', 'g')"
_NAMES = "select node_id as id, v as name from node_tags where k in ('name', 'name:zh')"


def _clean(x: str) -> str:
    return _CLEAN.format(x)


def edits(a: str, b: str) -> str:
    """The weighted edit distance: rows folded over a's letters, cells over b's."""
    cell = f"least(acc[-1] + 1, prev[y[1]::int + 1] + 1, prev[y[1]::int] + case when {a}[x[1]::int] = {b}[y[1]::int] then 0 else 1.5 end)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j::double]), lambda acc, y: list_append(acc, {cell}), [prev[1] + 1])"
    whole = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i::double]), lambda prev, x: {row}, range(0, length({b}) + 1)::double[])"
    return f"floor({whole}[-1] + 0.5)::int"


def _similar(text: str) -> str:
    """near (clean_name, distance) as CTEs up to ``tiered``."""
    own = _clean(f"'{text}'")
    return f""", names as ({_NAMES}), words as (select distinct {_clean("name")} as clean_name, {own} as own from names),
 measured as (select clean_name, {edits("clean_name", "own")} as distance from words),
 tiered as (select clean_name, distance from measured where distance <= (select case when min(distance) = 0 then 0 when min(distance) <= 3 then 3 else 5 end from measured)
   order by distance, length(clean_name) desc, clean_name limit 5)"""


def _bm25(text: str) -> str:
    """scored (name, score) as CTEs; needs names."""
    cut = "regexp_extract_all({0}, '([\\p{{L}}\\p{{N}}]+)')"
    return f""", docs as (select name, {cut.format("name")} as toks from (select distinct name from names)), full_docs as (select name, toks, len(toks) as length from docs where len(toks) > 0),
 totals as (select count(*) as n, floor(sum(length) / count(*)) as mean from full_docs),
 terms as (select name, length, token, count(*) as freq from (select name, length, unnest(toks) as token from full_docs)
   where token in (select unnest({cut.format(f"'{text}'")})) group by all),
 frequency as (select token, count(*) as df from terms group by 1),
 scored as (select name, sum(ln((n - df + 0.5e0) / (df + 0.5e0)) * (freq / length) * 2.2e0 / (freq / length + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) as score
   from terms join frequency using (token) cross join totals group by 1)"""


def _pairs(ordered: bool) -> str:
    start = "a.o" if ordered else "least(a.o, b.o)"
    one, two = _poi("PROMO"), _poi("SMALL")
    o = sphere("lat", "lon", _LAT, _LON)
    return f"""{with_tables("nodes", "node_tags")}, a as (select *, {o} as o from ({one})), b as (select *, {o} as o from ({two})), shown as ({_SHOWN}),
top as (select a.id as id1, b.id as id2, {sphere("a.lat", "a.lon", "b.lat", "b.lon")} + {start} as total from a, b where a.id <> b.id order by total, id1, id2 limit 5)
select id1, coalesce(x.name, '') as name1, id2, coalesce(y.name, '') as name2, round(total, 3) as total from top left join shown x on x.node_id = id1 left join shown y on y.node_id = id2"""


def _middle(extra: str) -> str:
    (y1, x1), (y2, x2) = q.ENDS
    return f"""{with_tables("nodes", "node_tags")}, shown as ({_SHOWN}),
d as (select *, {planar("lat", "lon", y1, x1)} as d1, {planar("lat", "lon", y2, x2)} as d2, {planar("lat", "lon", (y1 + y2) / 2, (x1 + x2) / 2, "")} as aside from ({_poi("PROMO")}))
select id, coalesce(name, '') as name, latitude, longitude, round(d1, 3) as d1, round(d2, 3) as d2 from d left join shown on node_id = id
where d1 + d2 < {sphere(y1, x1, y2, x2)} * 1.2e0 and abs(d1 - d2) < least(d1, d2) * 0.5e0 {extra} order by aside, id limit 5"""


def _fixed(x: float) -> int:
    return int(x * 10_000_000)


def _values(rows) -> str:
    return "values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in row) + ")" for row in rows)


_EDGES = f"""{with_tables("nodes", "ways", "way_nodes", "way_tags")},
class(own, kind) as ({_values(routing.CLASS_OF.items())}), weights(mode, kind, weight) as ({_values((m, k, float(w)) for (m, k), w in routing.weights_table().items() if w > 0)}),
tagged as (select w.id as way_id, max(case when k = 'highway' then v end) as highway, max(case when k = 'oneway' then v end) as oneway from ways w join way_tags t on t.way_id = w.id group by 1),
usable as (select way_id, oneway, mode, weight from (select way_id, oneway, coalesce(class.kind, highway) as kind from tagged left join class on own = highway) t join weights using (kind)),
steps as (select id as way_id, node_id as src, lead(node_id) over (partition by id order by sequence_id) as dst from way_nodes),
directed as (select mode, way_id, weight, src, dst from steps join usable using (way_id) where dst is not null
  union all select mode, way_id, weight, dst, src from steps join usable using (way_id) where dst is not null and (coalesce(oneway, '') <> 'yes' or mode = 'walk')),
edges as materialized (select mode, src, dst, min_by(weight, way_id) as weight from directed group by all),
seen as (select id, latitude, longitude, latitude / 1e7 as lat, longitude / 1e7 as lon from nodes where visible)"""


def _snap(mode: str, lat: float, lon: float) -> str:
    y, x = _fixed(lat), _fixed(lon)
    return f"(select id from seen where id in (select src from edges where mode = '{mode}') order by pow(latitude - {y}, 2) + pow(longitude - {x}, 2), id limit 1)"


def _route(rounds: int = 24) -> str:
    (y1, x1), (y2, x2) = q.ENDS
    cost = sphere("a.lat", "a.lon", "b.lat", "b.lon")
    text = f"""{_EDGES}, graph as materialized (select src, dst, {cost} / weight as cost from edges join seen a on a.id = src join seen b on b.id = dst where mode = 'car'),
ends as materialized (select {_snap("car", y1, x1)} as a, {_snap("car", y2, x2)} as b), d0 as materialized (select a as node, 0e0 as cost from ends)"""
    for k in range(1, rounds + 1):
        text += f""",
d{k} as materialized (select node, min(cost) as cost from (select node, cost from d{k - 1} union all select dst, d.cost + g.cost from d{k - 1} d join graph g on src = node) group by 1)"""
    return text + f"\nselect 'success' as status, round(cost, 2) as cost from d{rounds} join ends on node = b"


_IN_BOX = f"latitude between {_fixed(q.BOX[0])} and {_fixed(q.BOX[1])} and longitude between {_fixed(q.BOX[2])} and {_fixed(q.BOX[3])}"
_DEGREES_IN_BOX = f"lat between {_num(q.BOX[0])} and {_num(q.BOX[1])} and lon between {_num(q.BOX[2])} and {_num(q.BOX[3])}"
_HELD = f"held as materialized (select * from way_nodes where node_id in (select id from nodes where {_IN_BOX}))"
_DIRECT = f"""direct as materialized (select * from relation_members where (member_type = 'Node' and member_id in (select id from nodes where {_IN_BOX}))
  or (member_type = 'Way' and member_id in (select id from held)))"""
_ABOVE = """up(relation_id, level) as (select * from start union all select m.relation_id, level + 1 from up join relation_members m on m.member_type = 'Relation' and m.member_id = up.relation_id where level < 20),
found as (select relation_id, min(level) as level from up group by 1)"""

_NEW = "news as (select id + 1 as file_id, latitude + (case when id % 3 = 0 then 100 else 4000 + id end) as latitude, longitude - (case when id % 3 = 0 then 100 else 4000 + id end) as longitude from nodes where id < 60)"
_MERGED = f"""{with_tables("nodes")}, {_NEW},
ranked as (select file_id, w.latitude, w.longitude, n.id as near_id, n.latitude as y, n.longitude as x,
  row_number() over (partition by file_id order by pow(w.latitude - n.latitude, 2) + pow(w.longitude - n.longitude, 2), n.id) as place,
  sqrt(pow(w.latitude - n.latitude, 2) + pow(w.longitude - n.longitude, 2)) as dist from news w, nodes n where n.visible),
merged as (select *, {sphere("latitude / 1e7", "longitude / 1e7", "y / 1e7", "x / 1e7")} as metres from ranked where place = 1)"""

_TARGETS = "(" + ", ".join(map(str, q.TARGETS)) + ")"
_SURVIVORS = {
    "nodes": ("id", f"changeset_id not in {_TARGETS}"),
    "node_tags": ("node_id", f"node_id not in (select id from nodes where changeset_id in {_TARGETS})"),
    "ways": ("id", f"changeset_id not in {_TARGETS}"),
    "way_nodes": ("node_id", f"id not in (select id from ways where changeset_id in {_TARGETS})"),
    "way_tags": ("way_id", f"way_id not in (select id from ways where changeset_id in {_TARGETS})"),
    "changesets": ("id", f"id not in {_TARGETS}"),
    "changesets_dependence": ("dep_id", f"id not in {_TARGETS}"),
}

_XML = """'\t<{0} ' || {1} || '{2}>'"""


def _esc(x: str) -> str:
    return f"""replace(replace(replace(replace({x}::varchar, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


def _attr(**values: str) -> str:
    return " || ' ' || ".join(f"""'{k}="' || {_esc(v)} || '"'""" for k, v in values.items())


_STAMP = "strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ')"
_NODE_HEAD = _attr(id="id", lat="printf('%.7f', latitude / 1e7)", lon="printf('%.7f', longitude / 1e7)", visible="visible", version="version", changeset="changeset_id", timestamp=_STAMP)
_WAY_HEAD = _attr(id="id", visible="visible", version="version", changeset="changeset_id", timestamp=_STAMP)
_XML_LINES = f"""{with_tables("nodes", "node_tags", "ways", "way_nodes", "way_tags")}, {_HELD},
kids as (select 1 as kind, node_id as id, 1 as part, 0 as seq, 0 as ref, k, v, '\t\t<tag ' || {_attr(k="k", v="v")} || '/>' as text from node_tags where node_id in (select id from nodes where {_IN_BOX})
  union all select 2, id, 0, sequence_id, node_id, '', '', '\t\t<nd ' || {_attr(ref="node_id")} || '/>' from held
  union all select 2, way_id, 1, 0, 0, k, v, '\t\t<tag ' || {_attr(k="k", v="v")} || '/>' from way_tags where way_id in (select id from held)),
heads as (select 1 as kind, id, '\t<node ' || {_NODE_HEAD} as head, '\t</node>' as tail from nodes where {_IN_BOX}
  union all select 2, id, '\t<way ' || {_WAY_HEAD}, '\t</way>' from ways where id in (select id from held)),
counted as (select h.*, (select count(*) from kids k where k.kind = h.kind and k.id = h.id) as n from heads h)
select kind, id, 0 as line, head || case when n = 0 then '/>' else '>' end as text from counted
union all select kind, id, row_number() over (partition by kind, id order by part, seq, ref, k, v), text from kids where (kind, id) in (select kind, id from heads)
union all select kind, id, n + 1, tail from counted where n > 0"""

_NEAREST_WAY = f"""{with_tables("nodes", "way_nodes", "way_tags")}, place_of as (select {_fixed(_LAT)} as y, {_fixed(_LON)} as x), shown as ({_WAY_SHOWN}),
near as (select id as node_id, row_number() over (order by pow(latitude - y, 2) + pow(longitude - x, 2), id) as place from nodes, place_of where visible qualify place <= 15),
middle as (select id, greatest(arg_min(sequence_id, place * 1000000 + sequence_id) - 8, 1) as low from way_nodes join near using (node_id) group by 1),
inside as (select w.id, sequence_id, latitude, longitude, lead(latitude) over o as y2, lead(longitude) over o as x2, row_number() over o as place, y, x
  from way_nodes w join middle m on m.id = w.id and sequence_id between low and low + 16 join nodes n on n.id = w.node_id and n.visible cross join place_of window o as (partition by w.id order by sequence_id)),
sides as (select *, {sphere("y / 1e7", "x / 1e7", "latitude / 1e7", "longitude / 1e7")} as l, {sphere("y / 1e7", "x / 1e7", "y2 / 1e7", "x2 / 1e7")} as r,
  {sphere("latitude / 1e7", "longitude / 1e7", "y2 / 1e7", "x2 / 1e7")} as b,
  (latitude <> y2 or longitude <> x2) and (y - latitude)::double * (y2 - latitude) + (x - longitude)::double * (x2 - longitude) >= -1e-7
  and (y - y2)::double * (latitude - y2) + (x - x2)::double * (longitude - x2) >= -1e-7 as beside from inside),
heights as (select *, case when beside then 2 * sqrt(greatest((l + r + b) / 2 * ((l + r + b) / 2 - l) * ((l + r + b) / 2 - r) * ((l + r + b) / 2 - b), 0e0)) / nullif(b, 0) end as height from sides),
measured as (select id, coalesce(arg_min(height, place) filter (where height is not null), least(arg_min(l, place), arg_max(l, place))) as metres from heights group by 1)
select id as way_id, round(metres, 3) as metres, coalesce(name, '') as way_name from measured left join shown on way_id = id order by measured.metres, id limit 1"""

_D2R = 2 * q.CIRCLE_M
_SWEEP = f"""{with_tables("nodes", "node_tags")}, p as materialized ({_poi("PROMO")}),
met as (select i.id as i, j.id as j, i.lat as lat_i, i.lon as lon_i, j.lat as lat_j, j.lon as lon_j, {sphere("i.lat", "i.lon", "j.lat", "j.lon")} as d from p i, p j where i.id <> j.id),
arcs as (select *, acos(least(1e0, d / {_D2R})) as phi, atan2(lon_i - lon_j, lat_i - lat_j) as back, atan2(lon_j - lon_i, lat_j - lat_i) as ahead from met where d <= {_D2R}),
events as (select i, j, lat_i, lon_i, back - phi as angle, 1 as delta, ahead - phi as toward from arcs union all select i, j, lat_i, lon_i, back + phi, -1, ahead + phi from arcs),
running as (select *, sum(delta) over (partition by i order by angle, delta desc, j rows unbounded preceding) + 1 as total, row_number() over (partition by i order by angle, delta desc, j) as place from events),
best as (select lat_i + degrees({q.CIRCLE_M} / {_R}e0) * cos(toward) as y, lon_i + degrees({q.CIRCLE_M} / {_R}e0) * sin(toward) as x, total::bigint as total from running where total > 1 order by total desc, i, place limit 1)
select round(y, 6) as latitude, round(x, 6) as longitude, total, (select count(*) from p where {planar("p.lat", "p.lon", "best.y", "best.x")} < {q.CIRCLE_M}) as covered from best"""

_BY_NAME = f"""{with_tables("nodes", "node_tags")}, names as ({_NAMES}), own as (select 'bluegizmo' as own),
words as (select distinct {_clean("name")} as clean_name, own from names, own), measured as (select clean_name, {edits("clean_name", "own")} as distance from words),
near as (select clean_name as name from measured where distance <= case when (select min(distance) from measured) = 0 then 0 else 5 end),
wanted as (select distinct name from names where name like '%blue%gizmo%' union select name from near),
ids as (select distinct n.id, w.name from wanted w join names n on {_clean("n.name")} = {_clean("w.name")})
select nodes.id, latitude, longitude, name, round({sphere("latitude / 1e7", "longitude / 1e7", _LAT, _LON)}, 3) as metres from nodes join ids using (id) where visible
order by {sphere("latitude / 1e7", "longitude / 1e7", _LAT, _LON)}, id, name limit 10"""

_NODE_WAYS = """, held as (select distinct n.node_id, w.id as way_id from node n join way_nodes w using (node_id)), shown as ({0}), way_shown as ({1})
select h.node_id, coalesce(s.name, '') as node_name, h.way_id, coalesce(t.name, '') as way_name, count(*) over () > 1 as is_intersection
from held h left join shown s using (node_id) left join way_shown t using (way_id)""".format(_SHOWN, _WAY_SHOWN)

_BEST_NAME = f"""{_similar(q.NAME)}{_bm25(q.NAME)},
best as (select clean_name, coalesce(score, 0) as score, distance from tiered left join (select {_clean("name")} as clean_name, max(score) as score from scored group by 1) using (clean_name)
  order by score desc, distance, clean_name limit 3)"""



def _bounds(*tables: str) -> str:
    """The points in the radius (t) and the map's bounds (w) as CTEs."""
    return f"""{with_tables("nodes", "node_tags", *tables)}, t as (select * from ({_poi("PROMO")}) where {planar("lat", "lon", _LAT, _LON)} < {q.RADIUS_M}),
e as (select least(min(lat), {_num(_LAT)} - 0.05e0) as a, least(min(lon), {_num(_LON)} - 0.05e0) as b, greatest(max(lat), {_num(_LAT)} + 0.05e0) as c, greatest(max(lon), {_num(_LON)} + 0.05e0) as d from t),
g as (select a - (c - a) * 0.1e0 as a, b - (d - b) * 0.1e0 as b, c + (c - a) * 0.1e0 as c, d + (d - b) * 0.1e0 as d from e),
w as (select *, greatest(0, (c - a) / 9 * 16 - (d - b)) / 2 as wide, greatest(0, (d - b) / 16 * 9 - (c - a)) / 2 as high from g)"""


_BOUNDED = f"""{_bounds()}
select round(a - high, 9) as min_lat, round(b - wide, 9) as min_lon, round(c + high, 9) as max_lat, round(d + wide, 9) as max_lon from w"""

_SHOWN_LINES = f"""{_bounds("way_nodes", "ways")},
l as (select w.id, count(*) as n from way_nodes w join nodes x on x.id = node_id and visible, w as box where w.id in (select id from ways)
  and x.latitude / 1e7 between box.a - high and box.c + high and x.longitude / 1e7 between box.b - wide and box.d + wide group by 1)
select 'target_points' as layer, count(*) as features, count(*) as places, 0 as segments from t union all select 'target_lines', count(*), sum(n)::bigint, sum(n - 1)::bigint from l"""

ORACLE: dict[str, str] = {
    "poi_within_radius": f"{with_tables('nodes', 'node_tags')} select id, round(dis, 3) as dis, latitude, longitude from (select *, {planar('lat', 'lon', _LAT, _LON)} as dis from ({_poi('PROMO')})) where dis < {q.RADIUS_M}",
    "poi_type_canonical": f"with w(alias) as ({_values([(x,) for x in q.WORDS])}), l(line) as ({_values([(x,) for x in POI_TYPE_LINES])}), a as (select unnest(string_split(line, ' ')) as alias, string_split(line, ' ')[1] as poitype from l) select w.alias, min(poitype) as poitype from w left join a using (alias) group by 1",
    "node_ways": f"{with_tables('way_nodes', 'way_tags')}, shown as ({_WAY_SHOWN}) select distinct w.id as way_id, coalesce(name, '') as way_name from way_nodes w left join shown on way_id = w.id where node_id = {q.NODE}",
    "node_ways_by_place": f"{with_tables('nodes', 'node_tags', 'way_nodes', 'way_tags')}, node as (select id as node_id from nodes where visible order by pow(latitude - {_fixed(_LAT)}, 2) + pow(longitude - {_fixed(_LON)}, 2), id limit 1){_NODE_WAYS}",
    "node_ways_by_name": f"{with_tables('nodes', 'node_tags', 'way_nodes', 'way_tags')}{_BEST_NAME}, node as (select min(id) as node_id from names where {_clean('name')} = (select clean_name from best order by score desc, distance, clean_name limit 1) and id in (select node_id from way_nodes)){_NODE_WAYS}",
    "intersections": f"{with_tables('way_nodes')} select node_id, count(distinct id) as ways, count(distinct id) > 1 as is_intersection from way_nodes group by 1",
    "way_nodes_ordered": f"{with_tables('nodes', 'way_nodes')} select w.id as way_id, sequence_id, node_id, latitude, longitude from way_nodes w left join nodes n on n.id = node_id and visible where w.id = {q.WAY}",
    "way_segments_by_name": f"{with_tables('nodes', 'way_nodes', 'way_tags')}, node_tags as (select way_id as node_id, k, v from way_tags){_similar(q.WAY_NAME)}{_bm25(q.WAY_NAME)}, best as (select clean_name from tiered left join (select {_clean('name')} as clean_name, max(score) as score from scored group by 1) using (clean_name) order by coalesce(score, 0) desc, distance, clean_name limit 1) select clean_name, w.id as way_id, sequence_id, w.node_id, latitude, longitude from best join (select distinct id, {_clean('name')} as clean_name from names) using (clean_name) join way_nodes w using (id) left join nodes n on n.id = w.node_id and visible",
    "way_polylines": f"{with_tables('way_nodes')} select id as way_id, string_agg(node_id, ',' order by sequence_id) as node_ids from way_nodes group by 1",
    "way_polyline_length": f"{with_tables('nodes', 'way_nodes')}, r as (select w.id, latitude / 1e7 as lat, longitude / 1e7 as lon, lead(latitude / 1e7) over o as lat2, lead(longitude / 1e7) over o as lon2 from way_nodes w join nodes n on n.id = node_id and visible window o as (partition by w.id order by sequence_id)) select id as way_id, count(*) as nodes, round(coalesce(sum({sphere('lat', 'lon', 'lat2', 'lon2')}), 0), 2) as metres from r group by 1",
    "knn_nodes": f"{with_tables('nodes')}, d as (select *, pow(latitude - {_fixed(_LAT)}, 2) + pow(longitude - {_fixed(_LON)}, 2) as d2 from nodes where visible) select (row_number() over (order by d2, id))::int as rank, id, latitude, longitude, round(sqrt(d2), 3) as dist from d qualify rank <= 15",
    "knn_batch": f"{_MERGED} select file_id as q, place::int as rank, near_id as id, round(dist, 3) as dist from ranked where place <= 3",
    "nearest_way": _NEAREST_WAY,
    "middle_poi": _middle(""),
    "middle_poi_ordered": _middle("and d1 > d2"),
    "poi_pair_topk": _pairs(False),
    "poi_pair_topk_ordered": _pairs(True),
    "max_cover_circle": _SWEEP,
    "clean_names": f"{with_tables('node_tags')} select id, name, {_clean('name')} as clean_name from ({_NAMES})",
    "name_index": f"{with_tables('node_tags')} select clean_name, string_agg(id, ',' order by id) as ids from (select distinct id, {_clean('name')} as clean_name from ({_NAMES})) group by 1",
    "edit_distance_matches": f"{with_tables('node_tags')}, words as (select distinct {_clean('v')} as clean_name, '{q.clean_text(q.WORD)}' as own from node_tags where k in ('name', 'name:zh')), d as (select clean_name, {edits('clean_name', 'own')} as distance from words) select * from d where distance <= 5",
    "fuzzy_lookup_tiered": f"{with_tables('node_tags')}{_similar(q.WORD)} select * from tiered",
    "name_like_segments": f"{with_tables('node_tags')} select distinct v as name from node_tags where k in ('name', 'name:zh') and v like '%blue%Brand%2%'",
    "bm25_scores": f"{with_tables('node_tags')}, names as ({_NAMES}){_bm25('blue gizmo Brand')} select name, round(score, 9) as score from scored",
    "most_similar_name": f"{with_tables('node_tags')}{_BEST_NAME} select clean_name, round(score, 9) as score, distance, (select count(distinct id) from names where {_clean('name')} = clean_name)::int as n_ids from best",
    "poi_by_name_nearby": _BY_NAME,
    "node_display_name": f"{with_tables('nodes', 'node_tags')} select id, coalesce(name, '') as name from nodes left join ({_SHOWN}) on node_id = id",
    "node_names_of_key": f"{with_tables('node_tags')} select k, count(*) as n, count(distinct v) as values from node_tags where starts_with(k, 'name') group by 1",
    "route_edges": f"{_EDGES} select mode, src, dst, weight from edges",
    "routable_nodes": f"{_EDGES} select id, latitude, longitude from seen where id in (select src from edges where mode = 'bike')",
    "route_snap": f"{_EDGES} select id, round(sqrt(pow(latitude - {_fixed(_LAT)}, 2) + pow(longitude - {_fixed(_LON)}, 2)), 3) as dist from seen where id = {_snap('car', _LAT, _LON)}",
    "shortest_route": _route(),
    "bbox_nodes": f"{with_tables('nodes')} select id, latitude, longitude, visible from nodes where {_IN_BOX}",
    "bbox_ways": f"{with_tables('nodes', 'ways', 'way_nodes')}, {_HELD} select id as way_id, string_agg(node_id, ',' order by sequence_id) as node_ids from held where id in (select id from ways) group by 1",
    "bbox_relations": f"{with_tables('nodes', 'way_nodes', 'relation_members', recursive=True)}, {_HELD}, {_DIRECT}, start as (select distinct relation_id, 0 as level from direct), {_ABOVE} select * from found",
    "bbox_members": f"{with_tables('nodes', 'way_nodes', 'relation_members', recursive=True)}, {_HELD}, {_DIRECT}, start as (select distinct relation_id, 0 as level from direct), {_ABOVE} select * from direct union all select m.* from relation_members m where member_type = 'Relation' and relation_id in (select relation_id from found) and member_id in (select relation_id from found)",
    "relation_ancestors": f"{with_tables('relation_members', recursive=True)}, start as (select distinct relation_id, 0 as level from relation_members where member_type = 'Way'), {_ABOVE} select * from found",
    "osm_xml_lines": _XML_LINES,
    "commit_node_merge": f"{_MERGED} select file_id, near_id, round(metres, 2) as metres, metres < 5 as merged from merged",
    "commit_new_ids": f"{_MERGED} select file_id, case when metres < 5 then near_id else (select max(id) from nodes) + sum(case when metres < 5 then 0 else 1 end) over (order by file_id) end::bigint as node_id from merged",
    "dependency_violations": f"{with_tables('changesets_dependence')} select distinct id, dep_id from changesets_dependence where dep_id in {_TARGETS} and id not in {_TARGETS}",
    "rollback_survivors": with_tables(*_SURVIVORS) + " union all ".join(f" select '{t}' as name, count(*) as n, sum({key})::bigint as checksum from {t} where {keep}" for t, (key, keep) in _SURVIVORS.items()),
    "changesets_in_range": f"{with_tables('changesets')} select id, created_at from changesets where created_at between timestamp '{q.RANGE[0][:10]} {q.RANGE[0][11:19]}' and timestamp '{q.RANGE[1][:10]} {q.RANGE[1][11:19]}'",
    "map_bounds": _BOUNDED,
    "map_report": _SHOWN_LINES,
    "background_points": f"{with_tables('nodes', 'node_tags')} select id as feature_id, latitude / 1e7 as lat, longitude / 1e7 as lon from nodes where id in (select node_id from node_tags) and {_DEGREES_IN_BOX.replace('lat ', 'latitude / 1e7 ').replace('lon ', 'longitude / 1e7 ')}",
    "clipped_lines": f"{with_tables('nodes', 'ways', 'way_nodes')}, r as (select w.id, sequence_id, latitude / 1e7 as lat, longitude / 1e7 as lon from way_nodes w join nodes n on n.id = node_id and visible where w.id in (select id from ways)) select id as feature_id, count(*) as places, min(sequence_id)::int as first_seq, max(sequence_id)::int as last_seq from r where {_DEGREES_IN_BOX} group by 1",
    "distances": f"{with_tables('nodes')} select id, round({sphere('latitude / 1e7', 'longitude / 1e7', _LAT, _LON)}, 3) as sphere, round({planar('latitude / 1e7', 'longitude / 1e7', _LAT, _LON)}, 3) as planar from nodes",
}
