"""The driver's test tables as a road network, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from geoloom.sources.model import Dataset

_DATED = "timestamp '2016-01-01 00:00:00'"

SQL: dict[str, str] = {
    "nodes": f"""select p_partkey as id, cast(307000000 + ((p_partkey * 7919) % 10007) * 1000 as bigint) as latitude,
  cast(1209000000 + ((p_partkey * 104729) % 10009) * 1000 as bigint) as longitude, p_partkey % 7 + 2 as changeset_id,
  p_partkey % 50 <> 0 as visible, {_DATED} as timestamp, cast(0 as bigint) as tile, cast(1 as bigint) as version from part""",
    "node_tags": """select p_partkey as node_id, 'poitype' as k, p_type as v from part union all select p_partkey, 'name', p_name from part
  union all select p_partkey, 'name:zh', concat(p_name, ' (', p_brand, ')') from part where p_partkey % 10 = 0""",
    "ways": "select o_orderkey as id, o_custkey % 7 + 2 as changeset_id, o_orderdate as timestamp, true as visible, cast(1 as bigint) as version from orders",
    "way_nodes": """select l_orderkey as id, l_partkey as node_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as bigint) as sequence_id from lineitem""",
    "way_tags": """select o_orderkey as way_id, 'highway' as k, case o_orderpriority when '1-URGENT' then 'motorway' when '2-HIGH' then 'primary'
  when '3-MEDIUM' then 'tertiary' when '4-NOT SPECIFIED' then 'residential' else 'pedestrian' end as v from orders
  union all select o_orderkey, 'oneway', 'yes' from orders where o_orderstatus = 'F'
  union all select o_orderkey, 'name', concat('Road ', cast(o_custkey % 500 as varchar(20))) from orders""",
    "relations": f"""select relation_id, cast(2 as bigint) as changeset, {_DATED} as timestamp, true as visible, cast(1 as bigint) as version
  from (select 1000 + o_custkey as relation_id from orders union select cast(100 + c_nationkey as bigint) from customer union select cast(1 + n_regionkey as bigint) from nation) r""",
    "relation_tags": "select cast(1 + r_regionkey as bigint) as id, 'name' as k, r_name as v from region",
    "relation_members": """select 1000 + o_custkey as relation_id, 'Way' as member_type, o_orderkey as member_id, 'street' as member_role, o_orderkey as sequence_id from orders
  union all select cast(100 + c_nationkey as bigint), 'Relation', 1000 + c_custkey, '', c_custkey from customer
  union all select cast(1 + n_regionkey as bigint), 'Relation', cast(100 + n_nationkey as bigint), '', cast(n_nationkey as bigint) from nation""",
    "changesets": """select event_id + 2 as id, cast(-1 as bigint) as user_id, ts as created_at, cast(-900000000 as bigint) as min_lat, cast(900000000 as bigint) as max_lat,
  cast(-1800000000 as bigint) as min_lon, cast(1800000000 as bigint) as max_lon, ts as closed_at, 1 as num_changes from events""",
    "changesets_dependence": """select * from (select event_id + 2 as id, lag(event_id) over (partition by user_id order by ts, event_id) + 2 as dep_id from events) z
  where dep_id is not null""",
}

_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """All ten tables over the Parquet files in ``sf_dir``, lazily."""
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}

    def built(text: str):
        used = [t for t in _TABLES if re.search(rf"\bfrom {t}\b", text)]
        for t in used:
            text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
        return spark.sql(text, **{t: found[t] for t in used})

    return Dataset(**{name: built(text) for name, text in SQL.items()})


def with_tables(*names: str, recursive: bool = False) -> str:
    """The start of an SQL text that may use the named tables."""
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(f"{n} as materialized ({SQL[n]})" for n in names)
