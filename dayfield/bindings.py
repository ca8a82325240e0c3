"""Daylight tables derived from the star-schema test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    "b_rays": """SELECT vec_id AS ray_id, CAST(label AS INT) AS pt_id, CAST(vec_id % 4 AS INT) AS src,
  x/sqrt(x*x+y*y+z*z) AS dx, y/sqrt(x*x+y*y+z*z) AS dy, z/sqrt(x*x+y*y+z*z) AS dz, 1000*abs(l) AS lum, 0.01+0.1*abs(o) AS omega
FROM (SELECT vec_id, label, CAST(EL(1) AS DOUBLE) AS x, CAST(EL(2) AS DOUBLE) AS y, CAST(EL(3) AS DOUBLE) AS z,
  CAST(EL(4) AS DOUBLE) AS l, CAST(EL(5) AS DOUBLE) AS o FROM {embeddings}) e""",
    "b_dirs": """SELECT ray_id, pt_id, src, r*cos(phi) AS dx, r*sin(phi) AS dy, dz, lum, omega FROM (
 SELECT l_orderkey*8 + l_linenumber AS ray_id, min(l_suppkey) AS pt_id, CAST(min(l_partkey) % 4 AS INT) AS src,
  6.283185307179586E0 * ((l_orderkey*7919 + l_linenumber*104729) % 100003) / 100003 AS phi,
  2E0*((l_orderkey*15485863 + l_linenumber*32452843) % 100019)/100019 - 1 AS dz,
  sqrt(1 - (2E0*((l_orderkey*15485863 + l_linenumber*32452843) % 100019)/100019 - 1)
         * (2E0*((l_orderkey*15485863 + l_linenumber*32452843) % 100019)/100019 - 1)) AS r,
  CAST(max(l_extendedprice) AS DOUBLE)*1.000003E0 AS lum, CAST(max(l_quantity) AS DOUBLE)*1.000003E0/1E3 AS omega
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber) d""",
    "b_points": """SELECT s_suppkey AS pt_id, CAST(s_suppkey * 37 % 101 AS DOUBLE)/10 AS x, CAST(s_suppkey * 53 % 97 AS DOUBLE)/10 AS y,
  1.2E0 AS z, CAST(s_suppkey % 3 AS INT) AS level FROM {supplier}""",
    "b_queries": """SELECT c_custkey AS q_id, CAST(c_custkey * 41 % 1009 AS DOUBLE)/100 AS x, CAST(c_custkey * 59 % 997 AS DOUBLE)/100 AS y, 1.2E0 AS z FROM {customer}""",
    "b_asked": """SELECT q_id, x, y, z, r*cos(phi) AS sx, r*sin(phi) AS sy, sz FROM (
 SELECT c_custkey AS q_id, CAST(c_custkey * 41 % 1009 AS DOUBLE)/100 AS x, CAST(c_custkey * 59 % 997 AS DOUBLE)/100 AS y, 1.2E0 AS z, 6.283185307179586E0 * (c_custkey*104729 % 100003) / 100003 AS phi,
  (c_custkey*7919 % 10007 + 5E-1) / 10007 AS sz, sqrt(1 - ((c_custkey*7919 % 10007 + 5E-1) / 10007) * ((c_custkey*7919 % 10007 + 5E-1) / 10007)) AS r FROM {customer}) c""",
    "b_weather": """SELECT CAST(user_id % 3 AS INT) AS station, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, hour(ts) + 0.5E0 AS hour,
  avg(value) AS dir_norm, 5E-1*avg(value) + 1 AS dif_horiz FROM {events} GROUP BY user_id % 3, month(ts), day(ts), hour(ts)""",
    "b_sky": """SELECT CAST(year(o_orderdate)*12 + month(o_orderdate) AS INT) AS t, CAST(o_orderkey % 16 AS INT) AS patch, CAST(sum(o_totalprice) AS DOUBLE)/1E6 AS coef
FROM {orders} GROUP BY year(o_orderdate)*12 + month(o_orderdate), o_orderkey % 16""",
    "b_sun": """SELECT CAST(year(o_orderdate)*12 + month(o_orderdate) AS INT) AS t, CAST(max(o_orderkey) % 16 AS INT) AS patch, CAST(max(o_totalprice) AS DOUBLE)/1E3 AS sun_rad,
  CAST(max(o_totalprice) AS DOUBLE)/1E6 AS patch_rad FROM {orders} GROUP BY year(o_orderdate)*12 + month(o_orderdate)""",
    "b_contrib": """SELECT l_suppkey AS pt_id, CAST(l_linenumber AS INT) AS sensor_id, CAST(l_partkey % 16 AS INT) AS patch, CAST(avg(l_discount) AS DOUBLE)*1.000003E0 AS value
FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_partkey % 16""",
    "b_result": """SELECT CAST(year(l_shipdate)*12 + month(l_shipdate) AS INT) AS sky, l_suppkey AS point, l_returnflag AS view, l_linestatus AS metric,
  CAST(sum(l_quantity) AS DOUBLE) AS value FROM {lineitem} GROUP BY year(l_shipdate)*12 + month(l_shipdate), l_suppkey, l_returnflag, l_linestatus""",
    "b_result2": """SELECT CAST(year(l_shipdate)*12 + month(l_shipdate) + 2 AS INT) AS sky, l_suppkey AS point, l_returnflag AS view, l_linestatus AS metric,
  CAST(sum(l_quantity) AS DOUBLE) + 0.5E0 AS value FROM {lineitem} GROUP BY year(l_shipdate)*12 + month(l_shipdate) + 2, l_suppkey, l_returnflag, l_linestatus""",
    "b_grid": """SELECT CAST(l_linenumber AS INT) AS feature, CAST(l_partkey % 16 AS INT) AS i, CAST(l_orderkey % 16 AS INT) AS j, CAST(avg(l_extendedprice) AS DOUBLE)*1.000003E0 AS value
FROM {lineitem} GROUP BY l_linenumber, l_partkey % 16, l_orderkey % 16""",
}


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = re.sub(r"EL\((\d+)\)", r"element_at(embedding, \1)", SQL[name])
    tables = re.findall(r"\{(\w+)\}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"EL\((\d+)\)", r"embedding[\1]", SQL[name]))


def oracle(body: str, *names: str, ctes: str = "") -> str:
    """DuckDB SQL with the named bindings (and further ``ctes``) in front of ``body``."""
    parts = [f"{n} AS ({duck(n)})" for n in names] + ([ctes] if ctes else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
