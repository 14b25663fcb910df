"""Domain tables (walks, variations, food stops, track points, places) derived from the given tables.

The derivations are plain SQL that Spark and DuckDB read alike, so that queries and their oracle SQL
start from the same rows; all arithmetic is on whole cents first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Departure stations, commonest first.
STATIONS = "CLJ VIC WAT STP ECR LBG CHX BFR PAD LST EUS KGX MYB SRA FST MOG CST".split()
_CODES = "".join(STATIONS)


def _code(k: int) -> str:
    return f"CASE WHEN o_custkey % 4 > {k} THEN substr('{_CODES}', CAST(1 + 3 * ((o_custkey + {k}) % 17) AS INT), 3) END"


#: Two walks of different sources share each slug.
OF_ORDER = "concat('src_', lower(o_orderstatus), '_', o_orderkey % 2) AS source, concat('walk-', CAST((o_orderkey - o_orderkey % 2) / 2 AS BIGINT)) AS slug"
#: Four tracks share each slug: two of either source.
USER_KEY = ("concat('src_', user_id % 2) AS source", "concat('track-', CAST((user_id - user_id % 4) / 4 AS BIGINT)) AS slug", "CAST((user_id % 4 - user_id % 2) / 2 AS INT) AS track_no")

WALKS = f"""
SELECT source, slug, source_id, title, region, tags_text, toughness, published_ascent_m, computed_ascent_m, crs_text, seeded_journey_minutes,
       CASE WHEN k % 10 <> 0 THEN CAST(300 + cents % 2200 AS DOUBLE) / 100 END AS published_distance_km,
       CASE WHEN k % 3 <> 0 THEN CAST((300 + cents % 2200) * (80 + c % 41) AS DOUBLE) / 10000 END AS computed_distance_km,
       CASE WHEN k % 5 <> 0 THEN 50.5 + CAST(cents % 1500 AS DOUBLE) / 1000 END AS start_lat,
       CASE WHEN k % 5 <> 0 THEN -3.0 + CAST(c % 4000 AS DOUBLE) / 1000 END AS start_lon, k, cents,
       CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('A shorter loop is possible near ', region) WHEN 2 THEN concat('Returning by bus from ', region) WHEN 3 THEN 'Options abound by the river' ELSE concat('Views of the river near ', region) END AS summary,
       CASE WHEN k % 3 <> 0 OR k % 7 = 0 THEN concat('gpx/', slug, '.gpx') END AS gpx_path, CASE WHEN k % 3 <> 0 THEN k % 4 = 1 END AS has_elevation,
       CASE WHEN k % 9 <> 0 THEN CASE WHEN c % 3 = 0 THEN 'VIC' ELSE 'HAM' END END AS start_crs, CASE WHEN k % 8 <> 0 THEN 'Leave the station and turn left.' END AS directions
FROM (
  SELECT {OF_ORDER}, CAST(o_orderkey AS VARCHAR(20)) AS source_id,
         concat('Walk ', o_orderkey, ' ', o_orderpriority) AS title, c_mktsegment AS region, o_orderpriority AS tags_text,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(1 + o_orderkey % 10 AS INT) END AS toughness,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 600 AS DOUBLE) AS published_ascent_m,
         CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 500 AS DOUBLE) END AS computed_ascent_m,
         concat_ws(',', {_code(0)}, {_code(1)}, {_code(2)}) AS crs_text,
         CASE WHEN o_orderkey % 3 = 1 THEN CAST(20 + o_custkey % 100 AS INT) END AS seeded_journey_minutes,
         o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
) w0"""

_POSITION = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1"
VARIATIONS = f"""
SELECT {OF_ORDER}, l_orderkey AS k, CAST({_POSITION} AS INT) AS position, concat('Option ', l_linenumber) AS label,
       CASE l_linenumber % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'shortcut' WHEN 2 THEN 'extension' WHEN 3 THEN 'alt_start' WHEN 4 THEN 'alt_ending' ELSE 'pub_detour' END AS kind,
       CASE WHEN l_linenumber <> 1 THEN l_quantity / 2 END AS distance_km
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'"""
FOOD_STOPS = f"""
SELECT {OF_ORDER}, l_orderkey AS k, CAST({_POSITION} AS INT) AS position, concat('The ', p_name) AS name,
       CASE WHEN l_linestatus = 'F' THEN concat('01234 ', lpad(CAST(l_suppkey AS VARCHAR(20)), 6, '0')) END AS phone,
       CASE WHEN l_linenumber % 2 = 0 THEN 'lunch' ELSE 'tea' END AS role, l_quantity / 4 AS position_km
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'"""
POINTS = f"""
SELECT {", ".join(USER_KEY)}, seq, user_id,
       -1.5 + CAST(user_id % 100 AS DOUBLE) * 0.02 + CAST(seq AS DOUBLE) * 0.0004 - CASE WHEN user_id % 37 = 5 THEN 20.0 ELSE 0.0 END AS lon,
       51.0 + CAST(user_id % 50 AS DOUBLE) * 0.01 + CAST(cents % 100 - 50 AS DOUBLE) * 0.00001 AS lat,
       CASE WHEN user_id % 4 = 0 OR (user_id % 4 = 1 AND event_id % 11 = 0) THEN NULL ELSE 50.0 + CAST(cents % 200 AS DOUBLE) / 10 END AS ele
FROM (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq FROM events) e0"""
POIS = """
SELECT c_custkey AS poi_id, -1.5 + CAST(c_custkey * 13 % 2100 AS DOUBLE) * 0.001 AS lon,
       51.0 + CAST(c_custkey % 50 AS DOUBLE) * 0.01 + CAST(c_custkey % 7 - 3 AS DOUBLE) * 0.0005 AS lat FROM customer"""
#: Two home stations and the minutes to the termini they use; null where not known.
HOME = [("HNH", "Herne Hill", "VIC", 12), ("HNH", "Herne Hill", "BFR", 15), ("HNH", "Herne Hill", "STP", 22), ("HNH", "Herne Hill", "CHX", None), ("BRX", "Brixton", "VIC", 10)]

SQL = {"walks": WALKS, "variations": VARIATIONS, "food_stops": FOOD_STOPS, "points": POINTS, "pois": POIS}
_READS = {"walks": ["orders", "customer"], "variations": ["lineitem", "orders"], "food_stops": ["lineitem", "orders", "part"], "points": ["events"], "pois": ["customer"]}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or a given one where there is no recipe; walks get their arrays (tags, london_departure_crs)."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _READS[name]}
    text = SQL[name]
    for t in frames:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    df = spark.sql(text, **frames)
    if name == "walks":
        crs = F.when(F.col("crs_text") == "", F.array().cast("array<string>")).otherwise(F.split("crs_text", ","))
        df = df.withColumns({"tags": F.transform(F.split("tags_text", "-"), lambda t: F.trim(t)), "london_departure_crs": crs})
    return df


def home_termini(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOME, "station_crs string, station_name string, terminus_crs string, access_min int")


#: A walk's key in one string, which sorts as slug and source do.
KEYED = "SELECT * REPLACE (concat(slug, '/', source) AS slug) FROM"


def ctes(*names: str) -> str:
    """WITH clause of the same tables for oracle SQL, with whole keys as `slug`: slug/source for walks, slug/source/track_no for points."""
    whole = {"points": "SELECT * REPLACE (concat(slug, '/', source, '/', track_no) AS slug) FROM", "pois": "SELECT * FROM"}
    parts = [f"{n} AS ({whole.get(n, KEYED)} ({SQL[n]}))" for n in names if n in SQL]
    if "home_termini" in names:
        rows = ", ".join(f"('{s}', '{n}', '{t}', {m if m is not None else 'NULL'})" for s, n, t, m in HOME)
        parts.append(f"home_termini(station_crs, station_name, terminus_crs, access_min) AS (VALUES {rows})")
    return "WITH " + ", ".join(parts) + "\n"
