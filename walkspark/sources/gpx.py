"""GPX documents to track points and back, with Spark's own XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.functions.keys import key_of, track_key

_POINT = "struct<_lat:double,_lon:double,ele:double>"
SCHEMA = f"metadata struct<name:string>, trk array<struct<name:string,trkseg:array<struct<trkpt:array<{_POINT}>>>>>, rte array<struct<name:string,rtept:array<{_POINT}>>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, gpx): one row a file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source_path"), F.col("value").alias("gpx"))


def parse(documents: DataFrame, gpx: str = "gpx") -> DataFrame:
    """Points (…, track_no, name, seq, lon, lat, ele): tracks with their segments in a row, then routes; empty ones
    don't count, waypoints neither. A broken or empty document gives no rows. The text goes before any exchange."""
    keep = [c for c in documents.columns if c != gpx]
    x = documents.withColumn("_x", F.from_xml(gpx, SCHEMA, {"mode": "PERMISSIVE"}))
    tracks = F.transform(F.coalesce("_x.trk", F.array()), lambda t: F.struct(t["name"].alias("name"), F.flatten(F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: F.coalesce(s["trkpt"], F.array()))).alias("pts")))
    routes = F.transform(F.coalesce("_x.rte", F.array()), lambda r: F.struct(r["name"].alias("name"), F.coalesce(r["rtept"], F.array()).alias("pts")))
    every = F.filter(F.concat(tracks, routes), lambda t: F.size(t["pts"]) > 0)
    rows = x.select(*keep, F.col("_x.metadata.name").alias("_doc"), F.posexplode(every).alias("track_no", "_t"))
    rows = rows.select(*keep, "track_no", F.coalesce(F.nullif(F.trim("_t.name"), F.lit("")), "_doc").alias("name"), F.posexplode("_t.pts").alias("seq", "_p"))
    return rows.select(*keep, "track_no", "name", "seq", F.col("_p._lon").alias("lon"), F.col("_p._lat").alias("lat"), F.col("_p.ele").alias("ele"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render(points: DataFrame, name: str = "slug") -> DataFrame:
    """(key of the track, gpx): one document of one track and segment for each track, points by seq. name: a column of points."""
    key = track_key(points)
    ele = F.when(F.col("ele").isNull(), "").otherwise(F.concat(F.lit("<ele>"), F.format_string("%.1f", "ele"), F.lit("</ele>")))
    point = F.concat(F.lit('<trkpt lat="'), F.format_string("%.7f", "lat"), F.lit('" lon="'), F.format_string("%.7f", "lon"), F.lit('">'), ele, F.lit("</trkpt>"))
    title = F.first(F.coalesce(F.col(name), F.lit("")), True).alias("title")
    made = points.withColumn("p", point).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "p"))).alias("ps"), title)
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    return made.select(*key, F.concat(F.lit('<gpx version="1.1"><trk><name>'), escaped(F.col("title")), F.lit("</name><trkseg>"), body, F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def render_walks(points: DataFrame, name: str = "slug") -> DataFrame:
    """(source, slug, gpx): one document for each walk, with its tracks in order of track_no. name: a column of points."""
    inner = F.regexp_extract("gpx", "(?s)<gpx[^>]*>(.*)</gpx>", 1)
    walk = key_of(points)
    made = render(points, name).groupBy(*walk).agg(F.array_sort(F.collect_list(F.struct("track_no", inner.alias("t")))).alias("ts"))
    return made.select(*walk, F.concat(F.lit('<gpx version="1.1">'), F.array_join(F.transform("ts", lambda x: x["t"]), ""), F.lit("</gpx>")).alias("gpx"))


def write_files(documents: DataFrame, path: str) -> None:
    """One file a document (key of the track, gpx), in folders named by its key."""
    key = track_key(documents)
    documents.select(*key, "gpx").repartition(*key).write.partitionBy(*key).text(path)
