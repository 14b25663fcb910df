"""Facts of tracks from their points (source, slug, track_no, seq, lon, lat, ele): one partitioning by runs of a track serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from walkspark.functions.bng import in_gb, to_bng, to_wgs84
from walkspark.functions.keys import track_key


#: Points of a track that one task handles at least; a longer track is spread over several.
CHUNK = 1 << 16


def projected(points: DataFrame) -> DataFrame:
    """points inside Great Britain with e, n in metres; a track with one point outside is left out whole."""
    key = track_key(points)
    outside = points.filter(~F.coalesce(in_gb(F.col("lon"), F.col("lat")), F.lit(False))).select(*key).distinct()
    kept = points.join(outside, key, "left_anti")
    return kept.withColumn("_g", to_bng("lon", "lat")).select("*", "_g.e", "_g.n").drop("_g")


def in_chunks(points: DataFrame, halo: int, chunk: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """points with `_chunk` and `_own`, and the window of a chunk in order of seq.

    A track's points are numbered from 0 without gaps (`seq`); a chunk is a run of them. The `halo` points before and
    behind a run are in it too, as rows that aren't its own, so what looks at so many neighbours needs no other chunk."""
    size = max(chunk or CHUNK, halo, 1)
    at, own = F.col("seq") % size, F.floor(F.col("seq") / size).cast("long")
    near = F.array(F.when((at < halo) & (own > 0), own - 1), own, F.when(at >= size - halo, own + 1))
    made = points.withColumns({"_home": own, "_chunk": F.explode(F.filter(near, lambda c: c.isNotNull()))})
    made = made.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")
    return made, Window.partitionBy(*track_key(points), "_chunk").orderBy("seq")


def _own(chunks: DataFrame) -> DataFrame:
    return chunks.filter("_own").drop("_own")


def step_m(track: WindowSpec) -> Column:
    """Metres from the point before; 0 at the first point of a track."""
    e, n = F.col("e") - F.lag("e").over(track), F.col("n") - F.lag("n").over(track)
    return F.coalesce(F.sqrt(e * e + n * n), F.lit(0.0))


def cumulative(points: DataFrame, chunk: int | None = None) -> DataFrame:
    """projected points with metres from the start, 0 at the first: sums within chunks, and the sums of the chunks before."""
    return _summed(points, chunk).drop("_chunk")


def _summed(points: DataFrame, chunk: int | None, *ahead: str) -> DataFrame:
    """cumulative() with `_chunk`; ahead: columns of the next point to have as well, named with a 2."""
    key = track_key(points)
    chunks, run = in_chunks(points, 1, chunk)
    rows = _own(chunks.withColumns({"step": step_m(run), **{f"{c}2": F.lead(c).over(run) for c in ahead}}))
    totals = rows.groupBy(*key, "_chunk").agg(F.sum("step").alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    starts = totals.select(*key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_start"))
    within = F.sum("step").over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cum_m", within).join(starts, [*key, "_chunk"]).withColumn("cum_m", F.col("_start") + F.col("cum_m")).drop("_start")


def smoothed(track: WindowSpec, window: int = 5) -> Column:
    """Centred moving average of ele; edges use the neighbours there are; a window of 1 or less changes nothing."""
    if window <= 1:
        return F.col("ele")
    half = window // 2
    return F.avg("ele").over(track.rowsBetween(-half, half))


def moving_average(points: DataFrame, window: int = 5, chunk: int | None = None) -> DataFrame:
    """points with `smoothed`."""
    chunks, run = in_chunks(points, max(window // 2, 0), chunk)
    return _own(chunks.withColumn("smoothed", smoothed(run, window))).drop("_chunk")


def naismith_minutes(km: Column, ascent_m: Column) -> Column:
    return km * 12 + F.coalesce(ascent_m, F.lit(0.0)) * 0.1


def describe(points: DataFrame, window: int = 5, pace: float = 1.4, lunch: int = 60, chunk: int | None = None) -> DataFrame:
    """One row a track of two points or more: km, ascent (null unless every point has a height), minutes, ends, points."""
    key = track_key(points)
    chunks, run = in_chunks(points, max(window // 2, 0) + 1, chunk)
    rows = chunks.withColumns({"step": step_m(run), "s": smoothed(run, window)})
    rows = _own(rows.withColumn("rise", F.greatest(F.lit(0.0), F.col("s") - F.lag("s").over(run))))
    full = F.min(F.col("ele").isNotNull().cast("int")) == 1
    made = rows.groupBy(*key).agg((F.sum("step") / 1000).alias("km"), F.when(full, F.coalesce(F.sum("rise"), F.lit(0.0))).alias("ascent_m"), full.alias("has_elevation"), F.count("*").alias("point_count"), F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"))
    minutes = F.bround(naismith_minutes(F.col("km"), F.col("ascent_m")) * pace + lunch, 0).cast("int")
    return made.filter("point_count >= 2").select(*key, "km", "ascent_m", minutes.alias("est_minutes"), "has_elevation", "point_count", F.col("a.lon").alias("start_lon"), F.col("a.lat").alias("start_lat"), F.col("b.lon").alias("finish_lon"), F.col("b.lat").alias("finish_lat"))


def bbox(points: DataFrame, buffer_m: float) -> DataFrame:
    """Corners of each track's padded box, back in degrees."""
    key = track_key(points)
    box = points.groupBy(*key).agg(F.min("e").alias("e0"), F.min("n").alias("n0"), F.max("e").alias("e1"), F.max("n").alias("n1"))
    low, high = to_wgs84(F.col("e0") - buffer_m, F.col("n0") - buffer_m), to_wgs84(F.col("e1") + buffer_m, F.col("n1") + buffer_m)
    return box.select(*key, low.alias("lo"), high.alias("hi")).select(*key, F.col("lo.lon").alias("min_lon"), F.col("lo.lat").alias("min_lat"), F.col("hi.lon").alias("max_lon"), F.col("hi.lat").alias("max_lat"))


def segments(points: DataFrame, chunk: int | None = None) -> DataFrame:
    """(key of the track, seg, e, n, e2, n2, cum_m, cum2, len_m and both ends' lon, lat, ele): each point with the next; tracks of one point have none."""
    made = _summed(points, chunk, "e", "n", "lon", "lat", "ele").drop("_chunk").filter("e2 is not null").withColumnRenamed("seq", "seg")
    e, n = F.col("e2") - F.col("e"), F.col("n2") - F.col("n")
    return made.withColumn("len_m", F.sqrt(e * e + n * n)).withColumn("cum2", F.col("cum_m") + F.col("len_m"))


def track_lengths(segs: DataFrame) -> DataFrame:
    """(key of the track, length_m, last_seg) of segments."""
    return segs.groupBy(*track_key(segs)).agg(F.max("cum2").alias("length_m"), F.max("seg").alias("last_seg"))


def sample_along(points: DataFrame, every_m: float = 500.0, chunk: int | None = None) -> DataFrame:
    """(key of the track, at_m, e, n): a place each every_m metres from the start, and the end unless it is within 5 % of the last.

    Every segment makes the samples that fall on it, so no sample is joined."""
    segs, key = segments(points, chunk), track_key(points)
    segs = segs.join(track_lengths(segs).select(*key, "last_seg"), key).withColumn("is_last", F.col("seg") == F.col("last_seg")).drop("last_seg")
    k0, k1 = F.ceil(F.col("cum_m") / every_m), F.ceil(F.col("cum2") / every_m) - 1
    k1 = F.when(F.col("is_last"), F.floor(F.col("cum2") / every_m)).otherwise(k1)
    ks = F.when(k1 >= k0, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))
    rest = F.col("cum2") - F.floor(F.col("cum2") / every_m) * every_m
    places = F.concat(F.transform(ks, lambda k: k * every_m), F.when(F.col("is_last") & (rest > 0.05 * every_m), F.array("cum2")).otherwise(F.array().cast("array<double>")))
    made = segs.withColumn("at_m", F.explode(places))
    t = F.when(F.col("len_m") > 0, (F.col("at_m") - F.col("cum_m")) / F.col("len_m")).otherwise(0.0)
    return made.select(*key, "at_m", (F.col("e") + t * (F.col("e2") - F.col("e"))).alias("e"), (F.col("n") + t * (F.col("n2") - F.col("n"))).alias("n"))


def slice_track(points: DataFrame, low: float, high: float, chunk: int | None = None) -> DataFrame:
    """(key of the track, at_m, lon, lat, ele) between two fractions of the length: vertices inside, ends interpolated."""
    if not 0 <= low < high <= 1:
        raise ValueError("fractions run from 0 to 1")
    segs, key = segments(points, chunk), track_key(points)
    segs = segs.join(track_lengths(segs).select(*key, "length_m"), key).withColumns({"lo": F.col("length_m") * low, "hi": F.col("length_m") * high})
    t = lambda d: F.when(F.col("len_m") > 0, (d - F.col("cum_m")) / F.col("len_m")).otherwise(0.0)
    at = lambda d: F.struct(d.alias("at_m"), *[(F.col(c) + t(d) * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("lon", "lat", "ele")])
    holds = lambda d: (d <= F.col("cum2")) & ((d > F.col("cum_m")) | ((F.col("seg") == 0) & (d == F.col("cum_m"))))
    inside = F.struct(F.col("cum2").alias("at_m"), F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), F.col("ele2").alias("ele"))
    parts = F.array(F.when(holds(F.col("lo")), at(F.col("lo"))), F.when((F.col("cum2") > F.col("lo")) & (F.col("cum2") < F.col("hi")), inside), F.when(holds(F.col("hi")), at(F.col("hi"))))
    return segs.select(*key, F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p")).select(*key, "p.*")


def missing_requests(points: DataFrame, batch: int = 100) -> DataFrame:
    """(key of the track, lat_key, lon_key, batch): each missing height once a track, in batches."""
    key = track_key(points)
    keys = points.filter("ele is null").select(*key, F.format_string("%.6f", "lat").alias("lat_key"), F.format_string("%.6f", "lon").alias("lon_key")).distinct()
    number = F.row_number().over(Window.partitionBy(*key).orderBy("lat_key", "lon_key")) - 1
    return keys.withColumn("batch", F.floor(number / batch).cast("int"))


def filled(points: DataFrame, heights: DataFrame) -> DataFrame:
    """points with missing ele taken from heights (lat_key, lon_key, height); known ones stay."""
    keyed = points.withColumns({"lat_key": F.format_string("%.6f", "lat"), "lon_key": F.format_string("%.6f", "lon")})
    return keyed.join(heights.dropDuplicates(["lat_key", "lon_key"]), ["lat_key", "lon_key"], "left").withColumn("ele", F.coalesce("ele", "height")).drop("lat_key", "lon_key", "height")
