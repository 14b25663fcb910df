"""Places near tracks: a range join over grid cells as wide as the corridor.

Each segment covers the cells of its padded box (segments longer than a few cells are split first), and a place
lies in one cell, so a place meets a segment once and no join is without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.functions.bng import in_gb, to_bng
from walkspark.functions.keys import track_key
from walkspark.operators.tracks import segments, track_lengths


def _pieces(segs: DataFrame, cell: float, most_cells: int = 4) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("len_m") / (cell * most_cells)).cast("int"))
    cut = segs.withColumn("parts", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("parts")
    return cut.withColumns({f"{c}{i}": at(c, f"{c}2", F.col("part") + i) for c in "en" for i in (0, 1)})


def _placed(met: DataFrame) -> DataFrame:
    """met with d, metres from the place (pe, pn) to the segment, and along, metres from the track's start to the nearest point."""
    de, dn = F.col("e2") - F.col("e"), F.col("n2") - F.col("n")
    share = ((F.col("pe") - F.col("e")) * de + (F.col("pn") - F.col("n")) * dn) / (de * de + dn * dn)
    met = met.withColumn("t", F.when(F.col("len_m") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).otherwise(0.0))
    x, y = F.col("pe") - F.col("e") - F.col("t") * de, F.col("pn") - F.col("n") - F.col("t") * dn
    return met.withColumns({"d": F.sqrt(x * x + y * y), "along": F.col("cum_m") + F.col("t") * F.col("len_m")})


def _nearest(met: DataFrame, length: DataFrame) -> DataFrame:
    """(key of the track, poi_id, distance_m, fraction) by the nearest segment of each pair; of equally near ones the first counts."""
    key = track_key(met)
    near = met.groupBy(*key, "poi_id").agg(F.min(F.struct("d", "seg", "along")).alias("m")).join(length, key)
    fraction = F.when(F.col("length_m") > 0, F.least(F.lit(1.0), F.col("m.along") / F.col("length_m"))).otherwise(0.0)
    return near.select(*key, "poi_id", F.col("m.d").alias("distance_m"), fraction.alias("fraction"))


def _projected(places: DataFrame) -> DataFrame:
    return places.filter(in_gb(F.col("lon"), F.col("lat"))).withColumn("_g", to_bng("lon", "lat")).withColumns({"pe": F.col("_g.e"), "pn": F.col("_g.n")}).drop("_g", "lon", "lat")


def to_tracks(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(key of the track, poi_id, distance_m, fraction) for each asked pair (key of the track, poi_id, lon, lat), however far apart.

    points: projected. One join by track; pairs without a track in Great Britain, or a place outside it, have no row."""
    segs = segments(points)
    key = track_key(segs)
    length = track_lengths(segs).drop("last_seg")
    met = segs.select(*key, "seg", "e", "n", "e2", "n2", "cum_m", "len_m").join(_projected(asked), track_key(segs, asked))
    return _nearest(_placed(met), length)


def corridor(points: DataFrame, places: DataFrame, max_m: float = 250.0) -> DataFrame:
    """(key of the track, poi_id, distance_m, fraction) of all places within max_m of a track, the edge included.

    points: projected; fraction: of the track's length at the nearest point, of the first nearest segment."""
    cell = max(max_m, 250.0)
    segs = segments(points)
    key = track_key(segs)
    length = track_lengths(segs).drop("last_seg")
    pieces = _pieces(segs.select(*key, "seg", "e", "n", "e2", "n2", "cum_m", "len_m"), cell)
    span = lambda c: F.sequence(F.floor((F.least(f"{c}0", f"{c}1") - max_m) / cell), F.floor((F.greatest(f"{c}0", f"{c}1") + max_m) / cell))
    keyed = pieces.withColumn("ce", F.explode(span("e"))).withColumn("cn", F.explode(span("n")))
    keyed = keyed.select(*key, "seg", "e", "n", "e2", "n2", "cum_m", "len_m", "ce", "cn")  # two pieces may meet in a cell; the minimum is the same
    there = _projected(places.select("poi_id", "lon", "lat")).withColumns({"ce": F.floor(F.col("pe") / cell), "cn": F.floor(F.col("pn") / cell)})
    met = keyed.join(there, ["ce", "cn"])
    return _nearest(_placed(met).filter(F.col("d") <= max_m), length)
