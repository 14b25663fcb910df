"""Access from a home station: estimates, budgets and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.operators.search import DISTANCE, best, find_walks, with_variations


def profile_table(spark: SparkSession, stations: Sequence[Mapping]) -> DataFrame:
    """Rows (station_crs, station_name, terminus_crs, access_min, position) of a profile: termini as a mapping to minutes or null, or as a list.

    Codes are upper-cased and have three characters; a profile has a station at least.
    """
    if not stations:
        raise ValueError("a profile has a home station at least")
    rows = []
    for s in stations:
        termini = s["termini"]
        items = list(termini.items()) if isinstance(termini, Mapping) else [(t, None) for t in termini]
        for code in (s["crs"], *(t for t, _ in items)):
            if len(code) != 3:
                raise ValueError(f"not a station code: {code}")
        rows += [(s["crs"].upper(), s["name"], t.upper(), m, i) for i, (t, m) in enumerate(items)]
    return spark.createDataFrame(rows, "station_crs string, station_name string, terminus_crs string, access_min int, position int")


def termini_for(profile: DataFrame, station: str | None = None) -> DataFrame:
    """Termini of one home station, or of all, each once in order of first mention."""
    if station is not None:
        profile = profile.filter(F.col("station_crs") == station.upper())
    return profile.groupBy("terminus_crs").agg(F.min("position").alias("position"))


def _minutes(profile: Sequence) -> Column:
    """Known minutes by terminus as a map column; the profile is a handful of rows."""
    pairs = [x for t, m in profile for x in (F.lit(t), F.lit(m).cast("int"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")


def estimates(walks: DataFrame, home: DataFrame, station: str) -> DataFrame:
    """walks with terminus, access_min, preferred, total_min and travel_text.

    Among a walk's termini that the station lists, the quickest known one counts (unknown times last, then the
    walk's order); without any, the walk's first terminus, not preferred. One row a walk: no shuffle.
    """
    rows = [(r["terminus_crs"].upper(), r["access_min"]) for r in home.filter(F.col("station_crs") == station.upper()).select("terminus_crs", "access_min").collect()]
    if not rows:
        raise ValueError(f"unknown home station {station}")
    minutes = _minutes(rows)
    known = F.array(*[F.lit(t) for t, _ in rows])
    listed = F.filter(F.transform("london_departure_crs", lambda c, i: F.struct(F.element_at(minutes, F.upper(c)).isNull().alias("u"), F.coalesce(F.element_at(minutes, F.upper(c)), F.lit(0)).alias("m"), i.alias("i"), c.alias("c"), F.array_contains(known, F.upper(c)).alias("l"))), lambda x: x["l"])
    pick = F.get(F.array_sort(listed), F.lit(0))
    out = walks.withColumn("_p", pick)
    access = F.when(~F.col("_p.u"), F.col("_p.m"))
    out = out.withColumns({"preferred": F.col("_p").isNotNull(), "terminus": F.coalesce(F.col("_p.c"), F.get("london_departure_crs", F.lit(0))), "access_min": access}).drop("_p")
    onward = F.col("seeded_journey_minutes")
    text = F.when(onward.isNull(), "?").when(F.col("access_min").isNull(), F.concat(F.lit("?+"), onward)).otherwise(F.concat(F.col("access_min"), F.lit("+"), onward, F.lit("="), F.col("access_min") + onward))
    return out.withColumns({"total_min": F.col("access_min") + onward, "travel_text": text})


def within_budget(estimated: DataFrame, minutes: int) -> DataFrame:
    """Only known totals can exceed a budget."""
    return estimated.filter(F.col("total_min").isNull() | (F.col("total_min") <= minutes))


def crow_km(lat: Column, lon: Column, lat0: float = 51.5074, lon0: float = -0.1276, radius: float = 6371.0) -> Column:
    """Great-circle kilometres from the centre of London."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def rank_order() -> list[Column]:
    """Preferred first, then total, then distance from London (unknown or 0 last), then length, slug and source."""
    crow = F.coalesce(F.nullif(F.round(crow_km(F.col("start_lat"), F.col("start_lon")), 6), F.lit(0.0)), F.lit(10_000.0))
    return [(~F.col("preferred")).cast("int"), F.coalesce("total_min", F.lit(10_000)), crow, best(DISTANCE).asc_nulls_first(), F.col("slug"), F.col("source")]


def find_from(walks, variations, home, station, max_total_min=None, only_preferred=False, with_options=False, limit=20, prelimit=True, **filters):
    """Filter, take the nearest lengths, estimate access, rank. prelimit=False ranks every match."""
    cut = max(limit * 10, 200) * (3 if with_options else 1) if prelimit else None
    found = find_walks(walks, limit=cut, **filters)
    if with_options:
        found = with_variations(found, variations)
    made = estimates(found, home, station)
    if max_total_min is not None:
        made = within_budget(made, max_total_min)
    if only_preferred:
        made = made.filter("preferred")
    return made.orderBy(*rank_order()).limit(limit)
