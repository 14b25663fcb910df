"""The ingest job: index pages, route pages and GPX to catalogue rows, with bad rows set aside, named and counted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.functions.bng import in_gb
from walkspark.functions.keys import WALK
from walkspark.operators import tracks
from walkspark.operators.pages import parse_pages, parse_walks
from walkspark.operators.store import replace_children, set_apart, upsert, valid, valid_food, valid_variations
from walkspark.sources.gpx import parse
from walkspark.sources.scratch import stored

KEYS = list(WALK)


def geometry(gpx: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(source, slug, gpx_route_count, start and finish, km, ascent_m, has_elevation, backfilled, error) of each document's main track.

    heights: (lat_key, lon_key, height) for points without one. A track that they complete is backfilled. `error` says why a
    document has no figures: no track points (nothing in it, or it is broken), missing heights (a gap that heights don't
    fill), a point outside Great Britain, or fewer than two points. What was found before the error is kept: the number of
    routes and the ends, and that the track was backfilled."""
    points = stored(parse(gpx.filter("length(gpx) > 0").select(*KEYS, "gpx")), "ingest-points")  # for the ends, the heights and the lengths
    first, whole = F.col("track_no") == 0, points.filter("track_no = 0")
    ends = points.groupBy(*KEYS).agg(
        (F.max("track_no") + 1).cast("int").alias("gpx_route_count"), F.min_by(F.struct("lon", "lat"), F.when(first, F.col("seq"))).alias("a"), F.max_by(F.struct("lon", "lat"), F.when(first, F.col("seq"))).alias("b"),
        F.bool_or(first & F.col("ele").isNull()).alias("gaps"), F.bool_or(first & ~in_gb(F.col("lon"), F.col("lat"))).alias("abroad"), F.count_if(first).alias("n"),
    )
    if heights is not None:
        whole = tracks.filled(whole, heights)
        ends = ends.join(whole.groupBy(*KEYS).agg(F.bool_or(F.col("ele").isNull()).alias("short")), KEYS, "left")
    else:
        ends = ends.withColumn("short", F.lit(False))
    stats = tracks.describe(tracks.projected(whole)).select(*KEYS, "km", "ascent_m", "has_elevation")
    made = gpx.filter("length(gpx) > 0").select(*KEYS).join(ends, KEYS, "left").join(stats, KEYS, "left")
    error = F.when(F.col("n").isNull(), "no track points").when(F.col("gaps") & F.col("short"), "missing heights").when(F.col("abroad"), "outside Great Britain").when(F.col("n") < 2, "fewer than two points")
    made = made.withColumn("error", error)
    figure = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    backfilled = F.lit(heights is not None) & F.coalesce("gaps", F.lit(False)) & ~F.coalesce("short", F.lit(True))
    return made.select(*KEYS, "gpx_route_count", F.col("a.lon").alias("start_lon"), F.col("a.lat").alias("start_lat"), F.col("b.lon").alias("finish_lon"), F.col("b.lat").alias("finish_lat"), figure("km"), figure("ascent_m"), figure("has_elevation"), backfilled.alias("backfilled"), "error")


@dataclass
class Ingested:
    """walks: every ref with status, error, mismatch and backfilled; children of the walks that are stored; bad children with their reason."""

    walks: DataFrame
    variations: DataFrame
    food_stops: DataFrame
    bad_variations: DataFrame
    bad_food_stops: DataFrame

    def stored_walks(self) -> DataFrame:
        return self.walks.filter("status <> 'failed'").drop("status", "error", "mismatch", "backfilled")

    def errors(self) -> DataFrame:
        """(source, slug, stage, position, error): everything that went wrong, by stage: page, geometry, variations or food_stops."""
        walks = self.walks.filter("error is not null").select(*KEYS, F.when(F.col("status") == "failed", "page").otherwise("geometry").alias("stage"), F.lit(None).cast("int").alias("position"), "error")
        child = lambda df, stage: df.select(*KEYS, F.lit(stage).alias("stage"), "position", F.col("reason").alias("error"))
        return reduce(DataFrame.unionByName, [walks, child(self.bad_variations, "variations"), child(self.bad_food_stops, "food_stops")])


def ingest(refs: DataFrame, raw: DataFrame, gpx: DataFrame, tolerance: float = 0.10, limit: int | None = None, heights: DataFrame | None = None, order: str = "listed", gpx_dir: str = "gpx") -> Ingested:
    """Parse, check and measure the walks of refs (source, slug, ...); raw: their pages, gpx: their GPX texts, both with source and slug.

    `status` is failed (`error`: no page, or the bound that it breaks), without_gpx, geometry_failed (`error`: why) or measured. limit: only the first
    refs by `order`. Nothing raises in a task. Lengths are rounded to two places after they are compared with the published
    ones. Refs, GPX and pages are read and parsed once, into tables that the three outputs read. A walk with GPX has a `gpx_path` in gpx_dir, whatever is in it."""
    if limit is not None:
        refs = refs.orderBy(order, "slug", "source").limit(limit)
    refs, gpx = stored(refs, "ingest-refs"), stored(gpx.select(*KEYS, "gpx"), "ingest-gpx")
    parts = stored(parse_pages(raw.join(refs.select(*KEYS), KEYS, "left_semi")), "ingest-pages")
    walks, variations, food_stops = parse_walks(refs, raw, parts)
    has_gpx = gpx.select(*KEYS, (F.length("gpx") > 0).alias("has_gpx"))
    made = refs.select(*KEYS).join(valid(walks), KEYS, "left").join(has_gpx, KEYS, "left").join(geometry(gpx, heights), KEYS, "left").withColumn("has_gpx", F.coalesce("has_gpx", F.lit(False)))
    failed = F.col("title").isNull() | F.col("reason").isNotNull()
    status = F.when(failed, "failed").when(~F.col("has_gpx"), "without_gpx").when(F.col("error").isNotNull(), "geometry_failed").otherwise("measured")
    error = F.when(F.col("title").isNull(), "no page").otherwise(F.coalesce("reason", "error"))
    apart = F.abs(F.col("km") - F.col("published_distance_km")) / F.col("published_distance_km") > tolerance
    path = F.when(F.col("has_gpx"), F.concat(F.lit(f"{gpx_dir}/"), "source", F.lit("/"), "slug", F.lit(".gpx")))
    made = made.withColumns({"status": status, "mismatch": F.coalesce(apart & ~failed, F.lit(False)), "backfilled": F.coalesce("backfilled", F.lit(False)) & ~failed, "computed_distance_km": F.bround("km", 2), "computed_ascent_m": F.bround("ascent_m", 0), "gpx_path": path, "error": error})
    made = stored(made.drop("km", "ascent_m", "has_gpx", "reason"), "ingest-walks")
    kept = made.filter("status <> 'failed'").select(*KEYS)
    v, bad_v = set_apart(valid_variations(variations.join(kept, KEYS)))
    f, bad_f = set_apart(valid_food(food_stops.join(kept, KEYS)))
    return Ingested(made, v, f, bad_v, bad_f)


def report(walks: DataFrame) -> DataFrame:
    """One row of counts. Every walk but the failed ones is `ingested`, as it goes to the store; those with figures are `measured`."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return walks.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "failed").alias("ingested"), *map(count, ("failed", "without_gpx", "geometry_failed", "measured")), F.count_if("backfilled").alias("backfilled"), F.count_if("mismatch").alias("mismatches"))


def report_lists(new: Ingested) -> DataFrame:
    """(list, source, slug, error, published_km, computed_km): the walks behind each count of the report, with causes and lengths."""
    rows = new.walks.select(*KEYS, "status", "error", "backfilled", "mismatch", F.col("published_distance_km").alias("published_km"), F.col("computed_distance_km").alias("computed_km"))
    lists = F.array(F.when(F.col("status").isin("failed", "without_gpx", "geometry_failed"), F.col("status")), F.when(F.col("backfilled"), "backfilled"), F.when(F.col("mismatch"), "mismatch"))
    found = rows.select(F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"), *KEYS, "error", "published_km", "computed_km")
    only = lambda c, names: F.when(F.col("list").isin(*names), F.col(c)).alias(c)
    return found.select("list", *KEYS, only("error", ("failed", "geometry_failed")), only("published_km", ("mismatch",)), only("computed_km", ("mismatch",)))


def update(store: tuple[DataFrame, DataFrame, DataFrame], new: Ingested) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walks, variations, food stops) of a store with the new walks in place of those of equal keys; their children are replaced whole."""
    walks, variations, food_stops = store
    fresh = new.stored_walks()
    return upsert(walks, fresh.withColumn("_version", F.lit(0)), KEYS, "_version"), replace_children(variations, new.variations, fresh, KEYS), replace_children(food_stops, new.food_stops, fresh, KEYS)
