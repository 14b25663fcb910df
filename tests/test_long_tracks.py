"""Tracks in runs against whole ones, several tracks of a walk, and a long track in many tasks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkspark.operators import corridor, quality, search, tracks

KEY = ["source", "slug", "track_no"]


@pytest.fixture(scope="module")
def points(spark):
    """Five tracks of two sources with one slug; one of a point, one with a point abroad."""
    rng, rows = np.random.default_rng(71), []
    for source, no, n in (("a", 0, 57), ("a", 1, 23), ("b", 0, 40), ("b", 1, 1), ("b", 2, 9)):
        lon, lat = -1.5 + np.cumsum(rng.normal(0, 0.002, n)), 51.0 + np.cumsum(rng.normal(0, 0.002, n))
        lon[5:8] = lon[4] if n > 8 else lon[5:8]  # points in one place
        lat[5:8] = lat[4] if n > 8 else lat[5:8]
        rows += [(source, "w", no, i, float(lon[i]), float(lat[i]), float(100 + rng.normal(0, 5)) if (source, no) != ("a", 1) or i % 7 else None) for i in range(n)]
    rows[-1] = (*rows[-1][:4], 30.0, 51.0, 1.0)
    return spark.createDataFrame(rows, "source string, slug string, track_no int, seq int, lon double, lat double, ele double")


def _rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 2, 5, 16])
def test_runs_equal_whole_tracks(points, chunk):
    p = tracks.projected(points)
    assert p.filter("source = 'b' AND track_no = 2").count() == 0
    for f in (lambda c: tracks.cumulative(p, c), lambda c: tracks.describe(p, chunk=c), lambda c: tracks.describe(p, window=4, chunk=c), lambda c: tracks.segments(p, c), lambda c: tracks.sample_along(p, 300.0, c), lambda c: tracks.slice_track(p, 0.2, 0.7, c), lambda c: tracks.moving_average(points, 5, c)):
        whole = f(None)
        assert _rounded(f(chunk).select(whole.columns)) == _rounded(whole)


def test_tracks_of_one_slug_stay_apart(points):
    got = {tuple(r[k] for k in KEY): r for r in tracks.describe(tracks.projected(points)).collect()}
    assert {k: r["point_count"] for k, r in got.items()} == {("a", "w", 0): 57, ("a", "w", 1): 23, ("b", "w", 0): 40} and not got["a", "w", 1]["has_elevation"]
    p = tracks.projected(points).toPandas()
    for k, r in got.items():
        t = p[(p.source == k[0]) & (p.track_no == k[2])].sort_values("seq")
        assert r["km"] == pytest.approx(np.hypot(np.diff(t.e), np.diff(t.n)).sum() / 1000)
    places = points.sparkSession.createDataFrame([(1, -1.5, 51.0)], "poi_id long, lon double, lat double")
    near = corridor.corridor(tracks.projected(points), places, 2000.0)
    assert sorted(tuple(r[k] for k in KEY) for r in near.collect()) == [("a", "w", 0), ("a", "w", 1), ("b", "w", 0)]


def test_a_long_track_is_spread(spark):
    n = 400_000
    p = spark.range(n).select(F.lit("s").alias("source"), F.lit("long").alias("slug"), F.lit(0).alias("track_no"), F.col("id").cast("int").alias("seq"), (400_000.0 + 10 * F.col("id")).alias("e"), F.lit(200_000.0).alias("n"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), (F.col("id") % 100).cast("double").alias("ele"))
    rows = tracks.cumulative(p, chunk=8192)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\([^)]*_chunk", plan)  # dealt out by run, not by track
    assert rows.agg(F.max("cum_m")).first()[0] == pytest.approx(10.0 * (n - 1)) and rows.count() == n
    assert tracks.describe(p, chunk=8192).first()["km"] == pytest.approx((n - 1) / 100)


def test_children_of_two_sources(spark):
    w = spark.createDataFrame([("s1", "a", 10.0), ("s2", "a", 20.0)], "source string, slug string, published_distance_km double").withColumn("computed_distance_km", F.lit(None).cast("double"))
    v = spark.createDataFrame([("s1", "a", 0, "one", 8.0), ("s2", "a", 0, "two", 15.0), ("s2", "a", 1, "three", 25.0)], "source string, slug string, position int, label string, distance_km double")
    f = spark.createDataFrame([("s2", "a", 0, "Inn", "1")], "source string, slug string, position int, name string, phone string")
    got = {r["source"]: ([x["label"] for x in r["variations"]], [x["name"] for x in r["food_stops"]]) for r in search.hydrate(w, v, f).collect()}
    assert got == {"s1": (["one"], []), "s2": (["two", "three"], ["Inn"])}
    assert {r["source"]: (r["n_options"], r["shorter"]) for r in search.shorter_options(w, v).collect()} == {"s1": (1, [8.0]), "s2": (2, [15.0])}
    assert [r["source"] for r in search.with_variations(w, v.filter("source = 's2'")).collect()] == ["s2"]
    assert quality.children_coverage(v, f).first().asDict() == {"with_variations": 2, "with_variation_distance": 2, "with_food": 1, "with_food_phone": 1}
