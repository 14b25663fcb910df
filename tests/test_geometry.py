"""Tracks whose lengths are known: built on the grid, taken to degrees and back."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from walkspark.functions.bng import from_grid, to_grid
from walkspark.operators import corridor, tracks
from walkspark.sources import gpx

E0, N0 = 540000.0, 160000.0


def _track(spark, e, n, ele=None, slug="t"):
    lon, lat = from_grid(np.array(e, float), np.array(n, float))
    rows = pd.DataFrame({"slug": slug, "seq": range(len(e)), "lon": lon, "lat": lat, "ele": [None] * len(e) if ele is None else [float(x) for x in ele]})
    return spark.createDataFrame(rows, "slug string, seq int, lon double, lat double, ele double")


def test_grid_round_trip():
    e, n = np.meshgrid(np.linspace(100000, 650000, 9), np.linspace(10000, 1100000, 9))
    back = to_grid(*from_grid(e.ravel(), n.ravel()))
    assert np.allclose(back[0], e.ravel(), atol=1e-5) and np.allclose(back[1], n.ravel(), atol=1e-5)


def test_straight_and_ramp(spark):
    straight = tracks.describe(tracks.projected(_track(spark, [E0 + 100 * i for i in range(11)], [N0] * 11))).first()
    assert straight["km"] == pytest.approx(1.0, rel=1e-6) and straight["ascent_m"] is None and not straight["has_elevation"]
    up = list(range(41)) + list(range(39, -1, -1))
    ramp = tracks.projected(_track(spark, [E0 + 50 * i for i in up], [N0] * 81, [50 + 2.5 * i for i in up]))
    assert tracks.describe(ramp, window=1).first()["ascent_m"] == pytest.approx(100)
    assert tracks.describe(ramp, window=5).first()["ascent_m"] == pytest.approx(100, rel=0.1)
    assert tracks.describe(ramp).first()["km"] == pytest.approx(4.0, rel=1e-6)


def test_one_point_and_abroad(spark):
    assert tracks.describe(tracks.projected(_track(spark, [E0], [N0]))).count() == 0
    abroad = spark.createDataFrame([("a", 0, -20.0, 51.0, None), ("a", 1, -1.0, 51.0, None)], "slug string, seq int, lon double, lat double, ele double")
    assert tracks.projected(abroad).count() == 0


def test_samples_and_slices(spark):
    p = tracks.projected(_track(spark, [E0 + 100 * i for i in range(12)], [N0] * 12))
    assert sorted(round(r["at_m"]) for r in tracks.sample_along(p).collect()) == [0, 500, 1000, 1100]
    assert sorted(round(r["at_m"]) for r in tracks.slice_track(p, 0.25, 0.5).collect()) == [275, 300, 400, 500, 550]
    with pytest.raises(ValueError):
        tracks.slice_track(p, 0.5, 0.2)


def test_corridor_edge_and_long_segment(spark):
    p = tracks.projected(_track(spark, [E0, E0 + 6000], [N0, N0]))
    lon, lat = from_grid(np.array([E0 + 3000, E0 + 4500, E0 + 3000, E0 - 100]), np.array([N0 + 249.9, N0 - 30, N0 + 251, N0]))
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat))], "poi_id long, lon double, lat double")
    got = {r["poi_id"]: r for r in corridor.corridor(p, places).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0]["distance_m"] == pytest.approx(249.9, abs=0.01) and got[0]["fraction"] == pytest.approx(0.5, abs=1e-4)
    assert got[3]["fraction"] == 0.0


def test_gpx_shapes(spark):
    text = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>doc</name></metadata><wpt lat="1" lon="2"/><rte><name>r &amp; s</name><rtept lat="51.2" lon="0.1"/></rte><rte/><trk><trkseg><trkpt lat="51" lon="0"><ele>5</ele></trkpt></trkseg><trkseg><trkpt lat="51.1" lon="0"/></trkseg></trk></gpx>'
    docs = spark.createDataFrame([("a", text), ("b", "<gpx></gpx>"), ("c", "<gpx"), ("d", None), ("e", "")], "slug string, gpx string")
    rows = gpx.parse(docs).orderBy("track_no", "seq").collect()
    assert [(r["slug"], r["track_no"], r["name"], r["lat"], r["ele"]) for r in rows] == [("a", 0, "doc", 51.0, 5.0), ("a", 0, "doc", 51.1, None), ("a", 1, "r & s", 51.2, None)]
    named = _track(spark, [E0, E0 + 1], [N0, N0], slug="x<y>&z")
    assert gpx.parse(gpx.render(named)).select(F.first("name")).first()[0] == "x<y>&z"
