"""Pages that arrive in loads end up in one store, the later page of a walk in place of the earlier, with its children."""

from datetime import datetime

from walkspark.streaming.ingest import compact, current, follow

REFS = "source string, slug string, source_id string, url string, title string, region string, tags array<string>, km double, effort int, ascent_m double, description string, london_departure_crs array<string>"


def test_follow(spark, tmp_path):
    ref = lambda s: ("c", s, s, f"https://w.example/walk/{s}/", s, None, [], 9.0, 3, 10.0, None, [])
    refs = spark.createDataFrame([ref("a"), ref("b")], REFS)
    page = lambda t, n: f"<h1>{t} Walk</h1><table><tr><th>Length</th><td>8 km, 2 hours</td></tr><tr><th>Walk options</th><td>{'<li>A shorter walk of about 5 km by the lake' * n}</td></tr><tr><th>Lunch</th><td><b>The Inn {t}</b>, by the green.</td></tr></table>"
    where = [str(tmp_path / n) for n in ("raw", "store", "mark", "compact")]
    at = lambda h: datetime(2024, 5, 1, h)
    loads = [[("a", page("Old", 2), at(1))], [("a", page("Late", 1), at(5)), ("a", page("Early", 3), at(2)), ("b", page("Bee", 1), at(1)), ("zz", page("No ref", 1), at(1))]]
    for rows in loads:
        spark.createDataFrame([("c", *r) for r in rows], "source string, slug string, page string, fetched_at timestamp").write.mode("append").parquet(where[0])
        follow(spark, where[0], refs, where[1], where[2]).awaitTermination()
    compact(spark, where[1], where[3])
    for store in (where[1], where[3]):
        walks, variations, food = current(spark, store)
        assert {r["slug"]: (r["title"], r["published_distance_km"]) for r in walks.collect()} == {"a": ("Late", 8.0), "b": ("Bee", 8.0)}
        assert sorted((r["slug"], r["position"]) for r in variations.collect()) == [("a", 0), ("b", 0)]
        assert {r["slug"]: r["name"] for r in food.collect()} == {"a": "The Inn Late", "b": "The Inn Bee"}
    assert [r["slug"] for r in spark.read.parquet(f"{where[1]}/orphans").collect()] == ["zz"]
