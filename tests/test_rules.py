"""Rules at their edges: nulls, zeros, ties, odd texts."""

import pytest
from pyspark.sql import functions as F

from walkspark.functions import text as tx
from walkspark.operators import search, store, travel
from walkspark.operators import pages

WALK = "slug string, title string, summary string, region string, tags array<string>, london_departure_crs array<string>, computed_distance_km double, published_distance_km double, computed_ascent_m double, published_ascent_m double, toughness int, seeded_journey_minutes int, start_lat double, start_lon double, source string"


def _walks(spark):
    rows = [
        ("quick", "A café by the king's road", None, "Kent", ["x"], ["VIC", "CHX"], None, 10.0, 0.0, 50.0, 3, 20, 51.2, 0.1, "s"),
        ("slow", "Blue hills", None, "Kent", [], ["BFR"], 0.0, 9.0, None, None, None, 60, None, None, "s"),
        ("unknown", "Bluebells", None, "Sussex", [], ["chx"], None, None, None, None, 0, 40, 51.5074, -0.1276, "s"),
        ("unlisted", "Far", None, None, [], ["KGX"], None, 12.0, None, None, 5, None, None, None, "s"),
        ("none", "Nowhere", None, None, [], [], None, 8.0, None, None, 5, 5, None, None, "s"),
    ]
    return spark.createDataFrame(rows, WALK)


HOME = [{"crs": "hnh", "name": "Home", "termini": {"vic": 12, "BFR": 15, "CHX": None}}]


def test_estimates_and_ranking(spark):
    made = travel.estimates(_walks(spark), travel.profile_table(spark, HOME), "HNH")
    got = {r["slug"]: (r["terminus"], r["access_min"], r["preferred"], r["total_min"], r["travel_text"]) for r in made.collect()}
    assert got["quick"] == ("VIC", 12, True, 32, "12+20=32")
    assert got["unknown"] == ("chx", None, True, None, "?+40")
    assert got["unlisted"] == ("KGX", None, False, None, "?")
    assert got["none"] == (None, None, False, None, "?+5")
    assert [r["slug"] for r in made.orderBy(*travel.rank_order()).collect()] == ["quick", "slow", "unknown", "none", "unlisted"]
    assert {r["slug"] for r in travel.within_budget(made, 40).collect()} == {"quick", "unknown", "unlisted", "none"}
    with pytest.raises(ValueError):
        travel.estimates(_walks(spark), travel.profile_table(spark, HOME), "XXX")
    for bad in ([], [{"crs": "LONG", "name": "", "termini": {}}]):
        with pytest.raises(ValueError):
            travel.profile_table(spark, bad)


def test_filters(spark):
    w = _walks(spark)
    slugs = lambda **k: [r["slug"] for r in search.find_walks(w, **k).collect()]
    assert slugs() == ["unknown", "slow", "none", "quick", "unlisted"]
    assert slugs(min_km=0.0, max_km=8.0) == ["slow", "none"]
    assert slugs(max_travel_min=30) == ["none", "quick"]
    assert slugs(text="cafe king's") == ["quick"] and slugs(text="blue") == ["slow"] and slugs(text="kings") == [] and slugs(text="& blue") == ["slow"]
    with pytest.raises(ValueError):
        slugs(text='" & "')


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, o int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], "o").collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_valid(spark):
    rows = _walks(spark).withColumn("published_distance_km", F.when(F.col("slug") == "slow", 0.0).otherwise(F.col("published_distance_km")))
    got = {r["slug"]: r["reason"] for r in store.valid(rows).collect()}
    assert got == {"quick": None, "slow": "distance", "unknown": None, "unlisted": None, "none": None}


@pytest.mark.parametrize("text, minutes", [("19 to 26 mins", 26), ("30 and 34 minutes", 34), ("about 2 hrs", 120), ("just under an hour", 55), ("over one hour", 65), ("nothing", None), ("1 hour 5 minutes", 65), ("an hour and a quarter", 75)])
def test_minutes(spark, text, minutes):
    assert spark.createDataFrame([(text,)], "t string").select(tx.parse_minutes(F.col("t"))).first()[0] == minutes


def test_food(spark):
    body = "<p>After 3 km you reach <b>Littleham</b>, a village. <b>The Swan Inn</b> (01234 567890; open until 3 pm). <b>Corner Shop</b> 01234 567891. <b>The swan inn</b> again"
    found = lambda body: spark.createDataFrame([(body,)], "b string").select(pages.venues(F.col("b"))).first()[0]
    got = found(body)
    assert [(g["name"], g["phone"], g["position_km"]) for g in got][:2] == [("The Swan Inn", "01234 567890", 3.0), ("Corner Shop", "01234 567891", 3.0)]
    assert len(got) == 2 and "open until 3 pm" in got[0]["hours_note"]
    more = found("See <strong>Caf&eacute; Uno</strong>. Tel01234 567890 opens daily, 4½ km along the way. Then <b>Mill</b><b>The Bell:</b><b></b> closed Mondays")
    assert [(g["name"], g["phone"], g["position_km"]) for g in more] == [("Café Uno", None, None), ("The Bell", None, 4.5)] and more[1]["hours_note"] == "closed Mondays"
    assert found("No bold name, tel 01234 567890") == [] and found("") == [] and found(None) is None
    assert [g["phone"] for g in found("<b>Shop</b> Tel01234 567890.")] == ["01234 567890"]


def test_entry_registers():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_accents_and_summaries(spark):
    rows = [("a", "Ştefan's Łódź Ấp", None), ("b", "plain", "By the rivière"), ("c", "e\u0301te", None)]
    w = spark.createDataFrame(rows, "slug string, title string, summary string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("region", "source")], F.array().cast("array<string>").alias("tags"), *[F.lit(None).cast("double").alias(c) for c in ("computed_distance_km", "published_distance_km")])
    slugs = lambda text: [r["slug"] for r in search.find_walks(w, text=text).collect()]
    assert slugs("stefan") == ["a"] and slugs("riviere") == ["b"] and slugs("ETE") == ["c"] and slugs("ap") == ["a"]


def test_get_walk(spark):
    w = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "a")], "slug string, source string")
    got = lambda *a: [r["source"] for r in search.get_walk(w, *a).collect()]
    assert got("x") == ["a"] and got("x", "b") == ["b"] and got("z") == []


def test_children_are_checked(spark):
    v = spark.createDataFrame([("a", None, "other", 1.0), ("b", "x", "stroll", 1.0), ("c", "x", "other", 0.0), ("d", "x", "other", None)], "slug string, label string, kind string, distance_km double")
    good, bad = store.set_apart(store.valid_variations(v))
    assert [r["slug"] for r in good.collect()] == ["d"] and {r["slug"]: r["reason"] for r in bad.collect()} == {"a": "label", "b": "kind", "c": "distance"}
    f = spark.createDataFrame([("a", None, "tea", 1.0), ("b", "x", "dinner", 1.0), ("c", "x", "lunch", -1.0), ("d", "x", "lunch", 0.0)], "slug string, name string, role string, position_km double")
    assert {r["slug"]: r["reason"] for r in store.valid_food(f).collect()} == {"a": "name", "b": "role", "c": "position", "d": None}
