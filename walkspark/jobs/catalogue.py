"""Registered queries over the derived catalogue, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.functions import bng
from walkspark.operators import corridor, quality, search, store, tracks, travel
from walkspark.sources import gpx, scratch, walk_store
from walkspark.sources.tables import HOME, USER_KEY, ctes, domain, home_termini

QUERIES, ORACLES = {}, {}
KM = "coalesce(computed_distance_km, published_distance_km)"


#: How the SQL's whole keys are taken apart again: of walks, of tracks, and of GPX documents.
_WALK = "split_part(slug, '/', 1) AS slug, split_part(slug, '/', 2) AS source"
PARTS = {"walk": _WALK, "track": _WALK + ", CAST(split_part(slug, '/', 3) AS INT) AS track_no", "doc": _WALK + ", CAST(split_part(slug, '/', 3) AS INT) AS doc"}
WALK = ["source", "slug"]
TRACK = [*WALK, "track_no"]


def query(name: str, sql: str | None, *tables: str, key: str | None = "walk"):
    """Register a function of (spark, read) under a name; read(table) gives a domain table. key: what a row of the result belongs to, if anything."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: domain(spark, sf_dir, t))
        if sql:
            whole = (ctes(*tables) if tables else "") + sql
            ORACLES[name] = f"SELECT {PARTS[key]}, * EXCLUDE (slug) FROM ({whole})" if key else whole
        return f

    return keep


def _slugs(df):
    return df.select(*WALK, F.round(search.best(search.DISTANCE), 4).alias("km"))


def _filtered(name, where, **given):
    query(name, f"SELECT slug, round({KM}, 4) AS km FROM walks WHERE {where}", "walks")(lambda spark, read: _slugs(search.find_walks(read("walks"), limit=None, **given)))


_filtered("q1_distance_range", f"{KM} BETWEEN 5 AND 13", min_km=5.0, max_km=13.0)
_filtered("q2_max_ascent", "coalesce(computed_ascent_m, published_ascent_m) <= 150", max_ascent_m=150.0)
_filtered("q3_max_toughness", "toughness <= 4", max_toughness=4)
_filtered("q4_regions", "lower(region) IN ('building', 'machinery')", regions=("Building", "MACHINERY"))
_filtered("q5_termini", "list_has_any(string_split(crs_text, ','), ['VIC', 'BFR'])", london_crs_in=("vic", "BFR"))
_filtered("q6_travel_limit", "seeded_journey_minutes <= 75", max_travel_min=75)
_filtered("q7_source", "source = 'src_f_1'", source="src_f_1")
_TOKENS = "concat(' ', trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
_TEXT = " AND ".join("(" + " OR ".join(f"contains({_TOKENS.format(c)}, ' {w} ')" for c in ("title", "coalesce(summary, '')", "region", "tags_text")) + ")" for w in ("not specified", "walk", "river"))
_filtered("q8_keywords", _TEXT, text="not-specified WALK RIVÈR &")
query("q9_order_limit", f"SELECT slug, round({KM}, 4) AS km FROM walks ORDER BY {KM} NULLS FIRST, slug LIMIT 200", "walks")(lambda spark, read: _slugs(search.find_walks(read("walks"))))
query("q10_find_walks", f"SELECT slug, round({KM}, 4) AS km FROM walks WHERE {KM} <= 15 AND toughness <= 7 AND lower(region) IN ('building', 'household') AND list_has_any(string_split(crs_text, ','), ['VIC', 'STP', 'LBG']) ORDER BY {KM} NULLS FIRST, slug LIMIT 50", "walks")(
    lambda spark, read: _slugs(search.find_walks(read("walks"), max_km=15.0, max_toughness=7, regions=("building", "household"), london_crs_in=("VIC", "STP", "LBG"), limit=50))
)
query("q11_get_walk", "SELECT slug, title FROM walks WHERE split_part(slug, '/', 1) = 'walk-42' ORDER BY slug LIMIT 1", "walks")(lambda spark, read: search.get_walk(read("walks"), "walk-42").select(*WALK, "title"))
query("q11b_get_walk_of_source", "SELECT slug, title FROM walks WHERE slug IN ('walk-1/src_f_1', 'walk-1/src_o_1', 'walk-1/src_p_1')", "walks")(lambda spark, read: reduce(DataFrame.union, [search.get_walk(read("walks"), "walk-1", f"src_{x}_1").select(*WALK, "title") for x in "fop"]))
query("q12b_all_walks", "SELECT slug, title FROM walks ORDER BY slug", "walks")(lambda spark, read: search.all_walks(read("walks")).select(*WALK, "title"))
query("q12_count", "SELECT count(*) AS n_walks FROM walks", "walks", key=None)(lambda spark, read: read("walks").agg(F.count("*").alias("n_walks")))


@query(
    "q13_hydrate",
    """SELECT walks.slug, coalesce(v.n, 0) AS n_variations, coalesce(v.labels, '') AS labels, coalesce(f.n, 0) AS n_food, coalesce(f.names, '') AS names FROM walks
LEFT JOIN (SELECT slug, count(*) AS n, string_agg(concat(position, ':', label), ',' ORDER BY position) AS labels FROM variations GROUP BY slug) v ON v.slug = walks.slug
LEFT JOIN (SELECT slug, count(*) AS n, string_agg(name, ',' ORDER BY position) AS names FROM food_stops GROUP BY slug) f ON f.slug = walks.slug""",
    "walks", "variations", "food_stops",
)
def _(spark, read):
    made = search.hydrate(read("walks"), read("variations"), read("food_stops"))
    labels = F.array_join(F.transform("variations", lambda x: F.concat_ws(":", x["position"], x["label"])), ",")
    return made.select(*WALK, F.size("variations").cast("long").alias("n_variations"), labels.alias("labels"), F.size("food_stops").cast("long").alias("n_food"), F.array_join(F.transform("food_stops", lambda x: x["name"]), ",").alias("names"))


query("q14_with_options", "SELECT slug FROM walks WHERE slug IN (SELECT slug FROM variations)", "walks", "variations")(lambda spark, read: search.with_variations(read("walks"), read("variations")).select(*WALK))
_SHORTER = f"SELECT v.slug, count(*) AS n_options, coalesce(array_to_string(list_transform((list(v.distance_km ORDER BY v.position) FILTER (WHERE v.distance_km < {KM}))[1:3], lambda x: CAST(round(x, 2) AS VARCHAR)), ' '), '') AS shorter FROM variations v JOIN walks ON walks.slug = v.slug GROUP BY v.slug"
query("q15_shorter_options", _SHORTER, "walks", "variations")(
    lambda spark, read: search.shorter_options(read("walks"), read("variations")).select(*WALK, "n_options", F.array_join(F.transform("shorter", lambda x: F.round(x, 2).cast("string")), " ").alias("shorter"))
)
query(
    "q16_result_table",
    f""", o AS ({_SHORTER}), fs AS (SELECT slug, array_to_string((list(concat(name, CASE WHEN phone IS NOT NULL THEN '*' ELSE '' END) ORDER BY position))[1:2], ', ') AS food FROM food_stops GROUP BY slug)
SELECT walks.slug, round({KM}, 4) AS km, coalesce(nullif(computed_ascent_m, 0), nullif(published_ascent_m, 0), 0) AS ascent_m, coalesce(CAST(nullif(toughness, 0) AS VARCHAR), '?') AS toughness, seeded_journey_minutes AS mins,
substr(region, 1, 14) AS region, coalesce(n_options, 0) AS n_options, coalesce(shorter, '') AS shorter, coalesce(food, '') AS food FROM walks LEFT JOIN o ON o.slug = walks.slug LEFT JOIN fs ON fs.slug = walks.slug""",
    "walks", "variations", "food_stops",
)(lambda spark, read: search.result_table(read("walks"), read("variations"), read("food_stops")))

# travel
_EST = """, wc AS (SELECT slug, unnest(string_split(crs_text, ',')) AS crs, generate_subscripts(string_split(crs_text, ','), 1) AS pos FROM walks WHERE crs_text <> ''),
pick AS (SELECT slug, crs, access_min FROM (SELECT wc.slug, wc.crs, h.access_min, row_number() OVER (PARTITION BY wc.slug ORDER BY h.access_min IS NULL, coalesce(h.access_min, 0), wc.pos) AS r FROM wc JOIN home_termini h ON h.terminus_crs = wc.crs AND h.station_crs = 'HNH') WHERE r = 1),
est AS (SELECT walks.*, pick.crs IS NOT NULL AS preferred, coalesce(pick.crs, CASE WHEN crs_text <> '' THEN string_split(crs_text, ',')[1] END) AS terminus, pick.access_min AS access_min, CAST(pick.access_min + seeded_journey_minutes AS INT) AS total_min,
 CASE WHEN seeded_journey_minutes IS NULL THEN '?' WHEN pick.access_min IS NULL THEN concat('?+', seeded_journey_minutes) ELSE concat(pick.access_min, '+', seeded_journey_minutes, '=', pick.access_min + seeded_journey_minutes) END AS travel_text
 FROM walks LEFT JOIN pick ON pick.slug = walks.slug)
"""
_CROW = "round(2 * 6371.0 * asin(sqrt(pow(sin(radians(start_lat - 51.5074) / 2), 2) + cos(radians(51.5074)) * cos(radians(start_lat)) * pow(sin(radians(start_lon + 0.1276) / 2), 2))), 6)"
_RANK = f"CASE WHEN preferred THEN 0 ELSE 1 END, coalesce(total_min, 10000), coalesce(nullif({_CROW}, 0), 10000), {KM} NULLS FIRST, slug"
_est = lambda spark, read: travel.estimates(read("walks"), home_termini(spark), "HNH")
query("a1_access_estimate", _EST + "SELECT slug, terminus, access_min, preferred FROM est", "walks", "home_termini")(lambda spark, read: _est(spark, read).select(*WALK, "terminus", "access_min", "preferred"))
query("a2_total_text", _EST + "SELECT slug, total_min, travel_text FROM est", "walks", "home_termini")(lambda spark, read: _est(spark, read).select(*WALK, "total_min", "travel_text"))
query("a3_budget", _EST + "SELECT slug, total_min FROM est WHERE total_min IS NULL OR total_min <= 75", "walks", "home_termini")(lambda spark, read: travel.within_budget(_est(spark, read), 75).select(*WALK, "total_min"))
query("a4_only_preferred", _EST + "SELECT slug, terminus FROM est WHERE preferred", "walks", "home_termini")(lambda spark, read: _est(spark, read).filter("preferred").select(*WALK, "terminus"))
query("a5_rank", _EST + f"SELECT slug, total_min, preferred FROM est ORDER BY {_RANK} LIMIT 100", "walks", "home_termini")(lambda spark, read: _est(spark, read).orderBy(*travel.rank_order()).limit(100).select(*WALK, "total_min", "preferred"))
query("a6_estimates_for", _EST.replace("'HNH'", "'BRX'") + "SELECT slug, terminus, total_min FROM est", "walks", "home_termini")(lambda spark, read: travel.estimates(read("walks"), home_termini(spark), "brx").select(*WALK, "terminus", "total_min"))
query(
    "a7_find_from",
    _EST + f"SELECT slug, round({KM}, 4) AS km, terminus, total_min, travel_text FROM (SELECT * FROM est WHERE {KM} <= 13 ORDER BY {KM} NULLS FIRST, slug LIMIT 600) WHERE slug IN (SELECT slug FROM variations) AND (total_min IS NULL OR total_min <= 90) ORDER BY {_RANK} LIMIT 20",
    "walks", "home_termini", "variations",
)(lambda spark, read: travel.find_from(read("walks"), read("variations"), home_termini(spark), "HNH", max_total_min=90, with_options=True, limit=20, max_km=13.0).select(*WALK, F.round(search.best(search.DISTANCE), 4).alias("km"), "terminus", "total_min", "travel_text"))
_PROFILE = [{"crs": s, "name": n, "termini": {t: m for c, _, t, m in HOME if c == s}} for s, n in (("HNH", "Herne Hill"), ("BRX", "Brixton"))]
query("s8_walks_by_home_terminus", ", wc AS (SELECT slug, unnest(string_split(crs_text, ',')) AS crs FROM walks) SELECT h.station_crs, h.terminus_crs, h.access_min, count(wc.slug) AS n_walks FROM home_termini h LEFT JOIN wc ON wc.crs = h.terminus_crs GROUP BY ALL", "walks", "home_termini", key=None)(
    lambda spark, read: F.broadcast(travel.profile_table(spark, _PROFILE)).join(read("walks").select(F.explode("london_departure_crs").alias("terminus_crs"), *WALK).groupBy("terminus_crs").agg(F.count("*").alias("n")), "terminus_crs", "left").select("station_crs", "terminus_crs", "access_min", F.coalesce("n", F.lit(0)).alias("n_walks"))
)
query("s9_walks_by_any_terminus", ", wc AS (SELECT slug, unnest(string_split(crs_text, ',')) AS crs FROM walks) SELECT crs AS terminus_crs, count(*) AS n_walks FROM wc WHERE crs IN (SELECT terminus_crs FROM home_termini) GROUP BY crs", "walks", "home_termini", key=None)(
    lambda spark, read: read("walks").select(F.explode("london_departure_crs").alias("terminus_crs")).join(F.broadcast(travel.termini_for(travel.profile_table(spark, _PROFILE))), "terminus_crs").groupBy("terminus_crs").agg(F.count("*").alias("n_walks"))
)
query("g20_crow_km", f"SELECT slug, {_CROW} AS crow_km FROM walks", "walks")(lambda spark, read: read("walks").select(*WALK, F.round(travel.crow_km(F.col("start_lat"), F.col("start_lon")), 6).alias("crow_km")))

# statistics and quality
_HAVE = {"gpx": "gpx_path", "elevation": "CASE WHEN has_elevation THEN 1 END", "start_crs": "start_crs", "directions": "directions", "computed_distance": "computed_distance_km", "computed_ascent": "computed_ascent_m", "seeded_journey": "seeded_journey_minutes", "start_point": "start_lat", "toughness": "toughness"}
query("r1_by_source", "SELECT source, count(*) AS n_walks FROM walks GROUP BY source", "walks", key=None)(lambda spark, read: read("walks").groupBy("source").agg(F.count("*").alias("n_walks")))
query("r2_coverage", "SELECT source, count(*) AS n_walks, " + ", ".join(f"count({c}) AS n_{n}, round(100.0 * count({c}) / count(*), 4) AS pct_{n}" for n, c in _HAVE.items()) + " FROM walks GROUP BY source", "walks", key=None)(lambda spark, read: quality.coverage(read("walks")))
query("r3_children_coverage", "SELECT (SELECT count(DISTINCT slug) FROM variations) AS with_variations, (SELECT count(DISTINCT slug) FROM variations WHERE distance_km IS NOT NULL) AS with_variation_distance, (SELECT count(DISTINCT slug) FROM food_stops) AS with_food, (SELECT count(DISTINCT slug) FROM food_stops WHERE phone IS NOT NULL) AS with_food_phone", "variations", "food_stops", key=None)(lambda spark, read: quality.children_coverage(read("variations"), read("food_stops")))
_SHARE = "abs(computed_distance_km - published_distance_km) / published_distance_km"
query("r4_mismatch", f"SELECT slug, published_distance_km, computed_distance_km, round({_SHARE}, 6) AS share FROM walks WHERE {_SHARE} > 0.10", "walks")(lambda spark, read: quality.mismatches(read("walks")))
query("r5_histogram", f"SELECT CAST(floor({KM} / 2) * 2 AS INT) AS bucket, count(*) AS n FROM walks WHERE {KM} IS NOT NULL GROUP BY 1", "walks", key=None)(lambda spark, read: quality.histogram(read("walks")))
query("r6_zero_filled", f", h AS (SELECT CAST(floor({KM}) AS INT) AS bucket, count(*) AS n FROM walks WHERE {KM} IS NOT NULL GROUP BY 1) SELECT CAST(u AS INT) AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS u FROM h) LEFT JOIN h ON bucket = u", "walks", key=None)(lambda spark, read: quality.histogram(read("walks"), 1, True))
_GROUP = "CASE " + " ".join(f"WHEN list_has_any(string_split(crs_text, ','), {s}) THEN '{n}'" for n, s in quality.GROUPS) + " ELSE 'other' END"
query("r7_station_group", f"SELECT slug, {_GROUP} AS station_group FROM walks", "walks")(lambda spark, read: read("walks").select(*WALK, quality.station_group().alias("station_group")))
# option sentences are rendered from the variations: a stated total, a saving, or a way back at some point
_SAID = """, sa AS (SELECT v.slug, position, CASE position % 3 WHEN 0 THEN concat('A route of ', printf('%.2f', distance_km), ' km by the lake') WHEN 1 THEN concat('Shorten the walk by ', printf('%.2f', distance_km), ' km') ELSE concat('At ', printf('%.2f', distance_km), ' km take the bus back') END AS sentence,
CASE WHEN position % 3 <> 1 THEN distance_km WHEN distance_km < published_distance_km THEN published_distance_km - distance_km END AS option_km, published_distance_km AS km FROM variations v JOIN walks ON walks.slug = v.slug WHERE distance_km IS NOT NULL AND published_distance_km IS NOT NULL),
dl AS (SELECT * FROM sa WHERE option_km IS NOT NULL)"""


def _said(read):
    km = F.format_string("%.2f", "distance_km")
    sentence = F.when(F.col("position") % 3 == 0, F.concat(F.lit("A route of "), km, F.lit(" km by the lake"))).when(F.col("position") % 3 == 1, F.concat(F.lit("Shorten the walk by "), km, F.lit(" km"))).otherwise(F.concat(F.lit("At "), km, F.lit(" km take the bus back")))
    made = read("variations").select(*WALK, F.col("position").alias("sentence_no"), F.when(F.col("distance_km").isNull(), "A detour to the inn").otherwise(sentence).alias("sentence"))
    return quality.derived_lengths(read("walks"), made)


query("r8b_derived_lengths", _SAID + " SELECT slug, position AS sentence_no, round(option_km, 4) AS option_km FROM dl", "walks", "variations")(lambda spark, read: _said(read).select(*WALK, "sentence_no", F.round("option_km", 4).alias("option_km")))
query(
    "r8_feasibility",
    _SAID + f""", g(station_group) AS (VALUES {', '.join(f'({n!r})' for n in [*[x for x, _ in quality.GROUPS], 'other'])}), f AS (SELECT {_GROUP} AS station_group, published_distance_km <= 13 AS short, k % 6 IN (1, 2) AS sniff, slug IN (SELECT slug FROM dl WHERE option_km BETWEEN 3 AND 13) AS opt FROM walks WHERE published_distance_km IS NOT NULL)
SELECT g.station_group, count(short) AS n_walks, count(*) FILTER (WHERE short) AS n_short, count(*) FILTER (WHERE NOT short AND sniff) AS n_sniff, count(*) FILTER (WHERE NOT short AND opt) AS n_shortenable, count(*) FILTER (WHERE short OR opt) AS n_feasible FROM g LEFT JOIN f ON f.station_group = g.station_group GROUP BY g.station_group""",
    "walks", "variations", key=None)(lambda spark, read: quality.feasibility(read("walks"), _said(read)))
query("r9_best_option", _SAID + " SELECT slug, round(option_km, 4) AS option_km, position AS sentence_no, sentence FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY option_km, position) AS r FROM dl WHERE km > 13 AND option_km BETWEEN 3 AND 13) WHERE r = 1", "walks", "variations")(lambda spark, read: quality.best_options(read("walks"), _said(read)).withColumn("option_km", F.round("option_km", 4)))
query("r10_departures", "SELECT crs, count(*) AS n FROM (SELECT unnest(string_split(crs_text, ',')) AS crs FROM walks WHERE crs_text <> '') GROUP BY crs", "walks", key=None)(lambda spark, read: quality.departures(read("walks")))


@query(
    "r11_grounding",
    """, e AS (SELECT walks.slug, published_distance_km, crs_text, computed_distance_km, seeded_journey_minutes, start_crs, coalesce(v.n, 0) AS nv, coalesce(f.n, 0) AS nf, coalesce(f.phones, 0) AS np FROM walks
 LEFT JOIN (SELECT slug, count(*) AS n FROM variations GROUP BY slug) v ON v.slug = walks.slug LEFT JOIN (SELECT slug, count(*) FILTER (WHERE contains(lower(name), 'the')) AS n, count(phone) AS phones FROM food_stops GROUP BY slug) f ON f.slug = walks.slug)
SELECT slug, 'distance' AS check_name, coalesce(abs(computed_distance_km - published_distance_km) <= 0.1 * published_distance_km, false) AS passed FROM e WHERE published_distance_km IS NOT NULL
UNION ALL SELECT slug, 'terminus', list_has_any(string_split(crs_text, ','), ['VIC', 'WAT']) FROM e
UNION ALL SELECT slug, 'start', coalesce(start_crs = 'VIC', false) FROM e
UNION ALL SELECT slug, 'variations', nv >= 2 FROM e
UNION ALL SELECT slug, 'food', nf > 0 FROM e
UNION ALL SELECT slug, 'phone', np > 0 FROM e
UNION ALL SELECT slug, 'journey', coalesce(seeded_journey_minutes BETWEEN 30 AND 90, false) FROM e""",
    "walks", "variations", "food_stops",
)
def _(spark, read):
    walks = read("walks")
    expected = walks.select(*WALK, F.col("published_distance_km").alias("published_km"), F.lit(0.1).alias("tolerance"), F.array(F.lit("VIC"), F.lit("WAT")).alias("crs_any"), F.lit("VIC").alias("start_crs"), F.lit(2).alias("variations_min"), F.array(F.lit("THE")).alias("food_names"), F.lit(True).alias("need_phone"), F.lit(30).alias("journey_lo"), F.lit(90).alias("journey_hi"))
    return quality.grounding(expected, walks, read("variations"), read("food_stops"))


# store
@query("s6_upsert", "SELECT slug, CASE WHEN k % 3 = 0 THEN concat(title, ' b') ELSE title END AS title, k % 3 = 0 AS fresh FROM walks WHERE k % 2 = 0 OR k % 3 = 0", "walks")
def _(spark, read):
    w = read("walks").select("source", "slug", "title", "k")
    old = w.filter("k % 2 = 0").select("source", "slug", "title", F.lit(False).alias("fresh"))
    new = w.filter("k % 3 = 0").withColumn("v", F.explode(F.array(F.lit("a"), F.lit("b"))))
    new = new.select("source", "slug", F.concat("title", F.lit(" "), "v").alias("title"), F.lit(True).alias("fresh"), F.col("v").alias("version"))
    return store.upsert(old, new, WALK, "version").select(*WALK, "title", "fresh")


query("s6b_replace_children", "SELECT slug, position, CASE WHEN k % 3 = 0 THEN 'new' ELSE label END AS label FROM variations WHERE k % 3 <> 0 OR position = 0", "variations")(
    lambda spark, read: (lambda v: store.replace_children(v.select(*WALK, "position", "label"), v.filter("k % 3 = 0 AND position = 0").select(*WALK, "position", F.lit("new").alias("label")), v.filter("k % 3 = 0"), WALK))(read("variations"))
)


def _walk_store(spark, read):
    """A store after two loads: all walks, then some of one source with a new title and, for half of them, no children."""
    w, v, f = read("walks"), read("variations").drop("k"), read("food_stops").drop("k")
    out = walk_store.WalkStore(spark, scratch.fresh_path(spark, "walk-store"), buckets=32)
    out.upsert(w, v, f, 1)
    again = w.filter(_AGAIN)
    twice = again.withColumn("version", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("title", F.concat("title", F.lit(" River "), "version"))
    some = again.filter("k % 32 = 1").select(*WALK)
    out.upsert(twice, v.join(some, WALK, "left_semi"), f.join(some, WALK, "left_semi"), 2, order="version")
    return out


_AGAIN = "source = 'src_o_1' AND k % 16 = 1"
_TITLE = f"CASE WHEN {_AGAIN} THEN concat(title, ' River b') ELSE title END"
query("s6c_walk_store", f"SELECT slug, {_TITLE} AS title, CASE WHEN {_AGAIN} AND k % 32 <> 1 THEN 0 ELSE coalesce(v.n, 0) END AS n_variations, CASE WHEN {_AGAIN} AND k % 32 <> 1 THEN 0 ELSE coalesce(f.n, 0) END AS n_food, CAST(CASE WHEN {_AGAIN} THEN 2 ELSE 1 END AS BIGINT) AS load FROM walks LEFT JOIN (SELECT slug AS s, count(*) AS n FROM variations GROUP BY slug) v ON v.s = slug LEFT JOIN (SELECT slug AS s, count(*) AS n FROM food_stops GROUP BY slug) f ON f.s = slug", "walks", "variations", "food_stops")(
    lambda spark, read: _walk_store(spark, read).rows().select(*WALK, "title", F.size("variations").cast("long").alias("n_variations"), F.size("food_stops").cast("long").alias("n_food"), "load")
)
query("q8b_token_index", f"SELECT slug FROM (SELECT * REPLACE ({_TITLE} AS title) FROM walks) WHERE {_TEXT}", "walks")(lambda spark, read: _walk_store(spark, read).search("not-specified WALK RIVÈR &").select(*WALK))
query("s7_added_columns", "SELECT slug, region, CAST(NULL AS DOUBLE) AS finish_lat FROM walks", "walks")(lambda spark, read: store.with_columns_of(read("walks").select(*WALK, "region"), spark.range(0).select(F.lit("").alias("slug"), F.lit(0.0).alias("finish_lat")).schema))
_url = lambda: F.concat_ws("/", F.lit("https://walks.example"), "source", "slug").alias("url")
query("s10_to_fetch", "SELECT slug FROM walks WHERE k % 4 <> 1", "walks")(lambda spark, read: store.to_fetch(read("walks").select(*WALK, _url()), read("walks").filter("k % 4 = 1").select(_url())).select(*WALK))
_BROKEN = [("slug", "''", "identity"), ("source", "NULL", "source"), ("source_id", "''", "source_id"), ("title", "''", "title"), ("url", "NULL", "url"), ("published_distance_km", "0.0", "distance"), ("published_ascent_m", "-1.0", "ascent"), ("published_duration_min", "0", "duration"), ("toughness", "11", "toughness"), ("seeded_journey_minutes", "0", "journey"), ("computed_distance_km", "-2.5", "computed_distance"), ("computed_ascent_m", "-0.5", "computed_ascent")]
query("p9_validation", "SELECT k, CASE k % 14 " + " ".join(f"WHEN {i} THEN '{reason}'" for i, (_, _, reason) in enumerate(_BROKEN)) + " END AS reason FROM walks", "walks", key=None)(
    lambda spark, read: (lambda w: store.valid(w.withColumns({c: F.expr(f"CASE WHEN k % 14 = {i} THEN {bad} ELSE {c} END") for i, (c, bad, _) in enumerate(_BROKEN)})).select("k", "reason"))(read("walks").withColumns({"url": F.concat(F.lit("https://walks.example/"), "slug"), "published_duration_min": F.lit(90)}))
)
query("p9b_children_validation", "SELECT 'variations' AS child, slug, position, CASE position % 4 WHEN 1 THEN 'label' WHEN 2 THEN 'kind' WHEN 3 THEN 'distance' END AS reason FROM variations UNION ALL SELECT 'food_stops', slug, position, CASE position % 4 WHEN 1 THEN 'name' WHEN 2 THEN 'role' WHEN 3 THEN 'position' END FROM food_stops", "variations", "food_stops")(
    lambda spark, read: store.valid_variations(read("variations").withColumns({"label": F.expr("if(position % 4 = 1, null, label)"), "kind": F.expr("if(position % 4 = 2, 'stroll', kind)"), "distance_km": F.expr("if(position % 4 = 3, 0.0, distance_km)")})).select(F.lit("variations").alias("child"), *WALK, "position", "reason").union(
        store.valid_food(read("food_stops").withColumns({"name": F.expr("if(position % 4 = 1, null, name)"), "role": F.expr("if(position % 4 = 2, 'dinner', role)"), "position_km": F.expr("if(position % 4 = 3, -0.1, position_km)")})).select(F.lit("food_stops"), *WALK, "position", "reason"))
)

# geometry
_BNG = """
, x0 AS (SELECT *, radians(lat) AS f, radians(lon) AS l, 1 - pow(6356752.314140 / 6378137.0, 2) AS w2, 1 - pow(6356256.909 / 6377563.396, 2) AS e2 FROM ins),
x1 AS (SELECT *, 6378137.0 / sqrt(1 - w2 * pow(sin(f), 2)) AS nu0 FROM x0),
x2 AS (SELECT *, nu0 * cos(f) * cos(l) AS x, nu0 * cos(f) * sin(l) AS y, (1 - w2) * nu0 * sin(f) AS z, 1 + 20.4894e-6 AS m, radians(-0.1502 / 3600) AS rx, radians(-0.2470 / 3600) AS ry, radians(-0.8421 / 3600) AS rz FROM x1),
x3 AS (SELECT *, -446.448 + m * x - rz * y + ry * z AS xs, 125.157 + rz * x + m * y - rx * z AS ys, -542.060 - ry * x + rx * y + m * z AS zs FROM x2),
l0 AS (SELECT *, sqrt(xs * xs + ys * ys) AS p, atan2(zs, sqrt(xs * xs + ys * ys) * (1 - e2)) AS a0 FROM x3),
l1 AS (SELECT *, atan2(zs + e2 * 6377563.396 / sqrt(1 - e2 * pow(sin(a0), 2)) * sin(a0), p) AS a1 FROM l0),
l2 AS (SELECT *, atan2(zs + e2 * 6377563.396 / sqrt(1 - e2 * pow(sin(a1), 2)) * sin(a1), p) AS a2 FROM l1),
l3 AS (SELECT *, atan2(zs + e2 * 6377563.396 / sqrt(1 - e2 * pow(sin(a2), 2)) * sin(a2), p) AS a3 FROM l2),
l4 AS (SELECT *, atan2(zs + e2 * 6377563.396 / sqrt(1 - e2 * pow(sin(a3), 2)) * sin(a3), p) AS fi, atan2(ys, xs) - radians(-2.0) AS d FROM l3),
t0 AS (SELECT *, 6377563.396 * 0.9996012717 / sqrt(1 - e2 * pow(sin(fi), 2)) AS nu, 6377563.396 * 0.9996012717 * (1 - e2) / pow(1 - e2 * pow(sin(fi), 2), 1.5) AS rho, sin(fi) AS s, cos(fi) AS c, tan(fi) AS t, fi - radians(49.0) AS dm, fi + radians(49.0) AS sm, (6377563.396 - 6356256.909) / (6377563.396 + 6356256.909) AS nn FROM l4),
t1 AS (SELECT *, nu / rho - 1 AS h2, 6356256.909 * 0.9996012717 * ((1 + nn + 1.25 * nn * nn + 1.25 * pow(nn, 3)) * dm - (3 * nn + 3 * nn * nn + 2.625 * pow(nn, 3)) * sin(dm) * cos(sm) + (1.875 * nn * nn + 1.875 * pow(nn, 3)) * sin(2 * dm) * cos(2 * sm) - 35.0 / 24 * pow(nn, 3) * sin(3 * dm) * cos(3 * sm)) AS arc FROM t0),
g AS (SELECT slug, seq, lon, lat, ele, 400000.0 + nu * c * d + nu / 6 * pow(c, 3) * (nu / rho - t * t) * pow(d, 3) + nu / 120 * pow(c, 5) * (5 - 18 * t * t + pow(t, 4) + 14 * h2 - 58 * t * t * h2) * pow(d, 5) AS e,
 arc - 100000.0 + nu / 2 * s * c * d * d + nu / 24 * s * pow(c, 3) * (5 - t * t + 9 * h2) * pow(d, 4) + nu / 720 * s * pow(c, 5) * (61 - 58 * t * t + pow(t, 4)) * pow(d, 6) AS n FROM t1),
st AS (SELECT *, coalesce(sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)), 0) AS step FROM g WINDOW w AS (PARTITION BY slug ORDER BY seq)),
cu AS (SELECT *, sum(step) OVER (PARTITION BY slug ORDER BY seq) AS cum FROM st),
sg AS (SELECT * FROM (SELECT *, lead(e) OVER w AS ex, lead(n) OVER w AS nx, lead(cum) OVER w AS cx, lead(lon) OVER w AS lonx, lead(lat) OVER w AS latx, lead(ele) OVER w AS elex FROM cu WINDOW w AS (PARTITION BY slug ORDER BY seq)) WHERE ex IS NOT NULL)
"""
_BNG = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\de])", r"\1e0", _BNG)  # doubles, not decimals
_INS = ", ins AS (SELECT * FROM points WHERE slug NOT IN (SELECT slug FROM points WHERE NOT (lon BETWEEN -9.0 AND 2.5 AND lat BETWEEN 49.5 AND 61.5)))"
_G = _INS + _BNG


def geo(name, sql, f, *tables):
    query(name, _G + sql, "points", *tables, key="track")(lambda spark, read: f(tracks.projected(read("points")), read))


query("g1_bounds", "SELECT slug, bool_and(lon BETWEEN -9.0 AND 2.5 AND lat BETWEEN 49.5 AND 61.5) AS in_gb FROM points GROUP BY slug", "points", key="track")(lambda spark, read: read("points").groupBy(*TRACK).agg(F.bool_and(bng.in_gb(F.col("lon"), F.col("lat"))).alias("in_gb")))
geo("g2_to_grid", "SELECT slug, seq, round(e, 3) AS e, round(n, 3) AS n FROM g", lambda p, read: p.select(*TRACK, "seq", F.round("e", 3).alias("e"), F.round("n", 3).alias("n")))
geo("g3_round_trip", "SELECT slug, seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM g", lambda p, read: p.withColumn("w", bng.to_wgs84("e", "n")).select(*TRACK, "seq", F.round("w.lon", 6).alias("lon"), F.round("w.lat", 6).alias("lat")))
geo("g4_length", "SELECT slug, round(sum(step) / 1000, 6) AS km FROM st GROUP BY slug HAVING count(*) >= 2", lambda p, read: tracks.describe(p).select(*TRACK, F.round("km", 6).alias("km")))
geo("g5_cumulative", "SELECT slug, seq, round(cum, 3) AS cum_m FROM cu", lambda p, read: tracks.cumulative(p).select(*TRACK, "seq", F.round("cum_m", 3).alias("cum_m")))
_NEAR = (
    _INS.replace("ins AS (SELECT *", "ins AS (SELECT slug, seq, lon, lat, ele").replace("ins AS (", "ins AS (SELECT concat('poi-', poi_id) AS slug, CAST(poi_id AS INT) AS seq, lon, lat, CAST(NULL AS DOUBLE) AS ele FROM pois WHERE lon BETWEEN -9.0 AND 2.5 AND lat BETWEEN 49.5 AND 61.5 UNION ALL ", 1)
    + _BNG
    + """, pg AS (SELECT seq AS poi_id, e AS pe, n AS pn FROM g WHERE slug LIKE 'poi-%'),
d0 AS (SELECT slug, seq, poi_id, cum, cx, e, n, ex, nx, pe, pn, CASE WHEN cx > cum THEN least(1.0, greatest(0.0, ((pe - e) * (ex - e) + (pn - n) * (nx - n)) / (pow(ex - e, 2) + pow(nx - n, 2)))) ELSE 0.0 END AS t FROM sg JOIN pg ON abs(pe - e) < 3000 AND abs(pn - n) < 3000),
d1 AS (SELECT slug, poi_id, seq, cum + t * (cx - cum) AS along, sqrt(pow(pe - e - t * (ex - e), 2) + pow(pn - n - t * (nx - n), 2)) AS dist FROM d0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY slug, poi_id ORDER BY dist, seq) AS r FROM d1),
tl AS (SELECT slug, max(cx) AS total FROM sg GROUP BY slug),
hits AS (SELECT d2.slug, CAST(poi_id AS BIGINT) AS poi_id, dist, along / total AS fr FROM d2 JOIN tl ON tl.slug = d2.slug WHERE r = 1 AND dist <= 250)
"""
)


def _corridor(name, sql, f):
    query(name, _NEAR + sql, "points", "pois", key="track")(lambda spark, read: f(corridor.corridor(tracks.projected(read("points")), read("pois"))))


# each place is measured against the track of its own number, however far away that is
_TO = _NEAR[: _NEAR.index("d0 AS")] + """d0 AS (SELECT slug, seq, poi_id, cum, cx, e, n, ex, nx, pe, pn, CASE WHEN cx > cum THEN least(1.0, greatest(0.0, ((pe - e) * (ex - e) + (pn - n) * (nx - n)) / (pow(ex - e, 2) + pow(nx - n, 2)))) ELSE 0.0 END AS t FROM sg JOIN (SELECT DISTINCT slug AS s, user_id FROM points) u ON s = slug JOIN pg ON poi_id = user_id),
""" + _NEAR[_NEAR.index("d1 AS") :].replace("WHERE r = 1 AND dist <= 250", "WHERE r = 1")


def _to_track(name, sql, f):
    query(name, _TO + sql, "points", "pois", key="track")(lambda spark, read: f(corridor.to_tracks(tracks.projected(read("points")), read("pois").selectExpr("*", *[x.replace("user_id", "poi_id") for x in USER_KEY]))))


_to_track("g6_distance_to_track", "SELECT slug, poi_id, round(dist, 3) AS distance_m FROM hits", lambda h: h.select(*TRACK, "poi_id", F.round("distance_m", 3).alias("distance_m")))
_to_track("g7_fraction_along", "SELECT slug, poi_id, round(fr, 6) AS fraction FROM hits", lambda h: h.select(*TRACK, "poi_id", F.round("fraction", 6).alias("fraction")))
_corridor("g8_corridor", "SELECT slug, poi_id, round(dist, 3) AS distance_m, round(fr, 6) AS fraction FROM hits", lambda h: h.select(*TRACK, "poi_id", F.round("distance_m", 3).alias("distance_m"), F.round("fraction", 6).alias("fraction")).orderBy(*TRACK, "fraction", "poi_id"))
geo("g9_bbox_grid", "SELECT slug, round(min(e) - 100, 3) AS e0, round(min(n) - 100, 3) AS n0, round(max(e) + 100, 3) AS e1, round(max(n) + 100, 3) AS n1 FROM g GROUP BY slug", lambda p, read: tracks.bbox(p, 100.0).withColumns({"a": bng.to_bng("min_lon", "min_lat"), "b": bng.to_bng("max_lon", "max_lat")}).select(*TRACK, F.round("a.e", 3).alias("e0"), F.round("a.n", 3).alias("n0"), F.round("b.e", 3).alias("e1"), F.round("b.n", 3).alias("n1")))
geo(
    "g10_samples",
    """, tot AS (SELECT slug, max(cx) AS len FROM sg GROUP BY slug),
sm AS (SELECT slug, k * 500.0 AS at_m FROM (SELECT slug, unnest(range(0, CAST(floor(len / 500.0) AS BIGINT) + 1)) AS k FROM tot) UNION ALL SELECT slug, len FROM tot WHERE len - floor(len / 500.0) * 500.0 > 25.0),
sj AS (SELECT sm.slug, at_m, sg.*, row_number() OVER (PARTITION BY sm.slug, at_m ORDER BY sg.seq) AS r FROM sm JOIN sg ON sg.slug = sm.slug AND at_m >= cum AND at_m <= cx)
SELECT slug, round(at_m, 3) AS at_m, round(e + CASE WHEN cx > cum THEN (at_m - cum) / (cx - cum) ELSE 0 END * (ex - e), 3) AS e, round(n + CASE WHEN cx > cum THEN (at_m - cum) / (cx - cum) ELSE 0 END * (nx - n), 3) AS n FROM sj WHERE r = 1""",
    lambda p, read: tracks.sample_along(p).select(*TRACK, *[F.round(c, 3).alias(c) for c in ("at_m", "e", "n")]),
)
geo(
    "g11_slice",
    """, tot AS (SELECT slug, max(cx) AS len FROM sg GROUP BY slug), so AS (SELECT sg.*, len * 0.25 AS lo, len * 0.75 AS hi FROM sg JOIN tot ON tot.slug = sg.slug),
pt AS (SELECT slug, lo AS at_m, lon + (lo - cum) / (cx - cum) * (lonx - lon) AS lon, lat + (lo - cum) / (cx - cum) * (latx - lat) AS lat, ele + (lo - cum) / (cx - cum) * (elex - ele) AS ele FROM so WHERE lo > cum AND lo <= cx
UNION ALL SELECT slug, cx, lonx, latx, elex FROM so WHERE cx > lo AND cx < hi
UNION ALL SELECT slug, hi, lon + (hi - cum) / (cx - cum) * (lonx - lon), lat + (hi - cum) / (cx - cum) * (latx - lat), ele + (hi - cum) / (cx - cum) * (elex - ele) FROM so WHERE hi > cum AND hi <= cx)
SELECT slug, round(at_m, 3) AS at_m, round(lon, 7) AS lon, round(lat, 7) AS lat, round(ele, 3) AS ele FROM pt""",
    lambda p, read: tracks.slice_track(p, 0.25, 0.75).select(*TRACK, F.round("at_m", 3).alias("at_m"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("ele", 3).alias("ele")),
)
query("g12_has_elevation", "SELECT slug, bool_and(ele IS NOT NULL) AS has_elevation FROM points GROUP BY slug", "points", key="track")(lambda spark, read: read("points").groupBy(*TRACK).agg(F.bool_and(F.col("ele").isNotNull()).alias("has_elevation")))
query("g13_moving_average", "SELECT slug, seq, round(avg(ele) OVER (PARTITION BY slug ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM points", "points", key="track")(lambda spark, read: tracks.moving_average(read("points"), 5).select(*TRACK, "seq", F.round("smoothed", 6).alias("smoothed")))
_ASC = ", sv AS (SELECT slug, seq, ele, avg(ele) OVER (PARTITION BY slug ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sv FROM g), rise AS (SELECT slug, greatest(0.0, sv - lag(sv) OVER (PARTITION BY slug ORDER BY seq)) AS up, ele FROM sv), asc_ AS (SELECT slug, CASE WHEN bool_and(ele IS NOT NULL) THEN coalesce(sum(up), 0.0) END AS ascent_m, bool_and(ele IS NOT NULL) AS has_elevation, count(*) AS point_count FROM rise GROUP BY slug HAVING count(*) >= 2)"
geo("g14_ascent", _ASC + " SELECT slug, round(ascent_m, 4) AS ascent_m FROM asc_", lambda p, read: tracks.describe(p).select(*TRACK, F.round("ascent_m", 4).alias("ascent_m")))
_DESC = _ASC + ", len AS (SELECT slug, sum(step) / 1000 AS km FROM st GROUP BY slug), dsc AS (SELECT asc_.slug, km, ascent_m, CAST(round_even((km * 12 + coalesce(ascent_m, 0) * 0.1) * 1.4 + 60, 0) AS INT) AS est_minutes, has_elevation, point_count FROM asc_ JOIN len ON len.slug = asc_.slug)"
geo("g17_duration", _DESC + " SELECT slug, est_minutes FROM dsc", lambda p, read: tracks.describe(p).select(*TRACK, "est_minutes"))
geo("g18_describe", _DESC + " SELECT slug, round(km, 6) AS km, round(ascent_m, 4) AS ascent_m, est_minutes, has_elevation, point_count FROM dsc", lambda p, read: tracks.describe(p).select(*TRACK, F.round("km", 6).alias("km"), F.round("ascent_m", 4).alias("ascent_m"), "est_minutes", "has_elevation", "point_count"))
query("g16_naismith", f"SELECT slug, round({KM} * 12 + coalesce(computed_ascent_m, 0) * 0.1, 6) AS minutes FROM walks", "walks")(lambda spark, read: read("walks").select(*WALK, F.round(tracks.naismith_minutes(search.best(search.DISTANCE), F.col("computed_ascent_m")), 6).alias("minutes")))
query("g19_ends", "SELECT slug, arg_min(lon, seq) AS start_lon, arg_min(lat, seq) AS start_lat, arg_max(lon, seq) AS finish_lon, arg_max(lat, seq) AS finish_lat FROM points GROUP BY slug HAVING count(*) >= 2", "points", key="track")(lambda spark, read: tracks.describe(read("points").withColumns({"e": F.col("lon"), "n": F.col("lat")})).select(*TRACK, "start_lon", "start_lat", "finish_lon", "finish_lat"))
query("g15_missing_requests", "SELECT slug, lat_key, lon_key, CAST((row_number() OVER (PARTITION BY slug ORDER BY lat_key, lon_key) - 1) // 100 AS INT) AS batch FROM (SELECT DISTINCT slug, printf('%.6f', lat) AS lat_key, printf('%.6f', lon) AS lon_key FROM points WHERE ele IS NULL)", "points", key="track")(lambda spark, read: tracks.missing_requests(read("points")))
query("g15b_filled", "SELECT slug, seq, coalesce(ele, CASE WHEN seq % 2 = 0 THEN 7.5 END) AS ele FROM points", "points", key="track")(lambda spark, read: tracks.filled(read("points"), read("points").filter("ele IS NULL AND seq % 2 = 0").select(F.format_string("%.6f", "lat").alias("lat_key"), F.format_string("%.6f", "lon").alias("lon_key"), F.lit(7.5).alias("height"))).select(*TRACK, "seq", "ele"))

# GPX
_GPX = """SELECT slug, concat('<gpx version="1.1"><trk><name>', split_part(slug, '/', 1), '</name><trkseg>', string_agg(concat('<trkpt lat="', printf('%.7f', lat), '" lon="', printf('%.7f', lon), '">', CASE WHEN ele IS NOT NULL THEN concat('<ele>', printf('%.1f', ele), '</ele>') ELSE '' END, '</trkpt>'), '' ORDER BY seq), '</trkseg></trk></gpx>') AS gpx FROM points GROUP BY slug"""
query("s5_render_gpx", _GPX, "points", key="track")(lambda spark, read: gpx.render(read("points")))
query("s2_parse_gpx", "SELECT concat(split_part(slug, '/', 1), '/', split_part(slug, '/', 2), '/', dense_rank() OVER (PARTITION BY split_part(slug, '/', 1), split_part(slug, '/', 2) ORDER BY track_no) - 1) AS slug, split_part(slug, '/', 1) AS name, seq, round(lon, 7) AS lon, round(lat, 7) AS lat, ele FROM points", "points", key="track")(lambda spark, read: gpx.parse(gpx.render_walks(read("points"))).select(*TRACK, "name", "seq", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "ele"))
_PT = lambda tag: f"concat('<{tag} lat=\"', printf('%.7f', lat), '\" lon=\"', printf('%.7f', lon), '\">', CASE WHEN ele IS NOT NULL THEN concat('<ele>', printf('%.1f', ele), '</ele>') ELSE '' END, '</{tag}>')"


def rich_gpx(points):
    """(source, slug, doc, gpx): a waypoint, a main track of two segments, for some a second track, an empty one and a route; some documents are cut."""
    tagged = lambda tag: F.concat(F.lit(f'<{tag} lat="'), F.format_string("%.7f", "lat"), F.lit('" lon="'), F.format_string("%.7f", "lon"), F.lit('">'), F.when(F.col("ele").isNull(), "").otherwise(F.concat(F.lit("<ele>"), F.format_string("%.1f", "ele"), F.lit("</ele>"))), F.lit(f"</{tag}>"))
    made = points.groupBy(*WALK, F.col("track_no").alias("doc"), "user_id").agg(F.array_sort(F.collect_list(F.struct("seq", tagged("trkpt").alias("t"), tagged("rtept").alias("r")))).alias("p"))
    part = lambda lo, n, c: F.array_join(F.transform(F.slice("p", lo, n), lambda x: x[c]), "")
    half = (F.size("p") / 2).cast("int")
    main = F.concat(F.lit('<gpx version="1.1"><metadata><name>doc</name></metadata><wpt lat="1" lon="2"><name>w</name></wpt><trk><trkseg>'), part(F.lit(1), half, "t"), F.lit("</trkseg><trkseg>"), part(half + 1, F.size("p"), "t"), F.lit("</trkseg></trk>"))
    more = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("<trk><name>none</name></trk><trk><name> Second </name><trkseg>"), part(F.lit(1), F.lit(3), "t"), F.lit("</trkseg></trk>"))).otherwise("")
    route = F.when(F.col("user_id") % 3 < 2, F.concat(F.lit("<rte><name></name>"), part(F.lit(2), F.lit(2), "r"), F.lit("</rte><rte/>"))).otherwise("")
    whole = F.concat(main, more, route, F.lit("</gpx>"))
    return made.select(*WALK, "doc", F.when(F.col("user_id") % 11 == 10, F.substring(whole, 1, 200)).when(F.col("user_id") % 11 == 9, "").otherwise(whole).alias("gpx"))


_RICH = """, rp AS (SELECT slug, user_id, seq, count(*) OVER (PARTITION BY slug) AS n FROM points WHERE user_id % 11 < 9),
rr AS (SELECT slug, 0 AS track_no, 'doc' AS name, seq FROM rp UNION ALL SELECT slug, 1, 'Second', seq FROM rp WHERE user_id % 3 = 0 AND seq < 3 UNION ALL SELECT slug, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END, 'doc', seq - 1 FROM rp WHERE user_id % 3 < 2 AND seq BETWEEN 1 AND 2)"""
query("s2b_parse_rich_gpx", _RICH + " SELECT slug, CAST(track_no AS INT) AS track_no, name, CAST(seq AS INT) AS seq FROM rr", "points", key="doc")(lambda spark, read: gpx.parse(rich_gpx(read("points"))).select(*WALK, "doc", "track_no", "name", "seq"))
query("s3_routes", _RICH + " SELECT slug, count(DISTINCT track_no) AS n_routes, count(*) FILTER (WHERE track_no = 0) AS main_points FROM rr GROUP BY slug", "points", key="doc")(lambda spark, read: gpx.parse(rich_gpx(read("points"))).groupBy(*WALK, "doc").agg(F.countDistinct("track_no").alias("n_routes"), F.count_if(F.col("track_no") == 0).alias("main_points")))
query("s5b_render_named", _GPX.replace("1), '</name>", "1), ' &amp; back</name>"), "points", key="track")(lambda spark, read: gpx.render(read("points").withColumn("title", F.concat("slug", F.lit(" & back"))), name="title"))


@query("s4_gpx_folder", "SELECT slug, seq, round(lon, 7) AS lon, round(lat, 7) AS lat, ele FROM points", "points", key="track")
def _(spark, read):
    path = scratch.fresh_path(spark, "gpx-folder")
    gpx.write_files(gpx.render(read("points")), path)
    points = gpx.parse(gpx.read_files(spark, path)).drop("track_no")
    of = lambda c: F.regexp_extract("source_path", f"{c}=([^/]+)/", 1)
    return points.select(of("source").alias("source"), of("slug").alias("slug"), of("track_no").cast("int").alias("track_no"), "seq", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), "ele")
