"""Registered queries of the text and page parsers: pages and phrases are rendered from the given tables and
parsed back; the SQL states the facts that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.functions import text as tx
from walkspark.jobs.catalogue import _ASC, _BNG, ORACLES, QUERIES, WALK, query
from walkspark.jobs.ingest import ingest, report, report_lists, update
from walkspark.operators import pages
from walkspark.sources import gpx


def _cell(value, data=None):
    opening = F.lit("<td>") if data is None else F.concat(F.lit('<td data-text="'), data, F.lit('">'))
    return F.concat(opening, value, F.lit("</td>"))


def _text(column):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def index_pages(walks: DataFrame) -> DataFrame:
    """(source, p, page): index pages of up to 500 rows each, numbered; rows by k."""
    km = F.coalesce(F.format_string("%.2f", "published_distance_km"), F.lit("?"))
    cells = [
        _cell(F.concat(F.lit("<b>"), "region", F.lit("</b>"))), _cell(F.lit(""), F.concat(F.lit("1 "), F.array_join("tags", ", "))), _cell(F.lit(""), F.concat(F.lit("w"), F.col("k") % 90, F.lit("."), "k")),
        _cell(F.concat(F.lit('<a href="/walk/'), "slug", F.lit('/">'), "title", F.lit("</a>")), F.col("title")), _cell(F.when(F.col("published_distance_km").isNull(), "?").otherwise(km)), _cell(_text("toughness")),
        _cell(F.format_string("%.0f", "published_ascent_m"), F.lit("999")), _cell(F.concat(F.lit("Up &amp; down from&nbsp;"), "region")), _cell(F.lit(""), F.array_join("london_departure_crs", " ")),
    ]
    rows = walks.select("source", F.floor(F.col("k") / 500).alias("p"), F.struct("k", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"])  # at most 500 rows
    return rows.groupBy("source", "p").agg(F.concat(F.lit("<table>"), F.array_join(ordered, "\n"), F.lit("</table>")).alias("page"))


def route_pages(walks: DataFrame, variations: DataFrame, food_stops: DataFrame) -> DataFrame:
    """(source, slug, page): a route page for each walk."""
    option = F.concat(F.lit("<li><b>"), "label", F.lit("</b>: "), F.when(F.col("distance_km").isNull(), F.lit("a detour to the pub by the river")).otherwise(F.concat(F.lit("a shorter walk of about "), F.format_string("%.1f", "distance_km"), F.lit(" km"))))
    opts = variations.groupBy(*WALK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", option.alias("t")))), lambda x: x["t"]), "\n").alias("opts"))
    stop = F.concat(F.lit("<p>After "), F.format_string("%.2f", "position_km"), F.lit(" km comes <b>"), "name", F.lit(" Inn</b> by the green"), F.when(F.col("phone").isNull(), "").otherwise(F.concat(F.lit(", tel. "), "phone")), F.lit("; open daily; well liked.</p>"))
    by_role = food_stops.select(*WALK, "role", "position", stop.alias("t")).groupBy(*WALK, "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "t"))), lambda x: x["t"]), "\n").alias("t"))
    lunch, tea = (by_role.filter(F.col("role") == r).select(*WALK, F.col("t").alias(r)) for r in ("lunch", "tea"))
    row = lambda label, body: F.when(body.isNull(), "").otherwise(F.concat(F.lit(f"<tr><th>{label}</th>\n<td>"), body, F.lit("</td></tr>\n")))
    km = F.when(F.col("published_distance_km").isNotNull(), F.concat(F.format_string("%.2f", "published_distance_km"), F.lit(" km (some miles), 3 hours "), F.col("k") % 60, F.lit(" minutes. <p>Short Walk, by the lake: 4.5 km, an hour and a half")))
    train = F.concat(F.lit('<a data-to="ABC" data-from="London">out</a> <a data-from="xyz" data-to="London">back</a> '), F.when(F.col("seeded_journey_minutes").isNull(), "Trains run hourly").otherwise(F.concat(F.lit("Journey time is about "), "seeded_journey_minutes", F.lit(" minutes."))))
    made = walks.join(opts, WALK, "left").join(lunch, WALK, "left").join(tea, WALK, "left")
    page = F.concat(
        F.lit("<h1>"), "title", F.lit(' Walk</h1><div data-walk_id="id-'), "k", F.lit('"></div><table>'), row("Length", km), row("Toughness", F.concat("toughness", F.lit(" out of 10"))), row("Features", F.concat(F.lit("<p>Fine views near "), "region", F.lit("<p>More"))),
        row("Walk Options", F.col("opts")), row("By Train", train), row("Lunch", F.col("lunch")), row("Tea", F.col("tea")), F.lit('</table><h2 id="walk-instructions">Walk Directions</h2><p>Leave the station.<p>Turn left &amp; go on.<h4>Donate</h4>'),
    )
    return made.select(*WALK, page.alias("page"))


def _pages(read):
    return route_pages(read("walks"), read("variations"), read("food_stops"))


_LISTING = "SELECT slug, concat('w', k % 90, '.', k) AS source_id, title, region, replace(tags_text, '-', ',') AS tags, round(published_distance_km, 2) AS km, toughness AS effort, published_ascent_m AS ascent_m, concat('Up & down from ', region) AS description, replace(crs_text, ',', ' ') AS crs FROM walks"
query("p1_listing", _LISTING, "walks")(lambda spark, read: pages.listing(index_pages(read("walks"))).select(*WALK, "source_id", "title", "region", F.array_join("tags", ",").alias("tags"), "km", "effort", "ascent_m", "description", F.array_join("london_departure_crs", " ").alias("crs")))
query("p2_summary_rows", "SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN published_distance_km IS NOT NULL THEN 'length' END, CASE WHEN toughness IS NOT NULL THEN 'toughness' END, 'features', 'by train', CASE WHEN slug IN (SELECT slug FROM variations) THEN 'walk options' END, CASE WHEN slug IN (SELECT slug FROM food_stops WHERE role = 'lunch') THEN 'lunch' END, CASE WHEN slug IN (SELECT slug FROM food_stops WHERE role = 'tea') THEN 'tea' END], lambda x: x IS NOT NULL)) AS label FROM walks) GROUP BY label", "walks", "variations", "food_stops", key=None)(lambda spark, read: pages.summary(_pages(read)).groupBy("label").agg(F.count("*").alias("n")))
query("p3_lengths", "SELECT slug, 0 AS position, true AS is_main, round(published_distance_km, 2) AS km, CAST(180 + k % 60 AS INT) AS minutes FROM walks WHERE published_distance_km IS NOT NULL UNION ALL SELECT slug, 1, false, 4.5, 90 FROM walks WHERE published_distance_km IS NOT NULL", "walks")(lambda spark, read: pages.lengths(pages.summary(_pages(read))).select(*WALK, "position", "is_main", "km", "minutes"))
query("p4_options", "SELECT v.slug, v.position, label, CASE WHEN distance_km IS NULL THEN 'pub_detour' ELSE 'shortcut' END AS kind, round(distance_km, 1) AS distance_km FROM variations v JOIN walks ON walks.slug = v.slug", "walks", "variations")(
    lambda spark, read: pages.options(pages.summary(_pages(read)), read("walks").select(*WALK, F.col("published_distance_km").alias("published_km"))).select(*WALK, F.col("item").alias("position"), "label", "kind", "distance_km")
)
_FOOD = ", ff AS (SELECT f.*, row_number() OVER (PARTITION BY f.slug, role, lower(name) ORDER BY position) AS r FROM food_stops f JOIN walks ON walks.slug = f.slug), fo AS (SELECT slug, CAST(row_number() OVER (PARTITION BY slug ORDER BY role, position) - 1 AS INT) AS position, role, concat(name, ' Inn') AS name, phone, 'open daily' AS hours_note, round(position_km, 2) AS position_km FROM ff WHERE r = 1) "
query("p5_food", _FOOD + "SELECT * FROM fo", "walks", "food_stops")(lambda spark, read: pages.food(pages.summary(_pages(read))).select(*WALK, "position", "role", "name", "phone", "hours_note", "position_km"))
query("p6_food_notes", "SELECT slug, string_agg(part, chr(10) || chr(10) ORDER BY role) AS food_notes FROM (SELECT f.slug, role, concat(CASE role WHEN 'lunch' THEN 'Lunch: ' ELSE 'Tea: ' END, string_agg(concat('After ', printf('%.2f', position_km), ' km comes ', name, ' Inn by the green', CASE WHEN phone IS NOT NULL THEN concat(', tel. ', phone) ELSE '' END, '; open daily; well liked.'), ' ' ORDER BY position)) AS part FROM food_stops f JOIN walks ON walks.slug = f.slug GROUP BY f.slug, role) GROUP BY slug", "walks", "food_stops")(
    lambda spark, read: pages.food_notes(pages.summary(_pages(read))).select(*WALK, "food_notes")
)
query("p7_directions", "SELECT slug, concat('Leave the station.', chr(10), 'Turn left & go on.') AS directions FROM walks", "walks")(lambda spark, read: _pages(read).select(*WALK, pages.directions(F.col("page")).alias("directions")))


@query(
    "p8_walk_page",
    """SELECT slug, concat('id-', k) AS source_id, title, concat('Fine views near ', region) AS summary, round(published_distance_km, 2) AS km, CASE WHEN published_distance_km IS NOT NULL THEN CAST(180 + k % 60 AS INT) END AS minutes, toughness,
'ABC' AS start_crs, 'XYZ' AS finish_crs, seeded_journey_minutes AS journey, CASE WHEN seeded_journey_minutes IS NOT NULL THEN split_part(slug, '/', 2) END AS journey_source FROM walks""",
    "walks",
)
def _(spark, read):
    walks = pages.parse_walks(pages.listing(index_pages(read("walks"))), _pages(read))[0]
    return walks.select(*WALK, "source_id", "title", "summary", F.col("published_distance_km").alias("km"), F.col("published_duration_min").alias("minutes"), "toughness", "start_crs", "finish_crs", F.col("seeded_journey_minutes").alias("journey"), F.col("seeded_journey_source").alias("journey_source"))


_VARIATIONS = """, vs AS (SELECT slug, 0 AS r, 0 AS p, 'Short Walk, by the lake' AS label, 'shortcut' AS kind, 4.5 AS distance_km, 'structured' AS provenance FROM walks WHERE published_distance_km IS NOT NULL
UNION ALL SELECT v.slug, 1, v.position, v.label, CASE WHEN v.distance_km IS NULL THEN 'pub_detour' ELSE 'shortcut' END, round(v.distance_km, 1), 'heuristic' FROM variations v JOIN walks ON walks.slug = v.slug),
va AS (SELECT slug, CAST(row_number() OVER (PARTITION BY slug ORDER BY r, p) - 1 AS INT) AS position, label, kind, distance_km, provenance FROM vs) """
_parsed = lambda read: pages.parse_walks(pages.listing(index_pages(read("walks"))), _pages(read))
query("p8b_page_variations", _VARIATIONS + "SELECT * FROM va", "walks", "variations")(lambda spark, read: _parsed(read)[1].drop("note"))
query("p8c_page_food", _FOOD + "SELECT * FROM fo", "walks", "food_stops")(lambda spark, read: _parsed(read)[2].select(*WALK, "position", "role", "name", "phone", "hours_note", "position_km"))

# ingest: tracks belong to the walks of the same number. Some pages are missing, some break a bound, some tracks are cut
# short, and some heights are known for points without one
_INGEST = (
    """, hk AS (SELECT DISTINCT printf('%.6f', lat) AS a, printf('%.6f', lon) AS b FROM points WHERE ele IS NULL AND user_id % 8 IN (0, 1)),
hp AS (SELECT * REPLACE (coalesce(ele, CASE WHEN concat(printf('%.6f', lat), ' ', printf('%.6f', lon)) IN (SELECT concat(a, ' ', b) FROM hk) THEN 7.5 END) AS ele), ele IS NULL AS gap FROM points),
ins AS (SELECT slug, seq, lon, lat, ele FROM hp WHERE slug NOT IN (SELECT slug FROM points WHERE NOT (lon BETWEEN -9.0 AND 2.5 AND lat BETWEEN 49.5 AND 61.5)))"""
    + _BNG
    + _ASC
    + """, ln AS (SELECT slug, sum(step) / 1000 AS km FROM st GROUP BY slug), gp AS (SELECT user_id, slug AS track, bool_or(gap) AS gaps, bool_or(ele IS NULL) AS short, bool_or(NOT (lon BETWEEN -9.0 AND 2.5 AND lat BETWEEN 49.5 AND 61.5)) AS abroad, count(*) AS np FROM hp GROUP BY user_id, slug),
i0 AS (SELECT w.slug, w.k, published_distance_km AS pub, CASE WHEN k % 13 = 0 THEN 'no page' WHEN k % 13 = 1 AND toughness IS NOT NULL THEN 'toughness' END AS bad, gp.track IS NOT NULL AS has_gpx, k % 5 <> 2 AND gaps AND NOT short AS filled,
CASE WHEN gp.track IS NULL THEN NULL WHEN k % 5 = 2 THEN 'no track points' WHEN gaps AND short THEN 'missing heights' WHEN abroad THEN 'outside Great Britain' WHEN np < 2 THEN 'fewer than two points' END AS bad_track, ln.km, ascent_m, asc_.has_elevation
FROM walks w LEFT JOIN gp ON gp.user_id = w.k LEFT JOIN ln ON ln.slug = gp.track LEFT JOIN asc_ ON asc_.slug = gp.track),
i1 AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'failed' WHEN NOT has_gpx THEN 'without_gpx' WHEN bad_track IS NOT NULL THEN 'geometry_failed' ELSE 'measured' END AS status, has_gpx AND bad_track IS NULL AS measured FROM i0),
ing AS (SELECT slug, k, status, round(pub, 2) AS pub, coalesce(bad, bad_track) AS error, CASE WHEN measured THEN km END AS km, CASE WHEN measured THEN ascent_m END AS ascent_m, CASE WHEN measured THEN has_elevation END AS has_elevation,
coalesce(filled, false) AND bad IS NULL AS backfilled, coalesce(CASE WHEN measured THEN abs(km - round(pub, 2)) / round(pub, 2) > 0.1 END, false) AND bad IS NULL AS mismatch FROM i1) """
)


def _ingested(spark, read, limit=None):
    """An ingest of rendered pages; the track of a walk is the one of the user of its number."""
    walks, points = read("walks"), read("points")
    whole = _pages(read).join(walks.select(*WALK, "k"), WALK).filter("k % 13 <> 0")
    raw = whole.select(*WALK, F.when(F.col("k") % 13 == 1, F.regexp_replace("page", r"\d+ out of 10", "11 out of 10")).otherwise(F.col("page")).alias("page"))
    of_walk = points.drop(*WALK, "track_no").join(walks.select(F.col("k").alias("user_id"), *WALK), "user_id")
    tracks_ = gpx.render(of_walk).join(walks.select(*WALK, "k"), WALK)
    tracks_ = tracks_.select(*WALK, F.when(F.col("k") % 5 == 2, F.substring("gpx", 1, 150)).otherwise(F.col("gpx")).alias("gpx"))
    heights = points.filter("ele IS NULL AND user_id % 8 IN (0, 1)").select(F.format_string("%.6f", "lat").alias("lat_key"), F.format_string("%.6f", "lon").alias("lon_key"), F.lit(7.5).alias("height"))
    return ingest(pages.listing(index_pages(walks), number="p"), raw, tracks_, heights=heights, limit=limit)


def _ingest_query(name, sql, f, *tables, key="walk"):
    query(name, _INGEST + sql, "walks", "points", *tables, key=key)(lambda spark, read: f(_ingested(spark, read), read))


_ingest_query("i1_ingest", "SELECT slug, status, round_even(km, 2) AS computed_km, CASE WHEN status NOT IN ('failed', 'without_gpx') THEN concat('gpx/', split_part(slug, '/', 2), '/', split_part(slug, '/', 1), '.gpx') END AS gpx_path FROM ing", lambda x, read: x.walks.select(*WALK, "status", F.col("computed_distance_km").alias("computed_km"), F.when(F.col("status") != "failed", F.col("gpx_path")).alias("gpx_path")))
_ingest_query("i1b_children", _VARIATIONS + ", " + _FOOD.strip()[1:] + " SELECT slug, position, label AS name, kind, 'variation' AS child FROM va WHERE slug IN (SELECT slug FROM ing WHERE status <> 'failed') UNION ALL SELECT slug, position, name, role, 'food' FROM fo WHERE slug IN (SELECT slug FROM ing WHERE status <> 'failed')", lambda x, read: x.variations.select(*WALK, "position", F.col("label").alias("name"), "kind", F.lit("variation").alias("child")).union(x.food_stops.select(*WALK, "position", "name", "role", F.lit("food"))), "variations", "food_stops")
query("i1c_limit", "SELECT slug, CASE WHEN k % 13 = 0 OR k % 13 = 1 AND toughness IS NOT NULL THEN 1 ELSE 0 END AS failed FROM walks ORDER BY floor(k / 500), row_number() OVER (PARTITION BY source, floor(k / 500) ORDER BY k), slug LIMIT 100", "walks")(lambda spark, read: _ingested(spark, read, limit=100).walks.select(*WALK, (F.col("status") == "failed").cast("int").alias("failed")))


def _updated(new, read):
    """A store of half of the walks, each with a child of its own, after the ingest."""
    old = read("walks").filter("k % 4 < 2").select(*WALK, F.lit("old").alias("title"))
    child = old.select(*WALK, F.lit(0).alias("position"), F.lit("old").alias("label"))
    walks, variations, _ = update((old, child, child.withColumnRenamed("label", "name")), new)
    n = variations.groupBy(*WALK).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "old").alias("n_old"))
    return walks.join(n, WALK, "left").select(*WALK, (F.col("title") == "old").alias("old"), F.coalesce("n", F.lit(0)).alias("n_variations"), F.coalesce("n_old", F.lit(0)).alias("n_old"))


_ingest_query("i1d_update", _VARIATIONS + ", vn AS (SELECT slug, count(*) AS n FROM va GROUP BY slug) SELECT ing.slug, status = 'failed' AS old, CASE WHEN status = 'failed' THEN 1 ELSE coalesce(n, 0) END AS n_variations, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS n_old FROM ing LEFT JOIN vn ON vn.slug = ing.slug WHERE status <> 'failed' OR k % 4 < 2", _updated, "variations")
_ingest_query("i2_failures", "SELECT status, coalesce(error, '') AS error, count(*) AS n FROM ing GROUP BY ALL", lambda x, read: x.walks.groupBy("status", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n")), key=None)
_ingest_query("i2b_errors", "SELECT slug, CASE status WHEN 'failed' THEN 'page' ELSE 'geometry' END AS stage, error FROM ing WHERE error IS NOT NULL AND status <> 'without_gpx'", lambda x, read: x.errors().select(*WALK, "stage", "error"))
_ingest_query("i3_geometry", "SELECT slug, round_even(km, 2) AS computed_km, CAST(round_even(ascent_m, 0) AS DOUBLE) AS ascent_m, has_elevation FROM ing WHERE km IS NOT NULL", lambda x, read: x.walks.filter("computed_distance_km is not null").select(*WALK, F.col("computed_distance_km").alias("computed_km"), F.col("computed_ascent_m").cast("double").alias("ascent_m"), "has_elevation"))
_ingest_query("i4_mismatch", "SELECT slug, mismatch FROM ing WHERE mismatch", lambda x, read: x.walks.filter("mismatch").select(*WALK, "mismatch"))
_ingest_query("i5_report", "SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'failed') AS ingested, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'without_gpx') AS without_gpx, count(*) FILTER (WHERE status = 'geometry_failed') AS geometry_failed, count(*) FILTER (WHERE status = 'measured') AS measured, count(*) FILTER (WHERE backfilled) AS backfilled, count(*) FILTER (WHERE mismatch) AS mismatches FROM ing", lambda x, read: report(x.walks), key=None)
_ingest_query("i5b_report_lists", "SELECT slug, status AS list, error, CAST(NULL AS DOUBLE) AS published_km, CAST(NULL AS DOUBLE) AS computed_km FROM (SELECT * REPLACE (CASE WHEN status <> 'without_gpx' THEN error END AS error) FROM ing) WHERE status <> 'measured' UNION ALL SELECT slug, 'backfilled', NULL, NULL, NULL FROM ing WHERE backfilled UNION ALL SELECT slug, 'mismatch', NULL, pub, round_even(km, 2) FROM ing WHERE mismatch", lambda x, read: report_lists(x))

# phrases
_N = "CAST(p_size AS INT) + 1"


def _phrases(name, texts, expected, kind, value, extra=None):
    """A bank of phrases, one a part: template by p_partkey, number by p_size."""

    def run(spark, sf_dir):
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size").cast("int") + 1).alias("n"))
        chosen = F.coalesce(*[F.when(F.col("p_partkey") % len(texts) == i, F.expr(t)) for i, t in enumerate(texts)])
        return part.withColumn("t", chosen).select("p_partkey", value(F.col("t")).alias("got"))

    QUERIES[name] = run
    cases = " ".join(f"WHEN {i} THEN CAST({e} AS {kind})" for i, e in enumerate(expected))
    ORACLES[name] = f"SELECT p_partkey, CASE p_partkey % {len(texts)} {cases} END AS got FROM (SELECT p_partkey, {_N} AS n FROM part)"


_q = lambda s: "'" + s.replace("'", "''").replace("{n}", "' || n || '").replace("{m}", "' || (n + 5) || '") + "'"
_phrases("t3_minutes", [_q(x) for x in ("about 2 hours {n} minutes", "an hour and a half", "just over an hour", "{n} to {m} mins", "half an hour", "Three hours", "two and a quarter hours", "no time", "{n}-{m} minutes by bus", "just under an hour away", "1 hr and {n} mins")], ["120 + n", "90", "65", "n + 5", "30", "180", "135", "NULL", "n + 5", "55", "60 + n"], "INT", tx.parse_minutes)
_phrases("t4_numbers", [_q(x) for x in ("{n}.75", "n/a", " {n} ", "")], ["n", "NULL", "n", "NULL"], "INT", tx.to_int)
_phrases("t5_first_km", [_q(x) for x in ("it is {n} km long, not {m} km", "{n}.5kms", "{n} kilometres", "{n} miles")], ["n", "n + 0.5", "n", "NULL"], "DOUBLE", tx.first_km)
_phrases("t6_kinds", [_q(x) for x in ("a detour to the Swan Inn", "finishing at the mill {n}", "start from the church", "a shorter way", "an extension of {n} km", "a stile")], ["'pub_detour'", "'alt_ending'", "'alt_start'", "'shortcut'", "'extension'", "'other'"], "VARCHAR", tx.variation_kind)
_phrases("t7_variation_km", [_q(x) for x in ("Short walk: {n}.5 km by the lake", "a circuit of about {n} km", "reduce the walk to {n} km", "this shortens the day by 3 km", "cut 4 km off", "At {n} km, take the train back", "At {n} km, admire the view", "shorten the walk by 900 km")], ["n + 0.5", "n", "n", "17", "16", "n", "NULL", "NULL"], "DOUBLE", lambda t: tx.variation_km(t, F.lit(20.0)))
_phrases("t8_journey", [_q(x) for x in ("Journey time is about {n} minutes.", "journey times of an hour and a half", "The journey time to Ham: {n} to {m} mins", "Trains take {n} minutes", "journey time 0 minutes")], ["n", "90", "n + 5", "NULL", "NULL"], "INT", tx.journey_minutes)
_phrases("t9_toughness", [_q(x) for x in ("7 out of 10", "3/10", "10 / 10", "hard")], ["7", "3", "10", "NULL"], "INT", tx.toughness)
_phrases("t10_stations", [_q(x) for x in ('<a data-to="abc" class="x" data-from="London">', '<a data-from="abc" data-to="London">')], ["'ABC'", "NULL"], "VARCHAR", lambda t: tx.station(t, True))
_phrases("t11_gpx_link", [_q(x) for x in ('<a href="auto/{n}.gpx"><a href="main{n}.gpx">', '<a href="/d/{n}.gpx">', '<a href="auto/{n}.gpx">', '<a href="https://o.example/{n}.gpx">', "none", '<a href="../x{n}.gpx">', '<a href="//host.example/x{n}.gpx">', '<a href="/auto/x.gpx"><a href="my-auto/{n}.gpx">', '<a href="./b/../c/{n}.gpx">', '<a href="../../../{n}.gpx">')], ["'https://w.example/walk/a/main' || n || '.gpx'", "'https://w.example/d/' || n || '.gpx'", "'https://w.example/walk/a/auto/' || n || '.gpx'", "'https://o.example/' || n || '.gpx'", "NULL", "'https://w.example/walk/x' || n || '.gpx'", "'https://host.example/x' || n || '.gpx'", "'https://w.example/walk/a/my-auto/' || n || '.gpx'", "'https://w.example/walk/a/c/' || n || '.gpx'", "'https://w.example/' || n || '.gpx'"], "VARCHAR", lambda t: tx.gpx_link(t, F.lit("https://w.example/walk/a/")))
_phrases("t12_option_words", [_q(x) for x in ("a Short walk", "flat and easy", "with an extension", "options abound", "an option of {n} km", "a variation", "the early train", "Returning via the mill", "return to the mill", "cut across the heath", "cutting across", "take the bus back", "train back home", "shortened by {n} km")], ["true", "false", "false", "false", "true", "true", "true", "true", "false", "true", "false", "true", "true", "false"], "BOOLEAN", tx.has_option_word)
_phrases("t14_all_lengths", [_q(x) for x in ("At {n} km take the bus, or a walk of 9 km", "a walk of {n} km or a route of {m} km", "shorten it by 3 km or cut 4 km off", "shorten by 900 km", "Shorter options: Ham to Eggton {n} km", "Longer walk: {n} km")], ["n || '.0'", "n || '.0,' || (n + 5) || '.0'", "'17.0,16.0'", "''", "n || '.0'", "''"], "VARCHAR", lambda t: F.array_join(F.transform(tx.all_lengths(t, F.lit(20.0)), lambda x: x.cast("string")), ","))
_phrases("t1_text_of", [_q(x) for x in ("<b>{n}¼</b> km &amp; more", "  a<br>b&nbsp;c ", "&lt;p&gt; ½ mile", "")], ["n || '.25 km & more'", "'a b c'", "'<p> 0.5 mile'", "''"], "VARCHAR", tx.text_of)
_phrases("t2_paragraphs", [_q(x) for x in ("<p>one {n}</p><p> </p><li>two", "a<br/>b", "")], ["'one ' || n || '|two'", "'a|b'", "''"], "VARCHAR", lambda t: F.array_join(tx.paragraphs_of(t), "|"))


@query("t13_option_sentences", "SELECT slug, 0 AS sentence_no, concat('The low road is ', k % 9 + 3, ' km;') AS sentence FROM walks UNION ALL SELECT slug, 1, 'A walk of 8.5 km by the lake' FROM walks UNION ALL SELECT slug, 2, concat(k % 20 + 5, ' km (some miles)') FROM walks WHERE k % 2 = 0", "walks")
def _(spark, read):
    length = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<th>length</th><td>"), F.col("k") % 20 + 5, F.lit(" km (some miles)</td></tr>"))).otherwise("<th>Length</th><td>9 km, never closed</tr>")
    row = F.concat(F.lit("<table><tr><th>Lunch</th><td>At 5 km</td></tr><tr><th> Walk Options\n</th><td>The low road is "), F.col("k") % 9 + 3, F.lit(" km; or stay. <li>A walk of <b>8.5 km</b> by the lake</td></tr><tr>"), length, F.lit("</table>"))
    return pages.option_sentences(read("walks").select(*WALK, row.alias("page")))


@query("s1_read_pages", "SELECT page_id, url, html FROM pages", key=None)
def _(spark, read):
    return read("pages").select("page_id", "url", "html")
