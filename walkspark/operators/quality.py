"""Coverage statistics, histograms, mismatches, station groups and grounding checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.functions.keys import WALK, key_of
from walkspark.functions.text import all_lengths, has_option_word
from walkspark.operators.search import DISTANCE, best


def coverage(walks: DataFrame) -> DataFrame:
    """One row a source: walks, how many have each fact, and percentages; one pass."""
    have = {"gpx": "gpx_path", "computed_distance": "computed_distance_km", "computed_ascent": "computed_ascent_m", "seeded_journey": "seeded_journey_minutes", "start_crs": "start_crs", "start_point": "start_lat", "directions": "directions", "toughness": "toughness"}
    have = {n: F.col(c).isNotNull() for n, c in have.items()} | {"elevation": F.col("has_elevation")}
    counts = [F.count_if(c).alias(f"n_{n}") for n, c in have.items()]
    made = walks.groupBy("source").agg(F.count("*").alias("n_walks"), *counts)
    return made.select("*", *[F.round(100 * F.col(f"n_{n}") / F.col("n_walks"), 4).alias(f"pct_{n}") for n in have])


def children_coverage(variations: DataFrame, food_stops: DataFrame) -> DataFrame:
    """How many walks have any variation, one with a length, any food stop, one with a phone."""
    parents = lambda df, fact: df.groupBy(*key_of(df)).agg(F.bool_or(F.col(fact).isNotNull()).alias("fact"))
    v = parents(variations, "distance_km").agg(F.count("*").alias("with_variations"), F.count_if("fact").alias("with_variation_distance"))
    f = parents(food_stops, "phone").agg(F.count("*").alias("with_food"), F.count_if("fact").alias("with_food_phone"))
    return v.crossJoin(f)  # one row each


def mismatches(walks: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Published and computed lengths further apart than the tolerance, worst first."""
    share = F.abs(F.col("computed_distance_km") - F.col("published_distance_km")) / F.col("published_distance_km")
    return walks.filter(share > tolerance).select(*WALK, "published_distance_km", "computed_distance_km", F.round(share, 6).alias("share")).orderBy(F.desc("share"), "slug", "source")


def histogram(walks: DataFrame, width: int = 2, zero_filled: bool = False) -> DataFrame:
    """(bucket, n) of lengths; unknown ones don't count. zero_filled: every bucket between the ends."""
    bucket = (F.floor(best(DISTANCE) / width) * width).cast("int")
    made = walks.select(bucket.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    if not zero_filled:
        return made
    ends = made.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(width))).alias("bucket")).join(made, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


#: Groups of departure stations, in order of precedence.
GROUPS = [("Victoria", ["VIC"]), ("Blackfriars", ["BFR", "STP"]), ("London Bridge", ["LBG", "CHX", "CST", "WAE"]), ("East Croydon", ["ECR"]), ("Clapham Jn/Waterloo", ["CLJ", "WAT"])]


def station_group(codes: str = "london_departure_crs") -> Column:
    """The first group by precedence that has one of the walk's stations, else other."""
    return F.coalesce(*[F.when(F.arrays_overlap(codes, F.array(*[F.lit(s) for s in stations])), name) for name, stations in GROUPS], F.lit("other"))


def derived_lengths(walks: DataFrame, sentences: DataFrame) -> DataFrame:
    """(source, slug, sentence_no, n, option_km, sentence): every length that a walk's option sentences (source, slug, sentence_no, sentence) state or imply."""
    known = sentences.join(walks.filter("published_distance_km is not null").select(*WALK, "published_distance_km"), list(WALK))
    return known.select(*WALK, "sentence_no", F.posexplode(all_lengths(F.col("sentence"), F.col("published_distance_km"))).alias("n", "option_km"), "sentence")


def feasibility(walks: DataFrame, derived: DataFrame, max_km: float = 13.0, least_km: float = 3.0) -> DataFrame:
    """For each station group: walks of known published length, those short enough, longer ones whose summary speaks of
    options (the sniff), longer ones with a derived length in reach, and the short and shortenable ones together."""
    options = derived.filter(F.col("option_km").between(least_km, max_km)).select(*WALK).distinct().withColumn("shortenable", F.lit(True))
    short = F.col("published_distance_km") <= max_km
    rows = walks.filter("published_distance_km is not null").select(*WALK, station_group().alias("station_group"), short.alias("short"), F.coalesce(has_option_word(F.col("summary")), F.lit(False)).alias("sniff")).join(options, list(WALK), "left")
    longer = ~F.col("short") & F.coalesce("shortenable", F.lit(False))
    made = rows.groupBy("station_group").agg(F.count("*").alias("n_walks"), F.count_if("short").alias("n_short"), F.count_if(~F.col("short") & F.col("sniff")).alias("n_sniff"), F.count_if(longer).alias("n_shortenable"))
    every = walks.sparkSession.createDataFrame([(n,) for n in [*[g for g, _ in GROUPS], "other"]], "station_group string")
    out = every.join(made, "station_group", "left").fillna(0)
    return out.withColumn("n_feasible", F.col("n_short") + F.col("n_shortenable"))


def best_options(walks: DataFrame, derived: DataFrame, max_km: float = 13.0, least_km: float = 3.0) -> DataFrame:
    """The shortest plausible derived length of each walk that is too long, with its sentence; the first of equal ones."""
    long_ones = walks.filter(F.col("published_distance_km") > max_km).select(*WALK)
    plausible = derived.filter(F.col("option_km").between(least_km, max_km)).join(long_ones, list(WALK), "left_semi")
    made = plausible.groupBy(*WALK).agg(F.min(F.struct("option_km", "sentence_no", "n", "sentence")).alias("b"))
    return made.select(*WALK, F.col("b.option_km").alias("option_km"), F.col("b.sentence_no").alias("sentence_no"), F.col("b.sentence").alias("sentence"))


def departures(walks: DataFrame) -> DataFrame:
    """Walks by departure station, commonest first."""
    return walks.select(F.explode("london_departure_crs").alias("crs")).groupBy("crs").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "crs")


def grounding(expected: DataFrame, walks: DataFrame, variations: DataFrame, food_stops: DataFrame) -> DataFrame:
    """One row a walk and check: length within tolerance, a terminus, the start station, options, food, phone, journey time.

    Children are reduced to the expected walks before they are grouped."""
    key, keys = list(WALK), expected.select(*WALK)
    v = variations.join(keys, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n_variations"))
    f = food_stops.join(keys, key, "left_semi").groupBy(*key).agg(F.collect_set(F.lower("name")).alias("names"), F.count("phone").alias("n_phones"))
    expected = expected.withColumnRenamed("start_crs", "start_wanted")
    rows = expected.join(walks, key, "left").join(v, key, "left").join(f, key, "left")
    checks = {
        "distance": F.abs(F.col("computed_distance_km") - F.col("published_km")) <= F.col("tolerance") * F.col("published_km"),
        "terminus": F.arrays_overlap("crs_any", "london_departure_crs"),
        "start": F.col("start_crs") == F.col("start_wanted"),
        "variations": F.coalesce("n_variations", F.lit(0)) >= F.col("variations_min"),
        "food": F.forall("food_names", lambda x: F.exists(F.coalesce("names", F.array()), lambda y: F.contains(y, F.lower(x)))),
        "phone": ~F.col("need_phone") | (F.coalesce("n_phones", F.lit(0)) > 0),
        "journey": F.col("seeded_journey_minutes").between(F.col("journey_lo"), F.col("journey_hi")),
    }
    wanted = {"distance": "published_km", "terminus": "crs_any", "start": "start_wanted", "variations": "variations_min", "food": "food_names", "phone": "need_phone", "journey": "journey_lo"}
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(wanted[n]).isNotNull().alias("asked"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return rows.select(*key, F.explode(each).alias("e")).filter("e.asked").select(*key, F.col("e.check").alias("check_name"), F.col("e.passed").alias("passed"))
