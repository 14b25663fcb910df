"""Filters, ordering, point look-ups and result tables over the walk catalogue."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.functions.keys import key_of

DISTANCE = ("computed_distance_km", "published_distance_km")
ASCENT = ("computed_ascent_m", "published_ascent_m")


def best(columns: Sequence[str]) -> Column:
    """The computed figure where there is one, else the published; 0 counts as a figure."""
    return F.coalesce(*columns)


def distance_between(walks: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        walks = walks.filter(best(DISTANCE) >= low)
    return walks if high is None else walks.filter(best(DISTANCE) <= high)


def in_regions(walks: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Case-blind; no regions, no filter."""
    return walks.filter(F.lower("region").isin([r.lower() for r in regions])) if regions else walks


def from_termini(walks: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Walks that start from any of the termini; no codes, no filter."""
    return walks.filter(F.arrays_overlap("london_departure_crs", F.array(*[F.lit(c.upper()) for c in codes]))) if codes else walks


def _unaccented() -> dict[str, str]:
    """Every lower-case letter up to U+1FFF that decomposes to one letter and accents, with that letter."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    return {c: d[0] for c, d in parts.items() if c == c.lower() and len(d) > 1 and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))}


ACCENTS = _unaccented()
#: Fixed value: the accents that may stand apart from their letter.
MARKS = r"[\u0300-\u036f]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without accents."""
    plain = F.regexp_replace(F.translate(F.lower(text), "".join(ACCENTS), "".join(ACCENTS.values())), MARKS, "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(query: str) -> list[list[str]]:
    """The tokens of each word of a query. A word without letters and digits is ignored beside others; a query with nothing else raises ValueError."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.replace('"', " ").lower()) if not unicodedata.combining(c))
    found = [p for p in (re.findall(r"[^\W_]+", w) for w in plain.split()) if p]
    if not found:
        raise ValueError("no word to search for")
    return found


def matches(columns: Sequence[Column], query: str) -> Column:
    """Every word of the query is a phrase of adjacent tokens in one of the columns; words of one query may be found in different columns."""
    padded = [F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" ")) for c in columns]
    found = [reduce(or_, [F.contains(c, F.lit(f" {' '.join(p)} ")) for c in padded]) for p in phrases(query)]
    return reduce(and_, found)


def find_walks(walks, min_km=None, max_km=None, max_ascent_m=None, max_toughness=None, regions=(), london_crs_in=(), max_travel_min=None, source=None, text="", limit=200):
    """All filters that are given, nearest length first (unknown lengths lead), then slug and source."""
    walks = from_termini(in_regions(distance_between(walks, min_km, max_km), regions), london_crs_in)
    if max_ascent_m is not None:
        walks = walks.filter(best(ASCENT) <= max_ascent_m)
    if max_toughness is not None:
        walks = walks.filter(F.col("toughness") <= max_toughness)
    if max_travel_min is not None:
        walks = walks.filter(F.col("seeded_journey_minutes") <= max_travel_min)  # unknown times fail
    if source is not None:
        walks = walks.filter(F.col("source") == source)
    if text:
        walks = walks.filter(matches([F.col("title"), F.col("summary"), F.col("region"), F.array_join("tags", " ")], text))
    walks = walks.orderBy(best(DISTANCE).asc_nulls_first(), "slug", *[c for c in ("source",) if c in walks.columns])
    return walks if limit is None else walks.limit(limit)


def get_walk(walks: DataFrame, slug: str, source: str | None = None) -> DataFrame:
    """The walk of that slug (and source), or no row; of several sources the first by name."""
    found = walks.filter(F.col("slug") == slug)
    return (found if source is None else found.filter(F.col("source") == source)).orderBy("source").limit(1)


def all_walks(walks: DataFrame) -> DataFrame:
    """All walks by slug: a range exchange and a sort of each part, no single task."""
    return walks.orderBy("slug", "source")


def with_variations(walks: DataFrame, variations: DataFrame) -> DataFrame:
    key = key_of(walks, variations)
    return walks.join(variations.select(*key).distinct(), key, "left_semi")


def hydrate(walks: DataFrame, variations: DataFrame, food_stops: DataFrame) -> DataFrame:
    """Children nested in order of position; empty arrays where a walk has none. Each child table is
    grouped before it is joined, so rows never multiply."""

    def nested(children: DataFrame, name: str) -> DataFrame:
        rest = [c for c in children.columns if c not in ("source", "slug", "position")]
        return children.groupBy(*key_of(walks, children)).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias(name))

    out = walks.join(nested(variations, "variations"), key_of(walks, variations), "left").join(nested(food_stops, "food_stops"), key_of(walks, food_stops), "left")
    return out.withColumns({n: F.coalesce(n, F.array()) for n in ("variations", "food_stops")})


def shorter_options(walks: DataFrame, variations: DataFrame, first: int = 3) -> DataFrame:
    """(source, slug, n_options, shorter): number of variations and the first lengths below the walk's own."""
    key = key_of(walks, variations)
    children = variations.join(walks.select(*key, best(DISTANCE).alias("km")), key)
    less = F.when(F.col("distance_km") < F.col("km"), F.struct("position", "distance_km"))
    made = children.groupBy(*key).agg(F.count("*").alias("n_options"), F.array_sort(F.collect_list(less)).alias("s"))
    return made.select(*key, "n_options", F.transform(F.slice("s", 1, first), lambda x: x["distance_km"]).alias("shorter"))


def result_table(walks: DataFrame, variations: DataFrame, food_stops: DataFrame) -> DataFrame:
    """Display columns: length, ascent (unknown or 0: the published, else 0), toughness, region cut at 14,
    options and the first two food stops, a phone marked with *."""
    names = F.transform(F.slice("f", 1, 2), lambda x: F.concat(x["name"], F.when(x["phone"].isNotNull(), "*").otherwise("")))
    key = key_of(walks, food_stops)
    food = food_stops.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "name", "phone"))).alias("f")).select(*key, F.array_join(names, ", ").alias("food"))
    made = walks.join(shorter_options(walks, variations), key_of(walks, variations), "left").join(food, key, "left")
    ascent = F.coalesce(F.nullif("computed_ascent_m", F.lit(0.0)), F.nullif("published_ascent_m", F.lit(0.0)), F.lit(0.0))
    tough = F.coalesce(F.nullif(F.col("toughness"), F.lit(0)).cast("string"), F.lit("?"))
    return made.select(*key_of(walks), F.round(best(DISTANCE), 4).alias("km"), ascent.alias("ascent_m"), tough.alias("toughness"), F.col("seeded_journey_minutes").alias("mins"), F.substring("region", 1, 14).alias("region"), F.coalesce("n_options", F.lit(0)).alias("n_options"), F.coalesce(F.array_join(F.transform("shorter", lambda x: F.round(x, 2).cast("string")), " "), F.lit("")).alias("shorter"), F.coalesce("food", F.lit("")).alias("food"))
