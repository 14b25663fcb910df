"""The keyed store as tables: upsert, child replacement, additive schema change, fetch plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """stored with the incoming rows in place of those of equal keys; of incoming rows with one key the last by `order` counts."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    fresh = incoming.withColumn("_r", last).filter("_r = 1").drop("_r", order)
    kept = stored.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_children(stored: DataFrame, incoming: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children of the upserted parents are replaced whole, also by none."""
    return stored.join(parents.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with every declared column that it lacks as null; nothing is dropped or retyped."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def to_fetch(refs: DataFrame, raw: DataFrame, force_refresh: bool = False) -> DataFrame:
    """Refs whose page isn't stored yet; all of them on a forced refresh."""
    return refs if force_refresh else refs.join(raw.select("url"), "url", "left_anti")


KINDS = ("shortcut", "extension", "alt_ending", "alt_start", "pub_detour", "other")


def _reasons(df: DataFrame, rules: dict[str, tuple[str, object]]) -> DataFrame:
    """df with `reason`: the first rule that a row breaks, null for good rows. Rules on columns that df lacks don't count."""
    bad = [F.when(F.coalesce(broken(F.col(column)), F.lit(False)), name) for name, (column, broken) in rules.items() if column in df.columns]
    return df.withColumn("reason", F.coalesce(*bad, F.lit(None).cast("string")))


_missing, _not_above, _below = lambda c: c.isNull() | (c == ""), lambda c: c <= 0, lambda c: c < 0


def valid(walks: DataFrame) -> DataFrame:
    """walks with `reason` by the bounds of a walk: what must be there, what must be above 0, and what mustn't be below."""
    rules = {
        "identity": ("slug", _missing), "source": ("source", _missing), "source_id": ("source_id", _missing), "title": ("title", _missing), "url": ("url", _missing),
        "distance": ("published_distance_km", _not_above), "ascent": ("published_ascent_m", _below), "duration": ("published_duration_min", _not_above), "toughness": ("toughness", lambda c: ~c.between(0, 10)),
        "journey": ("seeded_journey_minutes", _not_above), "computed_distance": ("computed_distance_km", _not_above), "computed_ascent": ("computed_ascent_m", _below),
    }
    return _reasons(walks, rules)


def valid_variations(variations: DataFrame) -> DataFrame:
    return _reasons(variations, {"label": ("label", F.isnull), "kind": ("kind", lambda c: c.isNull() | ~c.isin(*KINDS)), "distance": ("distance_km", _not_above)})


def valid_food(food_stops: DataFrame) -> DataFrame:
    return _reasons(food_stops, {"name": ("name", F.isnull), "role": ("role", lambda c: c.isNull() | ~c.isin("lunch", "tea")), "position": ("position_km", _below)})


def set_apart(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reason)."""
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")
