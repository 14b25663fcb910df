"""The written store: what a load rewrites, what it leaves, and searches that read only their tokens' buckets."""

import os

import pytest
from pyspark.sql import functions as F

from walkspark.operators import search
from walkspark.sources.walk_store import WalkStore

WALK = "source string, slug string, title string, summary string, region string, tags array<string>"
VARIATION = "source string, slug string, position int, label string"
FOOD = "source string, slug string, position int, name string, phone string"


def _walks(spark, n=200):
    words = ["river", "hill", "walk", "café", "king's road", "blue", "bluebells"]
    rows = [(f"s{i % 2}", f"w{i // 2}", f"{words[i % 7].title()} {words[i % 5]} {i}", None if i % 4 == 0 else f"a {words[i % 3]} {words[i % 6]}", "Kent", [words[i % 4], "easy"]) for i in range(n)]
    return spark.createDataFrame(rows, WALK)


def _children(spark, n=200):
    v = spark.createDataFrame([(f"s{i % 2}", f"w{i // 2}", k, f"v{i}-{k}") for i in range(n) for k in range(i % 3)], VARIATION)
    return v, spark.createDataFrame([(f"s{i % 2}", f"w{i // 2}", 0, f"inn {i}", None) for i in range(0, n, 2)], FOOD)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = WalkStore(spark, str(tmp_path_factory.mktemp("store") / "walks"), buckets=16)
    assert len(out.upsert(_walks(spark), *_children(spark), 1)) == 16
    return out


def _files(store, table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{store.path}/{table}") for f in fs if f.endswith(".parquet")}


def test_a_load_rewrites_only_its_buckets(spark, store):
    before = _files(store, "walks")
    new = spark.createDataFrame([("s0", "w3", "New title", None, "Surrey", []), ("s0", "w3", "Newer title", None, "Surrey", []), ("s9", "w3", "Third source", "s", None, None)], WALK).withColumn("version", F.col("title") == "Newer title").withColumn("extra", F.lit(7))
    touched = store.upsert(new, spark.createDataFrame([("s9", "w3", 0, "only")], VARIATION), spark.createDataFrame([], FOOD), 2, order="version")
    after = _files(store, "walks")
    assert 1 <= len(touched) <= 2
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in set(before) ^ set(after)}
    assert changed == set(touched) and len(set(before) & set(after)) > 0
    rows = {(r["source"], r["slug"]): r for r in store.rows().collect()}
    assert len(rows) == 201 and rows["s0", "w3"]["title"] == "Newer title" and rows["s0", "w3"]["variations"] == [] and rows["s0", "w3"]["food_stops"] == []
    assert rows["s1", "w3"]["load"] == 1 and rows["s1", "w3"]["extra"] is None and rows["s9", "w3"]["extra"] == 7 and [v["label"] for v in rows["s9", "w3"]["variations"]] == ["only"]
    again = store.upsert(new, spark.createDataFrame([("s9", "w3", 0, "only")], VARIATION), spark.createDataFrame([], FOOD), 2, order="version")  # a load that is repeated
    assert again == touched and store.rows().count() == 201 and store.children("variations").filter("source = 's9'").count() == 1


@pytest.mark.parametrize("query", ["blue", "river hill", "king's", "WALK kings-road", "king's road café", "café & easy", "newer", "river river", "easy kent", "nothing"])
def test_search_equals_a_scan(spark, store, query):
    of = [F.col("title"), F.col("summary"), F.col("region"), F.array_join("tags", " ")]
    want = sorted((r["source"], r["slug"]) for r in store.walks().filter(search.matches(of, query)).collect())
    assert sorted((r["source"], r["slug"]) for r in store.search(query).collect()) == want


def test_search_reads_few_buckets(spark, store, tmp_path):
    found = store.postings()
    assert found.select("bucket").distinct().count() > 4
    plan = store.search("bluebells")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("load#", "x#") or "PartitionFilters: [" in plan and "bucket#" in plan
    with pytest.raises(ValueError):
        store.search("& -")
    smaller = store.compact(str(tmp_path / "compact"))
    assert smaller.postings().count() < found.count() and smaller.search("blue").count() == store.search("blue").count()
