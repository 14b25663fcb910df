"""What an ingest reads again, and what its steps leave on disk."""

import glob

from walkspark.jobs import ingest, page_queries
from walkspark.sources import scratch, tables

SF = "/root/testdata/sf0.001"


def test_index_pages_and_gpx_are_parsed_into_tables_once(spark):
    new = page_queries._ingested(spark, lambda t: tables.domain(spark, SF, t))
    for df in (new.walks, new.variations, new.food_stops):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "index_rows" not in plan and "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower()


def test_steps_are_stored_from_tables(spark, monkeypatch):
    plans, kept = {}, scratch.stored

    def stored(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString().lower()
        return kept(df, label)

    monkeypatch.setattr(ingest, "stored", stored)
    page_queries._ingested(spark, lambda t: tables.domain(spark, SF, t))
    assert [k for k, p in plans.items() if "index_rows" in p] == ["ingest-refs"]
    assert [k for k, p in plans.items() if "from_xml" in p or "xmltostructs" in p] == ["ingest-points"]


def test_stored_tables_leave_no_shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    count = lambda: len(glob.glob(f"{root}/*/shuffle_*.data"))
    df = spark.range(1000).repartition(3)
    before = count()
    scratch.stored(df, "test")
    assert count() <= before
