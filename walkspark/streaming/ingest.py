"""Incremental ingest: pages that arrive as Parquet files are parsed batch by batch into a store of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from walkspark.functions.keys import WALK
from walkspark.operators.pages import parse_pages, parse_walks
from walkspark.sources.scratch import stored

RAW = "source string, slug string, page string, fetched_at timestamp"
KEYS = list(WALK)
TABLES = ("walks", "variations", "food_stops")


def follow(spark: SparkSession, raw_path: str, refs: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Parse what lies in raw_path now and stop; a later call goes on from the checkpoint.

    Each batch writes only its own walks and children, in a folder named by the batch, so a batch that is repeated after
    a failure writes the same rows again. Of a walk's pages in one batch the last fetched counts, of equal ones the
    larger text. Pages without a ref go to `orphans`."""

    def apply(pages: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct("page", "fetched_at"), F.struct("fetched_at", "page")).alias("last")
        latest = stored(pages.groupBy(*KEYS).agg(last).select(*KEYS, "last.*"), "follow-pages")
        parts = stored(parse_pages(latest.join(refs.select(*KEYS), KEYS, "left_semi")), "follow-parts")
        walks, variations, food_stops = parse_walks(refs, latest, parts)
        for name, df in zip(TABLES, (walks, variations, food_stops)):
            df.write.mode("overwrite").parquet(f"{store_path}/{name}/batch={batch_id}")
        latest.join(refs.select(*KEYS), KEYS, "left_anti").write.mode("overwrite").parquet(f"{store_path}/orphans/batch={batch_id}")

    stream = spark.readStream.schema(RAW).parquet(raw_path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walks, variations, food stops): of each walk the rows of the last batch that had its page."""
    walks, variations, food_stops = (spark.read.option("mergeSchema", "true").parquet(f"{store_path}/{name}") for name in TABLES)
    newest = F.max("batch").over(Window.partitionBy(*KEYS))
    walks = walks.withColumn("_newest", newest).filter("batch = _newest").drop("_newest")
    keys = walks.select(*KEYS, "batch")
    of = lambda children: children.join(keys, [*KEYS, "batch"], "left_semi").drop("batch")
    return walks.drop("batch"), of(variations), of(food_stops)


def compact(spark: SparkSession, store_path: str, target: str) -> None:
    """Write the current rows as a store of one batch; do it now and then, when no batch runs."""
    for name, df in zip(TABLES, current(spark, store_path)):
        df.write.mode("overwrite").parquet(f"{target}/{name}/batch=0")
