"""The catalogue as written tables: walks with their children in hash buckets, and an index of the tokens of their texts.

An upsert rewrites only the buckets that incoming walks fall in, by dynamic partition overwrite; a walk's children lie in its row,
so they are replaced with it. Every row has the number of the load that wrote it. The index only grows: each load
adds the postings of its own walks, in buckets by token, and a posting counts while its load is the one of its walk's row; compact()
drops the others. A load that fails half-way is repeated whole: it rewrites the same buckets and postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.functions.keys import WALK
from walkspark.operators.search import phrases, tokens
from walkspark.operators.store import upsert, with_columns_of
from walkspark.sources.scratch import without_leftovers

CHILDREN = ("variations", "food_stops")
#: The texts that are searched, in order.
TEXTS = {"title": F.col, "summary": F.col, "region": F.col, "tags": lambda c: F.array_join(c, " ")}


def _bucket(n: int, *by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def postings(walks: DataFrame) -> DataFrame:
    """(token, source, slug, load, column, positions): where each token stands in the texts of each walk."""
    texts = [F.struct(F.lit(c).alias("column"), tokens(F.coalesce(of(c), F.lit(""))).alias("ts")) for c, of in TEXTS.items() if c in walks.columns]
    each = walks.select(*WALK, "load", F.explode(F.array(*texts)).alias("t")).select(*WALK, "load", "t.column", F.posexplode("t.ts").alias("position", "token"))
    return each.groupBy("token", *WALK, "load", "column").agg(F.array_sort(F.collect_list("position")).alias("positions"))  # a text is one row's


def phrase_matches(found: DataFrame, query: str) -> DataFrame:
    """(source, slug, load) of the walks in whose texts every word of the query stands, as a phrase of adjacent tokens of one column.

    found: postings of the query's tokens at least. A token's positions, moved back by its place in the phrase, are the starts
    that it allows; a start that all tokens of a phrase allow is a match."""
    wanted = phrases(query)
    asked = [(n, i, t) for n, p in enumerate(wanted) for i, t in enumerate(p)]
    places = F.create_map(*[x for t in {t for _, _, t in asked} for x in (F.lit(t), F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(i).alias("place")) for n, i, u in asked if u == t]))])
    starts = found.withColumn("p", F.explode(places[F.col("token")])).select(*WALK, "load", "column", "p.*", F.explode("positions").alias("at"))
    lengths = F.element_at(F.array(*[F.lit(len(p)) for p in wanted]), F.col("phrase") + 1)
    whole = starts.groupBy(*WALK, "load", "column", "phrase", (F.col("at") - F.col("place")).alias("start")).agg(F.countDistinct("place").alias("n")).filter(F.col("n") == lengths)
    return whole.groupBy(*WALK, "load").agg(F.countDistinct("phrase").alias("n")).filter(F.col("n") == len(wanted)).select(*WALK, "load")


class WalkStore:
    """A store in a folder that driver and executors share. buckets: of walks, and of tokens; they stay as the first load had them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _there(self, table: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        """Walks with `variations` and `food_stops` nested in order, `load` and `bucket`."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/walks")

    def walks(self) -> DataFrame:
        return self.rows().drop(*CHILDREN, "load", "bucket")

    def children(self, name: str) -> DataFrame:
        """A child table: (source, slug, position, ...)."""
        return self.rows().select(*WALK, F.explode(name).alias("c")).select(*WALK, "c.*")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tokens")

    def upsert(self, walks: DataFrame, variations: DataFrame, food_stops: DataFrame, load: int, order: str | None = None) -> list[int]:
        """Put walks in place of those of equal keys, with their children; the buckets that were rewritten. Of walks with one key the last by `order` counts.

        load: a number above those of earlier loads; a repeated one replaces what it wrote."""
        nested = walks.withColumn("_order", F.col(order) if order else F.lit(0))
        for name, children in zip(CHILDREN, (variations, food_stops)):
            rest = [c for c in children.columns if c not in WALK and c != "position"]
            one = children.groupBy(*WALK).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias(name))
            nested = nested.join(one, list(WALK), "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
        bucket = _bucket(self.buckets, *[F.col(c) for c in WALK])
        fresh = nested.withColumns({"load": F.lit(load).cast("long"), "bucket": bucket})
        with without_leftovers(self.spark):
            touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return []
        if self._there("walks"):
            old = self.rows().filter(F.col("bucket").isin(touched))
            shape = old.limit(0).unionByName(fresh.drop("_order").limit(0), allowMissingColumns=True).schema
            fresh = upsert(with_columns_of(old, shape), with_columns_of(fresh, shape), WALK, "_order")
        else:
            fresh = upsert(fresh.drop("_order").limit(0), fresh, WALK, "_order")
        self._write(fresh.repartition("bucket"), "walks", "bucket")
        mine = self.rows().filter(F.col("bucket").isin(touched) & (F.col("load") == load))
        made = postings(mine).withColumn("bucket", _bucket(self.buckets, F.col("token")))
        self._write(made.repartition("bucket"), "tokens", "load", "bucket")
        return touched

    def _write(self, df: DataFrame, table: str, *by: str) -> None:
        with without_leftovers(self.spark):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{table}")

    def search(self, query: str) -> DataFrame:
        """The walks that match a query, as search.matches() does; only the buckets of its tokens are read."""
        asked = sorted({t for p in phrases(query) for t in p})
        found = self.postings().filter(F.col("bucket").isin(*[_bucket(self.buckets, F.lit(t)) for t in asked]) & F.col("token").isin(asked))
        return self.rows().join(phrase_matches(found, query), [*WALK, "load"], "left_semi").drop(*CHILDREN, "load", "bucket")

    def compact(self, target: str) -> WalkStore:
        """A copy without postings of walks that were replaced; to be done when no load runs."""
        out = WalkStore(self.spark, target, self.buckets)
        out._write(self.rows(), "walks", "bucket")
        live = self.postings().join(self.rows().select(*WALK, "load"), [*WALK, "load"], "left_semi")
        out._write(live.repartition("bucket"), "tokens", "load", "bucket")
        return out
