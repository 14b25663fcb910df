"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With weight w, the j-th block of a source (from 0) is
released at slot floor(j / w) and due by slot ceil((j + 1) / w). Earliest-deadline-first gives each
slot to a released block, so that after every slot each source that still has rows is less than
one block from its share of slots. Shares are multiples of 1 / period, so the schedule repeats
after `period` slots and only that many are ever worked out on the driver. A share is less than 1 / period
from its target weight: less than one more block in each period. The period doubles until the
smallest weight has a whole slot, so it grows with the number of sources and never caps it.

When a source has no rows left its slots stay empty; every row of the input is in the mix once.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkspark.llm.common import unused

PERIOD = 4096
BLOCK_ROWS = 16
CELLS = 1024
BROADCAST = 1 << 16


def period_for(weights: Mapping[str, float], least: int = PERIOD) -> int:
    """least, doubled until every weight is worth a slot or more."""
    if any(not weights[s] > 0 for s in weights):
        raise ValueError("weights must be positive")
    period, whole = least, sum(weights.values())
    smallest = min(weights.values(), default=whole)
    while period * smallest < whole:
        period *= 2
    return period


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source, by largest remainder: period in all, less than one from the weight's
    part of the period. At least one each; only where a weight is worth less than a slot (see period_for),
    the sources with most slots give it."""
    names = sorted(weights)
    if len(names) > period:
        raise ValueError(f"{len(names)} sources don't fit a period of {period} slots")
    if any(not weights[s] > 0 for s in names):
        raise ValueError("weights must be positive")
    whole = sum(weights.values())
    exact = {s: period * weights[s] / whole for s in names}
    got = {s: max(1, int(exact[s])) for s in names}
    spare = period - sum(got.values())
    for s in sorted(names, key=lambda s: (got[s] - exact[s], s))[: max(0, spare)]:
        got[s] += 1
    most = [(-n, s) for s, n in got.items()] if spare < 0 else []
    heapq.heapify(most)
    for _ in range(-spare):
        n, s = most[0]
        got[s] -= 1
        heapq.heapreplace(most, (n + 1, s))
    return got


def schedule(slots: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block in the period, release, deadline, slot) by earliest deadline first."""
    period = sum(slots.values())
    todo = sorted((j * period // n, -(-(j + 1) * period // n), s, j) for s, n in slots.items() for j in range(n))
    ready: list = []
    out, k = [], 0
    for slot in range(period):
        while k < len(todo) and todo[k][0] <= slot:
            release, deadline, s, j = todo[k]
            heapq.heappush(ready, (deadline, s, j, release))
            k += 1
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline, slot))
    return out


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table of Arrow columns, which executors read without Python workers."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)}), schema)


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", period: int = PERIOD, block_rows: int = BLOCK_ROWS, alpha: float = 0.5, cells: int = CELLS) -> DataFrame:
    """df with `block`, `row_in_block`, `release`, `deadline` and `slot`; (slot, row_in_block) is the mix's order.

    weights: target weight by source; None: (rows of a source) ** alpha. A null source counts as
    the source ''. Sources without a weight raise ValueError. period: the least; it grows as period_for says.
    Inside a source, rows come in the order of a hash of their key, then of all columns, so a
    block isn't a run of neighbours. Repeated rows are in the mix as often as in df, in either order (they are equal); null, empty and
    long texts are carried as they are. Columns of the five names are replaced, all others stay. A source's rows are ranked in `cells` cells of that hash, so
    one source with a third of all rows doesn't meet in one task. An empty table gives no rows.
    """
    spark = df.sparkSession
    made = ["block", "row_in_block", "release", "deadline", "slot"]
    df = df.drop(*made)
    src, h, tie, cell, n, first, rank, per, k, cycle, rel, due, at = unused(df, "source", "h", "tie", "cell", "n", "first", "rank", "per", "k", "cycle", "release", "deadline", "slot")
    whole = F.xxhash64(*[df[c] for c in df.columns])
    rows = df.withColumns({src: F.coalesce(F.col(source).cast("string"), F.lit("")), h: F.xxhash64(F.col(key).cast("string"), F.when(F.col(key).isNull(), whole)), tie: whole})
    rows = rows.withColumn(cell, F.pmod(h, F.lit(cells)).cast("int"))
    counts = rows.groupBy(src, cell).agg(F.count("*").alias(n))
    found = {r[src]: r["total"] for r in counts.groupBy(src).agg(F.sum(n).alias("total")).collect()}
    given = dict(weights) if weights is not None else {s: x**alpha for s, x in found.items()}
    if missing := sorted(set(found) - set(given)):
        raise ValueError(f"no weight for {missing[:5]}")
    period = period_for(given, period)
    slots = shares(given, period) if given else {}
    small = F.broadcast if max(period, cells * len(found)) <= BROADCAST else lambda df: df  # larger ones are joined as Spark sees fit
    plan = _frame(spark, schedule(slots), f"{src} string, {k} long, {rel} long, {due} long, {at} long")
    of = _frame(spark, list(slots.items()), f"{src} string, {per} long")
    starts = counts.withColumn(first, F.sum(n).over(Window.partitionBy(src).orderBy(cell)) - F.col(n)).join(small(of), src).drop(n)
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(src, cell).orderBy(h, tie)) - 1).join(small(starts), [src, cell])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(first))
    ranked = ranked.withColumns({"block": F.floor(F.col(rank) / block_rows), "row_in_block": (F.col(rank) % block_rows).cast("int")})
    ranked = ranked.withColumns({k: F.col("block") % F.col(per), cycle: F.floor(F.col("block") / F.col(per))})
    placed = ranked.join(small(plan), [src, k])
    late = F.col(cycle) * period
    return placed.select(*[F.col(c) for c in df.columns], "block", "row_in_block", (late + F.col(rel)).alias("release"), (late + F.col(due)).alias("deadline"), (late + F.col(at)).alias("slot"))


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in the mix's order: files hold consecutive ranges of slots."""
    return mixed.repartitionByRange("slot", "row_in_block").sortWithinPartitions("slot", "row_in_block")
