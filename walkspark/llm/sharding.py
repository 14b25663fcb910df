"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 2**ring_bits cells. A key falls into a cell by its
hash and belongs to the owner of the first virtual node at or after that cell. Each shard may hold
its quota of rows only (floor or ceiling of rows / shards); keys that find their shard full go on
clockwise to the next virtual node whose shard has room. So row counts differ by one at most, and
only the overflow leaves its home shard.

What reaches the driver are the row counts of the ring's cells: 2**ring_bits numbers at any size
of the input. Rows are ranked inside their cell, so no shard's rows meet in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkspark.llm.common import unused

RING_BITS = 14
VNODES = 128


def ring(n_shards: int, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> list[tuple[int, int]]:
    """Virtual nodes as sorted (cell, shard); where two fall on a cell the lower shard has it."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard {shard} point {v}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest, "big") >> (64 - ring_bits), shard)
    return sorted(points.items())


def placement(counts: dict[int, int], n_shards: int, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, first slot, home shard) for the rows per cell."""
    nodes = ring(n_shards, vnodes, ring_bits)
    at = [cell for cell, _ in nodes]
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot, segments, overflow = [0] * n_shards, [], []

    def put(cell, lo, n, shard, home):
        segments.append((cell, lo, lo + n, shard, slot[shard], home))
        slot[shard] += n
        room[shard] -= n

    for cell in sorted(counts):
        k = bisect_left(at, cell) % len(nodes)
        home = nodes[k][1]
        if n := min(counts[cell], room[home]):
            put(cell, 0, n, home, home)
        if n < counts[cell]:
            overflow.append((cell, n, k, home))
    for cell, lo, k, home in overflow:
        while lo < counts[cell]:
            k = (k + 1) % len(nodes)
            shard = nodes[k][1]
            if n := min(counts[cell] - lo, room[shard]):
                put(cell, lo, n, shard, home)
                lo += n
    return segments


def assign_shards(df: DataFrame, key: str = "doc_id", n_shards: int = 8, vnodes: int = VNODES, ring_bits: int = RING_BITS, spread: Column | None = None) -> DataFrame:
    """df with `shard`, `slot` (gapless from 0 in a shard) and `home_shard` (the ring's first choice).

    Counts per shard differ by one at most. Rows with a null key take their place from `spread`
    (a column of the row; default: all columns). Rows equal in all columns may trade places;
    nothing else depends on the order of the input. Repeated rows each have a slot. An empty table gives no rows. Columns of df
    named shard, slot or home_shard are replaced; all others stay, null and long texts included.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "home_shard")
    rest = spread if spread is not None else F.xxhash64(*[df[c] for c in df.columns])
    h, tie, at, rank, cell, lo, hi, first = unused(df, "h", "tie", "at", "rank", "cell", "lo", "hi", "first")
    hashed = F.xxhash64(F.col(key).cast("string"), F.when(F.col(key).isNull(), rest))
    rows = df.withColumns({h: hashed, tie: rest}).withColumn(at, F.shiftrightunsigned(h, 64 - ring_bits).cast("int"))
    counts = {r[at]: r["n"] for r in rows.groupBy(at).agg(F.count("*").alias("n")).collect()}
    segments = spark.createDataFrame(placement(counts, n_shards, vnodes, ring_bits), f"{cell} int, {lo} long, {hi} long, shard int, {first} long, home_shard int")
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(at).orderBy(h, tie)) - 1)
    on = (F.col(at) == F.col(cell)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi))
    placed = ranked.join(F.broadcast(segments), on)  # at most 2**ring_bits cells and two pieces a cell
    return placed.select(*df.columns, "shard", (F.col(first) + F.col(rank) - F.col(lo)).alias("slot"), "home_shard")


def shard_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """Ids, sizes and checksums of the documents with their shards; texts aren't shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(slim, "doc_id", n_shards)
