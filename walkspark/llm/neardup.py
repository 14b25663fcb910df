"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its word shingles. Its signature has 45 symbols of 16 bits, each the low
bits of a minimum of hashed shingles; two sets of similarity J differ in about 45 * (1 - J) symbols.
The signature is split into 9 chunks of 5 symbols. By pigeonhole, two signatures that differ in
17 symbols or fewer have a chunk with at most one differing symbol, so every chunk is indexed
under its 5 one-symbol deletions: such pairs always meet in a bucket, and a pair at similarity 0.85
misses all buckets with probability 1e-7. Pairs that meet are confirmed on full shingle sets.

Equal sets are one class, represented by its smallest id. In each bucket everyone is first compared with
one member drawn by hash, and links join into components; after that only pairs whose components
still differ are compared. So a bucket of many near copies costs a pass, not all its pairs, and no link between
components is lost. Buckets of over 64 members are joined to clusters, whose members are
dealt to blocks of about 512; a task takes two blocks, counts all intersections at once and returns a
spanning forest of the links, so pairs inside large groups are never rows. Blocks inside one component aren't paired.
Signatures, buckets and pairs stay in tables; texts move only for the documents in buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import discard, lean, stored
from walkspark.llm.words import word_hashes

CHUNKS, SYMBOLS = 9, 5
WIDTH = CHUNKS * SYMBOLS
#: Members above which a bucket is crowded; documents and shingles in a block; rows that are hashed at once.
CROWD, BLOCK, BLOCK_SHINGLES, ROWS = 64, 512, 1 << 20, 256
#: Shingles that pairs of blocks may take in one round, if the clusters have no more themselves.
ROUND = 1 << 26
#: Edges up to which components are worked out at once, on the driver: a step over them is mostly the starting of tasks.
FEW = 1 << 16
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; of the whole sequence where there are fewer words."""
    for lo in range(0, len(texts), ROWS):
        h, lengths = word_hashes(texts.slice(lo, ROWS))
        whole = _windows(h, words)
        for start, n in zip(np.cumsum(lengths) - lengths, lengths):
            if n >= words:
                yield np.unique(whole[start : start + n - words + 1])
            else:
                yield _windows(h[start : start + n], n) if n else np.empty(0, np.uint64)


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signature(found: np.ndarray) -> bytes:
    lowest = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 4096):
        lowest = np.minimum(lowest, ((found[None, lo : lo + 4096] ^ _XOR[:, None]) * _MULT[:, None]).min(axis=1))
    return ((lowest * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("<u2").tobytes()


def fingerprints(df: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(id, n, set_key, sig) per row; set_key and sig are null for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, sigs = batch.column(0), [], [], []
            for found in shingle_sets(batch.column(1), words):
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_pydict({"id": ids, "n": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return df.select(F.col(id).cast("long").alias("id"), text).mapInArrow(lean(run), "id long, n long, set_key binary, sig binary")


def _deletions():
    """The index keys of a signature: for each chunk, its symbols without one."""
    out = []
    for c in range(CHUNKS):
        for p in range(SYMBOLS):
            at = 2 * (c * SYMBOLS) + 1
            rest = F.concat(F.substring("sig", at, 2 * p), F.substring("sig", at + 2 * p + 2, 2 * (SYMBOLS - 1 - p)))
            out.append(F.xxhash64(F.lit(c * SYMBOLS + p), rest))
    return F.array(*out)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, ROWS) for lo in range(0, batch.num_rows, ROWS)):
                a, keep = np.asarray(part.column("a")), []
                new = np.r_[True, a[1:] != a[:-1]]  # rows of one centre mostly follow each other
                centres = shingle_sets(part.column("ta").filter(pa.array(new)), words)
                for fresh, other in zip(new, shingle_sets(part.column("tb"), words)):
                    kept = next(centres) if fresh else kept
                    common = len(np.intersect1d(kept, other, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(kept) + len(other) - common))
                yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b")}).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the edges (a, b): the smallest id reachable.

    Alternating large-star and small-star steps: each attaches neighbours to the smallest one known,
    until only stars are left. A node's neighbours are never gathered, only their minimum, which is written
    before it is joined: both sides of the join are then plain exchanges, which Spark splits where a node is hot.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if edges.count() <= FEW:
        return _few_components(edges)
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges-least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has few neighbours left: one for each minimum around it
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        last, edges = edges, stored(small.filter("u <> v").distinct(), "edges")
        discard(last, least, large)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _few_components(edges: DataFrame) -> DataFrame:
    found = edges.toArrow()
    nodes, ends = np.unique(np.r_[found["u"].to_numpy(), found["v"].to_numpy()], return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(label, end, least)
        label = label[label]
    while (label != label[label]).any():
        label = label[label]
    made = pa.table({"id": pa.array(nodes, pa.int64()), "component": pa.array(nodes[label], pa.int64())})
    return edges.sparkSession.createDataFrame(made, "id long, component long")


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either linked to one smaller node and to nothing else, or a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 or (up = 1 and n > 1)").isEmpty()


def _block_links(threshold: int):
    """Links between components among the documents of one pair of blocks, as a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["sets"]]
        m, size = len(sets), np.array([len(x) for x in sets])
        codes = np.concatenate(sets)
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], np.repeat(np.arange(m), size)[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        counts = np.diff(np.r_[starts, len(codes)])
        column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)  # a column for each shingle of two documents or more
        rows, column = rows[column >= 0], column[column >= 0]
        common, at = np.zeros((m, m), np.float32), 0
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            end = np.searchsorted(column, lo + 4096)
            dense = np.zeros((m, 4096), np.float32)
            dense[rows[at:end], column[at:end] - lo] = 1
            common += dense @ dense.T
            at = end
        linked = 100 * common >= threshold * (size[:, None] + size[None, :] - common)
        label, ids, out = pdf["component"].to_numpy().copy(), pdf["id"].to_numpy(), []
        for i in range(m):
            for j in np.flatnonzero(linked[i, :i] & (label[:i] != label[i])):
                if label[i] != label[j]:
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _crowded_links(clusters: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links inside clusters (id, component: the cluster's label) between documents of different components.

    sizes: (id, n), shingles of each document; a block has about BLOCK documents and at most about BLOCK_SHINGLES shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "sets": pa.array(found, pa.binary())})

    placed = clusters.select("id", F.col("component").alias("cluster")).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(sizes, "id")
    weight = F.greatest(F.lit(1.0 / BLOCK), F.col("n") / BLOCK_SHINGLES)  # of a document, in blocks
    sizes = placed.groupBy("cluster", "component").agg(F.sum(weight).alias("size"))
    sizes = sizes.withColumn("own", F.when(F.col("size") >= 1, F.col("component")))  # a large component has blocks of its own
    pools = sizes.groupBy("cluster", "own").agg(F.ceil(F.sum("size")).alias("blocks"))
    placed = placed.join(sizes.select("cluster", "component", "own"), ["cluster", "component"]).withColumnRenamed("own", "pool")
    same = (placed["cluster"] == pools["cluster"]) & placed["pool"].eqNullSafe(pools["own"])
    placed = placed.join(pools, same).select(placed["cluster"], "id", "component", "n", "pool", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    placed = stored(placed, "neardup-placed")
    blocks = placed.groupBy("cluster", "pool", "block").agg(F.sum("n").alias("held"))
    left, right = (blocks.select("cluster", *[F.col(c).alias(f"{c}_{s}") for c in ("pool", "block", "held")]) for s in "ab")
    order = F.struct(F.coalesce("pool_a", F.lit(-(2**62))), "block_a") <= F.struct(F.coalesce("pool_b", F.lit(-(2**62))), "block_b")
    pairs = left.join(right, "cluster").filter(order & (F.col("pool_a").isNull() | ~F.col("pool_a").eqNullSafe(F.col("pool_b"))))
    pairs = pairs.withColumn("pair", F.xxhash64("cluster", "pool_a", "block_a", "pool_b", "block_b"))
    ends = F.explode(F.array_distinct(F.array(F.struct(F.col("pool_a").alias("pool"), F.col("block_a").alias("block")), F.struct(F.col("pool_b").alias("pool"), F.col("block_b").alias("block")))))
    ends = pairs.select("cluster", "pair", ends.alias("e")).select("cluster", "pair", "e.pool", "e.block")
    found = texts.join(clusters.select("id"), "id", "left_semi").select("id", "text").mapInArrow(lean(sets), "id long, sets binary")
    known = placed.drop("n").join(stored(found, "neardup-sets"), "id")
    on = (known["cluster"] == ends["cluster"]) & (known["block"] == ends["block"]) & known["pool"].eqNullSafe(ends["pool"])
    linked = lambda some: known.join(some, on).select("pair", "id", "component", "sets").groupBy("pair").applyInPandas(_block_links(threshold), "a long, b long")
    # a block's sets go to each pair of it: rounds of pairs, so that what is shuffled at once stays in proportion
    moved = pairs.agg(F.sum(F.col("held_a") + F.col("held_b"))).first()[0] or 0
    rounds = 1 if moved <= ROUND else -(-moved // max(ROUND, placed.agg(F.sum("n")).first()[0]))
    if rounds == 1:
        return linked(ends)
    made = [stored(linked(ends.filter(F.pmod("pair", F.lit(rounds)) == i)), "neardup-round") for i in range(rounds)]
    return reduce(DataFrame.unionByName, made)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of df: `id`, `n_shingles`, `set_id` (smallest id with an equal set), `component_id`, `kept`.

    Sets are linked when 100 * intersection >= threshold * union. component_id is the smallest id
    reachable over links, itself included. Null, empty and blank texts have an empty set and are linked with
    nothing; so is a row with a null id. Rows that repeat an id are one document, linked where any of their texts is; equal
    texts (ties) are one class. Texts of any length. Columns but id and text are ignored. An empty table gives no rows.
    """
    base = stored(fingerprints(df, id, text, words), "neardup-base")
    classes = base.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min(F.struct("id", "n", "sig")).alias("r")).select("set_key", "r.*")
    classes = stored(classes, "neardup-classes")  # read from a table, the join at the end can split a class of many copies
    keys = classes.select(F.explode(_deletions()).alias("key"), "id", F.col("n").cast("int").alias("n"))
    # a bucket's centre is drawn by hash, so that near copies, which share many buckets, meet many centres
    shared = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "n")).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = stored(keys.join(shared, "key").select("key", "id", "n", F.col("centre.id").alias("c"), F.col("centre.n").alias("cn"), "size"), "neardup-members")
    likely = lambda n, m: 100 * F.least(n, m).cast("long") >= threshold * F.greatest(n, m).cast("long")
    stars = stored(members.filter("id <> c").filter(likely(F.col("n"), F.col("cn"))).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct(), "neardup-stars")
    involved = members.select("id").distinct()
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(involved, "id", "left_semi")
    texts = stored(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"), "neardup-texts")
    links = stored(_confirm(stars, texts, words, threshold), "neardup-links")
    joined = components(links)
    clusters = components(members.filter(F.col("size") > CROWD).select(F.col("id").alias("a"), F.col("c").alias("b")))
    crowded = stored(_crowded_links(clusters, joined, classes.groupBy("id").agg(F.max("n").alias("n")), texts, words, threshold), "neardup-crowded")
    joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(crowded))
    split = members.filter(F.col("size") <= CROWD).select("key", "id", "n").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = split.join(clusters.withColumnRenamed("component", "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    open_keys = split.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    split = stored(split.join(open_keys, "key", "left_semi"), "neardup-open")
    left, right = (split.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "component", "cluster")]) for s in "ab")
    pairs = left.join(right, "key").filter("id_a < id_b and component_a <> component_b and cluster_a <> cluster_b").filter(likely(F.col("n_a"), F.col("n_b")))
    pairs = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    late = stored(_confirm(pairs, texts, words, threshold), "neardup-late")
    set_ids = classes.select("set_key", F.col("id").alias("set_id"))
    several = base.filter("set_key is not null").groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("id")
    repeated = base.join(several, "id", "left_semi").join(set_ids, "set_key").select(F.col("id").alias("a"), F.col("set_id").alias("b"))  # an id's sets belong together
    whole = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late).union(repeated))
    discard(members, stars, links, crowded, split, late, texts)
    rows = base.join(set_ids, "set_key", "left").withColumn("set_id", F.coalesce("set_id", "id")).join(whole.withColumnRenamed("id", "set_id"), "set_id", "left")
    rows = rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "set_id", F.coalesce("component", "set_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of df for each group of near copies: of the document with the smallest id.

    Where that id is repeated, the row of smallest hash stays, whatever the order of the input. Rows with a null id stay all.
    """
    found = near_duplicates(df, id, text, words, threshold)
    marks = found.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.min("kept").alias("_kept"), F.count("*").alias("_n")).filter("not _kept or _n > 1")
    marks = stored(marks, "neardup-marks")
    once = df.join(marks, df[id] == marks["_id"], "left_anti")
    again = df.join(marks.filter("_kept"), df[id] == marks["_id"], "left_semi")
    first = again.groupBy(id).agg(F.min_by(F.struct(*[again[c] for c in df.columns]), F.xxhash64(*[again[c] for c in df.columns])).alias("_row")).select("_row.*")
    return once.unionByName(first)
