"""An exact Jaccard join of word n-gram sets, as a join in the metric space of Jaccard distances.

With J the similarity, 1 - J is a metric, so distances to a pivot say how far apart two sets can be: by the triangle
inequality linked sets lie within r = 1 - threshold of each other as seen from any pivot.

1. Cells. Shingles have a global order: the longest first, then by hash. Two linked sets share one of the first
   n - ceil(threshold * n) + 1 shingles of either, so each of these keys is a cell of the space that a set lies in. Long
   shingles are rare at any size of the corpus; runs of short, frequent words meet by chance, in cells that fill up and get
   more as it grows. Keys of crowded cells (a passage that many documents hold) go to the end of the order, for all sets;
   sets that have them take the next keys instead.
   Sets that are alone in all their cells are linked with nothing.
2. Pivots. The member with the smallest hash is its cell's pivot; the distance of each other member to it is measured.
   A set near enough is linked to it.
3. Windows. In a cell only sets of different components, whose distances to the pivot differ by r or less, can still be
   linked in a way that matters; these pairs are measured.
4. Regions. Cells that stay crowded (of sets with hardly any other shingles: families of near copies) are joined to
   clusters. A cluster draws pivots of its own, its members go to the region of the nearest one, and to every region whose
   pivot is at most 2 r further away: a linked set of that region can't be further. Regions are divided in the same way
   until they are small or don't get smaller; pieces whose members are all in one component are done. What is left is compared block
   by block inside tasks.

Equal sets are one class, represented by its smallest id. Every link between components is found, measured on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkspark.llm.common import discard, stored
from walkspark.llm.neardup import ROWS, _confirm, _crowded_links, _windows, components, shingle_sets
from walkspark.llm.words import hashed, word_runs

#: How often the order of crowded cells is looked over; members above which a cell is crowded; members up to which a region isn't divided; pivots of a region; members measured in one task.
TURNS, CROWD, LEAF, PIVOTS, BLOCK = 3, 64, 1024, 16, 256


def prefix_length(n: int, threshold: int) -> int:
    """Keys that a set of n shingles needs: a linked set can lack all but one of its shared shingles among them."""
    return n - -(-threshold * n // 100) + 1 if n else 0


def _ordered_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit numbers of its shingles: six bits for their bytes, the longest first, then bits of their hash."""
    for lo in range(0, len(texts), ROWS):
        raw, starts, ends, lengths = word_runs(texts.slice(lo, ROWS))
        h, bytes_ = hashed(raw, starts, ends), np.r_[0, np.cumsum(ends - starts)]
        whole = _numbers(h, bytes_, words)
        for start, n in zip(np.cumsum(lengths) - lengths, lengths):
            if n >= words:
                yield np.unique(whole[start : start + n - words + 1])
            else:
                yield _numbers(h[start : start + n], bytes_[start : start + n + 1], n) if n else np.empty(0, np.uint64)


def _numbers(h: np.ndarray, bytes_: np.ndarray, n: int) -> np.ndarray:
    """Of each n neighbours; bytes_: those of the words before each word."""
    long = np.minimum((bytes_[n:] - bytes_[: max(0, len(bytes_) - n)]) // 2, 63).astype(np.uint64)
    return (np.uint64(63) - long) << np.uint64(58) | _windows(h, n) >> np.uint64(6)


def _packed(shingles: np.ndarray) -> bytes:
    """Keys of shingles: the upper 48 bits, six bytes each. Two shingles with one key only make a cell larger."""
    return (shingles >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _reserve(p: int) -> int:
    """How many of the keys that follow a set's first p are kept at hand."""
    return p // 2 + 8


def _fingerprints(df: DataFrame, id: str, text: str, words: int, threshold: int) -> DataFrame:
    """(id, n, set_key, keys, more) per row: the keys of the set and some that follow them, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"n": [], "set_key": [], "keys": [], "more": []}
            for found in _ordered_sets(batch.column(1), words):
                p = prefix_length(len(found), threshold)
                made["n"].append(len(found))
                made["set_key"].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                made["keys"].append(_packed(found[:p]))
                made["more"].append(_packed(found[p : p + _reserve(p)]))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array(made["n"], pa.int64()), **{c: pa.array(made[c], pa.binary()) for c in ("set_key", "keys", "more")}})

    return df.select(F.col(id).cast("long").alias("id"), text).mapInArrow(run, "id long, n long, set_key binary, keys binary, more binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h) of rows (h, keys)."""
    for batch in batches:
        for part in (batch.slice(lo, 4 * ROWS) for lo in range(0, batch.num_rows, 4 * ROWS)):
            packed = [x or b"" for x in part.column("keys").to_pylist()]
            wide = np.zeros((sum(map(len, packed)) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
            yield pa.RecordBatch.from_pydict({"key": pa.array(wide.view("<i8").ravel()), "h": pa.array(np.repeat(part.column("h").to_numpy(), [len(x) // 6 for x in packed]))})


def _cells_of(rows: DataFrame) -> DataFrame:
    return rows.select("h", "keys").mapInArrow(_unpacked, "key long, h long")


def _all_keys(texts: DataFrame, words: int) -> DataFrame:
    """(set_key, keys) with all shingles, of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, ROWS) for lo in range(0, batch.num_rows, ROWS)):
                made = [(xxhash.xxh3_128_digest(x.tobytes()), _packed(x)) for x in _ordered_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_pydict({c: pa.array([m[i] for m in made], pa.binary()) for i, c in enumerate(("set_key", "keys"))})

    return texts.select("id", "text").mapInArrow(run, "set_key binary, keys binary")


def cells(classes: DataFrame, df: DataFrame, id: str, text: str, words: int, threshold: int) -> DataFrame:
    """(key, id, n, size, rest): the cells that more than one class lies in. classes: (h, set_key, id, n, keys, more); h numbers them.

    rest: how many shingles of the set no small cell stands for. Two sets that share s small cells have at most s + rest
    shingles in common, with the larger rest of the two: of the sets whose keys end first in the order, all others are counted in rest.

    Tables that are written here are small beside the keys, mostly; where they are small enough, Spark broadcasts them by their size."""
    first = _cells_of(classes)
    shared = stored(first.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-shared")
    crowd = stored(shared.filter(F.col("size") > CROWD).select("key"), "jaccard-crowd")
    late = stored(first.join(crowd, "key").groupBy("h").agg(F.count("*").alias("lost")), "jaccard-late")
    # sets with keys of crowded cells take the next ones
    ahead = classes.select("h", "more").join(late, "h").select("h", F.expr("substring(more, 1, 6 * (3 * lost + 8))").alias("keys"))
    more = stored(_cells_of(ahead).join(crowd, "key", "left_anti"), "jaccard-more")
    got = more.groupBy("h").agg(F.count("*").alias("got"))
    short = stored(late.join(got, "h", "left").filter(F.coalesce("got", F.lit(0)) < F.col("lost")).select("h"), "jaccard-short")
    scratch, rest, asking, extra = [shared, crowd, late, more, short], None, short, more
    for turn in range(TURNS):
        if not asking.isEmpty():
            # sets that are made of little else take any of their shingles
            their = stored(classes.select("h", "id", "n", "set_key").join(asking, "h"), "jaccard-their")
            whole = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(stored(their.select("id").distinct(), "jaccard-asked"), "id", "left_semi")
            keys = _all_keys(whole, words).join(their.select("h", "set_key"), "set_key").groupBy("h").agg(F.first("keys").alias("keys"))
            made = _cells_of(keys)
            rest = stored(made if rest is None else rest.unionByName(made), "jaccard-rest")
            scratch += [their, rest]
        before = more.join(short, "h", "left_anti")
        if rest is not None:
            # in the common order, those of crowded cells last; a set has at most as many as words
            marked = rest.join(crowd.withColumn("last", F.lit(True)), "key", "left").groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("last", F.lit(False)).alias("last"), "key"))).alias("ks"))
            taken = F.slice("ks", F.lit(1), (F.size("ks") - F.ceil(F.size("ks") * threshold / 100) + 1).cast("int"))
            chosen = stored(marked.select("h", F.explode(taken).alias("k")).select("h", "k.*"), "jaccard-chosen")
            before = before.unionByName(chosen.filter("not last").select("key", "h"))
            extra = before.unionByName(chosen.filter("last").select("key", "h"))
            scratch.append(chosen)
        if turn + 1 == TURNS:
            break  # what is crowded now mostly holds sets that have nothing else: the regions are for them
        sizes = shared.unionByName(extra.groupBy("key").agg(F.count("*").alias("size"))).groupBy("key").agg(F.sum("size").alias("size"))
        if rest is not None:  # a passage goes with all its shingles: else those that come next in the order are crowded next
            sizes = sizes.unionByName(rest.groupBy("key").agg(F.count("*").alias("size")))
        fresh = stored(sizes.filter(F.col("size") > CROWD).select("key").distinct().join(crowd, "key", "left_anti"), "jaccard-fresh")
        scratch.append(fresh)
        if fresh.isEmpty():
            break
        held = before.unionByName(first.join(short, "h", "left_anti")).join(fresh, "key").select("h").distinct()
        asking = stored(held.join(short, "h", "left_anti"), "jaccard-asking")
        crowd, short = stored(crowd.union(fresh), "jaccard-crowd"), stored(short.union(asking), "jaccard-short")
        scratch += [asking, crowd, short]
    more = before
    asked = shared.select("key").join(crowd, "key", "left_anti").union(extra.select("key")).distinct()
    found = stored(first.join(short, "h", "left_anti").join(asked, "key", "left_semi").unionByName(extra), "jaccard-found")
    met = stored(found.join(found.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"), "jaccard-met")
    scratch += [found, met]
    # keys that stand in the order before those of crowded cells: the first ones but the lost, and those taken instead
    lost, taken = late.withColumnRenamed("lost", "k"), more.groupBy("h").agg(F.count("*").alias("t"))
    kept = classes.select("h", "id", "n").join(met.select("h").distinct(), "h", "left_semi").join(lost, "h", "left").join(taken, "h", "left").join(short.withColumn("s", F.lit(True)), "h", "left")
    own = F.when(F.col("s"), 0).otherwise(F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - F.coalesce("k", F.lit(0))) + F.coalesce("t", F.lit(0))
    full = met.filter(F.col("size") > CROWD).groupBy("h").agg(F.count("*").alias("g"))
    kept = kept.join(full, "h", "left").select("h", "id", F.col("n").cast("int").alias("n"), (F.col("n") - own + F.coalesce("g", F.lit(0))).cast("int").alias("rest"))
    several = classes.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id", F.lit(True).alias("several"))  # of these nothing is said
    kept = kept.join(several, "id", "left").select("h", "id", "n", F.when(F.col("several"), F.col("n")).otherwise(F.col("rest")).alias("rest"))
    made = stored(met.join(kept, "h").select("key", "id", "n", "size", "rest"), "jaccard-cells")
    discard(*scratch)
    return made


def _loose(members: DataFrame, threshold: int) -> DataFrame:
    """(id, c): members of crowded cells that may be linked without a small cell in common, each with one that it has to be compared with.

    A linked pair without small cells has at most as many shingles in common as the rest of one of the two, the loose one. That bounds
    how many the other may have; others of its crowded cells aren't gone through. Sizes go by bands, four to an octave."""
    n, band = F.col("n").cast("long"), lambda x: F.floor(4 * F.log2(x)).cast("int")
    lo, hi = F.ceil(threshold * n / 100).cast("long"), F.floor((F.col("rest") * (100 + threshold) - threshold * n) / threshold).cast("long")
    loose = members.select("key", "id", band(n).alias("of"), lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")
    first = stored(loose.groupBy("key", "of").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("id").alias("first")), "jaccard-loose")
    wide = first.select("*", F.explode(F.sequence(band(F.col("lo")), band(F.col("hi")))).alias("band"))
    asked = stored(wide.groupBy("key", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("c")), "jaccard-loose")
    theirs = loose.join(first.select("key", "of", F.col("first").alias("c")), ["key", "of"]).select("id", "c")
    theirs = theirs.union(wide.join(asked.select("key", "band", "c"), ["key", "band"]).select(F.col("first").alias("id"), "c"))
    others = members.select("key", "id", "n", band(n).alias("band")).join(asked, ["key", "band"]).filter(F.col("n").between(F.col("lo"), F.col("hi"))).select("id", "c")
    return theirs.union(others).distinct()


def _distances(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, d): the Jaccard distances of pairs of ids, from their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, ROWS) for lo in range(0, batch.num_rows, ROWS)):
                a, d = np.asarray(part.column("a")), []
                new = np.r_[True, a[1:] != a[:-1]]  # rows of one pivot mostly follow each other
                pivots = shingle_sets(part.column("ta").filter(pa.array(new)), words)
                for fresh, other in zip(new, shingle_sets(part.column("tb"), words)):
                    pivot = next(pivots) if fresh else pivot
                    d.append(_distance(pivot, other))
                yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "d": pa.array(d, pa.float64())})

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, d double")


def _distance(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    whole = len(x) + len(y) - common
    return (whole - common) / whole if whole else 1.0


def near(d, threshold: int):
    """Whether a distance is a link: distances are ratios of whole numbers, and no two differ by less than the margin unless equal."""
    return d <= 1 - threshold / 100 + 1e-12


def _from_pivots(words: int):
    """Distances of a block's members to the pivots of its region: (region, id, pivot, d)."""

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(pivots):
            return pd.DataFrame({"region": [], "id": [], "pivot": [], "d": []}).astype({"region": "int64", "id": "int64", "pivot": "int64", "d": "float64"})
        sets = list(shingle_sets(pa.array(pivots["shape"], pa.string()), words))
        rows = []
        for i, x in zip(members["id"], shingle_sets(pa.array(members["text"], pa.string()), words)):
            rows += [(members["region"].iloc[0], i, c, _distance(x, s)) for c, s in zip(pivots["pivot"], sets)]
        return pd.DataFrame(rows, columns=["region", "id", "pivot", "d"])

    return run


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) with further links (a, b): the stars that are known stand for all earlier links."""
    return labels if links.isEmpty() else components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def regions(clusters: DataFrame, links: DataFrame, texts: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, labels): clusters (region, id) divided into overlapping pieces (region, id), so that linked members of a
    cluster meet in a piece or are in one component (labels: id, component) of the links (a, b) and what is measured on the way."""
    r = 1 - threshold / 100
    done, open_, labels = clusters.limit(0), stored(clusters, "jaccard-region"), components(links)
    while True:
        known = open_.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = known.groupBy("region").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        sizes = stored(sizes.select("region", "size"), "jaccard-sizes")
        small = open_.join(sizes.filter(F.col("size") <= LEAF), "region", "left_semi")
        done = done.unionByName(small.select("region", "id"))
        large = stored(open_.join(sizes.filter(F.col("size") > LEAF), "region"), "jaccard-large")
        if large.isEmpty():
            return stored(done, "jaccard-pieces"), labels
        drawn = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("region", "id"), "id"))
        pivots = stored(large.withColumn("k", drawn).filter(F.col("k") <= PIVOTS).select("region", "id"), "jaccard-pivots")
        blocks = stored(large.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))).select("region", "block", "id"), "jaccard-blocks")
        of_block = blocks.select(F.col("region").alias("g"), F.col("block").alias("b")).distinct()
        seen_from = of_block.join(pivots.select(F.col("region").alias("g"), F.col("id").alias("pivot")), "g").join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("shape")), "pivot")
        measured = blocks.join(texts, "id").select("region", "block", "id", "text").groupBy("region", "block").cogroup(seen_from.select("g", "b", "pivot", "shape").groupBy("g", "b")).applyInPandas(_from_pivots(words), "region long, id long, pivot long, d double")
        measured = stored(measured, "jaccard-measured")
        labels = _joined(labels, measured.filter(near(F.col("d"), threshold) & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        nearest = measured.groupBy("region", "id").agg(F.min("d").alias("least"))
        placed = measured.join(nearest, ["region", "id"]).filter(F.col("d") <= F.col("least") + 2 * r + 1e-9).select(F.col("region").alias("parent"), "pivot", "id")
        placed = stored(placed.select("parent", F.xxhash64("parent", "pivot").alias("region"), "id").distinct(), "jaccard-placed")
        shrunk = placed.groupBy("parent", "region").agg(F.count("*").alias("now")).join(sizes.withColumnRenamed("region", "parent"), "parent")
        fine = shrunk.groupBy("parent").agg(F.max(F.col("now") / F.col("size")).alias("most")).filter("most <= 0.5").select("parent")  # else dividing doesn't help
        done = done.unionByName(large.join(fine.withColumnRenamed("parent", "region"), "region", "left_anti").select("region", "id"))
        open_ = stored(placed.join(fine, "parent", "left_semi").select("region", "id"), "jaccard-region")


def jaccard_join(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of df: `id`, `n_shingles`, `set_id` (smallest id with an equal set) and `component_id`.

    Sets are linked when 100 * intersection >= threshold * union. component_id is the smallest id
    reachable over links, itself included. Null, empty and blank texts have an empty set and are linked with
    nothing; so is a row with a null id. Rows that repeat an id are one document, linked where any of their texts is; equal
    texts (ties) are one class. Texts of any length. Columns but id and text are ignored. An empty table gives no rows.
    """
    prints = stored(_fingerprints(df, id, text, words, threshold), "jaccard-prints")
    known = prints.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min(F.struct("id", "n", "keys", "more")).alias("r"))
    classes = stored(known.select(F.monotonically_increasing_id().alias("h"), "set_key", "r.*"), "jaccard-classes")
    base = stored(prints.select("id", "n", "set_key"), "jaccard-base")
    discard(prints)
    members = cells(classes, df, id, text, words, threshold)
    r = 1 - threshold / 100
    pivot = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("c")).select("key", F.col("c.id").alias("c"))
    members = stored(members.join(pivot, "key"), "jaccard-members")
    # pairs of small cells that can be linked by their sizes and by the cells they share
    left, right = (members.filter(F.col("size") <= CROWD).select("key", *[F.col(x).alias(f"{x}_{s}") for x in ("id", "n", "rest")]) for s in "ab")
    likely = 100 * F.least("n_a", "n_b").cast("long") >= threshold * F.greatest("n_a", "n_b").cast("long")
    met = left.join(right, "key").filter((F.col("id_a") < F.col("id_b")) & likely).groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    met = met.agg(F.count("*").alias("shared"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(F.greatest("rest_a", "rest_b")).alias("rest"))
    possible = (F.col("shared") + F.col("rest")) * (100 + threshold) >= threshold * (F.col("n_a") + F.col("n_b"))
    met = stored(met.filter(possible).select("a", "b"), "jaccard-met")
    crowded = stored(_loose(members.filter(F.col("size") > CROWD), threshold), "jaccard-crowded")
    involved = stored(met.select(F.col("a").alias("id")).union(met.select("b")).union(crowded.select("id")).distinct(), "jaccard-involved")
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(involved, "id", "left_semi")
    texts = stored(texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"), "jaccard-texts")
    centres = members.filter("id <> c").select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b"), "c").distinct()
    stars = stored(met.join(centres, ["a", "b"]).select(F.col("c").alias("a"), F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "jaccard-centres")
    stars = stored(_distances(stars, texts, words).groupBy("a", "b").agg(F.min("d").alias("d"), F.max("d").alias("far")), "jaccard-stars")
    links = stored(stars.filter(near(F.col("d"), threshold)).select("a", "b"), "jaccard-links")
    clusters = components(crowded.select(F.col("id").alias("a"), F.col("c").alias("b")))
    pieces, joined = regions(clusters.select(F.col("component").alias("region"), "id"), links, texts, words, threshold)
    if not pieces.isEmpty():
        inside = _crowded_links(pieces.select("id", F.col("region").alias("component")), joined, classes.groupBy("id").agg(F.max("n").alias("n")), texts, words, threshold)
        joined = _joined(joined, stored(inside, "jaccard-inside"))
    # pairs inside the window: seen from each pivot that both were measured from at most r apart, and of different components
    seen = stars.select("a", "b", "d", "far").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "far"))
    of = lambda x, name: joined.select(F.col("id").alias(x), F.col("component").alias(name))
    open_ = met.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    open_ = stored(open_.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-open")
    from_ = lambda x: stars.select(F.col("b").alias(x), F.col("a").alias("p"), F.col("d").alias(f"d_{x}"), F.col("far").alias(f"far_{x}"))
    apart = (F.col("d_a") > F.col("far_b") + r + 1e-9) | (F.col("d_b") > F.col("far_a") + r + 1e-9)
    outside = open_.join(from_("a"), "a").join(from_("b"), ["b", "p"]).filter(apart).select("a", "b").distinct()
    late = stored(_confirm(open_.join(outside, ["a", "b"], "left_anti"), texts, words, threshold), "jaccard-late")
    set_ids = classes.select("set_key", F.col("id").alias("set_id"))
    several = base.filter("set_key is not null").groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("id")
    repeated = base.join(several, "id", "left_semi").join(set_ids, "set_key").select(F.col("id").alias("a"), F.col("set_id").alias("b"))  # an id's sets belong together
    whole = _joined(joined, late.union(repeated))
    discard(members, met, stars, open_, late, texts, crowded)
    rows = base.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(set_ids, "set_key", "left").withColumn("set_id", F.coalesce("set_id", "id")).join(whole.withColumnRenamed("id", "set_id"), "set_id", "left")
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "set_id", F.coalesce("component", "set_id").alias("component_id"))
