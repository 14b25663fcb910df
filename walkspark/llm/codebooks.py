"""Vector codes: integer product codebooks fitted by weighted Lloyd rounds over distinct parts.

A vector's components become whole numbers and its parts are equal runs of them. Parts that are equal at one position
are counted and kept once: a round assigns and sums the distinct parts, weighted by their counts, so a vector that
half of the rows repeat costs as much as any other. Sums of a round are added up by Spark and make the next codebooks
(parts times entries, a bounded table, is all that the driver sees). Codes and errors of the distinct parts are joined
back to the vectors. All arithmetic is on whole numbers, so results don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import discard, stored

#: Components are held to this many either way, so that squared distances fit 64 bits.
LIMIT = 1 << 27
#: Parts that are measured at once.
ROWS = 4096


@dataclass
class Codebooks:
    """entries[p]: the codebook of part p, an int64 array of entries by components of a part."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each part; of equally near entries the lowest index."""
    index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    small = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) < 1 << 22  # then all sums are whole numbers below 2^53
    for lo in range(0, len(parts), ROWS):
        some = parts[lo : lo + ROWS]
        if small:
            x, c = some.astype(np.float64), book.astype(np.float64)
            d = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
        else:
            d = np.stack([((some - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        best = d.argmin(axis=1)
        index[lo : lo + ROWS], error[lo : lo + ROWS] = best, d[np.arange(len(some)), best]
    return index, error


def whole_numbers(df: DataFrame, id: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """(uid, id, label, v) of the vectors that take part, v with floor(scale * component) as whole numbers; uid numbers the rows."""
    x = F.transform(vector, lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-2.0 * LIMIT / scale)), F.lit(2.0 * LIMIT / scale)) * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    kept = df.filter(good).select(F.col(id).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.transform(x, held).alias("v"))
    return kept.select(F.monotonically_increasing_id().alias("uid"), "*")


def distinct_parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(pos, part, n): every distinct part of each position with the number of rows that hold it."""
    return _parts(rows, parts, width).groupBy("pos", "part").agg(F.count("*").alias("n"))


def _parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    cut = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    return rows.select("uid", F.posexplode(cut).alias("pos", "part"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _sums(books: list[np.ndarray]):
    """For the distinct parts of a task: their number and the sums of their components for each entry that has any."""
    parts, size, width = len(books), max(map(len, books)), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            pos, n, x = batch.column("pos").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("part"), width)
            for p in range(parts):
                at = pos == p
                index, _ = nearest(x[at], books[p])
                np.add.at(sums[p], index, x[at] * n[at][:, None])
                np.add.at(counts[p], index, n[at])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e], pa.int64()), **{f"s{j}": pa.array(sums[p, e, j], pa.int64()) for j in range(width)}})

    return run


def fit(rows: DataFrame, distinct: DataFrame, parts: int, width: int, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of whole-number vectors (id, v) and their distinct parts (pos, part, n).

    They start as the parts of the rows with the smallest ids (ties by vector, null ids last), `entries` of them at most,
    and move `rounds` times to the floors of the means of what is assigned to them; unused entries stay."""
    first = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()], np.int64)
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    schema = "pos int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    for _ in range(rounds):
        # at most parts * entries rows come back
        found = distinct.mapInArrow(_sums(books), schema).groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect()
        books = [book.copy() for book in books]
        for r in found:
            books[r["pos"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return Codebooks(books)


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, part, entry, error) of distinct parts."""
    width, entries = books.entries[0].shape[1], books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, x = batch.column("pos").to_numpy(), _matrix(batch.column("part"), width)
            index, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p, book in enumerate(entries):
                at = pos == p
                index[at], error[at] = nearest(x[at], book)
            yield pa.RecordBatch.from_pydict({"pos": batch.column("pos"), "part": batch.column("part"), "entry": pa.array(index), "error": pa.array(error)}, schema=made)

    made = pa.schema([("pos", pa.int32()), ("part", pa.list_(pa.int32())), ("entry", pa.int32()), ("error", pa.int64())])
    return distinct.select("pos", "part").mapInArrow(run, "pos int, part array<int>, entry int, error long")


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row for each vector that takes part: id, `code` (an entry's index for each part, two hex digits each or more),
    `error` (squared distances to them), `label_error` (errors summed over rows of an equal label, nulls together) and
    `codebooks_sha256`.

    Vectors that are null or hold null or non-finite components take no part; nor do those whose length isn't that of
    most rows (of equally many the shorter) or isn't a multiple of `parts`. Components beyond 2^27 after scaling are held to that. Repeated rows and
    ids keep a row each and get equal codes; ties of distance go to the lower index. A null id comes last where rows are
    ordered by id. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    digits = max(2, len(f"{entries - 1:x}"))
    rows = stored(whole_numbers(df, id, vector, label, scale), "codes-rows")
    sizes = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).filter((F.col("k") > 0) & (F.col("k") % parts == 0))
    most = sizes.orderBy(F.desc("n"), "k").first()
    names = [F.col("id").alias(id), "code", "error", "label_error", "codebooks_sha256"]
    if most is None:
        return rows.limit(0).select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).select(*names)
    rows, width = rows.filter(F.size("v") == most["k"]), most["k"] // parts
    distinct = stored(distinct_parts(rows, parts, width), "codes-distinct")
    books = fit(rows, distinct, parts, width, entries, rounds)
    met = _parts(rows, parts, width).join(assigned(distinct, books), ["pos", "part"])
    found = met.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("c"), F.sum("error").alias("error"))
    code = F.array_join(F.transform("c", lambda x: F.lower(F.lpad(F.hex(x["entry"]), digits, "0"))), "")
    made = stored(rows.select("uid", "id", "label").join(found.select("uid", code.alias("code"), "error"), "uid"), "codes-made")
    totals = made.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    discard(distinct)
    return made.join(totals, F.col("label").eqNullSafe(F.col("_label"))).withColumn("codebooks_sha256", F.lit(books.digest())).select(*names)
