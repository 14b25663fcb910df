"""Helpers shared by the operators: tables, the shared scratch folder, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none (a test), a fresh temporary folder stands in; on a cluster that would be a
    folder of one machine, so there it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="walkspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the size at which an Arrow batch goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a cut in the lineage
    that outlives any executor. The shuffle files that the write made go with its end.
    batch_bytes: the size of Arrow batches for this write (None: as the session has it)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({} if batch_bytes is None else {BATCH: str(batch_bytes)})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        ours = urlparse(shared_dir(spark)).path + "/"  # with or without a scheme
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if urlparse(folder).path.startswith(ours):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns of our own that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


#: Rows of an Arrow batch that a Python worker holds as Python objects at once.
PIECE_ROWS = 256


def lean(run: Callable, rows: int | None = None) -> Callable:
    """The function of Arrow batches `run`, given pieces of at most `rows` rows (None: batches as they come).

    When a task ends, memory that Arrow keeps goes back to the system: an idle worker would hold it through later stages.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from [batch] if rows is None else (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pieces(batches))
        finally:
            pa.default_memory_pool().release_unused()

    return apply


def let(value, body):
    """Bind a column value to a name inside one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text):
    """Array of the words of a text column; empty for null, empty or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
