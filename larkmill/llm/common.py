"""Shared helpers: table access, shared-folder staging, let-binding of array expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Words of the shingle operators, after lower-casing: ASCII letters and digits, and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Most bytes of an Arrow batch that is sent to a Python worker (or one row).
BATCH_BYTES = 4 << 20
# Spark's own bound, and the name of its setting that removes the shuffles of an execution at its end.
ARROW_DEFAULT = "67108864b"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local folder does if the master
    is local too; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors see")
        at = "file:///tmp/larkmill-checkpoints"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def lean(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches held to BATCH_BYTES unless the session has a bound of its own: long texts then reach a
    worker by the dozen, not by the ten thousand."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, ARROW_DEFAULT) == ARROW_DEFAULT:
        conf.set(name, str(BATCH_BYTES))
    return df


#: What operators keep in a worker between tasks, by operator.
KEPT: dict = {}


def lighten(name: str = "") -> None:
    """Lets go what operators of other names keep in this worker, and gives freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    if any(k != name for k in KEPT):
        for k in [k for k in KEPT if k != name]:
            del KEPT[k]
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def light(run, name: str = ""):
    """run, a function of an iterator of batches, with lighten before and after."""

    def lightened(batches):
        lighten(name)
        yield from run(batches)
        lighten(name)

    return lightened


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors.

    sweep: the shuffles of the write are removed at its end; else Spark keeps them until the driver collects garbage.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    kept = spark.conf.get(CLEANUP, "false")
    if sweep:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once per row.

    A plain projection may be inlined into a lambda and evaluated again for each element; a generator is never inlined.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """Words of the contracts, unchanged; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of the shingle operators; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def rows(arr):
    """Slices of an Arrow string array, each of a few million bytes at most or of one value."""
    import numpy as np
    import pyarrow as pa

    arr = arr.cast(pa.large_string())
    if not len(arr):
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    at = 0
    while at < len(arr):
        to = int(np.searchsorted(offsets, offsets[at] + 5_000_000, "right")) - 1
        to = min(max(to, at + 1), len(arr), at + 4096)
        yield at, to, arr.slice(at, to - at)
        at = to
