"""Tables written to the folder that the driver and all executors see, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows beyond which a staged table is not broadcast for the size of its files: lists that repeat are compressed a hundredfold.
BROADCAST_ROWS = 100_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a local folder does if the master is local too; on a cluster, whose
    machines would not see each other's files, it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors see")
        at = "file:///tmp/larkmill-checkpoints"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written and read again, so that neither its use in several places nor a lost executor repeats it.

    Joins of many rows are told to shuffle: Spark would take the files' size, after compression, for that of the rows, and build
    the hash table of all of them on the driver.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > BROADCAST_ROWS else out
