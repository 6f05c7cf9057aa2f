"""Connected components over an edge table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Tasks of a step at least, and edges of a task where that makes more.
LEAST_PARTS, PART_EDGES = 8, 200_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b), component being the smallest id of its group.

    Few edges are worked on by few tasks, so that a step does not write hundreds of tiny files.

    Alternates the large-star and small-star steps until no edge changes. Stars have one centre and each step keeps at most
    the number of edges, so big groups cost no more than many small ones. No edges give no rows.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    parts = max(LEAST_PARTS, e.count() // PART_EDGES)
    fewer = lambda df: df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    before = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u links to the smallest id around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        e = staged(fewer(large), name)
        # small star: u and its smaller neighbours link to the smallest of them
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        small = e.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        e = staged(fewer(small.select("x.*").where("hi <> lo").distinct()), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component"))).distinct()
        before = now
