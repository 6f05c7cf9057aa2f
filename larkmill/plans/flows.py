"""Queries over stream forms (2.13): each reads what there is now as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.operators import cluster
from larkmill.sources.files import scratch
from larkmill.streaming import streams

from .base import Tables, query

#: Stage that an event stands for.
STAGE = {"signup": "register", "view": "check-in", "click": "issue", "purchase": "assign", "error": "feedback"}


def opened(t: Tables, name: str) -> DataFrame:
    """An input table as a stream. A pattern, since a stream's plain path must be a folder and some tables are one file."""
    return streams.unbounded(t.spark, f"{t.sf_dir}/{name}.parque[t]", getattr(t, name).schema)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All rows of a stream, through files."""
    path = scratch(stream.sparkSession, name)
    streams.buffered(stream, path, f"{path}-log").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query("src_22_unbounded_scan", "SELECT event_id, user_id, value FROM events")
def _(t):
    return drained(opened(t, "events").select("event_id", "user_id", "value"), "unbounded")


@query("str_01_repeated_scan", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return drained(opened(t, "events").select("event_type"), "repeated").groupBy("event_type").agg(F.count("*").alias("n"))


@query("str_02_online_rerank")
def _(t):
    lists = t.pred.where("rank <= 10").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("z"))
    lists = lists.select("user_id", F.transform("z", lambda x: x["item_id"]).alias("items"), F.transform("z", lambda x: 1.0 / x["rank"]).alias("scores"))
    path = scratch(t.spark, "lists")
    lists.write.parquet(path)
    return drained(streams.rerank_online(streams.unbounded(t.spark, path, lists.schema, files_per_trigger=1000), 0.5, 5), "reranked")


@query("str_03_minibatch_centroids")
def _(t):
    running = streams.Centroids([(r["code"], r["centroid"]) for r in cluster.random_start(t.emb, 8, "r").collect()])
    vectors = opened(t, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"))
    vectors.writeStream.foreachBatch(running.update).option("checkpointLocation", scratch(t.spark, "centroids")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.createDataFrame(running.book, "code int, centroid array<double>, seen bigint")


@query("str_04_buffered_flush", "SELECT event_id, value FROM events WHERE value > 10")
def _(t):
    return drained(opened(t, "events").where("value > 10").select("event_id", "value"), "flushed")


@query("snk_07_batched_writer", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def _(t):
    return drained(opened(t, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "written")


@query("str_05_staged_events")
def _(t):
    stage = F.element_at(F.create_map(*(F.lit(x) for kv in STAGE.items() for x in kv)), F.col("event_type"))
    return drained(streams.staged_events(opened(t, "events").select(F.col("user_id").alias("person"), stage.alias("stage"), F.col("event_id").cast("int").alias("at"))), "staged")


@query("str_06_late_arrivals", "SELECT item_id AS id, code FROM b_a1")
def _(t):
    book = t.codebook.where("level = 0").select("code", "centroid")
    vectors = opened(t, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("r"))
    return drained(streams.late_arrivals(vectors, book).withColumn("code", F.col("code").cast("bigint")), "late")
