"""Queries over extension points (2.14) and the loading and writing paths around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill import extend
from larkmill.functions import codes
from larkmill.operators.staging import scratch
from larkmill.sources import files

from .base import EVENT_TYPES, query
from .evaluation import metrics
from .statistics import r6
from .tables import HIST, hist

COUNTS = ", ".join(f"count(*) FILTER (event_type = '{x}')" for x in EVENT_TYPES)


@query("prj_02_sparse_to_dense", f"SELECT user_id, [{COUNTS}] AS counts FROM events GROUP BY user_id")
def _(t):
    kind = (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1).cast("int")
    sparse = t.events.groupBy("user_id", kind.alias("i")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.collect_list(F.struct("i", "n")).alias("z"))
    return sparse.select("user_id", codes.dense(F.col("z.i"), F.col("z.n"), len(EVENT_TYPES)).alias("counts"))


@query("prj_12_squeeze", "SELECT item_id, [item_id, item_id + 1] AS pair FROM b_emb")
def _(t):
    nested = t.emb.select("item_id", F.array(F.array("item_id", F.col("item_id") + 1)).alias("pair"))
    return nested.withColumn("pair", codes.squeeze(F.col("pair")))


@query("seq_29_item_collation", "SELECT r // 64 AS batch, list(p_partkey ORDER BY p_partkey) AS item_ids, list(p_size ORDER BY p_partkey) AS sizes FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY r // 64")
def _(t):
    rows = extend.collated(t.part.select("p_partkey", "p_size"), "p_partkey", 64, extend.item_features({"p_size": "sizes"}, "p_partkey"))
    return rows.select("batch", "rows.*")


@query("snk_01_split_artefacts", "SELECT user_id, item_id, pos FROM b_loo WHERE split = 'val'")
def _(t):
    path = scratch(t.spark, "split")
    files.write_split(t.loo.select("user_id", "item_id", "pos", "split").withColumn("window", F.lit("W5")), path)
    return t.spark.read.parquet(path).where("window = 'W5' and split = 'val'").select("user_id", "item_id", "pos")


@query("snk_08_merged_ranks", "SELECT event_id, value FROM events")
def _(t):
    path = scratch(t.spark, "ranks")
    for rank in range(2):
        t.events.where(F.col("event_id") % 2 == rank).select("event_id", "value").write.parquet(f"{path}/rank={rank}")
    return files.merged(t.spark, path, "event_id", scratch(t.spark, "merged")).select("event_id", "value")


@query("ext_01_function_list", "SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_type <> 'view' AND value * 2 > 5")
def _(t):
    steps = [lambda df: df.withColumn("drop", F.col("event_type") == "view"), lambda df: df.withColumn("value", F.col("value") * 2), lambda df: df.withColumn("drop", F.col("value") <= 5)]
    return extend.applied(t.events.select("event_id", "user_id", "event_type", "value"), steps).select("event_id", "user_id", "value")


@query("ext_02_label_function", f"WITH h AS ({HIST}) SELECT user_id, s[:-2] AS input, [s[-1]] AS label FROM h")
def _(t):
    return extend.with_label(hist(t), "s", "last").select("user_id", "input", "label")


@query("ext_03_collate_function", "SELECT r // 100 AS batch, count(*) AS n, max(p_size) AS largest FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY r // 100")
def _(t):
    packed = extend.collated(t.part.select("p_partkey", "p_size"), "p_partkey", 100)
    return packed.select("batch", F.size("rows").cast("bigint").alias("n"), F.array_max("rows.p_size").alias("largest"))


@query("ext_04_distance_plug_in", "WITH d AS (SELECT e.item_id, c.code, round(1 - list_dot_product(e.e, c.centroid) / (sqrt(list_dot_product(e.e, e.e)) * sqrt(list_dot_product(c.centroid, c.centroid))), 9) AS d FROM b_emb e, b_code c WHERE c.level = 0) SELECT item_id, arg_min(code, (d, code))::INT AS code, round(min(d), 6) AS distance FROM d GROUP BY item_id")
def _(t):
    book = t.codebook.where("level = 0").select("code", "centroid")
    return extend.assigned(t.emb.select("item_id", "e"), book, "cosine").select("item_id", "code", r6("distance").alias("distance"))


@query("ext_05_combination_hook", "WITH x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT item_id, round(sum(c * c), 6) AS energy FROM (SELECT item_id, v - avg(v) OVER (PARTITION BY d) AS c FROM x) GROUP BY item_id")
def _(t):
    vectors = extend.variant(extend.foundation(t.emb.select("item_id", "e"), t.edges), "text")
    return vectors.select("item_id", r6(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("energy"))


@query("ext_06_post_processing", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 2")
def _(t):
    post = [lambda df: df.groupBy("user_id").agg(F.count("*").alias("n")), lambda df: df.where("n > 2")]
    return extend.written(t.events.select("event_id", "user_id"), scratch(t.spark, "output"), post)


@query("ext_07_metric_registry", f"WITH {metrics('b_pred', 'b_test', '10, 20')}, m AS (SELECT k, avg(recall) AS recall, avg(ndcg) AS ndcg FROM pu GROUP BY k) SELECT 'recall@' || k AS metric, round(recall, 6) AS value FROM m UNION ALL SELECT 'ndcg@' || k, round(ndcg, 6) FROM m")
def _(t):
    return extend.evaluated(t.pred, t.test, extend.registered(["recall", "ndcg"], [10, 20])).select("metric", r6("value").alias("value"))
