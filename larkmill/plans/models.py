"""Queries over graphs (2.9), vectors and recommenders (2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkmill.functions.chance import normal_sql
from larkmill.operators import cluster, generate, graph, match, recommend, sequence, vector
from larkmill.operators.ranking import hash_order, top_k

from .base import query
from .sequences import KNN, RANKED
from .statistics import NMEAN, r6

LABELS = f"SELECT item_id, CASE WHEN r < floor(n * 0.2) THEN 'head' WHEN r >= floor(n * 0.8) THEN 'tail' ELSE 'mid' END AS label FROM ({RANKED})"


def long(df):
    """All dimensions, a row for each, rounded."""
    return df.select("item_id", F.posexplode("e").alias("d", "x")).select("item_id", F.col("d").cast("bigint").alias("d"), r6("x").alias("x"))


@query("grf_01_typed_graph", "SELECT src, dst, relation FROM b_edges WHERE dst IN (SELECT item_id FROM b_emb)")
def _(t):
    return t.edges.join(t.emb.select(F.col("item_id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation")


@query("grf_02_weighted_adjacency", "SELECT src, dst, round(w, 6) AS w FROM b_wedges")
def _(t):
    return t.wedges.select("src", "dst", r6("w").alias("w"))


@query("grf_03_reweighted", f"WITH l AS ({LABELS}) SELECT src, dst, round(w * CASE WHEN a.label = 'head' AND b.label = 'head' THEN 0.5 WHEN a.label || b.label IN ('headtail', 'tailhead') THEN 1.5 ELSE 1 END, 6) AS w FROM b_wedges JOIN l a ON a.item_id = src JOIN l b ON b.item_id = dst")
def _(t):
    return graph.reweighted(t.wedges, sequence.head_mid_tail(t.counts)).select("src", "dst", r6("w").alias("w"))


@query("grf_04_blend", f"WITH m AS ({NMEAN}), x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT x.item_id, x.d, round(CASE WHEN m IS NULL THEN v ELSE 0.7 * v + 0.3 * m END, 6) AS x FROM x LEFT JOIN m ON m.item_id = x.item_id AND m.d = x.d")
def _(t):
    return long(graph.blend(t.emb, t.wedges, 0.3))


INJECT = f"m AS ({NMEAN}), x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM x GROUP BY item_id), p AS (SELECT x.item_id, sum(m * v) / any_value(n) AS p FROM x JOIN m ON m.item_id = x.item_id AND m.d = x.d JOIN n ON n.item_id = x.item_id GROUP BY x.item_id), s AS (SELECT x.item_id, x.d, x.v, m.m - p * v / n AS s, n FROM x JOIN n ON n.item_id = x.item_id LEFT JOIN m ON m.item_id = x.item_id AND m.d = x.d LEFT JOIN p ON p.item_id = x.item_id), k AS (SELECT item_id, sqrt(sum(s * s)) AS k FROM s GROUP BY item_id)"


@query("grf_05_injection", f"WITH {INJECT} SELECT s.item_id, d, round(CASE WHEN n >= 1e-12 AND k >= 1e-12 THEN v + 0.3 * n * s / k ELSE v END, 6) AS x FROM s JOIN k ON k.item_id = s.item_id")
def _(t):
    return long(graph.inject(t.emb.select("item_id", "e"), t.wedges, 0.3))


@query("grf_06_centred", "WITH x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT item_id, d, round(v - avg(v) OVER (PARTITION BY d), 6) AS x FROM x")
def _(t):
    return long(vector.centred(t.emb))


@query("grf_07_co_occurrence", "WITH a AS (SELECT item_id AS src, lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS dst FROM b_seq), u AS (SELECT * FROM a WHERE src <> dst UNION ALL SELECT dst, src FROM a WHERE src <> dst) SELECT src, dst, count(*) AS n FROM u GROUP BY ALL")
def _(t):
    return graph.co_occurrence(t.seq)


@query("grf_08_rewired", "WITH e AS (SELECT src, dst FROM b_edges WHERE relation = 'also_viewed'), l AS (SELECT src, row_number() OVER (ORDER BY src, dst) AS r FROM e), h AS (SELECT dst, row_number() OVER (ORDER BY md5(concat(concat_ws('-', src, dst), '|n')), dst) AS r FROM e) SELECT DISTINCT src, dst FROM l JOIN h USING (r) WHERE src <> dst")
def _(t):
    return graph.rewired(t.edges.where("relation = 'also_viewed'"), "n")


@query("grf_09_knn_other_label", f"{KNN} SELECT item_id, nbr FROM p WHERE la <> lb AND cosine >= 0.05 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, nbr) <= 5")
def _(t):
    return vector.neighbours(t.emb, 5, group="label", floor=0.05).select("item_id", "nbr")


@query("grf_10_same_group_sample", "SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey QUALIFY row_number() OVER (PARTITION BY a.s_suppkey ORDER BY md5(concat(concat_ws('-', a.s_suppkey, b.s_suppkey), '|s')), b.s_suppkey) <= 3")
def _(t):
    s = t.supplier.select("s_nationkey", "s_suppkey")
    pairs = s.withColumnRenamed("s_suppkey", "src").join(s.withColumnRenamed("s_suppkey", "dst"), "s_nationkey").where("src <> dst")
    return top_k(pairs, ["src"], [hash_order(F.concat_ws("-", "src", "dst"), "s"), "dst"], 3).select("src", "dst")


@query("grf_11_interaction_edges", "SELECT least(x.user_id, y.user_id) AS a, greatest(x.user_id, y.user_id) AS b, round(sum(x.value + y.value), 4) AS w FROM events x JOIN events y ON y.event_id = x.event_id + 1 AND x.user_id <> y.user_id GROUP BY ALL")
def _(t):
    x, y = t.events.select("event_id", F.col("user_id").alias("u"), F.col("value").alias("v")), t.events.select((F.col("event_id") - 1).alias("event_id"), "user_id", "value")
    return x.join(y, "event_id").where("u <> user_id").groupBy(F.least("u", "user_id").alias("a"), F.greatest("u", "user_id").alias("b")).agg(F.round(F.sum(F.col("v") + F.col("value")), 4).alias("w"))


@query("grf_12_bounded_injection")
def _(t):
    def share(moved):
        near = vector.nearest_centroid(moved.select("item_id", F.col("e").alias("r")), t.codebook.where("level = 0").select("code", "centroid"))
        return near.groupBy("code").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).first()[0]

    moved, beta = graph.inject_bounded(t.emb.select("item_id", "e"), t.near_wedges, share, 0.15)
    return moved.select("item_id", F.lit(beta).alias("beta"), vector.norm(F.col("e")).alias("norm"))


@query("vec_01_distances", "SELECT item_id, code, round(list_sum(list_transform(list_zip(e, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM b_emb, b_code WHERE level = 0")
def _(t):
    c = t.codebook.where("level = 0").select(F.col("code").cast("bigint").alias("code"), "centroid")
    return t.emb.crossJoin(F.broadcast(c)).select("item_id", "code", r6(vector.squared_distance(F.col("e"), F.col("centroid"))).alias("d"))


@query("vec_02_normalised", "SELECT item_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS total FROM b_emb")
def _(t):
    return t.emb.select("item_id", r6(F.aggregate(vector.unit(F.col("e")), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("vec_03_random_start", "SELECT row_number() OVER (ORDER BY md5(concat(item_id, '|r')), item_id) - 1 AS code, round(e[1], 6) AS x FROM b_emb QUALIFY code < 8")
def _(t):
    return cluster.random_start(t.emb, 8, "r").select(F.col("code").cast("bigint").alias("code"), r6(F.col("centroid")[0]).alias("x"))


@query("vec_04_scalable_start")
def _(t):
    return cluster.kmeans_fit(t.emb, 8, seed=3, rounds=1)


@query("vec_05_lloyd")
def _(t):
    return cluster.lloyd(t.emb, cluster.random_start(t.emb, 8, "r"), rounds=5)


@query("vec_06_minibatch")
def _(t):
    book = [(r["code"], r["centroid"], 0) for r in cluster.random_start(t.emb, 8, "r").collect()]
    for k in range(2):
        book = cluster.minibatch_step(t.emb.where(F.col("item_id") % 2 == k), book)
    return t.spark.createDataFrame(book, "code int, centroid array<double>, seen bigint")


@query("vec_07_residuals", "SELECT item_id, round(list_sum(r), 6) AS total FROM b_r2")
def _(t):
    q = vector.residual_codes(t.emb.select("item_id", "e"), t.codebook, 1)
    return q.select("item_id", r6(F.aggregate("residual", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("vec_08_residual_quantization", "SELECT item_id, c1, c2, c3 FROM b_sid")
def _(t):
    return t.sid.select("item_id", "c1", "c2", "c3")


@query("vec_09_residual_fit")
def _(t):
    return cluster.residual_fit(t.emb, 8, 2)


@query("vec_10_assign_frozen", "SELECT c1, count(*) AS n FROM b_sid GROUP BY c1")
def _(t):
    return vector.residual_codes(t.emb.select("item_id", "e"), t.codebook, 1).groupBy("c1").agg(F.count("*").alias("n"))


@query("vec_12_reconstruction", "WITH x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT x.item_id, d, round(v - avg(v) OVER (PARTITION BY c1, d), 6) AS x FROM x JOIN b_sid USING (item_id)")
def _(t):
    joined = t.emb.join(t.sid.select("item_id", "c1"), "item_id")
    means = vector.group_mean(joined, ["c1"], "e", width=vector.width_of(t.emb, "e"))
    return long(joined.join(means, "c1").select("item_id", vector.minus(F.col("e"), F.col("mean")).alias("e")))


@query("vec_13_token_popularity", "SELECT c1::INT AS token, sum(cnt)::BIGINT AS pop, count(*) AS n FROM b_sid JOIN b_counts USING (item_id) GROUP BY c1")
def _(t):
    return match.token_popularity(t.sid, t.counts, "c1")


@query("vec_14_tokens_to_split", f"WITH l AS ({LABELS}), k AS (SELECT c1::INT AS token, sum(cnt)::BIGINT AS pop, avg((label = 'head')::INT) AS head, avg((label = 'tail')::INT) AS tail, count(*) OVER () AS n FROM b_sid JOIN b_counts USING (item_id) JOIN l USING (item_id) GROUP BY c1) SELECT token, pop FROM (SELECT *, row_number() OVER (ORDER BY pop DESC, token) AS r FROM k WHERE head > 0 AND tail < 0.5) WHERE r <= greatest(1, floor(n * 0.2))")
def _(t):
    return match.tokens_to_split(t.sid, t.counts, sequence.head_mid_tail(t.counts), "c1", 0.2)


@query("vec_15_adaptive_parts", "WITH k AS (SELECT c1::INT AS token, sum(cnt) AS pop FROM b_sid JOIN b_counts USING (item_id) GROUP BY c1) SELECT token, greatest(1, least(3, round_even(pop / avg(pop) OVER (), 0)))::BIGINT AS m FROM k")
def _(t):
    k = match.token_popularity(t.sid, t.counts, "c1").withColumn("avg", F.avg("pop").over(Window.partitionBy()))
    return k.select("token", F.greatest(F.lit(1), F.least(F.lit(3), F.bround(F.col("pop") / F.col("avg"), 0))).cast("bigint").alias("m"))


def first_residuals(t):
    return vector.residual_codes(t.emb.select("item_id", "e"), t.codebook, 1).select("item_id", F.col("residual").alias("r"))


@query("vec_16_split_slots")
def _(t):
    held = t.sid.join(t.counts, "item_id").join(first_residuals(t), "item_id")
    means = vector.group_mean(held.select(F.col("c1").alias("token"), F.col("c2").alias("child"), "r"), ["token", "child"], "r").withColumnRenamed("mean", "vec")
    sizes = held.groupBy(F.col("c1").alias("token"), F.col("c2").alias("child")).agg(F.count("*").alias("n"), F.sum("cnt").alias("pop"))
    return match.split_slots(sizes.join(means, ["token", "child"]), 3, 0.5)


@query("vec_17_rebalanced")
def _(t):
    return match.rebalance(t.sid.select("item_id", "c1", "c2", "c3"), t.counts, sequence.head_mid_tail(t.counts), first_residuals(t), 1)


@query("vec_18_token_report", "WITH k AS (SELECT c1, sum(cnt) AS x FROM b_sid JOIN b_counts USING (item_id) GROUP BY c1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM k) SELECT count(*) AS tokens, round(2 * sum(k * x) / (max(n) * sum(x))::DOUBLE - (max(n) + 1) / max(n)::DOUBLE, 6) AS gini FROM r")
def _(t):
    from larkmill.operators.stats import gini

    k = match.token_popularity(t.sid, t.counts, "c1")
    return k.agg(F.count("*").alias("tokens")).crossJoin(gini(k, "pop").select(r6("gini").alias("gini")))


@query("vec_19_binary_matrix", "SELECT user_id, count(DISTINCT item_id) AS items FROM b_train GROUP BY user_id")
def _(t):
    return t.train.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count("*").alias("items"))


@query("vec_20_most_popular", "SELECT user_id, item_id, rank FROM b_pred WHERE rank <= 10")
def _(t):
    return recommend.most_popular(t.counts, t.train, t.test.select("user_id").distinct(), 10).select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@query("vec_21_random_items", "SELECT u.user_id, c.item_id FROM (SELECT DISTINCT user_id FROM b_etarget) u, b_ecat c WHERE NOT EXISTS (SELECT 1 FROM b_etrain t WHERE t.user_id = u.user_id AND t.item_id = c.item_id) QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY md5(concat(concat_ws('-', u.user_id, c.item_id), '|q')), c.item_id) <= 10")
def _(t):
    return recommend.random_items(t.ecat, t.etrain, t.etarget.select("user_id").distinct(), 10, "q").select("user_id", "item_id")


SIMS = "WITH h AS (SELECT DISTINCT user_id, item_id FROM b_train), n AS (SELECT item_id, count(*) AS n FROM h GROUP BY item_id), s AS (SELECT a.item_id AS i, b.item_id AS j, round(count(*) / sqrt(any_value(x.n)::DOUBLE * any_value(y.n)), 9) AS sim FROM h a JOIN h b ON a.user_id = b.user_id AND a.item_id <> b.item_id JOIN n x ON x.item_id = a.item_id JOIN n y ON y.item_id = b.item_id GROUP BY a.item_id, b.item_id), k AS (SELECT * FROM s QUALIFY rank() OVER (PARTITION BY i ORDER BY sim DESC) <= 200)"


@query("vec_22_item_knn", f"{SIMS} SELECT h.user_id, j AS item_id, sum(round(sim * 1e9)::BIGINT)::DOUBLE / 1e9 AS score FROM h JOIN k ON k.i = h.item_id WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.user_id = h.user_id AND o.item_id = j) GROUP BY h.user_id, j QUALIFY row_number() OVER (PARTITION BY h.user_id ORDER BY sum(round(sim * 1e9)::BIGINT) DESC, j) <= 10")
def _(t):
    return recommend.history_knn(t.train, 10).select("user_id", "item_id", "score")


@query("vec_23_ease")
def _(t):
    return recommend.ease(t.etrain, 10)


CONTENT = "u AS (SELECT item_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM b_emb), h AS (SELECT DISTINCT user_id, item_id FROM b_etrain), p AS (SELECT user_id, d, avg(x) AS x FROM (SELECT user_id, unnest(u) AS x, unnest(range(64)) AS d FROM h JOIN u USING (item_id)) GROUP BY user_id, d), v AS (SELECT user_id, list(x ORDER BY d) AS v FROM p GROUP BY user_id), w AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v)"


@query("vec_24_content_knn", f"WITH {CONTENT} SELECT w.user_id, u.item_id, round(list_dot_product(v, u), 6) AS score FROM w, u WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = w.user_id AND h.item_id = u.item_id) QUALIFY row_number() OVER (PARTITION BY w.user_id ORDER BY round(list_dot_product(v, u), 9) DESC, u.item_id) <= 5")
def _(t):
    return recommend.content_knn(t.etrain, t.emb, 5).select("user_id", "item_id", r6("score").alias("score"))


@query("vec_25_seek_profiles", f"WITH {CONTENT} SELECT user_id, d, round(x, 6) AS x FROM (SELECT user_id, unnest(v) AS x, unnest(range(64)) AS d FROM w)")
def _(t):
    units = t.emb.select("item_id", vector.unit(F.col("e")).alias("u"))
    p = vector.group_mean(t.etrain.select("user_id", "item_id").distinct().join(units, "item_id"), ["user_id"], "u").select("user_id", vector.unit(F.col("mean")).alias("v"))
    return p.select("user_id", F.posexplode("v").alias("d", "x")).select("user_id", F.col("d").cast("bigint").alias("d"), r6("x").alias("x"))


@query("vec_26_neighbour_table", f"{KNN} SELECT item_id, nbr, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, nbr) AS rank FROM p QUALIFY rank <= 5")
def _(t):
    return vector.neighbours(t.emb, 5).select("item_id", "nbr", F.col("rank").cast("bigint").alias("rank"))


PAIRS = "WITH p AS (SELECT a.user_id AS a, b.user_id AS b, a.k AS score FROM (SELECT user_id, item_id, count(*) AS k FROM b_etrain GROUP BY ALL) a JOIN (SELECT DISTINCT user_id, item_id FROM b_etarget) b ON a.item_id = b.item_id AND a.user_id <> b.user_id), s AS (SELECT a, b, sum(score)::BIGINT AS score FROM p GROUP BY a, b)"


@query("vec_27_reciprocal", f"{PAIRS} SELECT x.a, x.b, least(x.score, y.score) AS score FROM s x JOIN s y ON x.a = y.b AND x.b = y.a")
def _(t):
    return match.reciprocal_overlap(t.etrain.groupBy("user_id", "item_id").agg(F.count("*").alias("k")), t.etarget)


def seated(t):
    people = t.supplier.select(F.col("s_suppkey").alias("person"), F.lit("guest").alias("role"), F.col("s_nationkey").alias("cohort"))
    return people, people.select("person", (F.pmod("person", F.lit(10))).cast("int").alias("table"))


@query("vec_28_annealed_tables")
def _(t):
    people, _ = seated(t)
    s = t.supplier.select("s_suppkey", "s_nationkey")
    a, b = s.withColumnRenamed("s_suppkey", "a").repartition(4 * t.spark.sparkContext.defaultParallelism), s.withColumnRenamed("s_suppkey", "b")
    scores = a.join(F.broadcast(b), "s_nationkey").where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    return match.assign_tables(people, scores, match.table_sizes(people.count()), rounds=3000)


@query("vec_29_table_report", "WITH p AS (SELECT s_suppkey AS person, s_suppkey % 10 AS t, s_nationkey FROM supplier), s AS (SELECT x.t, (x.s_nationkey = y.s_nationkey)::INT::DOUBLE AS score FROM p x JOIN p y ON x.t = y.t AND x.person < y.person) SELECT g.t::INT AS \"table\", any_value(g.n) AS seats, round(avg(score), 6) AS affinity FROM (SELECT t, count(*) AS n FROM p GROUP BY t) g LEFT JOIN s ON s.t = g.t GROUP BY g.t")
def _(t):
    _, at = seated(t)
    s = t.supplier.join(at, F.col("s_suppkey") == F.col("person")).select("table", "s_suppkey", "s_nationkey")
    o = s.select("table", F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nb"))
    scores = s.join(o, "table").where("s_suppkey < b").select(F.col("s_suppkey").alias("a"), "b", (F.col("s_nationkey") == F.col("nb")).cast("double").alias("score"))
    return match.table_report(at, scores).withColumn("affinity", r6("affinity"))


@query("vec_30_table_sizes", "WITH n AS (SELECT count(*) AS n, ceil(count(*) / 6.0)::BIGINT AS k FROM supplier) SELECT k AS tables, (n // k)::BIGINT AS least, (n // k + (n % k > 0)::INT)::BIGINT AS most, (n % k)::BIGINT AS larger FROM n")
def _(t):
    sizes = match.table_sizes(t.supplier.count())
    return t.spark.createDataFrame([(len(sizes), min(sizes), max(sizes), sum(s > min(sizes) for s in sizes))], "tables bigint, least bigint, most bigint, larger bigint")


@query("gen_03_noisy_vectors", f"WITH x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT item_id, d, round(greatest(-0.3, least(0.3, (v + 0.1 * {normal_sql('item_id, d', 1)}) * (0.88 + 0.012 * (item_id % 26)::DOUBLE))), 6) AS x FROM x")
def _(t):
    return long(generate.noisy_vectors(t.emb.select("item_id", "e"), 0.1, (F.col("item_id") % 26).cast("double"), -0.3, 0.3, seed=1))
