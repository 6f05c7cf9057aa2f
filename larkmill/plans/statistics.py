"""Queries over aggregations (2.6), ranking (2.7) and sets (2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkmill.functions.chance import uniform_sql
from larkmill.operators import evaluate, joins, ranking, sequence, stats, vector
from larkmill.operators.ranking import top_k

from .base import query
from .sequences import FUZZY, KNN, fuzzy


def r6(c):
    return F.round(c, 6)


@query("agg_01_popularity", "SELECT item_id, count(*) AS cnt FROM b_inter GROUP BY item_id")
def _(t):
    return t.inter.groupBy("item_id").agg(F.count("*").alias("cnt"))


@query("agg_02_group_statistics", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(median(value), 6) AS med, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("med"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("agg_03_quantiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in stats.QUANTILES) + " FROM events GROUP BY event_type")
def _(t):
    q = stats.quantiles(t.events, "value", ["event_type"])
    return q.select("event_type", "n", *(r6(c).alias(c) for c in q.columns[2:]))


GINI = "coalesce(2 * sum(k * cnt) / nullif(max(n) * sum(cnt), 0)::DOUBLE - (max(n) + 1) / max(n)::DOUBLE, 0)"


@query("agg_04_gini", f"SELECT round({GINI}, 6) AS gini FROM (SELECT cnt, row_number() OVER (ORDER BY cnt) AS k, count(*) OVER () AS n FROM b_counts)")
def _(t):
    return stats.gini(t.counts, "cnt").select(r6("gini").alias("gini"))


@query("agg_05_top_share", "SELECT round(sum(CASE WHEN k <= greatest(1, floor(n * 0.2)) THEN cnt ELSE 0 END) / sum(cnt), 6) AS share FROM (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, item_id) AS k, count(*) OVER () AS n FROM b_counts)")
def _(t):
    return stats.top_share(t.counts, "item_id", "cnt", 0.2).select(r6("share").alias("share"))


@query("agg_06_shares", "SELECT round(avg((n <= 10)::INT), 6) AS few, round(avg((n >= 50)::INT), 6) AS many FROM (SELECT count(*) AS n FROM b_inter GROUP BY user_id)")
def _(t):
    n = t.inter.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(r6(F.avg((F.col("n") <= 10).cast("double"))).alias("few"), r6(F.avg((F.col("n") >= 50).cast("double"))).alias("many"))


@query("agg_07_items_for_mass", "WITH s AS (SELECT row_number() OVER w AS r, sum(cnt) OVER (ORDER BY cnt DESC, item_id ROWS UNBOUNDED PRECEDING) AS s, sum(cnt) OVER () AS total FROM b_counts WINDOW w AS (ORDER BY cnt DESC, item_id)) SELECT x.share::DOUBLE AS share, min(r) AS items FROM s, (VALUES (0.5), (0.8), (0.9)) x(share) WHERE s >= x.share::DOUBLE * total GROUP BY x.share")
def _(t):
    return stats.items_for_mass(t.counts, "item_id", "cnt", [0.5, 0.8, 0.9])


@query("agg_08_density", "SELECT chunk, count(*) AS n, round(count(*) / greatest(count(DISTINCT user_id) * count(DISTINCT item_id), 1), 6) AS density, round(count(*) / greatest(date_diff('day', min(ts), max(ts)), 1), 6) AS per_day FROM b_chunk GROUP BY chunk")
def _(t):
    days = F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts")))
    return t.chunked.groupBy("chunk").agg(F.count("*").alias("n"), r6(F.count("*") / F.greatest(F.count_distinct("user_id") * F.count_distinct("item_id"), F.lit(1))).alias("density"), r6(F.count("*") / F.greatest(days, F.lit(1))).alias("per_day"))


@query("agg_09_active_span", "SELECT user_id, date_diff('day', min(ts), max(ts)) AS days FROM b_inter GROUP BY user_id HAVING count(*) >= 2")
def _(t):
    return t.inter.groupBy("user_id").agg(F.count("*").alias("n"), F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).cast("bigint").alias("days")).where("n >= 2").drop("n")


@query("agg_10_gaps", "SELECT round(avg(d), 6) AS mean, round(avg((d = 0)::INT), 6) AS same_day FROM (SELECT date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY pos), ts) AS d FROM b_seq) WHERE d IS NOT NULL")
def _(t):
    d = F.date_diff(F.to_date("ts"), F.to_date(F.lag("ts").over(Window.partitionBy("user_id").orderBy("pos"))))
    return t.seq.select(d.alias("d")).where("d is not null").agg(r6(F.avg("d")).alias("mean"), r6(F.avg((F.col("d") == 0).cast("double"))).alias("same_day"))


@query("agg_11_value_shares", "SELECT c_mktsegment, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def _(t):
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.select("c_mktsegment", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("agg_12_vocabulary_coverage", "WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM conversations), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, w) AS k FROM c) SELECT round(sum(CASE WHEN k <= 100 THEN n ELSE 0 END) / sum(n), 6) AS covered FROM r")
def _(t):
    c = t.conversations.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "w").limit(100).agg(F.sum("n").alias("a"))
    return c.agg(F.sum("n").alias("b")).crossJoin(top).select(r6(F.col("a") / F.col("b")).alias("covered"))


@query("agg_13_mean_vector", "SELECT d, round(avg(x), 6) AS mean FROM (SELECT unnest(e) AS x, unnest(range(64)) AS d FROM b_emb) GROUP BY d")
def _(t):
    m = vector.group_mean(t.emb.withColumn("g", F.lit(0)), ["g"], "e", width=vector.width_of(t.emb, "e"))
    return m.select(F.posexplode("mean").alias("d", "m")).select(F.col("d").cast("bigint").alias("d"), r6("m").alias("mean"))


NMEAN = "SELECT w.src AS item_id, d, sum(w.w * x.v) / sum(w.w) AS m FROM b_wedges w JOIN (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) x ON w.dst = x.item_id GROUP BY w.src, d"


@query("agg_14_neighbour_means", f"SELECT item_id, d, round(m, 6) AS mean FROM ({NMEAN})")
def _(t):
    from larkmill.operators.graph import neighbour_means

    return neighbour_means(t.wedges, t.emb).select("item_id", F.posexplode("mean").alias("d", "m")).select("item_id", F.col("d").cast("bigint").alias("d"), r6("m").alias("mean"))


@query("agg_15_code_entropy", "WITH l AS (SELECT 1 AS level, c1 AS code FROM b_sid UNION ALL SELECT 2, c2 FROM b_sid UNION ALL SELECT 3, c3 FROM b_sid), p AS (SELECT level, code, count(*) / sum(count(*)) OVER (PARTITION BY level) AS p FROM l GROUP BY level, code) SELECT level, count(*) AS used, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY level")
def _(t):
    long = t.sid.select(F.posexplode(F.array("c1", "c2", "c3")).alias("i", "code")).select((F.col("i") + 1).alias("level"), "code")
    return stats.entropy_bits(long, ["level"], "code").select("level", "used", r6("bits").alias("bits"))


@query("agg_16_collisions", "WITH k AS (SELECT *, count(*) OVER (PARTITION BY c1, c2, c3) AS k FROM b_sid) SELECT round(100 * avg((k = 1)::INT), 6) AS unique_pct, count(*) FILTER (k > 1) AS collided, max(k) AS largest, max(dis)::BIGINT AS max_serial FROM k")
def _(t):
    k = t.sid.withColumn("k", F.count("*").over(Window.partitionBy("c1", "c2", "c3")))
    return k.agg(r6(100 * F.avg((F.col("k") == 1).cast("double"))).alias("unique_pct"), F.count_if(F.col("k") > 1).alias("collided"), F.max("k").alias("largest"), F.max("dis").cast("bigint").alias("max_serial"))


@query("agg_17_quantizer_report", "SELECT round(avg(list_dot_product(r, r)) / 64, 6) AS mse, round(avg(sqrt(list_dot_product(r, r)) / sqrt(list_dot_product(e, e))), 6) AS norm_ratio FROM b_r4 JOIN b_emb USING (item_id)")
def _(t):
    q = vector.residual_codes(t.emb.select("item_id", "e"), t.codebook, 3)
    n = lambda c: vector.dot(F.col(c), F.col(c))
    return q.agg(r6(F.avg(n("residual")) / 64).alias("mse"), r6(F.avg(F.sqrt(n("residual")) / F.sqrt(n("e")))).alias("norm_ratio"))


@query("agg_18_purity", "SELECT round(avg(m / k), 6) AS purity, count(*) AS groups FROM (SELECT c1, max(n) AS m, sum(n) AS k FROM (SELECT c1, label, count(*) AS n FROM b_sid JOIN b_emb USING (item_id) GROUP BY c1, label) GROUP BY c1) WHERE k > 1")
def _(t):
    return stats.purity(t.sid.join(t.emb.select("item_id", "label"), "item_id"), "c1", "label").select(r6("purity").alias("purity"), "groups")


@query("agg_19_crosstab", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment = 'BUILDING') > 0 AND count(*) FILTER (c_mktsegment = 'MACHINERY') > 0 AS mixed FROM customer GROUP BY c_nationkey")
def _(t):
    p = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    b, m = F.coalesce("BUILDING", F.lit(0)), F.coalesce("MACHINERY", F.lit(0))
    return p.select("c_nationkey", b.alias("building"), m.alias("machinery"), ((b > 0) & (m > 0)).alias("mixed"))


@query("agg_20_random_purity", "SELECT round(sum(p * p), 6) AS purity FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)")
def _(t):
    n = t.emb.groupBy("label").agg(F.count("*").alias("n"))
    return n.select((F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p")).agg(r6(F.sum(F.col("p") * F.col("p"))).alias("purity"))


@query("agg_21_degrees", "WITH d AS (SELECT p_partkey, count(dst) AS d FROM part LEFT JOIN b_wedges ON src = p_partkey GROUP BY p_partkey), c AS (SELECT item_id, cnt FROM b_counts) SELECT round(avg(d), 6) AS mean, max(d) AS most, count(*) FILTER (d = 0) AS isolated, round(corr(d, cnt), 6) AS corr FROM d JOIN c ON item_id = p_partkey")
def _(t):
    d = t.parts.join(t.wedges.groupBy(F.col("src").alias("item_id")).agg(F.count_distinct("dst").alias("d")), "item_id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return d.join(t.counts, "item_id").agg(r6(F.avg("d")).alias("mean"), F.max("d").alias("most"), F.count_if(F.col("d") == 0).alias("isolated"), r6(F.corr("d", "cnt")).alias("corr"))


@query("agg_22_vector_statistics", "SELECT item_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_avg(e), 6) AS mean, round(list_stddev_samp(e), 6) AS sd, round(list_min(e), 6) AS lo, round(list_max(e), 6) AS hi FROM b_emb")
def _(t):
    x = t.emb.select("item_id", F.explode("e").alias("x"))
    return x.groupBy("item_id").agg(r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("norm"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("sd"), r6(F.min("x")).alias("lo"), r6(F.max("x")).alias("hi"))


@query("agg_23_anisotropy", "WITH u AS (SELECT unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x, unnest(range(64)) AS d FROM b_emb), s AS (SELECT sum(x) AS s FROM u GROUP BY d), n AS (SELECT count(*) AS n FROM b_emb) SELECT round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine FROM s, n")
def _(t):
    s = t.emb.select(F.posexplode(vector.unit(F.col("e"))).alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    return s.crossJoin(t.emb.agg(F.count("*").alias("n"))).select(r6((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


@query("agg_24_group_vectors", "SELECT label, d, round(avg(x), 6) AS mean FROM (SELECT label, unnest(e) AS x, unnest(range(64)) AS d FROM b_emb) GROUP BY label, d")
def _(t):
    return vector.group_mean(t.emb, ["label"], "e", width=vector.width_of(t.emb, "e")).select("label", F.posexplode("mean").alias("d", "m")).select("label", F.col("d").cast("bigint").alias("d"), r6("m").alias("mean"))


@query("agg_25_pca")
def _(t):
    from larkmill.operators.cluster import principal_components

    return principal_components(t.emb, 2)


@query("agg_26_relation_summary", "SELECT relation, count(*) AS edges, count(DISTINCT (src, dst)) AS pairs, count(DISTINCT src) AS sources FROM b_edges GROUP BY relation")
def _(t):
    return t.edges.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src", "dst").alias("pairs"), F.count_distinct("src").alias("sources"))


@query("agg_27_kappa", "WITH r AS (SELECT quality AS a, toxic AS b FROM labels), p AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM r) SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM p")
def _(t):
    p = t.labels.agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("po"), F.avg("quality").alias("pa"), F.avg("toxic").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return p.select("n", r6("po").alias("agreement"), r6((F.col("po") - pe) / (1 - pe)).alias("kappa"))


@query("agg_28_run_summary", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best, last(value ORDER BY ts) AS last FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.max_by("value", "ts").alias("last"))


@query("agg_29_match_bands", f"{FUZZY}, m AS (SELECT a, max(score) AS s FROM s GROUP BY a), b AS (SELECT CASE WHEN s >= 0.6 THEN 'auto' WHEN s >= 0.35 THEN 'review' ELSE 'none' END AS band FROM m) SELECT band, count(*) AS n FROM b GROUP BY band")
def _(t):
    m = fuzzy(t).groupBy("a").agg(F.max("score").alias("s"))
    return m.select(F.when(F.col("s") >= 0.6, "auto").when(F.col("s") >= 0.35, "review").otherwise("none").alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("agg_30_agreement", "SELECT round(avg((quality = 1)::INT) FILTER (toxic = 0), 6) AS rate FROM labels")
def _(t):
    return t.labels.where("toxic = 0").agg(r6(F.avg((F.col("quality") == 1).cast("double"))).alias("rate"))


@query("rnk_01_top_k", "SELECT user_id, item_id, rank FROM b_pred")
def _(t):
    return t.pred.select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@query("rnk_02_partial_top_k", f"{KNN} SELECT item_id, nbr FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, nbr) <= 10")
def _(t):
    return vector.neighbours(t.emb, 10).select("item_id", "nbr")


@query("rnk_03_most_common", "SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) <= 2")
def _(t):
    return top_k(t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), ["c_nationkey"], [F.desc("n"), "c_mktsegment"], 2).drop("rank")


@query("rnk_04_first_k", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5")
def _(t):
    return top_k(t.part.select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 5).drop("rank")


@query("rnk_05_strict_rank", "WITH s AS (SELECT a.item_id, b.item_id AS cand, a.label = b.label AND b.item_id = (a.item_id + 1) % 500 AS target, round(list_dot_product(a.e, b.e), 9) AS s FROM b_emb a JOIN b_emb b ON a.item_id <> b.item_id AND a.label = b.label), g AS (SELECT item_id, max(s) FILTER (target) AS ts FROM s GROUP BY item_id HAVING max(s) FILTER (target) IS NOT NULL) SELECT count(DISTINCT item_id) AS n, round(avg(1 / (r + 1)), 6) AS mrr FROM (SELECT s.item_id, count(*) FILTER (s.s > g.ts) AS r FROM s JOIN g USING (item_id) GROUP BY s.item_id)")
def _(t):
    r = evaluate.strict_ranks(t.emb, (F.col("item_id") + 1) % 500)
    return r.agg(F.count("*").alias("n"), r6(F.avg(1 / (F.col("r") + 1))).alias("mrr"))


@query("rnk_06_fraction_cut", "SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY cnt DESC, item_id) AS k, count(*) OVER () AS n FROM b_counts) WHERE k <= floor(n * 0.1)")
def _(t):
    return sequence.popularity_rank(t.counts).where(F.col("r") < F.floor(F.col("n_items") * 0.1)).select("item_id")


@query("rnk_07_serials", "SELECT item_id, dis FROM b_sid")
def _(t):
    return t.sid.select("item_id", "dis")


@query("rnk_08_transpose", "UNPIVOT (SELECT item_id, c1, c2, c3 FROM b_sid) ON c1, c2, c3 INTO NAME level VALUE code")
def _(t):
    return t.sid.select("item_id", "c1", "c2", "c3").unpivot(["item_id"], ["c1", "c2", "c3"], "level", "code")


LAM = "(VALUES (0.0::DOUBLE), (0.1), (0.5), (1.0)) x(lam)"
SCORED = "SELECT user_id, item_id, rank, 1.0::DOUBLE / (1 + rank) AS score FROM b_pred"
RERANK = f"WITH s AS ({SCORED}), q AS (SELECT lam, user_id, item_id, rank, round(ln(greatest(score, 1e-30)) - lam * ln(1 + cnt), 9) AS adj FROM s JOIN b_counts USING (item_id), {LAM}), n AS (SELECT *, row_number() OVER (PARTITION BY lam, user_id ORDER BY CASE WHEN lam = 0 THEN 0 ELSE -adj END, rank) AS new_rank FROM q)"


def scored(t):
    return t.pred.select("user_id", "item_id", "rank", (1.0 / (1 + F.col("rank"))).alias("score"))


def sweep(t):
    lams = F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.5, 1.0)))).alias("lam")
    return ranking.rerank_popularity(scored(t).select("*", lams), t.counts, F.col("lam"), ["lam"])


@query("rnk_09_popularity_rerank", f"{RERANK} SELECT user_id, item_id, new_rank FROM n WHERE lam = 0.5")
def _(t):
    return ranking.rerank_popularity(scored(t), t.counts, F.lit(0.5)).select("user_id", "item_id", F.col("new_rank").cast("bigint").alias("new_rank"))


@query("rnk_10_exposure_rerank")
def _(t):
    return ranking.rerank_exposure(scored(t), 0.5)


@query("rnk_11_sweep", f"{RERANK} SELECT lam, count(DISTINCT item_id) AS coverage, round(avg(cnt), 6) AS popularity FROM n JOIN b_counts USING (item_id) WHERE new_rank <= 10 GROUP BY lam")
def _(t):
    return sweep(t).where("new_rank <= 10").groupBy("lam").agg(F.count_distinct("item_id").alias("coverage"), r6(F.avg("cnt")).alias("popularity"))


@query("rnk_12_pareto", "WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, (s_suppkey * 37) % 101 AS y FROM supplier) SELECT id, EXISTS (SELECT 1 FROM p o WHERE o.id <> p.id AND o.x >= p.x AND o.y >= p.y AND (o.x > p.x OR o.y > p.y)) AS dominated FROM p")
def _(t):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") * 37) % 101).alias("y"))
    return ranking.pareto(p, "x", "y", "id").select("id", "dominated")


@query("rnk_13_pooling", "WITH h AS (SELECT user_id, list(item_id ORDER BY pos) AS s FROM b_seq GROUP BY user_id) SELECT user_id, s[1] AS first, s[-1] AS last, round(list_avg(list_slice(s, -5, -1)), 6) AS mean_last FROM h")
def _(t):
    h = sequence.histories(t.seq)
    five = sequence.trim_last(F.col("items"), 5)
    return h.select("user_id", F.col("items")[0].alias("first"), F.element_at("items", -1).alias("last"), r6(F.aggregate(five, F.lit(0.0), lambda a, x: a + x) / F.size(five)).alias("mean_last"))


@query("rnk_14_list_dedup", "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY min(pos)) AS rank FROM b_seq GROUP BY user_id, item_id")
def _(t):
    d = ranking.dedup_list(t.seq.select("user_id", "item_id", F.col("pos").alias("rank")))
    return d.select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@query("rnk_15_reach", "SELECT count(DISTINCT item_id) FILTER (rank <= 10) AS r10, count(DISTINCT item_id) FILTER (rank <= 50) AS r50, count(DISTINCT item_id) AS r200 FROM b_epred")
def _(t):
    return t.epred.agg(*(F.count_distinct(F.when(F.col("rank") <= d, F.col("item_id"))).alias(f"r{d}") for d in (10, 50, 200)))


@query("rnk_16_capped_slots")
def _(t):
    return ranking.exposure_slots(t.pred, 5, 30, explore=2)


@query("rnk_17_gumbel_sample", f"SELECT item_id, round(g, 6) AS g FROM (SELECT item_id, ln(cnt) - ln(-ln({uniform_sql('item_id', 3)})) AS g FROM b_counts WHERE cnt > 0) ORDER BY g DESC, item_id LIMIT 50")
def _(t):
    u = ranking.uniform("item_id", seed=3)
    return t.counts.where("cnt > 0").withColumn("g", F.log("cnt") + ranking.gumbel(u)).orderBy(F.desc("g"), "item_id").limit(50).select("item_id", r6("g").alias("g"))


@query("set_01_union", "SELECT src, dst, relation FROM b_edges")
def _(t):
    return t.edges


@query("set_02_reverse_union", "SELECT count(*) AS n FROM (SELECT src, dst FROM b_edges UNION SELECT dst, src FROM b_edges)")
def _(t):
    e = t.edges.select("src", "dst")
    return e.union(e.select("dst", "src")).distinct().agg(F.count("*").alias("n"))


@query("set_03_distinct", "SELECT DISTINCT user_id, item_id FROM b_inter")
def _(t):
    return t.inter.select("user_id", "item_id").dropDuplicates(["user_id", "item_id"])


@query("set_04_intersection", "SELECT user_id, item_id FROM b_test INTERSECT SELECT user_id, item_id FROM b_pred")
def _(t):
    # as a join, which keeps the hint of the staged table; an intersection loses it
    found = t.pred.select(F.col("user_id").alias("__u"), F.col("item_id").alias("__i"))
    return t.test.join(found, F.col("user_id").eqNullSafe(F.col("__u")) & F.col("item_id").eqNullSafe(F.col("__i")), "left_semi").distinct()


@query("set_05_difference", "SELECT p_partkey AS item_id FROM part EXCEPT SELECT item_id FROM b_pred")
def _(t):
    return t.parts.join(t.pred.select("item_id").distinct(), "item_id", "left_anti")


NB = "SELECT src AS item_id, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM b_wedges"


def graph_top(t, k=10):
    return top_k(t.wedges, ["src"], [F.desc("w"), "dst"], k).groupBy(F.col("src").alias("item_id")).agg(F.collect_set("dst").alias("a"))


@query("set_06_jaccard", f"{KNN}, g AS (SELECT item_id, list(dst) AS a FROM ({NB}) WHERE k <= 10 GROUP BY item_id), x AS (SELECT item_id, list(nbr) AS b FROM (SELECT item_id, nbr FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, nbr) <= 10) GROUP BY item_id) SELECT count(*) AS n, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS jaccard FROM g JOIN x USING (item_id)")
def _(t):
    x = vector.neighbours(t.emb, 10).groupBy("item_id").agg(F.collect_set("nbr").alias("b"))
    return graph_top(t).join(x, "item_id").agg(F.count("*").alias("n"), r6(F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))).alias("jaccard"))


@query("set_07_overlap_share", f"{KNN}, g AS (SELECT item_id, dst FROM ({NB}) WHERE k <= 10), x AS (SELECT item_id, nbr FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, nbr) <= 10) SELECT x.item_id, count(g.dst) / 10 AS share FROM x LEFT JOIN g ON g.item_id = x.item_id AND g.dst = x.nbr GROUP BY x.item_id")
def _(t):
    x = vector.neighbours(t.emb, 10).groupBy("item_id").agg(F.collect_set("nbr").alias("b"))
    return x.join(graph_top(t), "item_id", "left").select("item_id", (F.size(F.array_intersect(F.coalesce("a", F.array().cast("array<bigint>")), "b")) / 10).alias("share"))


@query("set_08_pair_agreement", "WITH s AS (SELECT item_id, c1, label FROM b_sid JOIN b_emb USING (item_id)) SELECT count(*) FILTER (a.c1 = b.c1) AS same_code, count(*) FILTER (a.c1 = b.c1 AND a.label = b.label) AS both_same FROM s a JOIN s b ON a.item_id < b.item_id")
def _(t):
    # pairs are counted from group sizes; no pair is formed
    s = t.sid.join(t.emb.select("item_id", "label"), "item_id")
    pairs = lambda *k: s.groupBy(*k).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    return pairs("c1").toDF("same_code").crossJoin(pairs("c1", "label").toDF("both_same"))


@query("set_09_concat", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("set_10_attribute_neighbours", "SELECT a.p_partkey AS item_id, b.p_partkey AS nbr FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.p_brand = b.p_brand) DESC, b.p_partkey) <= 5")
def _(t):
    return joins.attribute_neighbours(t.part.select("p_type", "p_size", "p_brand", F.col("p_partkey").alias("item_id")), ["p_type", "p_size"], "p_brand", 5)


