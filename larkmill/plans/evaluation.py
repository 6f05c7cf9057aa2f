"""Queries over generation, evaluation and statistics (2.11), stream forms (2.13) and generators (2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkmill.functions.chance import poisson_sql, uniform_sql
from larkmill.operators import evaluate, ranking, recommend, sequence, stats
from larkmill.operators.ranking import hash_order
from larkmill.operators.staging import staged

from .base import CODES, query
from .sequences import BUCKET, RANKED, TIER
from .statistics import r6

KS = [10, 20, 50]
TRANS = f"tr AS (SELECT level, prev, code, (1 + (level * 31 + (prev + 1) * 7 + code * 13) % 17) / 100.0::DOUBLE AS p FROM (SELECT 0 AS level, -1 AS prev, unnest(range({CODES})) AS code UNION ALL SELECT l, a, unnest(range({CODES})) FROM (SELECT unnest(range({CODES})) AS a, l FROM (VALUES (1), (2)) x(l))))"


def transitions(t):
    codes = t.spark.range(CODES)
    first = codes.select(F.lit(0).alias("level"), F.lit(-1).alias("prev"), F.col("id").cast("int").alias("code"))
    rest = codes.select(F.col("id").cast("int").alias("prev")).crossJoin(codes.select(F.col("id").cast("int").alias("code"))).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("level"), "prev", "code")
    return first.unionByName(rest).withColumn("p", (1 + (F.col("level") * 31 + (F.col("prev") + 1) * 7 + F.col("code") * 13) % 17) / 100.0)


def beams(valid: str) -> str:
    sql = f"WITH {TRANS}, s0 AS (SELECT [code]::INT[] AS path, round(ln(p), 9) AS logp, code AS prev FROM tr WHERE level = 0), k0 AS (SELECT * FROM s0 {valid.format(n=1)} ORDER BY logp DESC, path LIMIT 20)"
    for k in (1, 2):
        sql += f", s{k} AS (SELECT list_append(path, tr.code::INT) AS path, round(logp + ln(p), 9) AS logp, tr.code AS prev FROM k{k - 1} b JOIN tr ON tr.level = {k} AND tr.prev = b.prev), k{k} AS (SELECT * FROM s{k} {valid.format(n=k + 1)} ORDER BY logp DESC, path LIMIT 20)"
    return sql + " SELECT path, round(logp, 6) AS logp FROM k2"


@query("evl_01_beam_search", beams(""))
def _(t):
    return evaluate.beam_search(transitions(t), 20, 3).select("path", r6("logp").alias("logp"))


@query("evl_02_constrained_beam", beams("WHERE path IN (SELECT list_slice([c1, c2, c3], 1, {n}) FROM b_sid)"))
def _(t):
    return evaluate.beam_search(transitions(t), 20, 3, valid=t.sid).select("path", r6("logp").alias("logp"))


GENERATED = "g AS (SELECT item_id AS id, (c1 + id % 3)::INT % 16 AS c1, (c2 + id % 2)::INT % 16 AS c2, c3 FROM (SELECT *, item_id AS id FROM b_sid))"


def generated(t):
    i = F.col("item_id")
    return t.sid.select(i.alias("id"), ((F.col("c1") + i % 3) % 16).cast("int").alias("c1"), ((F.col("c2") + i % 2) % 16).cast("int").alias("c2"), "c3")


@query("evl_04_nearest_valid", f"WITH {GENERATED} SELECT g.id, arg_min(s.item_id, (-((g.c1 = s.c1)::INT + (g.c2 = s.c2)::INT + (g.c3 = s.c3)::INT), s.item_id)) AS nearest FROM g, b_sid s GROUP BY g.id")
def _(t):
    return evaluate.nearest_valid(generated(t), t.sid, ["c1", "c2", "c3"]).select("id", "nearest")


@query("evl_05_exact_lookup", f"WITH {GENERATED}, o AS (SELECT c1, c2, c3, min(item_id) AS item_id FROM b_sid GROUP BY ALL) SELECT g.id, coalesce(o.item_id, -1) AS item_id FROM g LEFT JOIN o USING (c1, c2, c3)")
def _(t):
    one = t.sid.groupBy("c1", "c2", "c3").agg(F.min("item_id").alias("item_id"))
    return generated(t).join(one, ["c1", "c2", "c3"], "left").select("id", F.coalesce("item_id", F.lit(-1)).alias("item_id"))


def metrics(pred, target, ks="10, 20, 50"):
    return f"""hits AS (SELECT p.user_id, k, count(x.item_id) FILTER (rank <= k) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k AND x.item_id IS NOT NULL), 0) AS dcg FROM {pred} p LEFT JOIN {target} x ON x.user_id = p.user_id AND x.item_id = p.item_id, (SELECT unnest([{ks}]) AS k) GROUP BY p.user_id, k),
nt AS (SELECT user_id, count(*) AS n FROM {target} GROUP BY user_id), pu AS (SELECT user_id, k, hits / n AS recall, (hits > 0)::INT::DOUBLE AS hr, dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM hits JOIN nt USING (user_id))"""


@query("evl_06_user_metrics", f"WITH {metrics('b_pred', 'b_test')} SELECT user_id, k, round(recall, 6) AS recall, hr, round(ndcg, 6) AS ndcg FROM pu")
def _(t):
    return evaluate.per_user(t.pred, t.test, KS).select("user_id", "k", r6("recall").alias("recall"), "hr", r6("ndcg").alias("ndcg"))


def bundle_sql(pred, target, counts, catalog):
    return f"""WITH {metrics(pred, target)}, tl AS (SELECT item_id, r >= floor(n * (1 - 0.8::DOUBLE)) AS tail FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, item_id) - 1 AS r, count(*) OVER () AS n FROM {counts})), ks AS (SELECT unnest([10, 20, 50]) AS k),
ul AS (SELECT k, user_id, sum(tail::INT) AS t, count(*) AS n FROM {pred} JOIN tl USING (item_id), ks WHERE rank <= k GROUP BY k, user_id),
ex AS (SELECT k, c.item_id, count(p.item_id) FILTER (p.rank <= k) AS x FROM {catalog} c CROSS JOIN ks LEFT JOIN {pred} p ON p.item_id = c.item_id GROUP BY k, c.item_id),
gi AS (SELECT k, avg((x > 0)::INT) AS coverage, coalesce(2 * sum(r * x) / nullif(max(n) * sum(x), 0)::DOUBLE - (max(n) + 1) / max(n)::DOUBLE, 0) AS exposure_gini FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) AS r, count(*) OVER (PARTITION BY k) AS n FROM ex) GROUP BY k),
w AS (SELECT a.*, b.aplt, b.tail_exposure, gi.coverage, gi.exposure_gini FROM (SELECT k, avg(recall) AS recall, avg(hr) AS hr, avg(ndcg) AS ndcg FROM pu GROUP BY k) a JOIN (SELECT k, avg(t / n) AS aplt, sum(t) / greatest(1, sum(n)) AS tail_exposure FROM ul GROUP BY k) b ON a.k = b.k JOIN gi ON gi.k = a.k)
SELECT k, metric, round(value, 6) AS value FROM (UNPIVOT w ON recall, hr, ndcg, aplt, tail_exposure, coverage, exposure_gini INTO NAME metric VALUE value)"""


@query("evl_07_metric_bundle", bundle_sql("b_pred", "b_test", "b_counts", "(SELECT p_partkey AS item_id FROM part)"))
def _(t):
    return evaluate.bundle(t.pred, t.test, sequence.long_tail(t.counts, 0.8), t.parts, KS)


@query("evl_08_exposure", bundle_sql("b_epred", "b_etarget", "b_ecounts", "b_ecat"))
def _(t):
    return evaluate.bundle(t.epred, t.etarget, sequence.long_tail(t.ecounts, 0.8), t.ecat, KS)


def group_sql(expr, group):
    return f"SELECT {group}, count(*) AS n, round(avg((p.item_id IS NOT NULL)::INT), 6) AS recall FROM b_etarget x LEFT JOIN (SELECT * FROM b_epred WHERE rank <= 50) p ON p.user_id = x.user_id AND p.item_id = x.item_id LEFT JOIN (SELECT item_id, {expr} AS {group} FROM b_ecounts) g ON g.item_id = x.item_id GROUP BY {group}"


@query("evl_09_bucket_recall", group_sql(BUCKET, "bucket"))
def _(t):
    g = t.ecounts.select("item_id", sequence.bucket(F.col("cnt")).alias("bucket"))
    return evaluate.group_recall(t.epred, t.etarget, g, "bucket", 50, False).withColumn("recall", r6("recall"))


@query("evl_10_tier_recall", group_sql(TIER, "tier"))
def _(t):
    g = t.ecounts.select("item_id", sequence.cold_tier(F.col("cnt")).alias("tier"))
    return evaluate.group_recall(t.epred, t.etarget, g, "tier", 50, True).withColumn("recall", r6("recall"))


@query("evl_11_clamped_recall", "SELECT x.user_id, round(count(p.item_id) / greatest(1, least(count(*), 10)), 6) AS recall FROM b_etarget x LEFT JOIN (SELECT * FROM b_epred WHERE rank <= 10) p ON p.user_id = x.user_id AND p.item_id = x.item_id GROUP BY x.user_id")
def _(t):
    return evaluate.clamped_recall(t.epred, t.etarget, 10).withColumn("recall", r6("recall"))


@query("evl_12_sid_match", f"WITH {GENERATED} SELECT g.id, (g.c1 = s.c1 AND g.c2 = s.c2 AND g.c3 = s.c3) AS hit FROM g JOIN b_sid s ON s.item_id = g.id")
def _(t):
    truth = t.sid.select(F.col("item_id").alias("id"), F.array("c1", "c2", "c3").alias("want"))
    return generated(t).select("id", F.array("c1", "c2", "c3").alias("got")).join(truth, "id").select("id", (F.col("got") == F.col("want")).alias("hit"))


@query("evl_13_sampled_retrieval", f"""WITH q AS (SELECT * FROM (SELECT item_id, e, lead(item_id) OVER (PARTITION BY label ORDER BY item_id) AS positive FROM b_emb) WHERE positive IS NOT NULL),
c AS (SELECT item_id, e, row_number() OVER (ORDER BY item_id) - 1 AS r FROM b_emb), d AS (SELECT item_id AS query_id, e, positive, unnest(range(30)) AS d FROM q),
n AS (SELECT query_id, round(list_dot_product(d.e, c.e), 9) AS x FROM d JOIN c ON c.r = floor({uniform_sql('query_id, d', 13)} * (SELECT count(*) FROM b_emb))::BIGINT AND c.item_id <> positive),
p AS (SELECT q.item_id AS query_id, positive, round(list_dot_product(q.e, c.e), 9) AS s FROM q JOIN c ON c.item_id = positive)
SELECT p.query_id, p.positive, count(*) FILTER (x > s) + 1 AS place, count(x) AS n FROM p LEFT JOIN n USING (query_id) GROUP BY p.query_id, p.positive""")
def _(t):
    following = F.lead("item_id").over(Window.partitionBy("label").orderBy("item_id"))
    queries = t.emb.select(F.col("item_id").alias("query_id"), "e", following.alias("positive")).where("positive is not null")
    return evaluate.sampled_retrieval(queries, t.emb.select("item_id", "e"), 30, seed=13)


@query("evl_14_mergeable_mean", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.avg("l_quantity")).alias("mean"), F.count("*").alias("n"))


@query("evl_15_decode_report", f"WITH {GENERATED}, o AS (SELECT c1, c2, c3, min(item_id) AS item_id FROM b_sid GROUP BY ALL), d AS (SELECT g.id, o.item_id FROM g LEFT JOIN o USING (c1, c2, c3)) SELECT count(*) AS n, count(*) FILTER (item_id IS NULL) AS invalid, count(item_id) - count(DISTINCT item_id) AS repeats FROM d")
def _(t):
    one = t.sid.groupBy("c1", "c2", "c3").agg(F.min("item_id").alias("item_id"))
    return generated(t).join(one, ["c1", "c2", "c3"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("item_id").isNull()).alias("invalid"), (F.count("item_id") - F.count_distinct("item_id")).alias("repeats"))


@query("evl_16_reachability", f"WITH g AS (SELECT item_id, {BUCKET} AS bucket FROM b_ecounts), f AS (SELECT item_id, min(rank) AS first FROM b_epred GROUP BY item_id) SELECT bucket, count(*) AS items, count(*) FILTER (first <= 10) AS r10, count(*) FILTER (first <= 50) AS r50, count(*) FILTER (first IS NULL) AS never FROM g LEFT JOIN f USING (item_id) GROUP BY bucket")
def _(t):
    first = t.epred.groupBy("item_id").agg(F.min("rank").alias("first"))
    g = t.ecounts.select("item_id", sequence.bucket(F.col("cnt")).alias("bucket")).join(first, "item_id", "left")
    return g.groupBy("bucket").agg(F.count("*").alias("items"), F.count_if(F.col("first") <= 10).alias("r10"), F.count_if(F.col("first") <= 50).alias("r50"), F.count_if(F.col("first").isNull()).alias("never"))


@query("evl_17_tail_sensitivity", f"WITH f AS (SELECT unnest([0.5, 0.667, 0.8, 0.9]::DOUBLE[]) AS f), tl AS (SELECT f, item_id, r >= floor(n * (1 - f)) AS tail FROM ({RANKED}), f) SELECT f AS fraction, round(avg(tail::INT), 6) AS tail_exposure FROM b_pred JOIN tl USING (item_id) WHERE rank <= 10 GROUP BY f")
def _(t):
    ranked = sequence.popularity_rank(t.counts)
    tails = ranked.select("item_id", "r", "n_items", F.explode(F.array(*map(F.lit, (0.5, 0.667, 0.8, 0.9)))).alias("fraction")).withColumn("tail", F.col("r") >= F.floor(F.col("n_items") * (1 - F.col("fraction"))))
    return t.pred.where("rank <= 10").join(tails, "item_id").groupBy("fraction").agg(r6(F.avg(F.col("tail").cast("double"))).alias("tail_exposure"))


def bootstrap_sql(pairs, rounds, seed):
    return f"""bd AS ({pairs}), bw AS (SELECT round, d, {poisson_sql('u')} AS w FROM (SELECT d, round, {uniform_sql('key, round', seed)} AS u FROM (SELECT key, d, unnest(range({rounds})) AS round FROM bd WHERE d IS NOT NULL))),
bm AS (SELECT sum(w * d) / sum(w) AS m FROM bw WHERE w > 0 GROUP BY round), bb AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((m <= 0)::INT) AS p FROM bm)"""


@query("evl_18_bootstrap", f"WITH {metrics('b_pred', 'b_test', '10, 50')}, {bootstrap_sql('SELECT user_id AS key, max(ndcg) FILTER (k = 50) - max(ndcg) FILTER (k = 10) AS d FROM pu GROUP BY user_id', 100, 0)} SELECT (SELECT count(*) FROM bd) AS n, round((SELECT avg(d) FROM bd), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p FROM bb")
def _(t):
    a = evaluate.per_user(t.pred, t.test, [10, 50]).groupBy("user_id").pivot("k", [10, 50]).agg(F.first("ndcg"))
    b = stats.bootstrap(staged(a.select(F.col("user_id").alias("key"), (F.col("50") - F.col("10")).alias("d")), "differences"), rounds=100)
    return b.select("n", *(r6(c).alias(c) for c in ("mean", "lo", "hi", "p")))


@query("evl_19_recovery_rate", "WITH r AS (SELECT event_type, avg(value) AS m, max(value) AS oracle, min(value) AS base FROM events GROUP BY event_type) SELECT event_type, round(CASE WHEN abs(oracle - base) < 1e-12 THEN NULL ELSE (m - base) / (oracle - base) END, 6) AS rate FROM r")
def _(t):
    r = t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.max("value").alias("o"), F.min("value").alias("b"))
    return r.select("event_type", r6(F.when(F.abs(F.col("o") - F.col("b")) >= 1e-12, (F.col("m") - F.col("b")) / (F.col("o") - F.col("b")))).alias("rate"))


RUNS = "r AS (SELECT event_type AS condition, user_id % 4 AS seed, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS metric, avg(value + CASE WHEN event_type = 'view' THEN 8 ELSE 0 END) AS value FROM events GROUP BY ALL)"


def runs(t):
    v = F.col("value") + F.when(F.col("event_type") == "view", 8).otherwise(0)
    metric = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return t.events.groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("seed"), metric.alias("metric")).agg(F.avg(v).alias("value"))


VERDICT = f"WITH {RUNS}, d AS (SELECT x.metric, x.seed, x.value - y.value AS d FROM r x JOIN r y ON x.metric = y.metric AND x.seed = y.seed WHERE x.condition = 'view' AND y.condition = 'click'), f AS (SELECT metric, max(s) AS floor FROM (SELECT metric, condition, max(value) - min(value) AS s FROM r WHERE condition IN ('view', 'click') GROUP BY ALL) GROUP BY metric), e AS (SELECT metric, count(*) AS n, avg(d) AS mean, abs(avg(d)) AS effect, min(abs(d)) AS least, bool_and(d > 0) OR bool_and(d < 0) AS same_sign, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM d GROUP BY metric)"


@query("evl_20_paired_t", f"{VERDICT} SELECT metric, n, round(mean, 6) AS mean, round(t, 4) AS t FROM e")
def _(t):
    return stats.verdict(runs(t), "view", "click").select("metric", "n", r6("mean").alias("mean"), F.round("t", 4).alias("t"))


@query("evl_21_noise_floor_verdict", f"{VERDICT} SELECT metric, same_sign, round(floor, 6) AS floor, same_sign AND effect > floor AS passes FROM e JOIN f USING (metric)")
def _(t):
    return stats.verdict(runs(t), "view", "click").select("metric", "same_sign", r6("floor").alias("floor"), "passes")


@query("evl_22_null_verdict", f"WITH {RUNS}, g AS (SELECT metric, avg(value) FILTER (condition = 'view') - avg(value) FILTER (condition = 'click') AS gain, avg(value) FILTER (condition = 'error') - avg(value) FILTER (condition = 'click') AS nul FROM r GROUP BY metric) SELECT metric, CASE WHEN gain <= 0 THEN 'no gain' WHEN nul <= 0 THEN 'vanishes' WHEN nul < gain / 2 THEN 'shrinks' ELSE 'remains' END AS verdict FROM g")
def _(t):
    m = lambda c: F.avg(F.when(F.col("condition") == c, F.col("value")))
    g = runs(t).groupBy("metric").agg((m("view") - m("click")).alias("gain"), (m("error") - m("click")).alias("nul"))
    return g.select("metric", stats.null_verdict(F.col("gain"), F.col("nul")).alias("verdict"))


@query("evl_23_window_verdict", "WITH m AS (SELECT chunk, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM b_chunk GROUP BY chunk) SELECT chunk, round(a - b, 6) AS effect, a > b AS better FROM m")
def _(t):
    m = lambda c: F.avg(F.when(F.col("event_type") == c, F.col("value")))
    return t.chunked.groupBy("chunk").agg(m("view").alias("a"), m("click").alias("b")).select("chunk", r6(F.col("a") - F.col("b")).alias("effect"), (F.col("a") > F.col("b")).alias("better"))


@query("evl_24_sign_agreement", f"WITH {RUNS}, d AS (SELECT x.condition, x.metric, sign(x.value - y.value) AS s FROM r x JOIN r y ON x.metric = y.metric AND x.seed = y.seed AND y.condition = 'click' AND x.condition <> 'click') SELECT condition, metric, count(DISTINCT s) = 1 AS agree FROM d GROUP BY ALL")
def _(t):
    y = runs(t).where("condition = 'click'").select("metric", "seed", F.col("value").alias("y"))
    d = runs(t).where("condition <> 'click'").join(y, ["metric", "seed"]).withColumn("s", F.signum(F.col("value") - F.col("y")))
    return d.groupBy("condition", "metric").agg((F.count_distinct("s") == 1).alias("agree"))


CURVES = "c AS (SELECT user_id, unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS lam, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id HAVING a IS NOT NULL AND b IS NOT NULL), v AS (SELECT user_id, lam, a - lam * b AS x, b - lam * a AS y FROM c)"


@query("evl_25_curve_comparison", f"""WITH {CURVES}, w AS (SELECT lam, x - y AS d, round, {poisson_sql(uniform_sql("user_id || '/' || lam, round", 0))} AS w FROM (SELECT *, unnest(range(50)) AS round FROM v)),
m AS (SELECT lam, round, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY lam, round), q AS (SELECT lam, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY lam)
SELECT lam, round(avg(x), 6) AS a, round(avg(y), 6) AS b, round(max(x) - min(x), 6) AS spread_a, round(max(y) - min(y), 6) AS spread_b, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi FROM v JOIN q USING (lam) GROUP BY lam""")
def _(t):
    mean = lambda c: F.avg(F.when(F.col("event_type") == c, F.col("value")))
    c = t.events.groupBy("user_id").agg(mean("view").alias("a"), mean("click").alias("b")).where("a is not null and b is not null")
    v = c.select("user_id", "a", "b", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("lam")).select("user_id", "lam", (F.col("a") - F.col("lam") * F.col("b")).alias("x"), (F.col("b") - F.col("lam") * F.col("a")).alias("y"))
    out = stats.compare_curves(v, "lam", "x", "y", F.concat_ws("/", "user_id", "lam"), rounds=50)
    return out.select("lam", *(r6(c).alias(c) for c in ("a", "b", "spread_a", "spread_b", "lo", "hi")))


@query("evl_26_gates", "WITH v AS (SELECT event_type, avg(value) AS v FROM events GROUP BY event_type), t(event_type, target, warn, fail) AS (VALUES ('click', 10.0::DOUBLE, 0.05::DOUBLE, 0.2::DOUBLE), ('view', 10.0, 5.0, 6.0), ('error', 10.0, NULL, NULL), ('signup', NULL, 0.1, 0.2)) SELECT event_type, CASE WHEN v IS NULL OR target IS NULL THEN 'SKIP' WHEN warn IS NULL THEN 'REPORT' WHEN abs(v - target) / greatest(abs(target), 1e-9) <= warn THEN 'PASS' WHEN abs(v - target) / greatest(abs(target), 1e-9) <= fail THEN 'WARN' ELSE 'FAIL' END AS gate FROM v LEFT JOIN t USING (event_type)")
def _(t):
    spec = t.spark.createDataFrame([("click", 10.0, 0.05, 0.2), ("view", 10.0, 5.0, 6.0), ("error", 10.0, None, None), ("signup", None, 0.1, 0.2)], "event_type string, target double, warn double, fail double")
    v = t.events.groupBy("event_type").agg(F.avg("value").alias("v")).join(F.broadcast(spec), "event_type", "left")
    return v.select("event_type", stats.gate(F.col("v"), F.col("target"), F.col("warn"), F.col("fail"), F.lit(True)).alias("gate"))


HIT = "(SELECT count(*) FROM b_etarget x JOIN {} p ON p.user_id = x.user_id AND p.item_id = x.item_id WHERE p.rank <= 20)"
RAND = "(SELECT u.user_id, c.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY md5(concat(concat_ws('-', u.user_id, c.item_id), '|g')), c.item_id) AS rank FROM (SELECT DISTINCT user_id FROM b_etarget) u, b_ecat c WHERE NOT EXISTS (SELECT 1 FROM b_etrain t WHERE t.user_id = u.user_id AND t.item_id = c.item_id))"


@query("evl_27_learnability", f"SELECT round({HIT.format('b_epred')} / {HIT.format(RAND)}::DOUBLE, 6) AS ratio")
def _(t):
    users = t.etarget.select("user_id").distinct()
    rand = recommend.random_items(t.ecat, t.etrain, users, 20, "g")
    hits = lambda p: t.etarget.join(p.where("rank <= 20"), ["user_id", "item_id"]).agg(F.count("*").alias("n"))
    return hits(t.epred).toDF("a").crossJoin(hits(rand).toDF("b")).select(r6(F.try_divide("a", "b")).alias("ratio"))


@query("evl_28_grid_selection", "SELECT arg_min(id, (round(d, 6), y, id)) AS best FROM (SELECT s_suppkey AS id, abs(s_acctbal - 5000) AS d, s_nationkey AS y FROM supplier)")
def _(t):
    return t.supplier.agg(F.min_by("s_suppkey", F.struct(F.round(F.abs(F.col("s_acctbal") - 5000), 6), "s_nationkey", "s_suppkey")).alias("best"))


@query("evl_29_comparison", "WITH m AS (SELECT event_type, avg(value) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY event_type) SELECT event_type, round(mean, 6) AS mean, rank() OVER (ORDER BY round(mean, 6) DESC, event_type) AS place, users < (SELECT max(users) FROM m) AS warning FROM m")
def _(t):
    m = t.events.groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), F.count_distinct("user_id").alias("users"))
    return m.select("event_type", "mean", F.rank().over(Window.orderBy(F.desc("mean"), "event_type")).cast("bigint").alias("place"), (F.col("users") < F.max("users").over(Window.partitionBy())).alias("warning"))


@query("evl_30_protocol_report", f"SELECT tier, count(*) AS pairs, count(DISTINCT user_id) AS users FROM b_etarget JOIN (SELECT item_id, {TIER} AS tier FROM b_ecounts) USING (item_id) GROUP BY tier")
def _(t):
    tiers = t.ecounts.select("item_id", sequence.cold_tier(F.col("cnt")).alias("tier"))
    return t.etarget.join(tiers, "item_id").groupBy("tier").agg(F.count("*").alias("pairs"), F.count_distinct("user_id").alias("users"))


@query("evl_31_independent_hits", "SELECT count(*) AS hits FROM b_test JOIN b_pred USING (user_id, item_id) WHERE rank <= 50")
def _(t):
    return t.test.join(t.pred.where("rank <= 50"), ["user_id", "item_id"]).agg(F.count("*").alias("hits"))


@query("str_08_availability", "WITH r AS (SELECT user_id, min(ts) AS reg FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.event_id FROM events e JOIN r USING (user_id) WHERE e.ts >= r.reg")
def _(t):
    r = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("reg"))
    return t.events.join(r, "user_id").where("ts >= reg").select("event_id")


U = "(('0x' || substr(md5(concat({}, '|u')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


def u(key):
    return (F.conv(F.substring(hash_order(key, "u"), 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0


@query("gen_01_weighted_draw", f"SELECT p_partkey, CASE WHEN u < 0.2 THEN 'a' WHEN u < 0.7 THEN 'b' ELSE 'c' END AS kind FROM (SELECT p_partkey, {U.format('p_partkey')} AS u FROM part)")
def _(t):
    from larkmill.operators import generate

    return generate.weighted_draw(t.part.select("p_partkey"), u("p_partkey"), {"a": 20.0, "b": 50.0, "c": 30.0}, "kind")


@query("gen_02_zipf_assignment", f"WITH w AS (SELECT r, sum(1 / pow(r, 1.1)) OVER (ORDER BY r) / sum(1 / pow(r, 1.1)) OVER () AS c FROM range(1, 21) x(r)) SELECT p_partkey, (SELECT min(r) FROM w WHERE c >= u)::INT AS k FROM (SELECT p_partkey, {U.format('p_partkey')} AS u FROM part)")
def _(t):
    from larkmill.operators import generate

    return generate.zipf_assign(t.part.select("p_partkey"), u("p_partkey"), 20, 1.1, "k")


@query("gen_04_top_dimensions", "WITH x AS (SELECT item_id, unnest(e) AS v, unnest(range(64)) AS d FROM b_emb) SELECT item_id, d FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY v DESC, d) <= 3")
def _(t):
    long = t.emb.select("item_id", F.posexplode("e").alias("d", "v"))
    return ranking.top_k(long, ["item_id"], [F.desc("v"), "d"], 3).select("item_id", F.col("d").cast("bigint").alias("d"))


@query("gen_05_interactions")
def _(t):
    from larkmill.operators import generate

    return generate.simulate(t.emb.select(F.col("item_id").alias("user_id"), "e"), t.emb.select("item_id", "e"), per_user=5, rounds=2)


@query("gen_06_activity_spans", f"""WITH u AS (SELECT c_custkey AS user_id, {uniform_sql('c_custkey', 0)} * 365.0::DOUBLE AS start, {uniform_sql('c_custkey', 1)} AS u1, exp(1.5 + 1.0 * sqrt(-2 * ln({uniform_sql('c_custkey', 2)})) * cos(2 * 3.141592653589793::DOUBLE * {uniform_sql('c_custkey', 3)})) AS w FROM customer)
SELECT user_id, round(start, 6) AS start, round(start + u1 * (365.0::DOUBLE - start), 6) AS stop, greatest(1, round(w * 20000 / (SELECT sum(w) FROM u)))::BIGINT AS n FROM u""")
def _(t):
    from larkmill.operators import generate

    made = generate.spans(t.customer.select(F.col("c_custkey").alias("user_id")), 20_000)
    return made.select("user_id", r6("start").alias("start"), r6("stop").alias("stop"), "n")


@query("gen_07_blind_sheet", "WITH s AS (SELECT p_partkey AS id, 'part' AS source FROM part UNION ALL SELECT c_custkey, 'customer' FROM customer), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(concat(id, '|b')), id) <= 30) SELECT row_number() OVER (ORDER BY md5(concat(source || id, '|p')), id) AS sheet, id, source FROM k")
def _(t):
    s = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("source")).union(t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer")))
    k = ranking.top_k(s, ["source"], [hash_order("id", "b"), "id"], 30)
    return k.select(F.row_number().over(Window.orderBy(hash_order(F.concat("source", F.col("id").cast("string")), "p"), "id")).cast("bigint").alias("sheet"), "id", "source")


@query("gen_08_parameter_grid", f"SELECT temperature, gamma, arg_max(item_id, ln(1 + cnt) * gamma - ln(-ln({uniform_sql('item_id, temperature', 4)})) * temperature) AS winner FROM b_counts, (SELECT unnest([0.15, 0.25]::DOUBLE[]) AS temperature) a, (SELECT unnest([0.0, 0.1]::DOUBLE[]) AS gamma) b GROUP BY temperature, gamma")
def _(t):
    grid = t.spark.createDataFrame([(a, b) for a in (0.15, 0.25) for b in (0.0, 0.1)], "temperature double, gamma double")
    score = F.log1p("cnt") * F.col("gamma") + ranking.gumbel(ranking.uniform("item_id", "temperature", seed=4)) * F.col("temperature")
    return t.counts.crossJoin(F.broadcast(grid)).groupBy("temperature", "gamma").agg(F.max_by("item_id", score).alias("winner"))


