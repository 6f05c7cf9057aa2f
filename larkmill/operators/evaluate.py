"""Accuracy, diversity, coverage and cold-start metrics over ranked lists and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions.chance import uniform

from .sequence import ranked_rows
from .staging import staged
from .stats import gini
from .vector import dot


def ideal_dcg(n: Column, k: Column | int) -> Column:
    """Sum of 1 / log2(r + 1) over the first min(n, k) ranks."""
    top = F.least(n, F.lit(k) if isinstance(k, int) else k).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))


def per_user(pred: DataFrame, targets: DataFrame, ks: list[int]) -> DataFrame:
    """(user_id, k, recall, hr, ndcg) of users with a list and a target.

    recall is hits over all targets. Users without a list do not count.
    """
    t = targets.select("user_id", "item_id").distinct()
    sizes = t.groupBy("user_id").agg(F.count("*").alias("n_targets"))
    hit = t.withColumn("hit", F.lit(1))
    long = pred.select("user_id", "item_id", "rank").where(F.col("rank") <= max(ks)).join(hit, ["user_id", "item_id"], "left")
    wanted = F.explode(F.array(*map(F.lit, ks))).alias("k")
    by = long.select("*", wanted).groupBy("user_id", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), F.coalesce("hit", F.lit(0))).otherwise(0)).alias("hits"),
        F.sum(F.when((F.col("rank") <= F.col("k")) & F.col("hit").isNotNull(), 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
    )
    return by.join(sizes, "user_id").select("user_id", "k", (F.col("hits") / F.col("n_targets")).alias("recall"), (F.col("hits") > 0).cast("double").alias("hr"), (F.col("dcg") / ideal_dcg(F.col("n_targets"), F.col("k"))).alias("ndcg"))


def tail_shares(pred: DataFrame, tail: DataFrame, ks: list[int]) -> DataFrame:
    """(k, aplt, tail_exposure): mean over users of the tail share of their list; tail slots over all slots."""
    marked = pred.join(tail.select("item_id", "tail"), "item_id").select("*", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    users = marked.groupBy("k", "user_id").agg(F.sum(F.col("tail").cast("int")).alias("t"), F.count("*").alias("n"))
    return users.groupBy("k").agg(F.avg(F.col("t") / F.col("n")).alias("aplt"), (F.sum("t") / F.greatest(F.lit(1), F.sum("n"))).alias("tail_exposure"))


def exposure(pred: DataFrame, catalog: DataFrame, ks: list[int]) -> DataFrame:
    """(k, coverage, exposure_gini) over the whole catalog, zeros included."""
    grid = catalog.select("item_id", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    shown = pred.select("item_id", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k").groupBy("k", "item_id").agg(F.count("*").alias("x"))
    full = grid.join(shown, ["k", "item_id"], "left").withColumn("x", F.coalesce("x", F.lit(0)))
    return full.groupBy("k").agg((F.count_if(F.col("x") > 0) / F.count("*")).alias("coverage")).join(gini(full, "x", ["k"]).withColumnRenamed("gini", "exposure_gini"), "k")


def bundle(pred: DataFrame, targets: DataFrame, tail: DataFrame, catalog: DataFrame, ks: list[int]) -> DataFrame:
    """All metrics as (k, metric, value), rounded to 6 digits, for users with a list and a target."""
    t = targets.select("user_id", "item_id").distinct()
    goal = t.groupBy("user_id").agg(F.collect_set("item_id").alias("wanted"))
    tails = tail.select("item_id", F.col("tail").cast("int").alias("tail"))
    # lists are marked once: a row for each user and place within some k, with its hit and tail marks
    marked = staged(pred.select("user_id", "item_id", "rank").where(F.col("rank") <= max(ks)).join(goal, "user_id").select("user_id", "item_id", "rank", F.size("wanted").alias("n_targets"), F.array_contains("wanted", F.col("item_id")).alias("hit")).join(tails, "item_id", "left"), "marked")
    inside = lambda k: F.col("rank") <= k
    total = lambda flag, x: F.sum(F.when(flag, x).otherwise(0))
    users = marked.groupBy("user_id").agg(
        F.max("n_targets").alias("n"),
        *(total(inside(k) & F.col("hit"), 1).alias(f"hits{k}") for k in ks), *(total(inside(k) & F.col("hit"), 1 / F.log2(F.col("rank") + F.lit(1.0))).alias(f"dcg{k}") for k in ks),
        *(total(inside(k), F.col("tail")).alias(f"t{k}") for k in ks), *(total(inside(k) & F.col("tail").isNotNull(), 1).alias(f"s{k}") for k in ks),
    )
    of = lambda name, k: F.col(f"{name}{k}")
    means = users.agg(*(x for k in ks for x in (
        F.avg(of("hits", k) / F.col("n")).alias(f"recall{k}"), F.avg((of("hits", k) > 0).cast("double")).alias(f"hr{k}"), F.avg(of("dcg", k) / ideal_dcg(F.col("n"), k)).alias(f"ndcg{k}"),
        F.avg(F.when(of("s", k) > 0, of("t", k) / of("s", k))).alias(f"aplt{k}"), (F.sum(of("t", k)) / F.greatest(F.lit(1), F.sum(of("s", k)))).alias(f"tail_exposure{k}"),
    )))
    names = ("recall", "hr", "ndcg", "aplt", "tail_exposure")
    accuracy = means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{m}{k}").alias(m) for m in names)) for k in ks))).alias("x")).select("x.*")
    shown = marked.groupBy("item_id").agg(*(F.count_if(inside(k)).alias(f"x{k}") for k in ks))
    full = catalog.select("item_id").join(shown, "item_id", "left").select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"x{k}", F.lit(0)).alias("x")) for k in ks))).alias("y")).select("y.*")
    wide = accuracy.join(full.groupBy("k").agg((F.count_if(F.col("x") > 0) / F.count("*")).alias("coverage")).join(gini(full, "x", ["k"]).withColumnRenamed("gini", "exposure_gini"), "k"), "k")
    return wide.unpivot(["k"], [c for c in wide.columns if c != "k"], "metric", "value").withColumn("value", F.round("value", 6))


def group_recall(pred: DataFrame, targets: DataFrame, groups: DataFrame, group: str, k: int, all_users: bool) -> DataFrame:
    """(group, n, recall) over pairs of user and target. all_users: users without a list count as misses, else not at all."""
    t = targets.select("user_id", "item_id").distinct()
    if not all_users:
        t = t.join(pred.select("user_id").distinct(), "user_id", "left_semi")
    hit = pred.where(F.col("rank") <= k).select("user_id", "item_id", F.lit(1.0).alias("hit"))
    joined = t.join(hit, ["user_id", "item_id"], "left").join(groups, "item_id", "left")
    return joined.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def clamped_recall(pred: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(user_id, recall): hits over min(number of targets, k); another definition than per_user's."""
    t = targets.select("user_id", "item_id").distinct()
    n = t.groupBy("user_id").agg(F.count("*").alias("n"))
    hits = pred.where(F.col("rank") <= k).select("user_id", "item_id").distinct().join(t, ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("hits"))
    return n.join(hits, "user_id", "left").select("user_id", (F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), F.least("n", F.lit(k)))).alias("recall"))


def sampled_retrieval(queries: DataFrame, catalog: DataFrame, negatives: int, seed: int = 0, vec: str = "e") -> DataFrame:
    """(query_id, positive, place, n): the place of each query's positive item, by dot product (9 digits), among n items drawn
    from the whole catalog; equal scores do not push it back.

    queries (query_id, vec, positive), catalog (item_id, vec). Draws are hashes of query and draw onto places in id order; those
    that hit the positive are left out. Draws meet the catalog by an equi-join on the place.
    """
    placed = ranked_rows(catalog.select("item_id", F.col(vec).alias("__v")), ["item_id"], "__r", "__size").withColumn("__r", F.col("__r").cast("bigint"))
    size = catalog.count()
    draws = queries.select("query_id", vec, "positive", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("__d"))
    drawn = draws.select("query_id", vec, "positive", F.floor(uniform("query_id", "__d", seed=seed) * size).cast("bigint").alias("__r")).join(placed.select("item_id", "__v", "__r"), "__r").where("item_id <> positive")
    truth = queries.join(placed.select(F.col("item_id").alias("positive"), "__v"), "positive").select("query_id", "positive", F.round(dot(F.col(vec), F.col("__v")), 9).alias("__s"))
    scored = drawn.select("query_id", F.round(dot(F.col(vec), F.col("__v")), 9).alias("__x"))
    joined = truth.join(scored, "query_id", "left")
    return joined.groupBy("query_id", "positive").agg((F.count_if(F.col("__x") > F.col("__s")) + 1).alias("place"), F.count("__x").alias("n"))


def strict_ranks(vectors: DataFrame, target: Column, key: str = "item_id", vec: str = "e", group: str = "label") -> DataFrame:
    """(key, r): how many others of the row's group have a larger dot product (9 digits) with it than its target; rows whose target
    is themselves, missing or of another group are left out.

    Targets are scored first, so that only rows with one meet their group, and the pairs are counted where they are made.
    """
    other = vectors.select(group, F.col(key).alias("__cand"), F.col(vec).alias("__f"))
    score = F.round(dot(F.col(vec), F.col("__f")), 9)
    aimed = vectors.select(group, key, vec, target.alias("__cand")).where(F.col(key) != F.col("__cand")).join(other, [group, "__cand"])
    aimed = aimed.select(group, key, vec, score.alias("__ts")).where(F.col("__ts").isNotNull())
    pairs = aimed.join(other, group).where(F.col(key) != F.col("__cand"))
    return pairs.groupBy(key).agg(F.count_if(score > F.col("__ts")).alias("r"))


def beam_search(transitions: DataFrame, beams: int, levels: int, start: list[int] = (), valid: DataFrame | None = None) -> DataFrame:
    """(path array, logp, rank): the best code paths of a transition table (level, prev, code, p), level by level.

    valid: code tuples (c1 .. cL); beams whose prefix begins none are dropped before the cut. Scores are rounded to 9
    digits, ties go to the smaller path.
    """
    spark = transitions.sparkSession
    out = spark.range(1).select(F.array().cast("array<int>").alias("path"), F.lit(0.0).alias("logp"), F.lit(-1).alias("prev"))
    for level in range(levels):
        step = transitions.where(F.col("level") == level).select(F.col("prev").cast("int").alias("prev"), F.col("code").cast("int").alias("code"), "p")
        grown = out.join(F.broadcast(step), "prev").select(F.concat("path", F.array("code")).alias("path"), F.round(F.col("logp") + F.log("p"), 9).alias("logp"), F.col("code").alias("prev"))
        if valid is not None:
            heads = valid.select(F.array(*(F.col(f"c{i + 1}").cast("int") for i in range(level + 1))).alias("path")).distinct()
            grown = grown.join(heads, "path", "left_semi")
        out = grown.orderBy(F.desc("logp"), "path").limit(beams)
    from pyspark.sql import Window

    return out.select("path", "logp", F.row_number().over(Window.orderBy(F.desc("logp"), "path")).alias("rank"))


def nearest_valid(codes: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """codes with the item that agrees in most positions, the smallest id on ties.

    Every set of positions has a table of the smallest item for its codes; distinct code tuples meet these tables by an equi-join,
    and the largest set with an item wins. Rows that agree nowhere get the smallest item of all.
    """
    masks = range(1, 1 << len(columns))
    key = lambda m: F.concat_ws("-", *(F.col(c).cast("string") if m >> i & 1 else F.lit("*") for i, c in enumerate(columns)))
    keyed = lambda df, *keep: df.select(*keep, F.explode(F.array(*(F.struct(F.lit(m.bit_count()).alias("__n"), key(m).alias("__key")) for m in masks))).alias("__x")).select(*keep, "__x.*")
    book = keyed(catalog, "item_id").groupBy("__key").agg(F.min("item_id").alias("__item"))
    best = keyed(codes.select(*columns).distinct(), *columns).join(book, "__key").groupBy(*columns).agg(F.min(F.struct((-F.col("__n")).alias("s"), "__item")).alias("__b"))
    least = catalog.agg(F.min("item_id").alias("__least"))
    joined = codes.join(best, columns, "left").crossJoin(F.broadcast(least))
    return joined.select(*codes.columns, F.coalesce("__b.__item", "__least").alias("nearest"), F.coalesce(-F.col("__b.s"), F.lit(0)).alias("agree"))
