"""Item graphs: typed edges, weights, blending and injection of neighbour means, null graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged
from .vector import dot, group_mean, norm, width_of

# Relation weights, and weights of head/mid/tail label pairs.
RELATION = {"bought_together": 2.0, "also_bought": 1.0, "also_viewed": 0.6}
PAIR = {("head", "head"): 0.5, ("head", "tail"): 1.5, ("tail", "head"): 1.5}
#: Items up to which their ids are sent to every task.
BROADCAST_ITEMS = 500_000
# Attributes that also_viewed items have in common.
LIKE = ["p_brand", "p_type", "p_size"]


def relation_weight(relation: Column) -> Column:
    w = F.lit(1.0)
    for name, value in RELATION.items():
        w = F.when(relation == name, value).otherwise(w)
    return w


def pair_weight(a: Column, b: Column) -> Column:
    w = F.lit(1.0)
    for (x, y), value in PAIR.items():
        w = F.when((a == x) & (b == y), value).otherwise(w)
    return w


def typed_edges(lines: DataFrame, seq: DataFrame, part: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(src, dst, relation), distinct: same order, next in a sequence, same brand, type and size.

    among (item_id): only edges of which it has both ends; rows of other items are dropped before edges are made of them.
    """
    if among is not None:
        ids = among.select("item_id").where("item_id is not null").distinct()
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ITEMS else ids
        held = lambda df, c: df.join(ids.select(F.col("item_id").alias(c)), c, "left_semi")
        lines, part = held(lines, "l_partkey"), held(part, "p_partkey")
    else:
        held = lambda df, c: df
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    together = a.join(b, "l_orderkey").where("src <> dst").select("src", "dst", F.lit("bought_together").alias("relation")).distinct()
    after = seq.select(F.col("item_id").alias("src"), F.lead("item_id").over(Window.partitionBy("user_id").orderBy("pos")).alias("dst")).where("src <> dst")
    after = held(held(after, "src"), "dst").select("src", "dst", F.lit("also_bought").alias("relation")).distinct()
    p, q = part.select(*LIKE, F.col("p_partkey").alias("src")), part.select(*LIKE, F.col("p_partkey").alias("dst"))
    return together.union(after).union(p.join(q, LIKE).where("src <> dst").select("src", "dst", F.lit("also_viewed").alias("relation")))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    other = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other))


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w): relation weights summed over relations and both directions."""
    return undirected(edges.select("src", "dst", relation_weight(F.col("relation")).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reweighted(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """weights times the weight of the label pair; labels (item_id, label)."""
    a, b = labels.select(F.col("item_id").alias("src"), F.col("label").alias("__a")), labels.select(F.col("item_id").alias("dst"), F.col("label").alias("__b"))
    return weights.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", (F.col("w") * pair_weight(F.col("__a"), F.col("__b"))).alias("w"))


def neighbour_means(weights: DataFrame, vectors: DataFrame, vec: str = "e") -> DataFrame:
    """(item_id, mean): weighted mean of the neighbours' vectors; items without neighbours have no row."""
    joined = weights.join(vectors.select(F.col("item_id").alias("dst"), F.col(vec).alias("__v")), "dst")
    return group_mean(joined.select(F.col("src").alias("item_id"), "w", "__v"), ["item_id"], "__v", F.col("w"), width_of(vectors, vec))


def blend(vectors: DataFrame, weights: DataFrame, alpha: float = 0.3, vec: str = "e") -> DataFrame:
    """vectors with (1 - alpha) x + alpha mean; isolated items keep x."""
    joined = vectors.join(neighbour_means(weights, vectors, vec), "item_id", "left")
    return joined.withColumn(vec, F.coalesce(F.zip_with(vec, "mean", lambda x, m: (1 - alpha) * x + alpha * m), F.col(vec))).drop("mean")


def inject(vectors: DataFrame, weights: DataFrame, beta: float = 0.3, vec: str = "e") -> DataFrame:
    """vectors with x + beta |x| m' / |m'|, m' being the neighbours' mean without its part along x; x where either is null."""
    return inject_means(vectors, neighbour_means(weights, vectors, vec), beta, vec)


def inject_means(vectors: DataFrame, means: DataFrame, beta: float, vec: str = "e") -> DataFrame:
    """inject by means (item_id, mean) that are made already."""
    joined = vectors.join(means, "item_id", "left")
    x, m = F.col(vec), F.col("mean")
    joined = joined.withColumn("__n", norm(x)).withColumn("__p", dot(m, x) / F.nullif(F.col("__n"), F.lit(0.0)))
    side = F.zip_with(m, x, lambda a, b: a - F.col("__p") * b / F.col("__n"))
    joined = joined.select("*", F.explode(F.array(side)).alias("__s")).withColumn("__k", norm(F.col("__s")))
    moved = F.zip_with(x, "__s", lambda a, b: a + beta * F.col("__n") * b / F.col("__k"))
    return joined.withColumn(vec, F.when((F.col("__n") >= 1e-12) & (F.col("__k") >= 1e-12), moved).otherwise(x)).drop("mean", "__n", "__p", "__s", "__k")


def inject_bounded(vectors: DataFrame, weights: DataFrame, share, cap: float, beta: float = 0.3, rounds: int = 4) -> tuple[DataFrame, float]:
    """inject, halving beta until share(vectors), a number of the moved vectors, is at most cap; at most `rounds` halvings.
    The neighbours' means do not depend on beta and are made once."""
    means = staged(neighbour_means(weights, vectors), "means")
    for _ in range(rounds):
        moved = inject_means(vectors, means, beta)
        if share(moved) <= cap:
            break
        beta /= 2
    return moved, beta


def co_occurrence(seq: DataFrame) -> DataFrame:
    """(src, dst, n): how often two different items stand side by side in a sequence, in either order."""
    after = seq.select(F.col("item_id").alias("src"), F.lead("item_id").over(Window.partitionBy("user_id").orderBy("pos")).alias("dst")).where("src <> dst")
    return undirected(after).groupBy("src", "dst").agg(F.count("*").alias("n"))


def rewired(edges: DataFrame, seed: str) -> DataFrame:
    """Degree-preserving null graph: sources keep their places, targets are shuffled by hash; loops and repeats are dropped.

    Numbers both sides with range-partitioned row numbers, so no task holds all edges.
    """
    from .ranking import hash_order
    from .sequence import global_row_number

    left = global_row_number(edges.select("src", "dst"), ["src", "dst"]).select("src", "r")
    shuffled = edges.select("dst", hash_order(F.concat_ws("-", "src", "dst"), seed).alias("h"))
    right = global_row_number(shuffled, ["h", "dst"]).select("dst", "r")
    return left.join(right, "r").where("src <> dst").select("src", "dst").distinct()


def rewired_best(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """The null graph, of several shuffles, that keeps the most edges."""
    found = [rewired(edges, s).persist() for s in seeds]
    sizes = [f.count() for f in found]
    best = sizes.index(max(sizes))
    for i, f in enumerate(found):
        if i != best:
            f.unpersist()
    return found[best]
