"""Top-k, re-ranking, reach and Pareto operators over long ranked lists (user_id, rank, item_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.functions.chance import uniform

from .staging import staged


def top_k(scored: DataFrame, group: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark prunes groups before the shuffle's sort."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def dedup_list(ranked: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Ranked lists without later repeats, numbered anew from 1."""
    first = ranked.groupBy(user, item).agg(F.min("rank").alias("__first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy("__first"))).drop("__first")


def rerank_popularity(ranked: DataFrame, counts: DataFrame, lam: Column, extra: list[str] = ()) -> DataFrame:
    """ranked with new_rank by ln(p) - lam * ln(1 + count); stable, and unchanged at lam = 0."""
    s = F.log(F.greatest(F.col("score"), F.lit(1e-30))) - lam * F.log1p(F.col("cnt").cast("double"))
    joined = ranked.join(counts, "item_id").withColumn("adjusted", F.round(s, 9))
    key = F.when(lam == 0, F.lit(0.0)).otherwise(-F.col("adjusted"))
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy("user_id", *extra).orderBy(key, "rank")))


def _by_user(batches, columns: list[str]):
    """Sorted batches (shard, user_id, columns) as lists of (shard, user, arrays) whose users are whole, a list for each batch: only
    the last user of a batch waits for the next one."""
    import numpy as np

    names = ["shard", "user_id", *columns]
    rest = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        starts = np.concatenate(([0], new))
        yield [(cols[0][lo], cols[1][lo], [c[lo:hi] for c in cols[2:]]) for lo, hi in zip(starts[:-1], starts[1:], strict=True)]
        rest = [c[starts[-1] :] for c in cols]
    if rest is not None:
        yield [(rest[0][0], rest[1][0], rest[2:])]


def _in_order(ranked: DataFrame, shards: int, columns: list[str]) -> DataFrame:
    """ranked as (shard, user_id, columns), each shard in one partition by user and rank: Spark sorts, and spills where it must."""
    keyed = ranked.where(F.col("user_id").isNotNull()).select(F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard"), F.col("user_id").cast("bigint").alias("user_id"), *columns, "rank")
    return keyed.repartition(shards, "shard").sortWithinPartitions("shard", "user_id", "rank").drop("rank")


def rerank_exposure(ranked: DataFrame, mu: float, slots: int = 20, shards: int = 1) -> DataFrame:
    """Sequential re-ranking in ascending user order: scores lose mu * ln(1 + times the item was already placed in a top slot).

    Every user depends on all before, so one shard is one task, through which the users stream; more shards give independent
    counters (an approximation).
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        seen: dict[int, int] = {}
        shard = None
        for users in _by_user(batches, ["item_id", "score"]):
            out = []
            for at, user, (items, score) in users:
                if at != shard:
                    shard, seen = at, {}
                s = np.log(np.maximum(score.astype(float), 1e-30)) - mu * np.log1p([seen.get(i, 0) for i in items.tolist()])
                placed = items[np.argsort(-s, kind="stable")]
                for i in placed[:slots].tolist():
                    seen[i] = seen.get(i, 0) + 1
                out.append((np.full(len(placed), user), placed, np.arange(1, len(placed) + 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["user_id", "item_id", "rank"])

    return _in_order(ranked, shards, ["item_id", "score"]).mapInArrow(run, "user_id bigint, item_id bigint, rank bigint")


def exposure_slots(ranked: DataFrame, k: int, cap: int, explore: int = 0) -> DataFrame:
    """(user_id, item_id, slot, explored): greedy lists in ascending user order in which no item is placed more than cap times: the k
    best, then `explore` of the others that were shown least, the better rank first among equals. Slots stay empty without items.

    Every user depends on all before: one task by nature, through which the users stream.
    """

    def run(batches):
        import pyarrow as pa

        used: dict[int, int] = {}
        for users in _by_user(batches, ["item_id"]):
            out = []
            for _, user, (items,) in users:
                left = [x for x in items.tolist() if used.get(x, 0) < cap]
                shown = left[:k] + (sorted(left[k:], key=lambda x: used.get(x, 0))[:explore] if explore else [])
                for slot, item in enumerate(shown, 1):
                    used[item] = used.get(item, 0) + 1
                    out.append((int(user), item, slot, slot > k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["user_id", "item_id", "slot", "explored"])

    return _in_order(ranked, 1, ["item_id"]).mapInArrow(run, "user_id bigint, item_id bigint, slot bigint, explored boolean")


def pareto(points: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """points with dominated: another is at least as good on both axes and better on one. Points without x or y are not."""
    # the best y of each x, ranges of falling x, and the best y of all larger x: of the ranges before, then within the range
    best = points.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("__x")).agg(F.max(y).alias("__y"))
    ranged = staged(best.repartitionByRange(F.desc("__x")).withColumn("__part", F.spark_partition_id()), "pareto")
    before = lambda name, w: F.max(name).over(w.rowsBetween(Window.unboundedPreceding, -1))
    tops = ranged.groupBy("__part").agg(F.max("__y").alias("__top")).withColumn("__ahead", before("__top", Window.orderBy("__part"))).select("__part", "__ahead")
    larger = ranged.withColumn("__inside", before("__y", Window.partitionBy("__part").orderBy(F.desc("__x")))).join(F.broadcast(tops), "__part")
    larger = larger.select("__x", "__y", F.greatest("__inside", "__ahead").alias("__larger"))
    joined = points.join(larger, F.col(x) == F.col("__x"), "left")
    return joined.withColumn("dominated", F.coalesce((F.col("__larger") >= F.col(y)) | (F.col("__y") > F.col(y)), F.col("__y") > F.col(y), F.lit(False))).select(*points.columns, "dominated")


def gumbel(u: Column) -> Column:
    """A Gumbel variable of a uniform one; adding it to log weights and taking the top k samples without replacement."""
    return -F.log(-F.log(u))


def hash_order(key: Column | str, seed: str) -> Column:
    """Random order that other engines can repeat."""
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f"|{seed}")))
