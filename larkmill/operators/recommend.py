"""Classical recommenders: popularity, random, item neighbours, content, closed-form linear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import Packed
from .ranking import hash_order, top_k
from .sequence import popularity_rank
from .staging import staged
from .vector import group_mean, nearest, unit, width_of

#: Items up to which the dense model is solved on the driver.
EASE_ITEMS = 20_000
#: Rows (user, item) and entries of neighbour lists up to which they are sent to every task, 16 bytes each; of more, blocks meet.
BROADCAST_PAIRS = 4_000_000
BROADCAST_NEIGHBOURS = 12_000_000
#: Places of the popularity list up to which each user's list is cut from it within the row.
LISTED = 20_000


def most_popular(counts: DataFrame, seen: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, cnt, rank): the k most frequent unseen items (then the smaller id).

    A user with h seen items finds k unseen ones among the first k + h, so only that many per user are listed.
    """
    ranked = popularity_rank(counts).select("item_id", "cnt", "r")
    have = seen.select("user_id", "item_id").distinct()
    longest = k + (seen.groupBy("user_id").agg(F.count("*").alias("h")).agg(F.max("h")).first()[0] or 0)
    if longest <= LISTED:
        head = ranked.where(F.col("r") < longest).agg(F.array_sort(F.collect_list(F.struct("r", "item_id", "cnt"))).alias("__head"))
        mine = users.select("user_id").distinct().join(have.groupBy("user_id").agg(F.collect_list("item_id").alias("__have")), "user_id", "left")
        none = F.slice("__have", 1, 0)
        # a user of h seen items finds k unseen ones among the first k + h
        own = F.filter(F.slice("__head", 1, k + F.coalesce(F.size("__have"), F.lit(0))), lambda x: ~F.array_contains(F.coalesce(F.col("__have"), none), x["item_id"]) | F.col("__have").isNull())
        listed = mine.crossJoin(F.broadcast(head)).select("user_id", F.posexplode(F.slice(own, 1, k)).alias("__p", "__x"))
        return listed.select("user_id", "__x.item_id", "__x.cnt", (F.col("__p") + 1).alias("rank"))
    most = have.groupBy("user_id").agg(F.count("*").alias("h"))
    need = users.join(most, "user_id", "left").select("user_id", (F.coalesce("h", F.lit(0)) + k).alias("need"))
    # places 0 .. need - 1, then the items by an equi-join: no condition join over users and items
    places = need.select("user_id", F.explode(F.sequence(F.lit(0), (F.col("need") - 1).cast("int"))).alias("r"))
    listed = places.join(ranked.where(F.col("r") < longest).withColumn("r", F.col("r").cast("int")), "r").join(have, ["user_id", "item_id"], "left_anti")
    return top_k(listed, ["user_id"], ["r"], k).select("user_id", "item_id", "cnt", "rank")


def random_items(catalog: DataFrame, seen: DataFrame, users: DataFrame, k: int, seed: str) -> DataFrame:
    """(user_id, item_id, rank): the first k unseen items in hash order of the pair.

    By definition every pair is hashed; the catalog travels within the row, so that nothing is shuffled but the k items kept.
    """
    book = catalog.agg(F.collect_list("item_id").alias("__all"))
    have = seen.groupBy("user_id").agg(F.collect_set("item_id").alias("__have"))
    mine = users.select("user_id").distinct().join(have, "user_id", "left").crossJoin(F.broadcast(book))
    left = F.when(F.col("__have").isNull(), F.col("__all")).otherwise(F.array_except("__all", "__have"))
    drawn = F.transform(left, lambda x: F.struct(hash_order(F.concat_ws("-", "user_id", x), seed).alias("h"), x.alias("item_id")))
    return mine.select("user_id", F.posexplode(F.slice(F.array_sort(drawn), 1, k)).alias("__p", "__x")).select("user_id", "__x.item_id", (F.col("__p") + 1).alias("rank"))


def _histories(rows: DataFrame) -> tuple[DataFrame, int]:
    """(user_id, items: the distinct ones), written once, and how many items they have in all."""
    have = rows.where("user_id is not null and item_id is not null").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"))
    found = staged(have.groupBy("user_id").agg(F.collect_set("item_id").alias("items")), "histories")
    return found, found.agg(F.sum(F.size("items"))).first()[0] or 0


def _packed(histories: DataFrame) -> tuple:
    """histories as (users, items, user places, item places) on the driver."""
    import numpy as np

    got = histories.select("user_id", F.explode("items").alias("item_id")).toArrow()
    user, item = (got.column(c).to_numpy() for c in ("user_id", "item_id"))
    users, at_user = np.unique(user, return_inverse=True)
    items, at_item = np.unique(item, return_inverse=True)
    return users, items, at_user, at_item


def _offsets(places, n: int):
    import numpy as np

    return np.concatenate(([0], np.cumsum(np.bincount(places, minlength=n))))


def _gather(starts, values, which):
    """Concatenated runs of values that belong to the places in which."""
    import numpy as np

    lo, n = starts[which], starts[which + 1] - starts[which]
    total = int(n.sum())
    return values[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)] if total else values[:0]


def _lists_in_tasks(spark, packed: tuple, k: int) -> DataFrame:
    """neighbour_lists for pairs that fit every task: items are dealt out, each task multiplies its rows of the sparse product."""
    import numpy as np

    users, items, at_user, at_item = packed
    by_user, by_item = np.argsort(at_user, kind="stable"), np.argsort(at_item, kind="stable")
    shared = spark.sparkContext.broadcast((items, _offsets(at_user, len(users)), at_item[by_user].astype(np.int32), _offsets(at_item, len(items)), at_user[by_item].astype(np.int32)))

    def run(batches):
        import pyarrow as pa

        names, user_at, items_of, item_at, users_of = shared.value
        size = np.diff(item_at).astype(float)
        for batch in batches:
            out = []
            for i in batch.column(0).to_numpy():
                near = _gather(user_at, items_of, users_of[item_at[i] : item_at[i + 1]])
                j, co = np.unique(near, return_counts=True)
                other = j != i
                j, co = j[other], co[other]
                sim = np.floor(co / np.sqrt(size[i] * size[j]) * 1e9 + 0.5).astype(np.int64)
                if len(sim) > k:
                    enough = sim >= np.partition(sim, len(sim) - k)[len(sim) - k]
                    j, sim = j[enough], sim[enough]
                if len(j):
                    out.append((names[i], names[j], sim))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[c] for x in out], pa.list_(pa.int64())) for c in (1, 2))], ["i", "js", "units"])

    return spark.range(0, len(items), 1, 4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "i bigint, js array<bigint>, units array<bigint>")


def neighbour_lists(rows: DataFrame, k: int = 200) -> DataFrame:
    """(i, js, units): per item its neighbours and their similarities in whole billionths, whose sums do not depend on their order: co-occurrence over users divided by the
    norms, for binary rows; every one at or above the k-th.

    Few pairs are sent to every task; of many, blocks of items meet the histories.
    """
    histories, pairs = _histories(rows)
    return _lists_in_tasks(rows.sparkSession, _packed(histories), k) if pairs <= BROADCAST_PAIRS else Packed(histories).neighbour_lists(k)


def item_similarities(rows: DataFrame, k: int = 200) -> DataFrame:
    """(i, j, sim): neighbour_lists, a row for each pair."""
    return neighbour_lists(rows, k).select("i", F.explode(F.arrays_zip("js", "units")).alias("x")).select("i", F.col("x.js").alias("j"), (F.col("x.units") / 1e9).alias("sim"))


def item_knn(train: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, score, rank): sums of similarities to the history, seen items excluded; lists as of neighbour_lists.

    Lists that fit every task are sent there and histories are scored one by one; others meet the histories by a join.
    """
    lists = staged(lists, "lists")
    have = train.select("user_id", "item_id").distinct()
    if (lists.agg(F.sum(F.size("js"))).first()[0] or 0) <= BROADCAST_NEIGHBOURS:
        return _knn_in_tasks(have.groupBy("user_id").agg(F.collect_list("item_id").alias("items")), lists, k)
    near = lists.select("i", F.explode(F.arrays_zip("js", "units")).alias("x")).select("i", F.col("x.js").alias("item_id"), "x.units")
    scored = have.withColumnRenamed("item_id", "i").join(near, "i").groupBy("user_id", "item_id").agg((F.sum("units") / 1e9).alias("score"))
    return top_k(scored.join(have, ["user_id", "item_id"], "left_anti"), ["user_id"], [F.desc("score"), "item_id"], k)


def history_knn(train: DataFrame, k: int, near: int = 200) -> DataFrame:
    """(user_id, item_id, score, rank): item_knn of train and its own neighbour_lists(near).

    What fits every task is sent there; beyond, lists and scores are made by blocks, and neither pairs nor lists are shuffled.
    """
    histories, pairs = _histories(train)
    if pairs <= BROADCAST_PAIRS:
        lists = staged(_lists_in_tasks(train.sparkSession, _packed(histories), near), "lists")
        if (lists.agg(F.sum(F.size("js"))).first()[0] or 0) <= BROADCAST_NEIGHBOURS:
            return _knn_in_tasks(histories, lists, k)
    return Packed(histories).scored(k, near)


def _knn_in_tasks(histories: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    import numpy as np

    got = lists.toArrow().combine_chunks()
    order = np.argsort(got.column("i").to_numpy())
    js, units = (got.column(c).combine_chunks().take(order) if got.num_rows else None for c in ("js", "units"))
    names = got.column("i").to_numpy()[order]
    flat = lambda x: x.flatten().to_numpy() if x is not None else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(js.value_lengths().to_numpy()))) if js is not None else np.zeros(1, np.int64)
    # a neighbour has a list of its own, in which its partner is a neighbour, unless that was cut; then it gets a place behind
    known = np.union1d(names, flat(js))
    at = np.searchsorted(known, names)
    full = np.zeros(len(known) + 1, np.int64)
    full[at + 1] = np.diff(starts)
    shared = histories.sparkSession.sparkContext.broadcast((known, np.cumsum(full), np.searchsorted(known, flat(js)).astype(np.int32), flat(units)))

    def run(batches):
        import pyarrow as pa

        ids, offsets, near, weight = shared.value
        for batch in batches:
            out = []
            for user, items in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                mine = np.searchsorted(ids, items := items.values.to_numpy())
                mine = mine[ids[np.minimum(mine, len(ids) - 1)] == items] if len(ids) else mine[:0]
                places = _gather(offsets, near, mine)
                total = np.bincount(places, _gather(offsets, weight, mine), len(ids))  # whole numbers below 2^53: exact
                total[mine] = 0
                some = np.flatnonzero(total)
                if len(some) > k:
                    some = some[total[some] >= np.partition(total[some], len(some) - k)[len(some) - k]]
                best = some[np.lexsort((some, -total[some]))[:k]]
                out.append((np.full(len(best), user), ids[best], total[best] / 1e9, np.arange(1, len(best) + 1)))
            cols = [np.concatenate([x[c] for x in out]) for c in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["user_id", "item_id", "score", "rank"])

    return histories.mapInArrow(run, "user_id bigint, item_id bigint, score double, rank int")


def content_knn(train: DataFrame, vectors: DataFrame, k: int, vec: str = "e") -> DataFrame:
    """(user_id, item_id, score, rank): cosine of items with the mean of the history's unit vectors, seen items excluded."""
    units = vectors.select("item_id", unit(F.col(vec)).alias("__v"))
    have = train.select("user_id", "item_id").distinct()
    profile = group_mean(have.join(units, "item_id"), ["user_id"], "__v", width=width_of(vectors, vec)).select("user_id", unit(F.col("mean")).alias("v"))
    hidden = have.groupBy("user_id").agg(F.collect_list("item_id").alias("hidden"))
    return nearest(profile.join(hidden, "user_id"), units.select("item_id", F.col("__v").alias("v")), k)


def ease(train: DataFrame, k: int, penalty: float = 250.0) -> DataFrame:
    """(user_id, item_id, score, rank) of the closed-form linear autoencoder with zero diagonal.

    Co-occurrences are counted by a self-join; the dense inverse needs all items on the driver, at most EASE_ITEMS.
    """
    import numpy as np
    import pandas as pd

    spark = train.sparkSession
    have = train.select("user_id", "item_id").distinct()
    gram = have.withColumnRenamed("item_id", "i").join(have.withColumnRenamed("item_id", "j"), "user_id").groupBy("i", "j").agg(F.count("*").alias("co"))
    items = sorted(r[0] for r in have.select("item_id").distinct().limit(EASE_ITEMS + 1).collect())
    if len(items) > EASE_ITEMS:
        raise ValueError(f"more than {EASE_ITEMS} items")
    at = {x: n for n, x in enumerate(items)}
    g = np.zeros((len(items), len(items)))
    rows = gram.toPandas()
    g[rows["i"].map(at), rows["j"].map(at)] = rows["co"]
    p = np.linalg.inv(g + penalty * np.eye(len(items)))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0.0)
    shared = spark.sparkContext.broadcast((np.array(items), at, b))

    def run(batches):
        ids, where, w = shared.value
        for batch in batches:
            for user, mine in zip(batch["user_id"], batch["items"], strict=True):
                cols = [where[i] for i in mine]
                s = w[cols].sum(0)
                s[cols] = -np.inf
                top = np.lexsort((ids, -np.round(s, 9)))[:k]
                top = top[np.isfinite(s[top])]
                yield pd.DataFrame({"user_id": user, "item_id": ids[top], "score": s[top], "rank": np.arange(1, len(top) + 1)})

    return have.groupBy("user_id").agg(F.collect_list("item_id").alias("items")).mapInPandas(run, "user_id bigint, item_id bigint, score double, rank int")
