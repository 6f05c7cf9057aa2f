"""Synthetic data: weighted draws, skewed assignment, activity spans, interaction simulation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from larkmill.functions.chance import Uniforms, normal, uniform

from .ranking import top_k
from .staging import staged
from .vector import unit

#: Rows of a block of users and of items at most, and users whose fits with a block of items are in memory at once.
USERS, ITEMS, TILE = 1024, 8192, 128


def weighted_draw(rows: DataFrame, u: Column, weights: dict[str, float], name: str, default: str = "") -> DataFrame:
    """rows with a label drawn by u from weights; the default where there are none."""
    total = sum(weights.values())
    if not total:
        return rows.withColumn(name, F.lit(default))
    edges, run = [], 0.0
    for label, w in weights.items():
        run += w
        edges.append((label, run / total))
    pick = reduce(lambda acc, e: F.when(u < e[1], e[0]).otherwise(acc), reversed(edges[:-1]), F.lit(edges[-1][0]))
    return rows.withColumn(name, pick)


def zipf_assign(rows: DataFrame, u: Column, n: int, a: float, name: str) -> DataFrame:
    """rows with a rank 1 .. n drawn by u with weight 1 / rank^a."""
    w = [1 / r**a for r in range(1, n + 1)]
    edges, run = [], 0.0
    for x in w:
        run += x
        edges.append(run / sum(w))
    below = F.array(*map(F.lit, edges))
    return rows.withColumn(name, F.least(F.lit(n), F.size(F.filter(below, lambda e: e < u)) + 1))


def noisy_vectors(rows: DataFrame, sigma: float, years: Column, low: float, high: float, key: str = "item_id", vec: str = "e", seed: int = 0) -> DataFrame:
    """rows with vec as a member of its group: the group's base vector plus normal noise of its own in every dimension, grown
    with the years of experience and clipped to a range."""
    grown = lambda x: x * (0.88 + 0.012 * years)
    noise = lambda d: sigma * normal(key, d, seed=seed)
    return rows.withColumn(vec, F.transform(vec, lambda x, d: F.greatest(F.lit(low), F.least(F.lit(high), grown(x + noise(d))))))


def spans(users: DataFrame, total: int, days: float = 365.0, mu: float = 1.5, sigma: float = 1.0) -> DataFrame:
    """(user_id, start, stop, n): registration day, end of activity and a lognormal count rescaled to a total."""
    u = [uniform("user_id", seed=k) for k in range(4)]
    normal = F.sqrt(-2 * F.log(u[2])) * F.cos(2 * 3.141592653589793 * u[3])
    rows = users.select("user_id", (u[0] * days).alias("start"), F.exp(mu + sigma * normal).alias("w")).withColumn("stop", F.col("start") + u[1] * (days - F.col("start")))
    return rows.crossJoin(rows.agg(F.sum("w").alias("all"))).select("user_id", "start", "stop", F.greatest(F.lit(1), F.round(F.col("w") * total / F.col("all"))).cast("bigint").alias("n"))


def simulate(users: DataFrame, items: DataFrame, per_user: int, rounds: int = 2, temperature: float = 0.25, gamma: float = 0.1, seed: int = 0, wanted: int = 0, blur: float = 0.0, delta: float = 0.0) -> DataFrame:
    """(user_id, item_id, round): items drawn by fit over temperature plus gamma * ln(1 + popularity) plus delta * recency plus Gumbel
    noise.

    users (user_id, e and, if items have days, stop), items (item_id, e and, if asked for, start): an item that starts after the
    user's stop is not drawn, and recency is exp(-(stop - start) / 180). wanted: a user looks at their so many largest dimensions
    only, 0 for all. blur: the fit is seen with normal noise of that size. Popularity feeds back between rounds, not between
    users, so that rounds are parallel: an approximation of the sequential simulation, exact with one user in each round.
    """
    timed = "start" in items.columns and "stop" in users.columns
    size = F.size("e")
    edge = F.element_at(F.array_sort("e"), F.greatest(F.lit(1), size - wanted + 1)) if wanted else F.array_min("e")
    seen = users.withColumn("e", F.transform("e", lambda x: F.when(x >= edge, x).otherwise(0.0)))
    day = lambda name: (F.col(name) if timed else F.lit(0.0)).cast("double").alias("day")
    vector = unit(F.col("e")).cast("array<double>").alias("v")
    looked = staged(seen.select("user_id", vector, day("stop")).where("day is not null"), "users")
    book = staged(items.select("item_id", vector, day("start")).where("day is not null"), "items")
    done = None
    for k in range(rounds):
        left, right = looked.withColumn("hidden", F.array().cast(ArrayType(items.schema["item_id"].dataType))), book.withColumn("pop", F.lit(0.0))
        if done is not None:
            left = looked.join(done.where("item_id is not null").groupBy("user_id").agg(F.collect_set("item_id").alias("hidden")), "user_id", "left")
            right = book.join(done.groupBy("item_id").agg(F.count("*").cast("double").alias("pop")), "item_id", "left")
        drawn = _draw(left, right, per_user, temperature, gamma if done is not None else 0.0, seed + k, seed + 1000, blur, delta)
        picked = staged(drawn.select("user_id", "item_id", F.lit(k).alias("round")), "picked")
        done = picked if done is None else done.union(picked)
    return done


def _blocks(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """rows as blocks (block, rows), each of some `most` rows, and their number."""
    columns = [F.col(key).alias("id"), F.col(key).cast("string").alias("key"), *(c for c in rows.columns if c != key)]
    count = max(1, -(-rows.count() // most))
    gathered = rows.select(*columns).groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("id", "key", *(c for c in rows.columns if c != key))).alias("rows"))
    return staged(gathered, "blocks"), count


def _draw(users: DataFrame, items: DataFrame, k: int, temperature: float, gamma: float, seed: int, blurred: int, blur: float, delta: float) -> DataFrame:
    """(user_id, item_id): for each of users (user_id, v, day, hidden) the k items (item_id, v, day, pop) of the best score (9 digits,
    then the smaller id), those of hidden or of a later day left out.

    Every pair is scored by definition: blocks of users and items meet in Arrow batches, numbers are drawn for a user and a block of
    items at once, and a block of users keeps its best from one partner to the next. Nothing but these is shuffled. A pair whose
    vectors are missing or of different lengths comes last.
    """
    import numpy as np

    tasks = 4 * users.sparkSession.sparkContext.defaultParallelism
    left, count = _blocks(users, "user_id", max(1, min(USERS, -(-users.count() // tasks))))
    right, blocks = _blocks(items, "item_id", ITEMS)
    pairs = left.repartition(max(1, min(count, tasks))).crossJoin(right.select(F.col("block").alias("block2"), F.col("rows").alias("rows2")).repartition(max(1, blocks // 16)))
    schema = StructType([StructField("user_id", users.schema["user_id"].dataType), StructField("item_id", items.schema["item_id"].dataType), StructField("s", DoubleType())])

    def taken(rows):
        """Ids, keys, vectors as a matrix, their lengths (-1: none) and days."""
        v = rows.field("v")
        sizes = np.array([-1 if x is None else x for x in v.value_lengths().to_pylist()], np.int64)
        flat = v.flatten()
        if flat.null_count:
            whole = [x is not None and None not in x for x in v.to_pylist()]
            sizes = np.where(whole, sizes, -1)
        width = int(sizes.max(initial=0))
        if (sizes == width).all() and not flat.null_count:
            matrix = flat.to_numpy(zero_copy_only=False).reshape(len(sizes), width)
        else:
            matrix = np.zeros((len(sizes), max(width, 0)))
            for at, (n, x) in enumerate(zip(sizes, v.to_pylist(), strict=True)):
                matrix[at, : max(n, 0)] = x if n > 0 else 0.0
        return rows.field("id").to_pylist(), rows.field("key").to_pylist(), matrix, sizes, rows.field("day").to_numpy()

    def normals(one, two, key):
        return np.sqrt(-2 * np.log(one(key))) * np.cos(2 * np.pi * two(key))

    def run(batches):
        import pyarrow as pa

        types = [schema_type for schema_type in to_arrow_schema(schema).types]
        at, best = None, []

        def found():
            out = [(user, item, s) for user, mine in zip(ids, best, strict=True) for s, _, item in mine]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], ["user_id", "item_id", "s"])

        held, ready = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                block, rows, block2, rows2 = (batch.column(c)[r] for c in range(4))
                if block.as_py() != at:
                    if at is not None:
                        yield found()
                    at = block.as_py()
                    ids, keys, vectors, sizes, stops = taken(rows.values)
                    hidden = rows.values.field("hidden").to_pylist()
                    best = [[] for _ in ids]
                if block2.as_py() != held:
                    held = block2.as_py()
                    others, names, across, widths, starts = taken(rows2.values)
                    pop = np.nan_to_num(rows2.values.field("pop").to_numpy(zero_copy_only=False).astype(float))
                    places = {}
                    for place, item in enumerate(others):
                        places.setdefault(item, []).append(place)
                    ready = Uniforms(names, seed), (Uniforms(names, blurred), Uniforms(names, blurred + 1)) if blur else None, gamma * np.log1p(pop)
                draw, noise, extra = ready
                short = min(vectors.shape[1], across.shape[1])
                for lo in range(0, len(ids), TILE):
                    fits = vectors[lo : lo + TILE, :short] @ across[:, :short].T
                    for n, fit in enumerate(fits, lo):
                        if noise:
                            fit = fit + blur * normals(*noise, keys[n])
                        score = fit / temperature + extra
                        if delta:
                            score += delta * np.exp((starts - stops[n]) / 180.0)
                        score[np.isnan(score)] = np.inf  # Spark orders NaN before all numbers
                        score[(widths != sizes[n]) | (widths < 0)] = -np.inf
                        may = (starts <= stops[n]) | np.isnan(stops[n])
                        for item in hidden[n] or ():
                            may[places.get(item, [])] = False
                        u = draw(keys[n])
                        mine = best[n]
                        last = mine[-1][0] if len(mine) == k else -np.inf
                        top = score.max(where=may, initial=-np.inf)
                        if np.isfinite(last) and np.isfinite(top):
                            # noise rises with u: below this number no score reaches the last of the best
                            may &= u >= np.exp(-np.exp(min(top - last + 1e-6, 700.0))) * (1 - 1e-9)
                        some = np.flatnonzero(may)
                        if not len(some):
                            continue
                        s = np.round(score[some] - np.log(-np.log(u[some])), 9)
                        if len(s) > k:
                            enough = s >= np.partition(s, len(s) - k)[len(s) - k]
                            some, s = some[enough], s[enough]
                        mine += [(x, others[i] is not None, others[i]) for x, i in zip(s.tolist(), some.tolist(), strict=True)]
                        mine.sort(key=lambda x: (-x[0], x[1], x[2]) if x[1] else (-x[0], x[1]))
                        del mine[k:]
        if at is not None:
            yield found()

    return top_k(pairs.mapInArrow(run, schema), ["user_id"], [F.desc("s"), "item_id"], k).select("user_id", "item_id")
