"""People matching: reciprocal scores, table sizes and assignment, audits; code-book rebalancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Users of a block of reciprocal_overlap, and items of its dense products at a time.
USERS, CHUNK = 1024, 1024


def reciprocal(pairs: DataFrame) -> DataFrame:
    """(a, b, score): the smaller of both directions' scores; pairs without a reverse are left out."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("__back"))
    return pairs.join(back, ["a", "b"]).select("a", "b", F.least("score", "__back").alias("score"))


def reciprocal_overlap(have: DataFrame, want: DataFrame) -> DataFrame:
    """(a, b, score): reciprocal of the directed scores of have (user_id, item_id, k) and want (user_id, item_id): of a for b, the sum
    of a's k over the items that b wants; pairs of no common item have none.

    Users are packed into blocks that meet in Arrow batches, each pair of blocks once: a dense product over the items of both blocks,
    CHUNK items at a time, gives both directions, so that no pair is shuffled.
    """
    import numpy as np

    tasks = 4 * have.sparkSession.sparkContext.defaultParallelism
    ours = have.select(F.col("user_id").cast("bigint").alias("u"), F.col("item_id").cast("bigint").alias("i"), F.col("k").cast("bigint").alias("k"), F.lit(0).alias("side"))
    theirs = want.select(F.col("user_id").cast("bigint").alias("u"), F.col("item_id").cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("k"), F.lit(1).alias("side")).distinct()
    # a user of one side only gets no score in the other direction
    both = ours.select("u").distinct().join(theirs.select("u").distinct(), "u")
    rows = staged(ours.union(theirs).where("i is not null and k is not null").join(both, "u"), "sides")
    n = rows.select("u").distinct().count()
    count = max(1, -(-n // max(1, min(USERS, -(-n // 16)))))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for number, block in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                cols = [block.values.field(c).to_numpy(zero_copy_only=False) for c in ("u", "i", "k", "side")]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.stack(cols).astype(np.int64).tobytes()], pa.binary())], ["block", "rows"])

    gathered = rows.groupBy(F.pmod(F.xxhash64("u"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("u", "i", "k", "side")).alias("rows"))
    packed = staged(gathered.mapInArrow(pack, "block bigint, rows binary"), "users")
    pairs = packed.repartition(max(1, min(count, tasks))).crossJoin(packed.select(F.col("block").alias("block2"), F.col("rows").alias("rows2")).repartition(max(1, count // 16)))
    # half of all pairs of blocks, the same number for each block
    apart = F.pmod(F.col("block2") - F.col("block"), F.lit(count))
    pairs = pairs.where((2 * apart < count) | ((2 * apart == count) & (F.col("block") < F.col("block2"))))

    def run(batches):
        import pyarrow as pa

        def sides(rows):
            u, i, k, side = np.frombuffer(rows, np.int64).reshape(4, -1)
            users, at = np.unique(u, return_inverse=True)
            return users, [(at[side == s], i[side == s], k[side == s]) for s in (0, 1)]

        def dense(side, items, n):
            at, i, k = side
            place = np.minimum(np.searchsorted(items, i), len(items) - 1)
            in_it = items[place] == i
            # sums below 2^24 are exact in float32, larger ones are made in float64
            out = np.zeros((n, len(items)), np.float32 if k.sum() < 1 << 24 else np.float64)
            np.add.at(out, (at[in_it], place[in_it]), k[in_it])
            return out

        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py() == batch.column(2)[r].as_py()
                (a, (ha, wa)), (b, (hb, wb)) = sides(batch.column(1)[r].as_py()), sides(batch.column(3)[r].as_py())
                there, back = np.intersect1d(ha[1], wb[1]), np.intersect1d(hb[1], wa[1])
                if not len(there) or not len(back):
                    continue
                forth, other = 0, 0
                for lo in range(0, len(there), CHUNK):
                    forth = forth + dense(ha, there[lo : lo + CHUNK], len(a)) @ dense(wb, there[lo : lo + CHUNK], len(b)).T
                for lo in range(0, len(back), CHUNK):
                    other = other + dense(wa, back[lo : lo + CHUNK], len(a)) @ dense(hb, back[lo : lo + CHUNK], len(b)).T
                score = np.minimum(forth, other)
                if same:
                    score[np.tril_indices(len(a))] = 0
                x, y = np.nonzero(score)
                for lo in range(0, len(x), 1 << 17):
                    xs, ys = x[lo : lo + (1 << 17)], y[lo : lo + (1 << 17)]
                    s = score[xs, ys].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[xs], b[ys]))), pa.array(np.concatenate((b[ys], a[xs]))), pa.array(np.concatenate((s, s)))], ["a", "b", "score"])

    return pairs.mapInArrow(run, "a bigint, b bigint, score bigint")


def table_sizes(n: int, least: int = 5, most: int = 6) -> list[int]:
    """Sizes of the fewest tables of at most `most` seats; the first ones have one less where n does not fill them."""
    k = max(1, math.ceil(n / most))
    base, extra = divmod(n, k)
    return [base] * (k - extra) + [base + 1] * extra


def assign_tables(people: DataFrame, scores: DataFrame, sizes: list[int], rounds: int = 20_000, seed: int = 0) -> DataFrame:
    """(person, table): seats people of (person, role, cohort) by annealing swaps within a role.

    The aim is the sum of scores (a, b, score) within tables, less 0.5 for each person beyond two of a cohort. One task: the
    algorithm is sequential. The pairs that may swap are drawn beforehand, so that only the scores of people drawn go to that task;
    they are looked up in sorted arrays, and no matrix of all people is made.
    """
    import numpy as np

    spark = people.sparkSession
    roster = people.select(F.col("person").cast("bigint").alias("person"), F.col("role").cast("string").alias("role"), F.col("cohort").cast("string").alias("cohort")).orderBy("role", "person").toArrow()
    n = roster.num_rows
    rng = np.random.default_rng(seed)
    draws = rng.integers(0, n, (rounds, 2)).astype(np.int32) if n else np.zeros((0, 2), np.int32)
    luck = rng.random(len(draws))
    person = roster.column("person").to_numpy()
    role, cohort = (np.unique(np.array(roster.column(c).to_pylist(), object).astype(str), return_inverse=True)[1] for c in ("role", "cohort"))
    moved = spark.createDataFrame([(int(x),) for x in person[np.unique(draws)]], "person bigint")
    near = scores.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("score").cast("double").alias("score"))
    for end in ("a", "b"):
        near = near.join(F.broadcast(moved.select(F.col("person").alias(end), F.lit(True).alias(f"__{end}"))), end, "left")
    # a row without a score, so that the task runs where no pair has one
    none = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("score"))
    near = near.where("(__a or __b) and score is not null").select("a", "b", "score").union(none)
    shared = spark.sparkContext.broadcast((person, role, cohort, draws, luck))

    def run(batches):
        import pyarrow as pa

        ids, roles, cohorts, drawn, chance = shared.value
        by_id = np.argsort(ids, kind="stable")
        keys, values = [], []
        for batch in batches:
            score = batch.column("score").to_numpy(zero_copy_only=False)
            ends, there = [], ~np.isnan(score)
            for c in ("a", "b"):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, x, sorter=by_id), max(0, n - 1))
                there &= ids[by_id[at]] == x if n else False
                ends.append(by_id[at] if n else at)
            keys.append((np.minimum(*ends) * n + np.maximum(*ends))[there])
            values.append(score[there])
        keys, values = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0), *values])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]

        def total(i: int, others) -> float:
            wanted = np.minimum(i, others) * n + np.maximum(i, others)
            at = np.searchsorted(keys, wanted, side="right") - 1
            return float(values[at[(at >= 0) & (keys[at] == wanted)]].sum()) if len(keys) else 0.0

        seats = np.array([t for k in range(max(sizes, default=0)) for t, size in enumerate(sizes) if k < size], np.int64)[:n]
        table = [list(t) for t in np.split(np.argsort(seats, kind="stable"), np.cumsum(np.bincount(seats, minlength=len(sizes)))[:-1])]
        excess = lambda t: sum(max(0, c - 2) for c in np.unique(cohorts[table[t]], return_counts=True)[1]) * 0.5
        best, now, top, kept = seats.copy(), 0.0, 0.0, []
        for k, (i, j) in enumerate(drawn.astype(np.int64)):
            heat = 0.5 * 0.01 ** (k / len(drawn))
            ti, tj = seats[i], seats[j]
            if ti == tj or roles[i] != roles[j]:
                continue
            both, mi, mj = total(i, np.array([j])), np.array(table[ti]), np.array(table[tj])
            gain = (total(j, mi) - both - total(i, mi)) + (total(i, mj) - both - total(j, mj))
            gain += excess(ti) + excess(tj)
            swap = lambda a, b: (table[ti].remove(a), table[ti].append(b), table[tj].remove(b), table[tj].append(a))  # noqa: B023, E731
            swap(i, j)
            gain -= excess(ti) + excess(tj)
            if gain > 0 or chance[k] < math.exp(gain / heat):
                seats[i], seats[j] = tj, ti
                kept.append((i, tj))
                kept.append((j, ti))
                now += gain
                if now > top:
                    for x, t in kept:
                        best[x] = t
                    kept, top = [], now
            else:
                swap(j, i)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best.astype(np.int32))], ["person", "table"])

    return near.repartition(1).mapInArrow(run, "person bigint, table int")


def table_report(assigned: DataFrame, scores: DataFrame) -> DataFrame:
    """(table, seats, affinity): mean score of the pairs at each table."""
    a, b = assigned.select(F.col("person").alias("a"), "table"), assigned.select(F.col("person").alias("b"), F.col("table").alias("tb"))
    inside = scores.where("a < b").join(a, "a").join(b, "b").where("table = tb").groupBy("table").agg(F.avg("score").alias("affinity"))
    return assigned.groupBy("table").agg(F.count("*").alias("seats")).join(inside, "table", "left")


def token_popularity(codes: DataFrame, counts: DataFrame, level: str) -> DataFrame:
    """(token, pop, n): summed popularity and number of the items of each token of a level."""
    return codes.join(counts, "item_id").groupBy(F.col(level).alias("token")).agg(F.sum("cnt").alias("pop"), F.count("*").alias("n"))


def tokens_to_split(codes: DataFrame, counts: DataFrame, labels: DataFrame, level: str, ratio: float, tail_guard: float = 0.5) -> DataFrame:
    """(token, pop): the most popular tokens that hold a head item and fewer tail items than the guard allows; as many as ratio of
    all tokens, one at least."""
    from pyspark.sql import Window

    rows = codes.join(counts, "item_id").join(labels.select("item_id", "label"), "item_id").groupBy(F.col(level).alias("token"))
    t = rows.agg(F.sum("cnt").alias("pop"), F.avg((F.col("label") == "head").cast("double")).alias("head"), F.avg((F.col("label") == "tail").cast("double")).alias("tail"))
    t = t.withColumn("__n", F.count("*").over(Window.partitionBy()))
    ok = t.where((F.col("head") > 0) & (F.col("tail") < tail_guard)).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("pop"), "token")))
    return ok.where(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * ratio))).select("token", "pop")


def split_slots(children: DataFrame, parts: int, balance: float, rounds: int = 20) -> DataFrame:
    """(token, child, slot): children (token, child, vec, n, pop) of each token spread over slots.

    Greedy by falling popularity: n * squared distance to the slot's centre plus balance * (slot's popularity with the child -
    target)^2; centres are then the weighted means, until nothing changes. Starts are the most popular child and the farthest
    ones from those chosen. As few children as slots take one each.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child").reset_index(drop=True)
        k = len(rows)
        if k <= parts:
            slots = np.arange(k)
        else:
            r, n, pop = np.stack(rows["vec"].to_list()), rows["n"].to_numpy(float), rows["pop"].to_numpy(float)
            chosen = [int(np.argmax(pop))]
            while len(chosen) < parts:
                far = np.min([((r - r[c]) ** 2).sum(1) for c in chosen], axis=0)
                chosen.append(int(np.argmax(far)))
            centres, target, slots = r[chosen].copy(), pop.sum() / parts, np.full(k, -1)
            by_pop = np.argsort(-pop, kind="stable")
            for _ in range(rounds):
                load, new = np.zeros(parts), np.empty(k, int)
                for i in by_pop:
                    cost = n[i] * ((r[i] - centres) ** 2).sum(1) + balance * (load + pop[i] - target) ** 2
                    new[i] = int(np.argmin(cost))
                    load[new[i]] += pop[i]
                if (new == slots).all():
                    break
                slots = new
                for m in range(parts):
                    if (slots == m).any():
                        centres[m] = np.average(r[slots == m], axis=0, weights=n[slots == m])
        return pd.DataFrame({"token": rows["token"], "child": rows["child"], "slot": slots})

    return children.groupBy("token").applyInPandas(run, "token int, child int, slot int")


def rebalance(codes: DataFrame, counts: DataFrame, labels: DataFrame, residuals: DataFrame, level: int, parts: int = 3, ratio: float = 0.2, balance: float = 0.5) -> DataFrame:
    """codes with the popular tokens of a level split: slot 0 keeps the token, others get fresh numbers after the largest one
    (a slot left empty still takes its number); codes below a token move together."""
    from pyspark.sql import Window

    from .vector import group_mean

    here, child = f"c{level}", f"c{level + 1}"
    chosen = tokens_to_split(codes, counts, labels, here, ratio)
    held = codes.join(F.broadcast(chosen.select(F.col("token").alias(here), F.col("pop").alias("__pop"))), here).join(counts, "item_id").join(residuals, "item_id")
    means = group_mean(held.select(F.col(here).alias("token"), F.col(child).alias("child"), "r"), ["token", "child"], "r")
    sizes = held.groupBy(F.col(here).alias("token"), F.col(child).alias("child")).agg(F.count("*").alias("n"), F.sum("cnt").alias("pop"))
    slots = split_slots(sizes.join(means.withColumnRenamed("mean", "vec"), ["token", "child"]), parts, balance)
    many = sizes.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    order = chosen.join(many, "token").withColumn("__i", F.row_number().over(Window.orderBy(F.desc("pop"), "token")) - 1)
    top = codes.agg(F.max(here).alias("__top"))
    fresh = slots.join(order, "token").crossJoin(F.broadcast(top)).select(F.col("token").alias(here), F.col("child").alias(child), F.when(F.col("slot") == 0, F.col("token")).otherwise(F.col("__top") + F.col("__i") * (parts - 1) + F.col("slot")).cast("int").alias("__new"))
    return codes.join(fresh, [here, child], "left").withColumn(here, F.coalesce("__new", here)).select(*codes.columns)
