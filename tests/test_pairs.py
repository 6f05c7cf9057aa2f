"""Pair operators that no longer list all pairs, against plain versions."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from larkmill.operators import graph, joins, match, recommend, vector
from larkmill.operators.ranking import hash_order, top_k


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made_pairs(spark, df):
    """Rows that Spark's joins of df's plan put out, after it ran."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName() or "Cartesian" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_attribute_neighbours_without_all_pairs(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), (F.col("id") % 2).alias("kind"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))).alias("brand"))
    a = items.alias("a").join(items.alias("b"), "kind").where("a.item_id <> b.item_id").select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("nbr"), (F.col("a.brand") == F.col("b.brand")).alias("same"))
    want = rows(top_k(a, ["item_id"], [F.desc("same"), "nbr"], 5).select("item_id", "nbr"))
    got = joins.attribute_neighbours(items, ["kind"], "brand", 5)
    assert rows(got) == want
    assert made_pairs(spark, got) <= 300


def test_two_hop_within_groups_without_paths(spark):
    items = spark.range(120).select(F.col("id").alias("src"), F.when(F.col("id") < 2, -1).when(F.col("id") == 2, -2).when(F.col("id") > 3, F.col("id") % 3).alias("kind"))
    edges = items.join(items.withColumnRenamed("src", "dst"), "kind").where("src <> dst").select("src", "dst")
    got = joins.two_hop_within(items, ["kind"], 3, "a")
    assert rows(got) == rows(joins.two_hop(edges, edges, 3, "a"))
    assert len(rows(got)) == 3 * 116 and made_pairs(spark, got) <= 120


def test_tables_without_a_matrix_of_all_people(spark):
    n = 40_000
    people = spark.range(n).select((F.col("id") * 3).alias("person"), F.lit("guest").alias("role"), (F.col("id") % 25).alias("cohort"))
    scores = spark.range(n - 1).select((F.col("id") * 3).alias("a"), (F.col("id") * 3 + 3).alias("b"), F.lit(1.0).alias("score"))
    sizes = match.table_sizes(n)
    got = match.assign_tables(people, scores, sizes, rounds=200).groupBy("table").agg(F.count("*").alias("n"), F.count_distinct("person").alias("d"))
    assert sorted(r["n"] for r in got.collect()) == sorted(sizes)
    few = people.limit(12)
    at = dict(rows(match.assign_tables(few, scores, [6, 6], rounds=3000)))
    inside = sum(at[x] == at[x + 3] for x in range(0, 33, 3))
    assert sorted(at) == list(range(0, 36, 3)) and inside >= 8
    assert match.assign_tables(few, scores.where("a < 0"), [6, 6], rounds=5).count() == 12
    assert match.assign_tables(people.limit(0), scores, [0], rounds=5).count() == 0


def test_reciprocal_overlap_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(match, "USERS", 7)
    monkeypatch.setattr(match, "CHUNK", 3)
    have = spark.range(240).select((F.col("id") % 40).alias("user_id"), (F.col("id") * 7 % 23).alias("item_id"), (F.col("id") % 3 + 1).alias("k")).dropDuplicates(["user_id", "item_id"])
    want = spark.range(200).select((F.col("id") % 50).alias("user_id"), (F.col("id") * 5 % 29).alias("item_id"))
    pairs = have.withColumnRenamed("user_id", "a").join(want.distinct().withColumnRenamed("user_id", "b"), "item_id").where("a <> b").groupBy("a", "b").agg(F.sum("k").alias("score"))
    got = match.reciprocal_overlap(have, want)
    assert rows(got) == rows(match.reciprocal(pairs)) != []
    assert match.reciprocal_overlap(have.limit(0), want).count() == 0


def test_content_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 6)
    monkeypatch.setattr(vector, "TILE", 4)
    vectors = spark.range(50).select(F.col("id").alias("item_id"), F.array(*(F.cos(F.col("id") * (d + 1)) for d in range(3))).alias("e"))
    train = spark.range(90).select((F.col("id") % 20).alias("user_id"), (F.col("id") * 7 % 60).alias("item_id"))
    vecs = {r["item_id"]: np.array(r["e"]) / np.linalg.norm(r["e"]) for r in vectors.collect()}
    seen = {}
    for u, i in rows(train):
        seen.setdefault(u, set()).add(i)
    want = []
    for u, items in seen.items():
        p = np.mean([vecs[i] for i in items if i in vecs], axis=0)
        score = sorted((-round(float(v @ p / np.linalg.norm(p)), 6), i) for i, v in vecs.items() if i not in items)[:4]
        want += [(u, i, k + 1) for k, (_, i) in enumerate(score)]
    got = recommend.content_knn(train, vectors, 4)
    assert rows(got.select("user_id", "item_id", "rank")) == sorted(want)
    assert rows(recommend.content_knn(train, vectors.where("item_id > 100"), 4)) == []


def test_bounded_injection_makes_edges_among_vectors_once(spark, monkeypatch):
    lines = spark.range(400).select((F.col("id") % 90).alias("l_orderkey"), (F.col("id") * 7 % 60).alias("l_partkey"))
    seq = spark.range(200).select((F.col("id") % 12).alias("user_id"), (F.col("id") * 11 % 60).alias("item_id"), F.col("id").alias("pos"))
    part = spark.range(60).select(F.col("id").alias("p_partkey"), (F.col("id") % 5).alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    vectors = spark.range(20).select((F.col("id") * 2).alias("item_id"), F.array(F.cos("id"), F.sin("id")).alias("e"))
    kept = {r["item_id"] for r in vectors.collect()}
    every = graph.typed_edges(lines, seq, part)
    near = graph.typed_edges(lines, seq, part, vectors)
    assert rows(near) == [e for e in rows(every) if e[0] in kept and e[1] in kept] != []
    assert {r[2] for r in rows(near)} == {"bought_together", "also_bought", "also_viewed"}
    weights, made = graph.undirected_weights(every), []
    means = graph.neighbour_means
    monkeypatch.setattr(graph, "neighbour_means", lambda *a: made.append(1) or means(*a))
    moved, beta = graph.inject_bounded(vectors, graph.undirected_weights(near), lambda m: 1.0, 0.15)
    assert len(made) == 1 and beta == 0.3 / 16
    want = {r["item_id"]: r["e"] for r in graph.inject(vectors, weights, beta * 2).collect()}
    got = {r["item_id"]: r["e"] for r in moved.collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[i], got[i]) for i in want)


def test_shared_tokens_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "KEYS", 7)
    monkeypatch.setattr(joins, "CHUNK", 3)
    tokens = spark.range(400).select((F.col("id") % 45).alias("k"), F.concat(F.lit("t"), (F.col("id") * 7 % 31).cast("string")).alias("token")).union(spark.sql("select 3L, 't1' union all select 3L, 'alone' union all select 4L, null"))
    a = tokens.distinct()
    want = a.withColumnRenamed("k", "a").join(a.withColumnRenamed("k", "b"), "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    assert rows(joins.shared_tokens(tokens, "k")) == rows(want) != []
    assert joins.shared_tokens(tokens.limit(0), "k").count() == 0


def plain_draws(users, items, k, rounds, temperature, gamma, delta, blur):
    """The simulator over lists of (id, vector, day), pair by pair."""
    import hashlib
    import math

    def uniform(*keys):
        return (int(hashlib.md5("-".join(str(x) for x in keys if x is not None).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    def unit(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    done, pop = [], {}
    for r in range(rounds):
        new = []
        for user, q, stop in users:
            scored = []
            for item, v, start in items:
                if start > stop or (user, item) in {x[:2] for x in done}:
                    continue
                fit = sum(x * y for x, y in zip(unit(q), unit(v), strict=True))
                fit += blur * math.sqrt(-2 * math.log(uniform(user, item, 1000))) * math.cos(2 * math.pi * uniform(user, item, 1001))
                score = fit / temperature + delta * math.exp((start - stop) / 180) + (gamma * math.log1p(pop.get(item, 0)) if r else 0.0)
                scored.append((-round(score - math.log(-math.log(uniform(user, item, r))), 9), item))
            new += [(user, item, r) for _, item in sorted(scored)[:k]]
        done += new
        for _, item, _ in new:
            pop[item] = pop.get(item, 0) + 1
    return sorted(done)


def test_simulator_lists_no_pairs(spark, monkeypatch):
    from larkmill.operators import generate

    rng = np.random.default_rng(11)
    users = [(u, [float(x) for x in rng.random(4)], float(rng.integers(0, 90))) for u in range(60)]
    items = [(i * 37, [float(x) for x in rng.random(4)], float(rng.integers(0, 90))) for i in range(50)]
    plans, write = [], generate.staged

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(generate, "staged", seen)
    monkeypatch.setattr(generate, "USERS", 7, raising=False)
    monkeypatch.setattr(generate, "ITEMS", 11, raising=False)
    u = spark.createDataFrame(users, "user_id bigint, e array<double>, stop double")
    i = spark.createDataFrame(items, "item_id bigint, e array<double>, start double")
    got = rows(generate.simulate(u, i, per_user=3, rounds=3, gamma=0.4, blur=0.1, delta=0.7))
    assert got == plain_draws(users, items, 3, 3, 0.25, 0.4, 0.7, 0.1)
    assert not any("explode" in p for p in plans)  # a row for each pair of user and item


def test_numbers_of_many_keys_at_once():
    import hashlib

    from larkmill.functions.chance import Uniforms

    for keys, left in (([str(i) for i in range(300)], "12345"), ([None, "a", "é" * 9], "u"), (["x" * 50, "y"], "abc"), (["1", "23"], None), (["9" * 20], "7" * 32), (["8"], "")):
        want = [(int(hashlib.md5("-".join([x for x in (left, k, "3") if x is not None]).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52) for k in keys]
        assert Uniforms(keys, 3)(left).tolist() == want


def test_many_staged_rows_are_not_broadcast(spark, tmp_path):
    from larkmill.operators.staging import BROADCAST_ROWS, staged
    from larkmill.plans import registry
    from larkmill.plans.base import Tables

    few, many = (staged(spark.range(n).select(F.lit(1).cast("bigint").alias("user_id"), F.lit(2).cast("bigint").alias("item_id"), F.lit(3).alias("rank")), "lists") for n in (10, BROADCAST_ROWS + 1))
    other = spark.range(10**7).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(other.join(few, ["user_id", "item_id"]))
    for grown in (many, many.where("rank <= 50"), many.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("lam"))):
        assert "Broadcast" not in plan(other.join(grown, ["user_id", "item_id"]))
    asked = Tables(spark, str(tmp_path))
    asked.__dict__.update(test=other, pred=many)
    met = inspect.getclosurevars(registry.queries()["set_04_intersection"]).nonlocals["f"](asked)
    assert "Broadcast" not in plan(met)
