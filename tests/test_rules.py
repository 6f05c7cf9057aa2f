"""Hand-checked rules of sequences, metrics and codes."""

import pytest
from pyspark.sql import functions as F

from larkmill.functions import codes, text
from larkmill.operators import evaluate, graph, match, ranking, recommend, sequence, stats, vector


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_leave_one_out(spark):
    log = spark.createDataFrame([("a", i, i) for i in (1, 2, 3, 4)] + [("b", 1, 1), ("b", 2, 2)], "user_id string, item_id bigint, ts bigint")
    loo = sequence.leave_one_out(sequence.positions(log, ["ts"]))
    assert rows(loo.select("user_id", "item_id", "split")) == [("a", 1, "train"), ("a", 2, "train"), ("a", 3, "val"), ("a", 4, "test")]


def test_count_windows_never_divide_a_value(spark):
    df = spark.createDataFrame([(t,) for t in (1, 1, 1, 2, 3)], "ts bigint")
    got = {r["chunk"]: r["n"] for r in sequence.count_windows(df, "ts", 5).groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 3, 3: 1, 4: 1}


def test_long_tail_ties_by_id(spark):
    counts = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, 0)], "item_id bigint, cnt bigint")
    assert {r["item_id"] for r in sequence.long_tail(counts, 0.5).where("tail").collect()} == {2, 3}


def test_serials_follow_ids(spark):
    df = spark.createDataFrame([(5, 1), (9, 1), (7, 1)], "item_id bigint, c1 int")
    assert rows(vector.with_serial(df, ["c1"]).select("item_id", "dis")) == [(5, 0), (7, 1), (9, 2)]


def test_two_recalls_differ(spark):
    pred = spark.createDataFrame([(1, 1, 1)], "user_id bigint, item_id bigint, rank int")
    target = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "user_id bigint, item_id bigint")
    assert evaluate.per_user(pred, target, [1]).first()["recall"] == pytest.approx(1 / 3)
    assert evaluate.clamped_recall(pred, target, 1).first()["recall"] == 1.0


def test_tail_shares(spark):
    pred = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 1)], "user_id bigint, item_id bigint, rank int")
    tail = spark.createDataFrame([(1, True), (2, False)], "item_id bigint, tail boolean")
    r = evaluate.tail_shares(pred, tail, [10]).first()
    assert (r["aplt"], r["tail_exposure"]) == (0.25, pytest.approx(1 / 3))


def test_rerank_zero_keeps_order(spark):
    ranked = spark.createDataFrame([(1, i, i, 0.5) for i in range(1, 6)], "user_id bigint, item_id bigint, rank int, score double")
    counts = spark.createDataFrame([(i, 10 - i) for i in range(1, 6)], "item_id bigint, cnt bigint")
    assert all(r["rank"] == r["new_rank"] for r in ranking.rerank_popularity(ranked, counts, F.lit(0.0)).collect())


def test_level_offsets(spark):
    df = spark.createDataFrame([([3, 260, 520],)], "c array<bigint>")
    assert df.select(codes.remove_level_offset(F.col("c"), 3, 257)).first()[0] == [3, 3, 6]
    with pytest.raises(Exception, match="out of its level"):
        df.select(codes.remove_level_offset(F.array(F.lit(300).cast("bigint")), 3, 257)).collect()


def test_injection_skips_parallel_means(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "item_id bigint, e array<double>")
    w = spark.createDataFrame([(1, 2, 1.0), (3, 1, 1.0)], "src bigint, dst bigint, w double")
    got = {r["item_id"]: r["e"] for r in graph.inject(v, w, 0.5).collect()}
    assert got[1] == [1.0, 0.0] and got[2] == [2.0, 0.0]
    assert got[3] == pytest.approx([0.5, 1.0])


def test_gini_bounds(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "x bigint")
    assert stats.gini(df, "x").first()[0] == pytest.approx(0)
    assert stats.gini(df.select(F.lit(0).alias("x")), "x").first()[0] == 0


def test_exposure_rerank_spreads(spark):
    ranked = spark.createDataFrame([(u, i, i, 1.0 / i) for u in range(6) for i in (1, 2, 3)], "user_id bigint, item_id bigint, rank int, score double")
    first = {r["item_id"] for r in ranking.rerank_exposure(ranked, 3.0, slots=1).where("rank = 1").collect()}
    assert first == {1, 2, 3}
    assert {r["item_id"] for r in ranking.rerank_exposure(ranked, 0.0, slots=1).where("rank = 1").collect()} == {1}


def test_popular_excludes_seen(spark):
    counts = spark.createDataFrame([(i, 10 - i) for i in range(5)], "item_id bigint, cnt bigint")
    seen = spark.createDataFrame([(1, 0), (1, 1)], "user_id bigint, item_id bigint")
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    assert rows(recommend.most_popular(counts, seen, users, 2).select("user_id", "item_id")) == [(1, 2), (1, 3), (2, 0), (2, 1)]


def test_rebalancing_conserves_items_and_children(spark):
    base = [(i, i % 2, i % 6, 0) for i in range(60)]
    sid = spark.createDataFrame(base, "item_id bigint, c1 int, c2 int, c3 int")
    counts = spark.createDataFrame([(i, 60 - i) for i in range(60)], "item_id bigint, cnt bigint")
    res = spark.createDataFrame([(i, [float(i % 6), 1.0]) for i in range(60)], "item_id bigint, r array<double>")
    out = match.rebalance(sid, counts, sequence.head_mid_tail(counts), res, 1, parts=2, ratio=0.5).collect()
    assert sorted(r["item_id"] for r in out) == list(range(60))
    by_child = {}
    for r in out:
        by_child.setdefault((base[r["item_id"]][1], r["c2"]), set()).add(r["c1"])
    assert all(len(v) == 1 for v in by_child.values())


def test_table_sizes():
    for n in range(5, 80):
        sizes = match.table_sizes(n)
        assert sum(sizes) == n and max(sizes) <= 6 and max(sizes) - min(sizes) <= 1


def test_global_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert all(r["x"] == r["r"] for r in sequence.global_row_number(df, ["x"]).collect())


def test_join_and(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "l array<string>")
    assert [r[0] for r in df.select(text.join_and(F.col("l"))).collect()] == ["", "a", "a, b and c"]


def test_masking_always_masks_one(spark):
    df = spark.createDataFrame([(i, list(range(1, 6))) for i in range(50)], "user_id bigint, s array<bigint>")
    for r in df.select(codes.mask_tokens(F.col("s"), F.col("user_id"), 0.01, -1, 1).alias("m")).collect():
        assert -1 in r["m"] and len(r["m"]) == 5
