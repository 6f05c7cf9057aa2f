"""Extension points, writers and readers around them, and the parts of recommenders that differ by size."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill import __main__ as cli
from larkmill import extend
from larkmill.functions import chance, codes
from larkmill.operators import cluster, evaluate, graph, neighbours, ranking, recommend, sequence, stats, vector
from larkmill.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_steps_drop_rows_before_the_next(spark):
    seen = []
    steps = [lambda d: d.withColumn("drop", F.col("id") % 2 == 0), lambda d: (seen.append(d.columns), d.withColumn("x", F.col("id") * 10))[1]]
    assert rows(extend.applied(spark.range(5), steps)) == [(1, 10), (3, 30)] and seen == [["id"]]


def test_dense_and_squeeze(spark):
    df = spark.sql("SELECT array(array(1, 2)) AS one, array(array(1), array(2)) AS two, array() AS none")
    assert df.select(codes.dense(F.array(F.lit(3), F.lit(0)), F.array(F.lit(7), F.lit(5)), 5)).first()[0] == [5, 0, 0, 7, 0]
    assert df.select(codes.squeeze(F.col("one"))).first()[0] == [1, 2] and df.select(codes.squeeze(F.col("none"))).first()[0] is None
    with pytest.raises(Exception, match="more than one entry"):
        df.select(codes.squeeze(F.col("two"))).collect()


def test_plug_ins(spark):
    v = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.2, 3.0])], "item_id bigint, e array<double>")
    book = spark.createDataFrame([(0, [9.0, 0.0]), (1, [0.0, 1.0])], "code int, centroid array<double>")
    assert [r["code"] for r in extend.assigned(v, book, "cosine").orderBy("item_id").collect()] == [0, 1]
    assert [r["code"] for r in extend.assigned(v, book, choose=F.array_max).orderBy("item_id").collect()] == [0, 0]
    with pytest.raises(KeyError):
        extend.registered(["speed"])


def test_combination_hook(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, e array<double>")
    edges = spark.createDataFrame([(1, 2, "also_bought")], "src bigint, dst bigint, relation string")
    f = extend.foundation(v, edges, centre=False)
    assert rows(extend.variant(f, "blend").select("item_id", F.round(F.col("e")[0], 6))) == [(1, 0.7), (2, 0.3)]
    assert rows(extend.variant(f, lambda x: x.vectors.where("item_id = 2").select("item_id"))) == [(2,)]


def test_writers(spark, tmp_path):
    a = spark.createDataFrame([("A", "ndcg@10", 0.5), ("A", "note", None), ("B", "hr", 1.0)], "label string, metric string, value double")
    files.write_results(a, f"{tmp_path}/r", {"file": 'x "y"'})
    got = {k: v for line in spark.read.text(f"{tmp_path}/r").collect() for k, v in json.loads(line[0]).items()}
    assert got["A"]["ndcg@10"] == 0.5 and got["A"]["_source"] == {"file": 'x "y"'} and got["B"]["hr"] == 1.0
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "p.json").write_text(json.dumps({"points": {"C": {"ndcg@10": 0.25, "_source": {"a": 1}}, "_test": {"ndcg@10": 9}}}))
    assert rows(files.metric_bundles(spark, f"{tmp_path}/points", "ndcg@10")) == [("C", "ndcg@10", 0.25)]
    spark.range(7).write.parquet(f"{tmp_path}/t")
    made = files.manifest(spark, f"{tmp_path}/t", {"seed": 1})
    assert sum(r["rows"] or 0 for r in made.collect()) == 7 and json.loads(made.first()["parameters"]) == {"seed": 1}
    with pytest.raises(ValueError, match="more than 3 rows"):
        files.markdown(spark.range(4), 3)
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(f"{tmp_path}/m/a")
    spark.createDataFrame([(1, "b")], "id int, x string").write.parquet(f"{tmp_path}/m/b")
    with pytest.raises(ValueError, match="different rows"):
        files.merged(spark, f"{tmp_path}/m", "id", f"{tmp_path}/out")


def test_metric_log_and_movies(spark, tmp_path):
    for run, text in (("r1", "step,val/ndcg,train/loss\n1,,0.5\n2,0.25,\n"), ("r2", "train/loss,step,val/hr\n0.1,5,0.75\n")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.csv").write_text(text)
    assert rows(files.metric_log(spark, f"{tmp_path}/runs")) == [("r1", 2, "val/ndcg", 0.25), ("r2", 5, "val/hr", 0.75)]
    (tmp_path / "m.dat").write_text("1::Toy (1995)::Animation|Comedy\nbad\n")
    assert rows(files.movies(spark, f"{tmp_path}/m.dat")) == [(1, "Toy (1995)", ["Animation", "Comedy"])]


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "ext_07_metric_registry" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "x"])


def history(seed=3, users=40, items=25):
    rng = np.random.default_rng(seed)
    return [(int(u), int(i)) for u in range(users) for i in rng.choice(items, rng.integers(1, 9), replace=False)]


def test_item_neighbours_alike_at_every_size(spark, monkeypatch):
    train = spark.createDataFrame(history(), "user_id bigint, item_id bigint")
    small = rows(recommend.item_similarities(train, 4)), rows(recommend.item_knn(train, recommend.neighbour_lists(train, 4), 5))
    monkeypatch.setattr(recommend, "BROADCAST_PAIRS", 3)
    monkeypatch.setattr(recommend, "BROADCAST_NEIGHBOURS", 3)
    assert small == (rows(recommend.item_similarities(train, 4)), rows(recommend.item_knn(train, recommend.neighbour_lists(train, 4), 5)))
    x = np.zeros((40, 25))
    for u, i in history():
        x[u, i] = 1
    co = x.T @ x
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.nan_to_num(np.floor(co / np.sqrt(np.outer(co.diagonal(), co.diagonal())) * 1e9 + 0.5)) / 1e9
    np.fill_diagonal(sim, 0)
    want = sorted((i, j, sim[i, j]) for i in range(25) for j in range(25) if sim[i, j] > 0 and sim[i, j] >= np.sort(sim[i])[-4])
    assert small[0] == want
    empty = train.where("false")
    assert recommend.item_knn(empty, recommend.neighbour_lists(empty), 3).count() == 0


def test_history_neighbours_by_blocks(spark, monkeypatch):
    # some ids far apart, an item that all users have, repeated rows, rows without an id
    have = [(u * 3, i if i else 1 << 40) for u, i in history(5, 60, 40)] + [(u * 3, 7) for u in range(60)]
    train = spark.createDataFrame([*have, *have[:9], (None, 3), (3, None), (999, 1000)], "user_id bigint, item_id bigint")
    small = rows(recommend.history_knn(train, 5, 4))
    lists = rows(recommend.item_similarities(train, 4))
    assert small == rows(recommend.item_knn(train.dropna(), recommend.neighbour_lists(train, 4), 5)) and len(small) > 250
    monkeypatch.setattr(recommend, "BROADCAST_PAIRS", 3)
    # neither pairs nor lists are shuffled or joined
    monkeypatch.setattr(type(train), "join", None)
    assert lists == rows(recommend.item_similarities(train, 4)) and small == rows(recommend.history_knn(train, 5, 4))
    for name, least in (("PAIRS", 50), ("CUT", 20), ("WIDTH", 7), ("REACH", 300), ("ROW", 16), ("HELD", 40), ("SUMMED", 30), ("USERS", 3)):
        monkeypatch.setattr(neighbours, name, least)
    assert lists == rows(recommend.item_similarities(train, 4)) and small == rows(recommend.history_knn(train, 5, 4))
    assert recommend.history_knn(train.where("false"), 3).count() == 0 and recommend.history_knn(train.where("user_id = 999"), 3).count() == 0


def test_popularity_alike_at_every_size(spark, monkeypatch):
    train = spark.createDataFrame(history(), "user_id bigint, item_id bigint")
    counts = sequence.item_counts(train, spark.range(30).select(F.col("id").alias("item_id")))
    users = spark.range(45).select(F.col("id").alias("user_id"))
    small = rows(recommend.most_popular(counts, train, users, 6))
    monkeypatch.setattr(recommend, "LISTED", 1)
    monkeypatch.setattr(sequence, "ONE_TASK", 1)
    assert small == rows(recommend.most_popular(counts, train, users, 6)) and len(small) == 45 * 6


def test_global_statistics(spark, monkeypatch):
    values = [5, 5, 3, 0, 9, 1, 1, 1, 0, 7]
    df = spark.createDataFrame(list(enumerate(values)), "k bigint, x bigint")
    s = sorted(values, reverse=True)
    want = {share: next(n for n in range(1, 11) if sum(s[:n]) >= share * sum(s)) for share in (0.0, 0.25, 0.5, 0.9, 1.0)}
    assert dict(rows(stats.items_for_mass(df, "k", "x", list(want)))) == want
    one = stats.top_share(df, "k", "x", 0.35).first()[0]
    monkeypatch.setattr(sequence, "ONE_TASK", 1)
    assert one == stats.top_share(df, "k", "x", 0.35).first()[0] == sum(s[:3]) / sum(s)


def test_pareto_like_definition(spark):
    rng = np.random.default_rng(5)
    pts = [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, 6, (40, 2)))]
    want = {k: any(o[1] >= a and o[2] >= b and (o[1] > a or o[2] > b) for o in pts) for k, a, b in pts}
    assert {r["k"]: r["dominated"] for r in ranking.pareto(spark.createDataFrame(pts, "k int, x int, y int").repartition(3), "x", "y", "k").collect()} == want


def test_chance_does_not_depend_on_partitions(spark):
    pairs = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 7 - 2.5).alias("d"))
    a, b = (stats.bootstrap(pairs.repartition(n), rounds=40).first().asDict() for n in (1, 5))
    assert a == pytest.approx(b) and a["lo"] < a["mean"] < a["hi"]
    w = spark.range(20_000).select(chance.poisson(chance.uniform("id")).alias("w"), chance.normal("id").alias("z")).agg(F.avg("w"), F.var_pop("w"), F.avg("z"), F.var_pop("z")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05 and abs(w[2]) < 0.03 and abs(w[3] - 1) < 0.05


def test_verdict_knows_its_table(spark):
    made = lambda n: spark.createDataFrame([(c, s, "m", float(s % 3) * 0.01 + (c == "a")) for c in "ab" for s in range(n)], "condition string, seed int, metric string, value double")
    jitter = lambda n: made(n).withColumn("value", F.col("value") + F.when(F.col("condition") == "a", F.col("seed") * 0.001).otherwise(0.0))
    assert stats.verdict(jitter(2), "a", "b").first()["significant"] is True
    assert stats.verdict(jitter(8), "a", "b").first()["significant"] is True
    assert stats.verdict(jitter(12), "a", "b").first()["significant"] is None


def test_retrieval_places_vary(spark):
    rng = np.random.default_rng(1)
    catalog = [(k, rng.normal(size=4).tolist()) for k in range(50)]
    q = spark.createDataFrame([(k, e, (k + 1) % 50) for k, e in catalog], "query_id bigint, e array<double>, positive bigint")
    got = evaluate.sampled_retrieval(q, spark.createDataFrame(catalog, "item_id bigint, e array<double>"), 20).collect()
    assert len(got) == 50 and len({r["place"] for r in got}) > 5 and all(1 <= r["place"] <= r["n"] + 1 for r in got)


def test_principal_components_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ np.diag([3, 2, 1, 0.5, 0.2])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "item_id bigint, e array<double>")
    got = np.array([r["projection"] for r in cluster.principal_components(df, 2).orderBy("item_id").collect()])
    w, v = np.linalg.eigh(np.cov(x.T))
    want = x @ v[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    share = cluster.explained_variance(df, 2)
    assert np.allclose(share, (w[::-1] / w.sum())[:2])


def test_linear_model_like_numpy(spark):
    train = spark.createDataFrame(history(4, 30, 12), "user_id bigint, item_id bigint")
    x = np.zeros((30, 12))
    for u, i in history(4, 30, 12):
        x[u, i] = 1
    p = np.linalg.inv(x.T @ x + 250 * np.eye(12))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0)
    s = x @ b
    for r in recommend.ease(train, 3).collect():
        assert r["score"] == pytest.approx(s[r["user_id"], r["item_id"]], abs=1e-9) and not x[r["user_id"], r["item_id"]]


def test_lloyd_like_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(60, 3)), 3)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "item_id bigint, e array<double>")
    start = [(c, x[c * 7].tolist()) for c in range(4)]
    got = {r["code"]: r["centroid"] for r in cluster.lloyd(df, spark.createDataFrame(start, "code int, centroid array<double>"), rounds=3).collect()}
    c = np.array([e for _, e in start])
    for _ in range(3):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(4)])
    assert np.allclose([got[k] for k in range(4)], c, atol=1e-9)


def test_bounded_injection_halves(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 6)], "item_id bigint, e array<double>")
    w = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src bigint, dst bigint, w double")
    assert graph.inject_bounded(v, w, lambda moved: 1.0, 0.5, beta=0.4, rounds=3)[1] == pytest.approx(0.05)
    assert graph.inject_bounded(v, w, lambda moved: 0.1, 0.5, beta=0.4)[1] == 0.4


def test_slots_like_plain_python(spark):
    rng = np.random.default_rng(8)
    lists = {u: rng.permutation(9).tolist() for u in range(12)}
    df = spark.createDataFrame([(u, int(i), r) for u, items in lists.items() for r, i in enumerate(items, 1)], "user_id bigint, item_id bigint, rank int")
    used, want = {}, []
    for u in range(12):
        left = [i for i in lists[u] if used.get(i, 0) < 4]
        shown = left[:2]
        others = left[2:]
        if others:
            least = min(used.get(i, 0) for i in others)
            shown.append(next(i for i in others if used.get(i, 0) == least))
        for slot, i in enumerate(shown, 1):
            used[i] = used.get(i, 0) + 1
            want.append((u, i, slot, slot > 2))
    assert rows(ranking.exposure_slots(df, 2, 4, explore=1)) == sorted(want) and max(used.values()) <= 4


def test_simulator_minds_days_and_wants(spark):
    from larkmill.operators import generate

    users = spark.createDataFrame([(u, [1.0, 0.2, 0.1], 10.0 * u) for u in range(4)], "user_id bigint, e array<double>, stop double")
    items = spark.createDataFrame([(i, [float(i % 2), 1.0, 0.0], 5.0 * i) for i in range(8)], "item_id bigint, e array<double>, start double")
    made = generate.simulate(users, items, per_user=2, rounds=1, wanted=1, delta=0.5, blur=0.01)
    got = rows(made.select("user_id", "item_id"))
    assert got and all(5 * i <= 10 * u for u, i in got) and {u for u, _ in got} == {0, 1, 2, 3}
    cold = generate.simulate(users.drop("stop"), items.drop("start"), per_user=4, rounds=1, temperature=0.001, wanted=1)
    assert all(i % 2 for _, i in rows(cold.select("user_id", "item_id")))  # only the first dimension counts, in which even items have nothing


def test_reviews_know_their_lines(spark, tmp_path):
    import gzip

    for name, n in (("a", 3), ("b", 2)):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.writelines(json.dumps({"reviewerID": f"{name}{k}", "asin": "x", "unixReviewTime": k}) + "\n" for k in range(n))
    got = rows(files.reviews(spark, f"{tmp_path}/*.json.gz").select("file", "orig_order", "reviewerID"))
    assert got == [("a.json.gz", 0, "a0"), ("a.json.gz", 1, "a1"), ("a.json.gz", 2, "a2"), ("b.json.gz", 0, "b0"), ("b.json.gz", 1, "b1")]


def test_nearest_valid_like_definition(spark):
    rng = np.random.default_rng(9)
    catalog = [(k, *map(int, rng.integers(0, 4, 3))) for k in range(30)]
    asked = [(100 + k, *map(int, rng.integers(0, 6, 3))) for k in range(40)] + [(200, 9, 9, 9)]
    want = {}
    for k, *c in asked:
        agree, item = max((sum(a == b for a, b in zip(c, x[1:], strict=True)), -x[0]) for x in catalog)
        want[k] = (-item, agree)
    got = evaluate.nearest_valid(spark.createDataFrame(asked, "id bigint, c1 int, c2 int, c3 int"), spark.createDataFrame(catalog, "item_id bigint, c1 int, c2 int, c3 int"), ["c1", "c2", "c3"])
    assert {r["id"]: (r["nearest"], r["agree"]) for r in got.collect()} == want


def test_example_records_without_a_schema(spark, tmp_path):
    from larkmill.sources import tfrecord

    spark.dataSource.register(tfrecord.TFRecord)
    df = spark.createDataFrame([(1, "a", [1, 2], 0.5), (2, "é", [3], None)], "id bigint, text string, seq array<bigint>, x double").coalesce(1)
    for kind in ("gzip", "none"):
        df.write.format("tfrecord").option("compression", kind).mode("append").save(f"{tmp_path}/{kind}")
        back = spark.read.format("tfrecord").load(f"{tmp_path}/{kind}")
        assert back.schema.simpleString() == "struct<id:bigint,seq:array<bigint>,text:string,x:double>" and rows(back) == [(1, [1, 2], "a", 0.5), (2, [3], "é", None)]
    part = next((tmp_path / "none").glob("*.tfrecord"))
    data = bytearray(part.read_bytes())
    data[-1] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        spark.read.format("tfrecord").schema("id bigint").load(f"{tmp_path}/none").collect()
    assert spark.read.format("tfrecord").option("verify", "false").schema("id bigint").load(f"{tmp_path}/none").count() == 2


@pytest.mark.parametrize("block", [0, 7])
def test_neighbours_like_definition(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (90, 4)).astype(float)
    v[:30] = v[0]  # one vector of many rows: ties at the cut
    rows_ = [(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)] + [(90, None, "a")]
    table = spark.createDataFrame(rows_, "item_id bigint, e array<double>, label string")
    norms = np.linalg.norm(v, axis=1)
    cos = np.round((v / np.where(norms == 0, 1, norms)[:, None]) @ (v / np.where(norms == 0, 1, norms)[:, None]).T, 9)
    monkeypatch.setattr(vector, "TILE", 5)
    for group, floor in ((None, None), ("label", 0.05)):
        want = []
        for i in range(90):
            others = [j for j in range(90) if j != i and (not group or (i - j) % 2) and (floor is None or cos[i, j] >= floor)]
            want += [(i, j) for j in sorted(others, key=lambda j: (-cos[i, j], j))[:6]]
        got = rows(vector.neighbours(table, 6, group=group, floor=floor, block=block).select("item_id", "nbr"))
        assert got == sorted(want)
    wide = np.full((3, 40), 0.5)
    top = vector._best((np.full((3, 2), -np.inf), np.zeros((3, 2), np.int64)), wide, np.arange(40)[::-1], 2, None)
    assert top[1].tolist() == [[0, 1]] * 3


def test_digests_of_parts_without_a_shuffle(spark):
    h = spark.createDataFrame([(1, [4, 5, 4]), (2, [7]), (3, [])], "user_id bigint, items array<bigint>")
    made = sequence.subsequence_digests(h)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert rows(made) == [(1, 0, 2, md5("4-5|4-5-4")), (1, 1, 1, md5("5-4"))]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_users_stream_through_the_one_task(spark):
    """No group is gathered in Python, and lists cut by batches come out whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = [(u, i, r, 1 / (1 + r)) for u in range(9) for r, i in enumerate(((u + 3 * r) % 7 for r in range(7)), 1)]
        ranked = spark.createDataFrame(made[::-1], "user_id bigint, item_id bigint, rank bigint, score double").repartition(3)
        seen, want = {}, []
        for u in range(9):
            mine = [(i, np.log(s) - 0.5 * np.log1p(seen.get(i, 0))) for v, i, _, s in made if v == u]
            placed = [i for i, _ in sorted(mine, key=lambda x: -x[1])]
            want += [(u, i, n) for n, i in enumerate(placed, 1)]
            for i in placed[:2]:
                seen[i] = seen.get(i, 0) + 1
        for df in (ranking.rerank_exposure(ranked, 0.5, slots=2), ranking.exposure_slots(ranked, 2, 4, explore=1)):
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert rows(ranking.rerank_exposure(ranked, 0.5, slots=2)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_strict_ranks_meet_only_rows_with_a_target(spark):
    rng = np.random.default_rng(2)
    v, label = rng.normal(size=(40, 3)), [i % 3 for i in range(40)]
    table = spark.createDataFrame([(i, v[i].tolist() if i != 4 else None, label[i]) for i in range(40)], "item_id bigint, e array<double>, label int")
    want = []
    for i in range(40):
        to = (3 * i + 1) % 10
        if i != 4 and to not in (i, 4) and label[i] == label[to]:
            want.append((i, sum(round(v[i] @ v[j], 9) > round(v[i] @ v[to], 9) for j in range(40) if j not in (i, 4) and label[j] == label[i])))
    got = evaluate.strict_ranks(table, (3 * F.col("item_id") + 1) % 10)
    assert rows(got) == want and want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
