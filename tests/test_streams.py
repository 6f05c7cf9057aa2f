from larkmill.streaming import streams


def put(spark, tmp_path, rows, schema, name, files=2):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return streams.unbounded(spark, path, schema)


def test_online_rerank(spark, tmp_path):
    schema = "user_id bigint, items array<bigint>, scores array<double>"
    s = put(spark, tmp_path, [(u, [1, 2, 3], [0.5, 0.4, 0.3]) for u in range(6)], schema, "lists")
    got = streams.run_to_memory(streams.rerank_online(s, 5.0, 1, shards=1), "reranked").where("rank = 1").collect()
    assert len(got) == 6 and {r["item_id"] for r in got} == {1, 2, 3}


def test_stages(spark, tmp_path):
    s = put(spark, tmp_path, [(1, "register", 0), (1, "issue", 1), (1, "check-in", 2), (2, "issue", 0)], "person bigint, stage string, at int", "stages", 1)
    got = {(r["person"], r["stage"]): r["accepted"] for r in streams.run_to_memory(streams.staged_events(s), "staged").collect()}
    assert got == {(1, "register"): True, (1, "issue"): False, (1, "check-in"): True, (2, "issue"): False}


def test_centroids_and_buffer(spark, tmp_path):
    s = put(spark, tmp_path, [(i, [float(i % 2) * 10, 0.0]) for i in range(20)], "item_id bigint, e array<double>", "vectors")
    running = streams.Centroids([(0, [1.0, 0.0]), (1, [9.0, 0.0])])
    q = s.writeStream.foreachBatch(running.update).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert [(c, v, n) for c, v, n in running.book] == [(0, [0.0, 0.0], 10), (1, [10.0, 0.0], 10)]
    streams.buffered(s, str(tmp_path / "out"), str(tmp_path / "c2"), 5).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0])], "code int, centroid array<double>")
    late = streams.run_to_memory(streams.late_arrivals(s.selectExpr("item_id as id", "e as r"), book), "late").collect()
    assert all(r["code"] == r["id"] % 2 for r in late)
