"""The entry module's queries at the smallest scale against their oracles."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["agg_04_gini", "evl_07_metric_bundle", "evl_09_bucket_recall", "evl_13_sampled_retrieval", "evl_18_bootstrap", "ext_07_metric_registry", "gen_03_noisy_vectors", "grf_05_injection", "joi_13_cosine_top_k", "prj_23_separators", "rnk_11_sweep", "seq_05_count_windows", "set_06_jaccard", "vec_08_residual_quantization", "vec_22_item_knn"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
