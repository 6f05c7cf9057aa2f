import hashlib
import math
import os
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, corpus, groups_by_force, plain, secrets_by_force, segments_by_force
from tokenizers import Tokenizer

from larkmill.llm import bpe, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_columns_and_drop_what_they_must(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = p.staged(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and all(len(r["token_ids"]) == r["n_tokens"] for r in last.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, bench_items):
    """Labels and benchmark items of small tables."""
    at = tmp_path_factory.mktemp("sf")
    bench_items.withColumn("doc_id", F.lit(1)).where("item_id <> 4").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (4, None), (7, 0), (None, 1), (9, 1)], "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_on_odd_tables(spark, odd, empty, folder):
    import corpus_pipeline as p

    # rows with nulls, empty and long texts, a repeated id, copies, columns that stages could use themselves
    docs = odd.withColumn("n_chars", F.length("text").cast("int"))
    for name in ("copy", "Copy_", "bad", "pieces", "row", "token_ids", "toxic"):
        docs = docs.withColumn(name, F.lit("x"))
    out = {name: stage(spark, docs, folder) for name, stage in p.STAGES}
    assert all(out[name].schema["doc_id"].dataType == docs.schema["doc_id"].dataType and out[name].columns == docs.columns for name, _ in p.STAGES[:-1])
    ids = {name: Counter(r["doc_id"] for r in df.collect()) for name, df in out.items()}
    every = Counter(r["doc_id"] for r in docs.collect())
    assert ids["toxicity"] == ids["secrets"] == ids["encoding"] == every
    assert ids["near_dedup"] == Counter({k: 1 for k in every if k != 8})  # 8 is a copy of 7
    assert ids["decontamination"] == Counter({k: n for k, n in every.items() if k not in (7, 8)})  # they hold item 1
    assert {"lang", "source", "n_chars", "copy"} <= set(out["encoding"].columns)
    repeated = docs.where("doc_id = 7 or doc_id is null").union(docs.where("doc_id = 7 or doc_id is null"))
    assert Counter(r["doc_id"] for r in p.near_dedup_stage(spark, repeated, folder).collect()) == {7: 1, None: 2}
    for name, stage in p.STAGES:
        none = stage(spark, empty, folder)
        assert none.count() == 0 and (name == "encoding" or none.columns == empty.columns)


def masked_by_force(text, trees):
    """text with its findings masked, each where it stands."""
    out, at = "", 0
    for value, _ in secrets_by_force(text, trees):
        start = text.index(value, at)
        out += text[at:start] + secrets.MASK
        at = start + len(value)
    return out + text[at:]


def test_pipeline_like_plain_python(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(31)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 12, 25, 40))]
    docs, labels = [], []
    for i, t in corpus(30, 260):
        w = t.split()
        bad = i % 7 == 0
        for _ in range(6 * bad):
            w.insert(rng.randrange(len(w) + 1), "grumf" + rng.choice(["", "a", "et", "os"]))
        if i % 11 == 0:
            w = w[:5] + items[i % 4][1].split() + w[5:]
        if i % 13 == 0:
            w.append(f'token = "{hashlib.sha1(t.encode()).hexdigest()}" end')
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in p.run(spark, str(tmp_path)).collect()}

    m = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def toxic(text):
        tokens = toxicity.WORD.findall(text.lower())
        weights = [next((m.weights[f] for f in [w, *(w[:k] + "*" for k in (7, 5, 4, 3) if len(w) > k)] if f in m.weights), 0.0) or toxicity.PENALTY for w in tokens]
        places = [k for k, s in enumerate(weights) if s > 0]
        near = [k for k in range(len(weights)) if any(abs(k - x) <= 20 for x in places)]  # segments lie near positive tokens
        part = [weights[k] for k in near]
        best = 0.0
        scores = sorted((s for _, _, s in segments_by_force(part)), reverse=True)
        for r, s in enumerate(scores, 1):
            ln_e = m.ln_k + math.log(max(len(tokens), 1)) - m.scale * s
            if ln_e < math.log(r):
                e = math.exp(ln_e)
                best = max(best, e + math.lgamma(r + 1) - r * ln_e + math.log1p(-e / (r + 1)))
        return m.score(min(best, toxicity.SATURATION)) >= 0.5

    kept = [(i, t) for i, t, *_ in docs if not toxic(t)]
    assert 20 < len(docs) - len(kept) < 80
    groups = groups_by_force(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    grams = lambda w, n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    holds = lambda t, q: len(grams(plain(t), min(5, len(plain(q)))) & grams(plain(q), min(5, len(plain(q))))) / len(grams(plain(q), min(5, len(plain(q))))) >= 0.8
    clean = [(i, t) for i, t in kept if not any(holds(t, q) for _, q in items)]
    assert len(clean) < len(kept)
    trees = secrets.train(spark)
    masked = [(i, masked_by_force(t, trees)) for i, t in clean]
    assert any(a != b for a, b in zip(clean, masked, strict=True))
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = {i: (library.encode(t, add_special_tokens=False).ids, len(t)) for i, t in masked}
    assert {i: (list(r["token_ids"]), r["n_chars"]) for i, r in got.items()} == want
