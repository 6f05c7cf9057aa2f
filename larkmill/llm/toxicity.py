"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are lower-cased words; each has a feature for the word and one for its first 7, 5, 4 and 3 letters, so that unseen words
of a known stem count. A feature's weight is its log-odds between toxic and clean labelled documents under a Dirichlet prior
in proportion to its frequency in all documents; features whose log-odds are not significant have none. A text is a sequence
of token scores: the weight of its most specific feature, or a penalty. One pass finds all maximal-scoring segments. By the
extreme-value law, the number of segments of at least some score in a clean text is Poisson distributed, with a mean that
falls exponentially in the score and grows with the text; the least probable of the best r segments, over all r, is the
evidence, and a logistic curve fitted on the learning rows turns it into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, light, rows, staged, table

#: Most labelled rows of either class that are learned from (smallest hashes first).
LEARN_ROWS = 20_000
#: Most features in the model.
FEATURES = 50_000
#: Documents of the toxic class that hold a feature, at least.
LEAST_DOCUMENTS = 3
#: Significance of a feature's log-odds (standard errors), and its least log-odds.
Z, LEAST_ODDS = 2.5, 1.5
#: Weight of the Dirichlet prior, in documents, and least weight of a feature in it.
PRIOR, LEAST_PRIOR = 50.0, 0.5
#: Score of a token without a feature.
PENALTY = -0.25
#: Largest evidence, a chance of e^-60: less likely counts and scores are certain alike.
SATURATION = 60.0
#: Words that a worker remembers the weight of, and their greatest length: some 8 MB at most.
REMEMBERED, REMEMBERED_LENGTH = 50_000, 32

WORD = re.compile(r"[^\W_]+")
STEMS = (7, 5, 4, 3)


def features(word: str) -> list[str]:
    """Of a word, from specific to general."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def segments(scored: list[tuple[int, float]], penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence, in one pass.

    scored: places and scores of the tokens with positive scores, in order; all others have the penalty. Each positive token
    opens a segment; it joins an earlier one where the whole scores more than either.
    """
    # a candidate: first, last, total before, total up to the end, and the nearest candidate before it of a smaller total
    # before (-1: none). Links lead past all candidates between, and a joined candidate inherits the link of its first part,
    # so that no link is followed twice and the pass is linear.
    found: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for place, score in scored:
        total += penalty * (place - last - 1)
        first, low = place, total
        total += score
        last = place
        k = len(found) - 1
        while k >= 0 and found[k][2] >= low:
            k = found[k][4]
        while k >= 0 and found[k][3] < total:
            first, _, low, _, before = found[k]
            del found[k:]
            k = before
        found.append((first, place, low, total, k))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


@dataclass
class Model:
    """Weights of features, the extreme-value law (scale and ln K) and the logistic curve."""

    weights: dict[str, float]
    scale: float = 1.0
    ln_k: float = 0.0
    slope: float = 1.0
    offset: float = -3.0

    def __post_init__(self):
        self.heads = {f[:3] for f in self.weights}
        self.seen: dict[str, float] = {}

    def token(self, word: str) -> float:
        """Weight of the most specific feature of a lower-cased word, 0 without one."""
        w = self.seen.get(word)
        if w is None:
            w = next((self.weights[f] for f in features(word) if f in self.weights), 0.0)
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = w
        return w

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and segments of a text."""
        words = WORD.findall((text or "").lower())
        heads, token = self.heads, self.token
        scored = [(i, s) for i, w in enumerate(words) if w[:3] in heads and (s := token(w)) > 0]
        return len(words), segments(scored) if scored else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Largest -ln p over r of the r best segments: a clean text of n tokens has Poisson many segments of a score of at least
        s, K n exp(-scale s) on average; p is the chance of r or more. No more than SATURATION."""
        best = 0.0
        for r, s in enumerate(sorted((x[2] for x in found), reverse=True), 1):
            ln_e = self.ln_k + math.log(max(n, 1)) - self.scale * s
            if ln_e < math.log(r):  # fewer expected than seen; the tail's terms fall at least like a geometric row from the first
                e = math.exp(ln_e)
                best = max(best, e + math.lgamma(r + 1) - r * ln_e + math.log1p(-e / (r + 1)))
        return min(best, SATURATION)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def _counts(batches):
    """(text, toxic) to (feature, toxic documents, clean documents)."""
    import pyarrow as pa

    for batch in batches:
        for at, to, texts in rows(batch.column(0)):
            both = (Counter(), Counter())
            for text, toxic in zip(texts.to_pylist(), batch.column(1).slice(at, to - at).to_pylist(), strict=True):
                both[0 if toxic else 1].update({f for w in set(WORD.findall((text or "").lower())) for f in features(w)})
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in both)], ["feature", "toxic", "clean"])


def _spread(wanted: set[str]):
    """text to (feature, documents), of the wanted features: a row for each and task."""
    heads = {f[:3] for f in wanted}

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()
        for batch in batches:
            for _, _, texts in rows(batch.column(0)):
                for text in texts.to_pylist():
                    held.update({f for w in set(WORD.findall((text or "").lower())) if w[:3] in heads for f in features(w) if f in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["feature", "documents"])

    return run


def _scores(model: Model):
    """(text, toxic) to (n, toxic, scores of segments)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, to, texts in rows(batch.column(0)):
                seen = [model.scan(t) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int64()), batch.column(1).slice(at, to - at), pa.array([[x[2] for x in found] for _, found in seen], pa.list_(pa.float64()))], ["n", "toxic", "scores"])

    return run


def _evidences(model: Model):
    """(n, toxic, scores) to (toxic, evidence)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [model.evidence(n, [(0, 0, s) for s in scores]) for n, scores in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.float64())], ["toxic", "evidence"])

    return run


def _fit_curve(xs: list[float], ys: list[int], counts: list[float] | None = None) -> tuple[float, float]:
    """Logistic regression on one variable, lightly ridged, by Newton steps; a row counts as counts says, or once."""
    import numpy as np

    x, y = np.array(xs, float), np.array(ys, float)
    c = np.ones(len(x)) if counts is None else np.array(counts, float)
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = c * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(c * x * (y - p)).sum() - 1e-3 * a, (c * (y - p)).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Model of the labelled documents; rows whose crc32(doc_id) mod 5 is 0 are never learned from.

    At most LEARN_ROWS rows of either class are used; the prior's frequencies cover all documents. In the logistic curve a row
    counts for all labelled rows of its class that it stands for, so that a score means the same at every size. A document
    with several labels is toxic if one of them is; of several texts of one id the smallest is learned from. Without toxic or
    clean rows every score is the same.
    """
    spark = documents.sparkSession
    docs = lean(documents).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("learn"))
    stands_for = {r["toxic"]: max(1.0, r["n"] / LEARN_ROWS) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(LEARN_ROWS).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(LEARN_ROWS))
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))
    sample = staged(sample.select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, offset=-3.0 if n0 or not n1 else 3.0)
    counted = sample.mapInArrow(light(_counts), "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    likely = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).where(F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0) > LEAST_ODDS / 2)
    held = {r["feature"]: (r["toxic"], r["clean"]) for r in likely.orderBy(F.desc(F.col("toxic") / n1 - F.col("clean") / n0), "feature").limit(FEATURES).collect()}
    shared = spark.sparkContext.broadcast(set(held))
    spread = docs.select("text").mapInArrow(light(lambda x: _spread(shared.value)(x)), "feature string, documents bigint").groupBy("feature").agg(F.sum("documents").alias("documents"))
    total = docs.count()
    prior = {r["feature"]: r["documents"] for r in spread.collect()}
    weights = {}
    for f, (t, c) in held.items():
        a = max(PRIOR * prior.get(f, t + c) / max(total, 1), LEAST_PRIOR)
        rest = PRIOR - a
        odds = math.log((t + a) / (n1 - t + rest)) - math.log((c + a) / (n0 - c + rest))
        if odds >= LEAST_ODDS and odds / math.sqrt(1 / (t + a) + 1 / (c + a)) >= Z:
            weights[f] = odds
    model = Model(weights)
    scored = staged(sample.mapInArrow(light(_scores(model)), "n bigint, toxic int, scores array<double>"), "segments")
    # scores of segments of clean texts above the least weight fall off exponentially: rate and scale by maximum likelihood
    floor = min(weights.values(), default=1.0)
    clean = scored.where("toxic = 0")
    tokens = clean.agg(F.sum("n")).first()[0] or 0
    over, excess = clean.select(F.explode("scores").alias("s")).where(F.col("s") >= floor).agg(F.count("*"), F.coalesce(F.sum(F.col("s") - floor), F.lit(0.0))).first()
    model.scale = (over + 1) / (excess + 1.0)
    model.ln_k = math.log((over + 0.5) / max(tokens, 1)) + model.scale * floor
    seen = scored.mapInArrow(_evidences(model), "toxic int, evidence double").collect()  # two numbers for each of 2 LEARN_ROWS rows at most
    model.slope, model.offset = _fit_curve([r["evidence"] for r in seen], [r["toxic"] for r in seen], [stands_for[r["toxic"]] for r in seen])
    return model


def score_documents(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted, passages) for every row; passages: first and last word and score of each segment.

    Null and empty texts have no token, hence the score of no evidence. Repeated rows give a row each.
    """
    schema = "doc_id bigint, score double, predicted int, passages array<struct<first: int, last: int, score: double>>"
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))
        for batch in batches:
            for at, to, texts in rows(batch.column(1)):
                out = []
                for t in texts.to_pylist():
                    n, found = m.scan(t)
                    s = m.score(m.evidence(n, found))
                    out.append((s, int(s >= 0.5), [dict(first=a, last=b, score=x) for a, b, x in found]))
                cols = [batch.column(0).slice(at, to - at), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "passages"])

    return lean(documents).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(light(run), schema)


def drop_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents, all columns, without rows whose score reaches 0.5.

    Each row is judged by its own text, whatever its id; repeated rows go or stay together. Null and empty texts have the score
    of no evidence, which stays unless the labels name no clean row. Names of other columns do not matter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for lo, hi, texts in rows(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array([m.score(m.evidence(*m.scan(t))) < 0.5 for t in texts.to_pylist()], pa.bool_()))

    return lean(documents).mapInArrow(light(run), documents.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    scored = score_documents(documents, learn(documents, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
