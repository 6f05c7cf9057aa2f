"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Each document has a vector of transformed statistics. For every group, concentration steps look for the three quarters of
its rows whose covariance has the least determinant: rows of the smallest Mahalanobis distances give the next mean and
covariance. Steps start from medians with MAD scales and from the classical moments; the smaller determinant wins. A
reweighting step and consistency factors follow. Rows far from their group's centre are rejected. Distances come from a
Cholesky factor unrolled into column expressions; every pass is an aggregation over all rows of a narrow table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bound, staged, table, words

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

#: Share of a group's rows that concentration steps keep.
SHARE = 0.75
#: Concentration steps at most, and the fall of a group's log-determinant below which they end.
STEPS, STILL = 30, 1e-3
#: Rejected beyond this squared distance: far outside what a heavy-tailed group of sound rows shows (chi-square 0.999 is 18.5).
CUTOFF = 60.0
#: Groups of fewer rows are judged by their language's estimate, languages of fewer by that of all rows.
LEAST_ROWS = 60
#: Standard deviation below which a statistic of a group is not believed: ratios are often all zero.
FLOORS = (0.02, 0.03, 0.08, 0.08)
P = len(FLOORS)
#: Groups up to which estimates are broadcast (under 200 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def base_statistics(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of every row."""
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col("lang"), F.col("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select("doc_id", "lang", "source", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), lines.alias("lines"), words(F.col("text")).alias("words"))
    docs = bound(bound(docs, "l", F.col("lines")), "w", F.col("words"))
    n = F.size("w")
    hashed = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.col("w")[i + j] for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    docs = docs.select(
        "doc_id", "lang", "source", "n_symbols", n.cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"), hashed.alias("hashed"),
    )
    docs = bound(docs, "h", F.col("hashed"))
    # texts without an equal pair of windows, nearly all, end here; others sort windows with their places
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    docs = bound(docs.withColumn("pairs", pairs).drop("hashed", "h"), "s", F.col("pairs"))
    same = lambda k, j: F.coalesce(F.get("s", k)["h"] == F.get("s", j)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    places = F.sort_array(F.transform(found, lambda k: F.get("s", k)["i"]))
    covered = F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return docs.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: log of mean word length, and square roots of the shares of signs, repeated lines and repeated
    words; short texts are drawn to common values."""
    words_, chars = F.col("n_words"), F.col("word_chars")
    return [F.log((chars + 250.0) / (words_ + 50.0)), F.sqrt(F.col("n_symbols") / (chars + 100.0)), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5.0)), F.sqrt(F.col("n_repeat_words") / (words_ + 20.0))]


def _chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _quantile(share: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if _chi_square((lo + hi) / 2, dof) < share else (lo, (lo + hi) / 2)
    return lo


def _factor(share: float) -> float:
    """What the covariance of the inner share of a normal sample is multiplied by to estimate the whole one's."""
    return share / _chi_square(_quantile(share, P), P + 2)


_MEANS = [f"m{i}" for i in range(P)]
_COVS = [f"c{i}{j}" for i in range(P) for j in range(i + 1)]


def _moments() -> list[Column]:
    return [*(F.avg(f"y{i}").alias(f"m{i}") for i in range(P)), *(F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)), F.count("*").alias("n")]


def _factored(moments: DataFrame, factor: float) -> DataFrame:
    """Cholesky factor l of factor * covariance + floors, and the log of its determinant."""
    made = moments
    for i in range(P):
        for j in range(i + 1):
            value = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * factor - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            made = made.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value + FLOORS[i] ** 2, F.lit(FLOORS[i] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    return made.withColumn("det", 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        z.append((F.col(f"y{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def _few(groups: DataFrame) -> DataFrame:
    """A written table of groups, broadcast if it is small: rows of a hot group then stay where they are."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per key column g of rows (g, y0 ..): n, m*, l* of the reweighted minimum-covariance-determinant estimate.

    Concentration steps end when no group's determinant falls any more. Medians and the edge of the kept share are quantile
    sketches of 1 in 10,000; how rows are partitioned can move an edge by that much, and with it a row at the border.
    """
    medians = rows.groupBy("g").agg(*(F.percentile_approx(f"y{i}", 0.5, 10000).alias(f"m{i}") for i in range(P)))
    spread = rows.join(_few(staged(medians, "mcd")), "g").groupBy("g").agg(*(F.percentile_approx(F.abs(F.col(f"y{i}") - F.col(f"m{i}")), 0.5, 10000).alias(f"a{i}") for i in range(P)), *(F.first(m).alias(m) for m in _MEANS))
    diagonal = [F.pow(F.col(f"a{i}") * 1.4826, 2).alias(f"c{i}{j}") if i == j else F.lit(0.0).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    first = spread.select("g", F.lit(0).alias("start"), *_MEANS, *diagonal).union(rows.groupBy("g").agg(*_moments()).select("g", F.lit(1).alias("start"), *_MEANS, *_COVS))
    now, det = staged(first, "mcd"), None
    for _ in range(steps):
        measured = rows.join(_factored(_few(now), 1.0), "g").select("g", "start", *(f"y{i}" for i in range(P)), _distance().alias("d"))
        edge = staged(measured.groupBy("g", "start").agg(F.percentile_approx("d", SHARE, 10000).alias("edge")), "mcd")
        inner = measured.join(_few(edge), ["g", "start"]).where("d <= edge")
        now = staged(inner.groupBy("g", "start").agg(*_moments()).select("g", "start", *_MEANS, *_COVS), "mcd")
        before, det = det, _factored(now, 1.0).select("g", "start", "det")
        if before is not None:
            fall = before.withColumnRenamed("det", "was").join(det, ["g", "start"]).agg(F.max(F.col("was") - F.col("det"))).first()[0]
            if fall is None or fall < STILL:
                break
    ranked = _factored(now, _factor(SHARE))
    best = ranked.groupBy("g").agg(F.min_by(F.struct(*_MEANS, *(f"l{i}{j}" for i in range(P) for j in range(i + 1))), F.struct("det", "start")).alias("b")).select("g", "b.*")
    weighed = rows.join(_few(staged(best, "mcd")), "g").where(_distance() <= _quantile(0.975, P)).select("g", *(f"y{i}" for i in range(P)))
    total = rows.groupBy("g").agg(F.count("*").alias("size"))
    final = _factored(weighed.groupBy("g").agg(*_moments()), _factor(0.975)).join(total, "g")
    return staged(final.select("g", F.col("size").alias("n"), *_MEANS, *(f"l{i}{j}" for i in range(P) for j in range(i + 1))), "mcd")


def judge(documents: DataFrame, cutoff: float = CUTOFF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row.

    Null and empty texts have no words and fail the base rules. Null languages or sources are groups of their own. Rows of
    languages that are too small are judged by all rows together. Repeated rows give a row each.
    """
    rows = base_statistics(documents, text, key).select("*", *(v.alias(f"y{i}") for i, v in enumerate(vector())), base_failed().alias("base_failed"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = staged(rows.withColumn("fine", F.concat_ws("\n", name("lang"), name("source"))).withColumn("wide", name("lang")).drop("lang", "source", "n_lines"), "statistics")
    passed = rows.where("not base_failed")
    measured = passed.select(F.explode(F.array("fine", "wide")).alias("g"), *(f"y{i}" for i in range(P)))
    by = estimates(measured).where(F.col("n") >= LEAST_ROWS).drop("n")
    far = lambda g: rows_of.join(_few(by.withColumnRenamed("g", g)), g, "left").withColumn(f"d_{g}", _distance()).drop(*by.columns)
    rows_of = rows
    rows_of = far("fine")
    rows_of = far("wide")
    if rows_of.where("d_fine is null and d_wide is null").isEmpty():
        rows_of = rows_of.withColumn("d_all", F.lit(None).cast("double"))
    else:  # one group, estimated apart: its only row is broadcast
        whole = estimates(passed.select(F.lit("").alias("g"), *(f"y{i}" for i in range(P)))).drop("g", "n")
        rows_of = rows_of.join(F.broadcast(whole), F.lit(True), "left").withColumn("d_all", _distance()).drop(*whole.columns)
    distance = F.coalesce("d_fine", "d_wide", "d_all")
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))
    return rows_of.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over all documents."""
    return judge(table(spark, sf_dir, "documents"))
