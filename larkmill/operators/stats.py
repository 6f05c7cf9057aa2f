"""Distribution statistics, gates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.functions.chance import poisson, uniform

from .sequence import ranked_rows
from .staging import staged

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: One-sided 5 % critical values of t by degrees of freedom (fixed values).
CRITICAL = {1: 6.314, 2: 2.920, 3: 2.353, 4: 2.132, 5: 2.015, 6: 1.943, 7: 1.895, 8: 1.860, 9: 1.833}


def gini(rows: DataFrame, x: str, groups: list[str] = ()) -> DataFrame:
    """Gini coefficient of x by group, 0 where the sum is 0. Equal values are counted once with their frequency, so that ranks
    need only one row for each distinct value."""
    sizes = rows.groupBy(*groups, x).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*groups).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    ranks = F.col("__c") * F.col("__b") + F.col("__c") * (F.col("__c") + 1) / 2
    n, total = F.sum("__c"), F.sum(F.col(x) * F.col("__c"))
    g = F.when(total == 0, 0.0).otherwise(2 * F.sum(F.col(x) * ranks) / F.nullif(n * total, F.lit(0).cast("double")) - (n + 1) / n)
    return placed.groupBy(*groups).agg(F.coalesce(g, F.lit(0.0)).alias("gini"))


def quantiles(rows: DataFrame, x: str, groups: list[str] = ()) -> DataFrame:
    """n, mean and p10 .. p99 of x, exactly interpolated."""
    q = rows.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.array(*map(F.lit, QUANTILES))).alias("__q"))
    return q.select(*groups, "n", "mean", *(F.col("__q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(QUANTILES)))


def top_share(rows: DataFrame, key: str, x: str, share: float) -> DataFrame:
    """Part of the sum of x that the first int(share n) rows hold, at least one."""
    r = ranked_rows(rows, [F.desc(x), F.col(key)], "__r", "__n")
    return r.agg((F.sum(F.when(F.col("__r") < F.greatest(F.lit(1), F.floor(F.col("__n") * share)), F.col(x)).otherwise(0)) / F.sum(x)).alias("share"))


def items_for_mass(rows: DataFrame, key: str, x: str, shares: list[float]) -> DataFrame:
    """(share, items): how many of the largest rows reach each share of the sum."""
    # equal values are counted once with their frequency; distinct values are summed over ranges, then within the range
    sizes = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count("*").alias("c"), F.sum(x).alias("s"))
    ranged = staged(sizes.repartitionByRange(F.desc("x")).withColumn("part", F.spark_partition_id()), "mass")
    before = lambda name, w: F.coalesce(F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("c").alias("pc"), F.sum("s").alias("ps"))
    by_part, inside = Window.orderBy("part"), Window.partitionBy("part").orderBy(F.desc("x"))
    parts = parts.select("part", before("pc", by_part).alias("pc"), before("ps", by_part).alias("ps"), F.sum("ps").over(Window.partitionBy()).alias("total"))
    run = ranged.select("part", "x", "c", "s", before("c", inside).alias("bc"), before("s", inside).alias("bs")).join(F.broadcast(parts), "part")
    run = run.select("x", "c", (F.col("pc") + F.col("bc")).alias("bc"), (F.col("ps") + F.col("bs")).alias("bs"), "total", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    missing = F.col("share") * F.col("total") - F.col("bs")
    reached = run.where((missing <= F.col("c") * F.col("x")) & (missing > 0) | (missing <= 0) & (F.col("bc") == 0))
    return reached.groupBy("share").agg(F.min(F.col("bc") + F.greatest(F.lit(1), F.ceil(missing / F.nullif(F.col("x"), F.lit(0))))).cast("bigint").alias("items"))


def entropy_bits(rows: DataFrame, groups: list[str], code: str) -> DataFrame:
    """(groups, used, bits) of the codes' usage."""
    n = rows.groupBy(*groups, code).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))
    return p.groupBy(*groups).agg(F.count("*").alias("used"), (-F.sum(F.col("p") * F.log2("p"))).alias("bits"))


def purity(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Mean share of the commonest label over groups of more than one row, and the number of groups."""
    n = rows.groupBy(group, label).agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("m"), F.sum("n").alias("k")).where("k > 1")
    return n.agg(F.avg(F.col("m") / F.col("k")).alias("purity"), F.count("*").alias("groups"))


def gate(value: Column, target: Column, warn: Column, fail: Column, relative: Column) -> Column:
    """PASS, WARN or FAIL of a value against a target; SKIP where either is missing, REPORT where there is no tolerance."""
    error = F.when(relative, F.abs(value - target) / F.greatest(F.abs(target), F.lit(1e-9))).otherwise(F.abs(value - target))
    return F.when(value.isNull() | target.isNull(), "SKIP").when(warn.isNull(), "REPORT").when(error <= warn, "PASS").when(error <= fail, "WARN").otherwise("FAIL")


def verdict(runs: DataFrame, a: str, b: str, use_min: bool = False) -> DataFrame:
    """Per metric of runs (condition, seed, metric, value): effect of a over b in paired seeds, noise floor (largest spread of
    either condition), whether all signs agree, paired t and whether it passes its critical value: null where t is undefined or the
    table of critical values does not reach."""
    spread = runs.where(F.col("condition").isin(a, b)).groupBy("metric", "condition").agg((F.max("value") - F.min("value")).alias("s")).groupBy("metric").agg(F.max("s").alias("floor"))
    x, y = runs.where(F.col("condition") == a).select("metric", "seed", F.col("value").alias("x")), runs.where(F.col("condition") == b).select("metric", "seed", F.col("value").alias("y"))
    d = x.join(y, ["metric", "seed"]).withColumn("d", F.col("x") - F.col("y"))
    table = F.create_map(*(F.lit(v) for kv in CRITICAL.items() for v in kv))
    effect = F.min(F.abs("d")) if use_min else F.abs(F.avg("d"))
    t = F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0))
    out = d.groupBy("metric").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), effect.alias("effect"), (F.bool_and(F.col("d") > 0) | F.bool_and(F.col("d") < 0)).alias("same_sign"), t.alias("t")).join(spread, "metric")
    return out.withColumn("passes", F.col("same_sign") & (F.col("effect") > F.col("floor"))).withColumn("significant", F.col("t") > F.try_element_at(table, (F.col("n") - 1).cast("int")))


def null_verdict(gain: Column, null_gain: Column) -> Column:
    """What of a gain is left under a null graph."""
    return F.when(gain <= 0, "no gain").when(null_gain <= 0, "vanishes").when(null_gain < gain / 2, "shrinks").otherwise("remains")


def compare_curves(rows: DataFrame, step: str, x: str, y: str, key: Column, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Per step of two curves: the means a and b of x and y, their spreads over rows, and a percentile interval lo, hi of the mean
    of x - y over Poisson resamples; a row's weights are hashes of its key and the round."""
    base = rows.groupBy(step).agg(F.avg(x).alias("a"), F.avg(y).alias("b"), (F.max(x) - F.min(x)).alias("spread_a"), (F.max(y) - F.min(y)).alias("spread_b"))
    drawn = rows.select(step, key.alias("__key"), (F.col(x) - F.col(y)).alias("__d"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("__round")).withColumn("__w", poisson(uniform("__key", "__round", seed=seed)))
    means = drawn.where("__w > 0").groupBy(step, "__round").agg((F.sum(F.col("__w") * F.col("__d")) / F.sum("__w")).alias("__m"))
    return base.join(means.groupBy(step).agg(F.percentile("__m", 0.025).alias("lo"), F.percentile("__m", 0.975).alias("hi")), step)


def bootstrap(pairs: DataFrame, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """(n, mean, lo, hi, p): percentile interval of the mean of paired differences (key, d) over Poisson resamples; p is the share of
    resamples whose mean is not above 0.

    A row's weight in a round is drawn from a hash of its key and the round, whatever its partition, so that partial sums merge
    and no task holds all rows.
    """
    drawn = pairs.where(F.col("d").isNotNull()).select("key", "d", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select("round", "d", poisson(uniform("key", "round", seed=seed)).alias("w"))
    means = drawn.where("w > 0").groupBy("round").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    point = pairs.agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    return means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((F.col("m") <= 0).cast("double")).alias("p")).crossJoin(point)
