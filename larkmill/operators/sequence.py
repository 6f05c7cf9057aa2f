"""Interaction logs to sequences, splits, windows, tiers and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Rows that one task may sort; more are numbered over ranges.
ONE_TASK = 2_000_000

# Names of tiers and buckets; cold_tier and bucket hold their limits.
TIERS = ("unseen", "very_rare", "rare", "normal")
BUCKETS = ("zero-shot", "few-shot", "low", "mid", "head")


def global_row_number(df: DataFrame, order: list, name: str = "r") -> DataFrame:
    """df with a 0-based number in a total order, without bringing all rows to one task.

    Rows are range-partitioned and numbered within their range; ranges add the rows before them. Order must be total or equal
    rows alike.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__local", local).join(F.broadcast(before), "__part").withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")


def ranked_rows(df: DataFrame, order: list, name: str = "r", size: str | None = None) -> DataFrame:
    """df with a 0-based number in a total order and, where asked for, the number of rows; few rows are sorted by one task, many
    over ranges."""
    n = df.count()
    out = df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1) if n <= ONE_TASK else global_row_number(df, order, name)
    return out.withColumn(size, F.lit(n).cast("bigint")) if size else out


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys in sorted order, numbered from 0."""
    return global_row_number(keys.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)


def positions(inter: DataFrame, order: list[str], user: str = "user_id") -> DataFrame:
    """inter with pos, the 0-based place in the user's sequence, and n, its length."""
    w = Window.partitionBy(user)
    return inter.withColumn("pos", (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))


def histories(seq: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(user, items): each user's items in order."""
    return seq.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item))), lambda x: x[item]).alias("items"))


def leave_one_out(seq: DataFrame, least: int = 3) -> DataFrame:
    """seq of users with at least `least` events, with split: last is test, the one before val, the rest train."""
    return seq.where(F.col("n") >= least).withColumn("split", F.when(F.col("pos") == F.col("n") - 1, "test").when(F.col("pos") == F.col("n") - 2, "val").otherwise("train"))


def item_counts(rows: DataFrame, catalog: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, cnt) of every catalog item, 0 where it has no rows."""
    return catalog.join(rows.groupBy(item).agg(F.count("*").alias("cnt")), item, "left").select(item, F.coalesce("cnt", F.lit(0)).alias("cnt"))


def cuts_by_count(df: DataFrame, ts: str, k: int) -> DataFrame:
    """(i, cut): the values at sorted places int(n * i / k), i = 1 .. k - 1."""
    numbered = global_row_number(df.select(ts), [ts])
    n = df.agg(F.count("*").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    places = n.select("i", F.floor(F.col("n") * F.col("i") / k).cast("bigint").alias("r"))
    return numbered.join(F.broadcast(places), "r").select("i", F.col(ts).alias("cut"))


def with_chunk(df: DataFrame, ts: str, cuts: DataFrame) -> DataFrame:
    """df with chunk: how many cuts are at or before ts. Windows are half-open, and no value is divided."""
    bounds = cuts.agg(F.array_sort(F.collect_list("cut")).alias("__cuts"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("chunk", F.size(F.filter("__cuts", lambda c: c <= F.col(ts))).cast("bigint")).drop("__cuts")


def count_windows(df: DataFrame, ts: str, k: int) -> DataFrame:
    """df with chunk 0 .. k - 1 by counts, cut at values."""
    return with_chunk(df, ts, cuts_by_count(df, ts, k))


def time_windows(df: DataFrame, seconds: Column, k: int) -> DataFrame:
    """df with chunk 0 .. k - 1 of equal spans of a numeric time; the last is closed."""
    span = df.agg(F.min(seconds).alias("__lo"), F.max(seconds).alias("__hi"))
    place = F.floor((seconds - F.col("__lo")) * k / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)))
    return df.crossJoin(F.broadcast(span)).withColumn("chunk", F.coalesce(F.least(place, F.lit(k - 1)), F.lit(0)).cast("bigint")).drop("__lo", "__hi")


def quantile_windows(df: DataFrame, seconds: Column, k: int) -> DataFrame:
    """df with chunk by interpolated quantiles, open at both ends."""
    bounds = df.agg(F.percentile(seconds, F.array(*(F.lit(i / k) for i in range(1, k)))).alias("__q"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("chunk", F.size(F.filter("__q", lambda c: c <= seconds)).cast("bigint")).drop("__q")


def index_windows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """df with chunk by place alone: the chunk c of row r holds int(n*c/k) <= r < int(n*(c+1)/k)."""
    total = df.agg(F.count("*").alias("__total"))
    numbered = global_row_number(df, order).crossJoin(F.broadcast(total))
    return numbered.withColumn("chunk", F.floor(((F.col("r") + 1) * k - 1) / F.col("__total")).cast("bigint")).drop("r", "__total")


def snapshots(chunked: DataFrame, windows: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Rows of each snapshot Wk with split: chunks before the last two train, then val and test (chunks counted from 1)."""
    w = F.explode(F.array(*map(F.lit, windows))).alias("w")
    c = F.col("chunk") + 1
    return chunked.select("*", w).where(c <= F.col("w")).withColumn("split", F.when(c < F.col("w") - 1, "train").when(c == F.col("w") - 1, "val").otherwise("test"))


def cold_tier(count: Column) -> Column:
    return F.when(count == 0, "unseen").when(count <= 3, "very_rare").when(count <= 5, "rare").otherwise("normal")


def bucket(count: Column) -> Column:
    return F.when(count == 0, "zero-shot").when(count <= 2, "few-shot").when(count <= 5, "low").when(count <= 20, "mid").otherwise("head")


def popularity_rank(counts: DataFrame, item: str = "item_id") -> DataFrame:
    """counts with r (0-based, by count descending then id) and the catalog's size."""
    return ranked_rows(counts, [F.desc("cnt"), F.col(item)], "r", "n_items")


def long_tail(counts: DataFrame, fraction: float) -> DataFrame:
    """(item, cnt, tail): tail from rank int(n * (1 - fraction)) on."""
    return popularity_rank(counts).withColumn("tail", F.col("r") >= F.floor(F.col("n_items") * F.lit(1 - fraction))).drop("r", "n_items")


def head_mid_tail(counts: DataFrame, head: float = 0.2, tail: float = 0.8) -> DataFrame:
    """(item, cnt, label): first int(head n) are head, from int(tail n) on tail, mid between."""
    return popularity_rank(counts).withColumn("label", F.when(F.col("r") < F.floor(F.col("n_items") * head), "head").when(F.col("r") >= F.floor(F.col("n_items") * tail), "tail").otherwise("mid")).drop("r", "n_items")


def subsequences(histories_: DataFrame, cap: int | None = None) -> DataFrame:
    """All contiguous parts of at least two items, row by row; cap: only of each history's last cap items."""
    s = F.col("items")
    last = s if cap is None else F.when(F.size(s) > cap, F.slice(s, -cap, cap)).otherwise(s)
    ends = histories_.withColumn("__s", last).where(F.size("__s") >= 2).select("user_id", "__s", F.explode(F.sequence(F.lit(2), F.size("__s"))).alias("stop"))
    return ends.select("user_id", "__s", "stop", F.explode(F.sequence(F.lit(1), F.col("stop") - 1)).alias("start")).select("user_id", (F.col("start") - 1).alias("start"), "stop", F.slice("__s", F.col("start"), F.col("stop") - F.col("start") + 1).alias("part"))


def subsequence_digests(histories_: DataFrame) -> DataFrame:
    """(user_id, start, parts, digest): of all contiguous parts of at least two items, those from one start as their number and the
    md5 of the parts, items joined by -, parts by |, shortest first. Made row by row: nothing is shuffled."""
    s = F.transform("items", lambda x: x.cast("string"))
    starts = histories_.where(F.size("items") >= 2).select("user_id", F.explode(F.array(s)).alias("__s")).select("user_id", "__s", F.explode(F.sequence(F.lit(1), F.size("__s") - 1)).alias("__at"))
    stops = F.sequence(F.col("__at") + 1, F.size("__s"))
    parts = F.transform(stops, lambda stop: F.array_join(F.slice("__s", F.col("__at"), stop - F.col("__at") + 1), "-"))
    return starts.select("user_id", (F.col("__at") - 1).alias("start"), (F.size("__s") - F.col("__at")).alias("parts"), F.md5(F.array_join(parts, "|")).alias("digest"))


def trim_last(seq: Column, n: int) -> Column:
    """The last n elements."""
    return F.when(F.size(seq) > n, F.slice(seq, -n, n)).otherwise(seq)


def pad(seq: Column, n: int, value: int = 0) -> Column:
    """seq padded on the right to n."""
    return F.concat(seq, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(0), F.lit(n) - F.size(seq))))
