"""Extension points: lists of table functions, plug-in quantizers, replaceable graph combination, metric registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions import codes
from larkmill.operators import evaluate, graph, vector

Step = Callable[[DataFrame], DataFrame]


def applied(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """df through table functions in order. A step that marks rows for removal sets its column `drop`; they go before the next."""

    def one(now: DataFrame, step: Step) -> DataFrame:
        out = now.transform(step)
        return out.where(~F.coalesce("drop", F.lit(False))).drop("drop") if "drop" in out.columns and "drop" not in now.columns else out

    return reduce(one, steps, df)


def written(df: DataFrame, path: str, post: Iterable[Step] = ()) -> DataFrame:
    """df written as a table, then what a list of post-processing functions makes of the written files, in order."""
    df.write.parquet(path)
    return applied(df.sparkSession.read.parquet(path), post)


#: Label functions: (sequence column) to (input, label).
LABELS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "last": lambda s: (F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, -1, 1)),
    "identity": lambda s: (s, s),
    "next_3": lambda s: codes.next_k_label(s, 3, -1, 0),
}


def with_label(df: DataFrame, sequence: str, label: str | Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """df with columns input and label made by a label function or the name of one."""
    before, after = (LABELS[label] if isinstance(label, str) else label)(F.col(sequence))
    return df.withColumn("input", before).withColumn("label", after)


def collated(df: DataFrame, key: str, size: int, collate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(batch, rows): batches of size rows in key order, each row a struct; collate may turn the array into something else."""
    from larkmill.operators.sequence import global_row_number

    batch = F.floor(F.col("__r") / size).cast("bigint").alias("batch")
    numbered = global_row_number(df, [key], "__r").select(batch, F.struct("__r", *df.columns).alias("x"))
    rows = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(*(x[c].alias(c) for c in df.columns)))
    packed = numbered.groupBy("batch").agg(rows.alias("rows"))
    return packed if collate is None else packed.withColumn("rows", collate(F.col("rows")))


def item_features(names: dict[str, str], key: str) -> Callable[[Column], Column]:
    """Collate function of items: their ids, and each feature stacked under its input name."""
    taken = lambda rows, name: F.transform(rows, lambda x: x[name])
    return lambda rows: F.struct(taken(rows, key).alias("item_ids"), *(taken(rows, f).alias(name) for f, name in names.items()))


#: Distances between a vector and a centroid.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": vector.squared_distance,
    "cosine": lambda a, b: 1 - vector.dot(vector.unit(a), vector.unit(b)),
}


def assigned(vectors: DataFrame, centroids: DataFrame, distance: str | Callable[[Column, Column], Column] = "euclidean", choose: Callable[[Column], Column] = F.array_min, vec: str = "e") -> DataFrame:
    """vectors with code and distance; distance: a name or a function of two arrays; choose: takes one of an array of (distance,
    code), by default the nearest. The codebook travels as one array to every row."""
    measure = DISTANCES[distance] if isinstance(distance, str) else distance
    book = centroids.agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("__book"))
    ranked = choose(F.transform("__book", lambda c: F.struct(F.round(measure(F.col(vec), c["centroid"]), 9).alias("d"), c["code"].alias("code"))))
    return vectors.crossJoin(F.broadcast(book)).withColumn("__n", ranked).select(*vectors.columns, F.col("__n.code").alias("code"), F.col("__n.d").alias("distance"))


@dataclass(frozen=True)
class Foundation:
    """What every graph variant starts from: centred vectors and weighted edges."""

    vectors: DataFrame
    weights: DataFrame


def foundation(vectors: DataFrame, edges: DataFrame, centre: bool = True) -> Foundation:
    """The fixed part of all variants."""
    return Foundation(vector.centred(vectors) if centre else vectors, graph.undirected_weights(edges))


#: Combinations of a foundation: only these differ between variants.
COMBINE: dict[str, Callable[[Foundation], DataFrame]] = {
    "text": lambda f: f.vectors,
    "blend": lambda f: graph.blend(f.vectors, f.weights, 0.3),
    "inject": lambda f: graph.inject(f.vectors, f.weights, 0.3),
}


def variant(f: Foundation, combine: str | Callable[[Foundation], DataFrame]) -> DataFrame:
    """The vectors of one variant."""
    return (COMBINE[combine] if isinstance(combine, str) else combine)(f)


#: Per-user metrics by name.
METRICS = ("recall", "hr", "ndcg")


def registered(names: Iterable[str] = METRICS, ks: Iterable[int] = (10, 20, 50)) -> dict[str, tuple[str, int]]:
    """name@k to (name, k)."""
    unknown = set(names := list(names)) - set(METRICS)
    if unknown:
        raise KeyError(f"no metric {sorted(unknown)}")
    return {f"{m}@{k}": (m, k) for m in names for k in ks}


def evaluated(pred: DataFrame, targets: DataFrame, metrics: dict[str, tuple[str, int]]) -> DataFrame:
    """(metric, value): means over users of registered metrics."""
    by = evaluate.per_user(pred, targets, sorted({k for _, k in metrics.values()}))
    found = by.unpivot(["user_id", "k"], list(METRICS), "name", "x").groupBy("name", "k").agg(F.avg("x").alias("value"))
    label = F.concat("name", F.lit("@"), F.col("k").cast("string"))
    return found.withColumn("metric", label).where(F.col("metric").isin(*metrics)).select("metric", "value")
