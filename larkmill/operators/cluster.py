"""Clustering fits: centroid starts, Lloyd and mini-batch steps, layer-wise residual fits, principal components."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import hash_order
from .vector import group_mean, minus, nearest_centroid, squared_distance, unit


def random_start(vectors: DataFrame, k: int, seed: str, key: str = "item_id", vec: str = "e") -> DataFrame:
    """(code, centroid): the first k rows in hash order."""
    rows = vectors.select(key, F.col(vec).alias("centroid"), hash_order(key, seed).alias("h")).orderBy("h", key).limit(k)
    from pyspark.sql import Window

    return rows.select((F.row_number().over(Window.orderBy("h", key)) - 1).alias("code"), "centroid")


def lloyd(vectors: DataFrame, centroids: DataFrame, rounds: int = 20, tolerance: float = 1e-6, vec: str = "e") -> DataFrame:
    """Centroids after Lloyd steps, until none moves more than tolerance; empty clusters stay where they are.

    Each step is one pass with a merged aggregation; centroids, a few, are gathered to cut the lineage.
    """
    spark = vectors.sparkSession
    book = centroids
    for _ in range(rounds):
        assigned = nearest_centroid(vectors.select(F.col(vec).alias("r")), book)
        means = group_mean(assigned.select("code", "r"), ["code"], "r")
        moved = book.join(means, "code", "left").select("code", F.coalesce("mean", "centroid").alias("centroid"), F.coalesce(squared_distance(F.col("mean"), F.col("centroid")), F.lit(0.0)).alias("shift")).collect()
        book = spark.createDataFrame([(r["code"], r["centroid"]) for r in moved], "code int, centroid array<double>")
        if max((r["shift"] for r in moved), default=0.0) <= tolerance:
            break
    return book


def minibatch_step(batch: DataFrame, centroids: list[tuple[int, list[float], int]], vec: str = "e") -> list[tuple[int, list[float], int]]:
    """(code, centroid, seen) after one batch: touched centroids move to the batch mean by batch count over total count."""
    spark = batch.sparkSession
    book = spark.createDataFrame([(c, v) for c, v, _ in centroids], "code int, centroid array<double>")
    assigned = nearest_centroid(batch.select(F.col(vec).alias("r")), book)
    counts = {r["code"]: r["n"] for r in assigned.groupBy("code").agg(F.count("*").alias("n")).collect()}
    means = {r["code"]: r["mean"] for r in group_mean(assigned.select("code", "r"), ["code"], "r").collect()}
    out = []
    for code, c, seen in centroids:
        if code in counts:
            seen += counts[code]
            c = [x - (x - m) * counts[code] / seen for x, m in zip(c, means[code], strict=True)]
        out.append((code, c, seen))
    return out


def kmeans_fit(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 20, vec: str = "e") -> DataFrame:
    """(code, centroid) of a k-means fit with scalable k-means++ starts."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", initMode="k-means||").fit(vectors.select(array_to_vector(vec).alias("__v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "code int, centroid array<double>")


def residual_fit(vectors: DataFrame, k: int, levels: int, seed: int = 1, normalize: bool = False, vec: str = "e", key: str = "item_id") -> DataFrame:
    """(level, code, centroid): k-means level by level, each on what the levels before leave."""
    residual, books = vectors.select(key, F.col(vec).alias("e")), []
    for level in range(levels):
        if normalize:
            residual = residual.select(key, unit(F.col("e")).alias("e"))
        book = kmeans_fit(residual, k, seed + level)
        books.append(book.select(F.lit(level).alias("level"), "code", "centroid"))
        residual = nearest_centroid(residual.withColumnRenamed("e", "r"), book).select(key, minus(F.col("r"), F.col("centroid")).alias("e"))
    out = books[0]
    for b in books[1:]:
        out = out.union(b)
    return out


def principal_components(vectors: DataFrame, k: int, key: str = "item_id", vec: str = "e") -> DataFrame:
    """(key, projection) on the first k principal components; signs are arbitrary."""
    from pyspark.ml.feature import PCA

    rows = vectors.select(key, array_to_vector(vec).alias("__v"))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows).select(key, vector_to_array("__p").alias("projection"))


def explained_variance(vectors: DataFrame, k: int, vec: str = "e") -> list[float]:
    """Share of the variance that each of the first k principal components explains."""
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol="__v", outputCol="__p").fit(vectors.select(array_to_vector(vec).alias("__v"))).explainedVariance.toArray().tolist()
