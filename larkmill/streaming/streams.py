"""Structured Streaming forms: unbounded scans, online exposure counters, mini-batch centroids, buffered writes, staged event
loops and late arrivals. None of them has a late-data rule of its own; watermarks are the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from larkmill.operators.cluster import minibatch_step
from larkmill.operators.vector import nearest_centroid

#: Stages of an event, in order; a person moves one stage at a time.
STAGES = ("register", "check-in", "issue", "assign", "feedback", "re-issue")


def unbounded(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_trigger: int = 1, **options) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_trigger).options(**options).load(path)


def rerank_online(ranked: DataFrame, mu: float, slots: int, shards: int = 8) -> DataFrame:
    """(shard, user_id, item_id, rank) of a stream of lists (user_id, items, scores): scores lose mu * ln(1 + times shown),
    counted per shard in keyed state. Users of one shard are taken in ascending order within a batch."""
    import numpy as np
    import pandas as pd

    def run(key, frames, state):
        shown = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("user_id")
        out = []
        for user, items, scores in zip(rows["user_id"], rows["items"], rows["scores"], strict=True):
            items = np.asarray(items)
            s = np.log(np.maximum(np.asarray(scores, float), 1e-30)) - mu * np.log1p([shown.get(int(i), 0) for i in items])
            placed = items[np.argsort(-s, kind="stable")]
            for i in placed[:slots]:
                shown[int(i)] = shown.get(int(i), 0) + 1
            out.append(pd.DataFrame({"shard": key[0], "user_id": user, "item_id": placed, "rank": np.arange(1, len(placed) + 1)}))
        state.update((list(shown), list(shown.values())))
        yield pd.concat(out)

    keyed = ranked.withColumn("shard", F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandasWithState(run, "shard int, user_id bigint, item_id bigint, rank int", "items array<bigint>, counts array<bigint>", "append", "NoTimeout")


class Centroids:
    """Running centroids of a stream; pass update to foreachBatch."""

    def __init__(self, start: list[tuple[int, list[float]]]):
        self.book = [(c, v, 0) for c, v in start]

    def update(self, batch: DataFrame, _id: int) -> None:
        if not batch.isEmpty():
            self.book = minibatch_step(batch, self.book)


def buffered(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 100_000) -> StreamingQuery:
    """Appends a stream to Parquet files of bounded size, all that is there now."""

    def write(batch: DataFrame, _id: int) -> None:
        batch.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged_events(events: DataFrame, person: str = "person", stage: str = "stage") -> DataFrame:
    """(person, stage, accepted): a person's events are accepted in the order of STAGES, one step at a time; state is the stage."""
    import pandas as pd

    def run(key, frames, state):
        at = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("at")
        out = []
        for s in rows[stage]:
            ok = s in STAGES and STAGES.index(s) == at + 1
            at += ok
            out.append((key[0], s, bool(ok)))
        state.update((at,))
        yield pd.DataFrame(out, columns=["person", "stage", "accepted"])

    return events.groupBy(person).applyInPandasWithState(run, "person bigint, stage string, accepted boolean", "at int", "append", "NoTimeout")


def late_arrivals(stream: DataFrame, codebook: DataFrame) -> DataFrame:
    """Codes of arriving vectors (id, r) against a frozen codebook (code, centroid): a stream-static join."""
    return nearest_centroid(stream, codebook, "r", "id").select("id", "code")


def windowed_counts(events: DataFrame, ts: str, lateness: str, width: str, slide: str, key: str) -> DataFrame:
    """Counts of a key in sliding event-time windows, late rows dropped past the watermark."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows a stream has now, through a memory sink; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


Batch = Callable[[DataFrame, int], None]
