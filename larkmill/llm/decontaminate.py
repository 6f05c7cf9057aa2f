"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size into classes of at most 2^c shingles. For a class, a document is a sequence of overlapping
windows of 2^(c+1) shingles, each starting 2^c after the last, so that an item lies whole in one of them, and the containment
threshold becomes a bound on Jaccard similarity there. An item meets a window if one of its HASHES minhash values is the
window's. The window's minhash can only equal the item's where the window holds that very shingle; so the minhash shingles
of all items are the index, document shingles probe it by an equi-join, and a window's minhash is taken at hits only.
Candidates are verified by exact containment of the item's shingles in the document.

An item of fewer words than a shingle is one shingle of its own length. Documents are probed with all their windows of the
lengths that such items have, so that a short item is found inside a long text too; there hits are results already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, bound, free, plain_words, staged, table

#: Minhash functions. Containment 0.8 in the largest window of a class is a similarity of at least 0.19: all miss with 0.81^48 = 4e-5.
HASHES = 48
#: Index rows (HASHES per item) up to which the benchmark's tables are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Document ids (8 bytes each) up to which those with candidates are broadcast, so that only their texts are sent on.
BROADCAST_IDS = 1_000_000


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Shingles of a bound array of words as strings, in order; fewer words than k are one shingle."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def hashed_shingles(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of the shingles, in order."""
    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(words[i + j] for j in range(k))))
    short = F.when(n > 0, F.array(F.xxhash64(*(F.get(words, F.lit(j)) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= k, full).otherwise(short)


def _minhash(hashes: Column, i: Column) -> Column:
    """Shingle hash with the least value under function i."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, i).alias("m"), h.alias("h"))))["h"]


def _short_hits(docs: DataFrame, items: DataFrame, few) -> DataFrame:
    """(doc_id, item_id, containment) of the items of fewer words than a shingle: their words stand in the text in a row."""
    short = items.where(F.col("n_words") < SHINGLE).select("item_id", "n_words", F.col("s")[0].alias("gram"))
    sizes = sorted(r[0] for r in short.select("n_words").distinct().collect())  # four values at most
    if not sizes:
        return short.select(F.lit(None).cast("bigint").alias("doc_id"), "item_id", F.lit(1.0).alias("containment")).where("false")
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    held = bound(docs.select("doc_id", plain_words(F.col("text")).alias("words")), "w", F.col("words")).select("doc_id", F.array_distinct(F.concat(*map(grams, sizes))).alias("grams"))
    return held.select("doc_id", F.explode("grams").alias("gram")).join(few(short.select("item_id", "gram")), "gram").select("doc_id", "item_id", F.lit(1.0).alias("containment"))


def contained(documents: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, containment) of all pairs whose containment reaches the threshold.

    Containment is the share of an item's distinct shingles that the text holds. Items of one to four words are found wherever
    these words stand in a row. Null and empty texts and items, and rows without an id, give no pair. Of repeated ids each text
    is compared by itself, and the best containment counts. Other columns are not read.
    """
    items = bound(benchmark.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("words")), "w", F.col("words")).where(F.size("w") > 0)
    made = items.select("item_id", F.size("w").alias("n_words"), F.array_distinct(shingles(F.col("w"))).alias("s"), F.array_distinct(hashed_shingles(F.col("w"))).alias("h"))
    items = staged(made.distinct(), "items")
    size_class = F.ceil(F.log2(F.size("h"))).cast("int")
    index = bound(items.where(F.col("n_words") >= SHINGLE), "hs", F.col("h")).select("item_id", size_class.alias("c"), F.explode(F.sequence(F.lit(1), F.lit(HASHES))).alias("i"), F.col("hs"))
    index = staged(index.select("item_id", "c", "i", _minhash(F.col("hs"), F.col("i")).alias("h")).distinct(), "index")
    small = index.count() <= BROADCAST_ROWS and items.count() <= BROADCAST_ROWS
    few = F.broadcast if small else lambda x: x
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    hashed = bound(bound(docs.select("doc_id", plain_words(F.col("text")).alias("words")), "w", F.col("words")).select("doc_id", hashed_shingles(F.col("w")).alias("hashed")), "hs", F.col("hashed")).select("doc_id", "hs")
    probes = hashed.select("doc_id", "hs", F.posexplode("hs").alias("p", "h")) if small else hashed.select("doc_id", F.posexplode("hs").alias("p", "h"))
    hits = probes.join(few(index), "h") if small else probes.join(index, "h").join(hashed, "doc_id")
    step = F.expr("cast(power(2, c) as int)")
    # the windows of a class that hold place p start at the last two multiples of the step up to p
    starts = F.array_distinct(F.array((F.floor(F.col("p") / step) * step).cast("int"), F.greatest(F.lit(0), ((F.floor(F.col("p") / step) - 1) * step).cast("int"))))
    meets = hits.select("doc_id", "item_id", "h", "i", "hs", step.alias("step"), F.explode(starts).alias("at")).where(_minhash(F.slice("hs", F.col("at") + 1, 2 * F.col("step")), F.col("i")) == F.col("h"))
    pairs = staged(meets.select("doc_id", "item_id").distinct(), "candidates")
    near = pairs.select("doc_id").distinct()
    near = F.broadcast(near) if near.count() <= BROADCAST_IDS else near
    # a text's shingles are made once and meet the shingles of its candidates, which travel with their ids
    wanted = pairs.join(few(items.where(F.col("n_words") >= SHINGLE).select("item_id", "s")), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "s")).alias("items"))
    found = docs.join(near, "doc_id", "left_semi").join(wanted, "doc_id")
    found = bound(found.select("items", "doc_id", plain_words(F.col("text")).alias("words")), "w", F.col("words")).select("doc_id", "items", shingles(F.col("w")).alias("shingles"))
    share = lambda x: F.struct(x["item_id"].alias("item_id"), (F.size(F.array_intersect(x["s"], F.col("held"))) / F.size(x["s"])).alias("containment"))
    found = bound(found, "held", F.col("shingles")).select("doc_id", F.explode(F.transform("items", share)).alias("x")).select("doc_id", "x.item_id", "x.containment")
    found = found.where(F.col("containment") >= threshold).union(_short_hits(docs, items, few))
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """documents, all columns, without those that contain an item.

    All rows of an id go if one of its texts contains an item; rows without an id and null or empty texts of other ids stay.
    Columns of any other name do not matter.
    """
    name = free(documents, "bad")
    bad = contained(documents, benchmark, text=text, key=key).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(bad, F.col(key) == F.col(name), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all documents and all benchmark items."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """DuckDB: containment of every item in every document that shares a shingle with it."""
    plain = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    cut = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')))"
    return f"""
WITH qw AS (SELECT item_id, row_number() OVER () AS qi, {plain("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, row_number() OVER () AS di, {plain("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT item_id, qi, k, unnest({cut}) AS s FROM (SELECT *, least(len(w), {SHINGLE}) AS k FROM qw WHERE len(w) > 0)),
d AS (SELECT doc_id, di, k, unnest({cut}) AS s FROM dw, (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
n AS (SELECT qi, count(*) AS n FROM q GROUP BY qi),
c AS (SELECT doc_id, item_id, di, qi, count(*)::DOUBLE / any_value(n) AS containment FROM d JOIN q USING (k, s) JOIN n USING (qi) GROUP BY doc_id, item_id, di, qi)
SELECT doc_id, item_id, max(containment) AS containment FROM c WHERE containment >= {SIMILARITY} GROUP BY doc_id, item_id"""
