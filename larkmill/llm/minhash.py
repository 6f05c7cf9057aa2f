"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles (5 words, see common.NOT_WORD) with their counts. For every shingle, darts arrive
at hashed times at hashed places of the weight levels [0, 1), [1, 2), [2, 4) ... that its weight reaches; darts beyond the
weight miss. Each dart belongs to one hashed coordinate, and the earliest dart of a coordinate is its signature value. Time
stops at (ln k + margin) / weight, and doubles only for documents with an empty coordinate. Signatures agree in a share of
coordinates that estimates the weighted Jaccard similarity. Bands of them bring candidates together.

Links of 0.8 or more are verified by exact weighted Jaccard similarity, and groups are the connected components. In a
bucket each member is compared to two hubs (star edges, linear in its size); a hub's pairs are dealt out over tasks. Buckets of
four or more that then still hold several components are compared block by block over signatures, so that no link depends on
the choice of hubs; blocks are bounded in members and bytes, and each task meets a few blocks with the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, lean, light, rows, staged, table
from .graph import components
from .kernel import mix, windows, word_hashes

BANDS = 25
DEPTH = 5
COORDINATES = BANDS * DEPTH
#: Expected empty coordinates before time is doubled: exp(-MARGIN).
MARGIN = 4.0
#: Members and bytes of text of a block in the comparison of unsettled buckets, about, and blocks that a task meets with all others.
BLOCK, BLOCK_BYTES, BLOCKS = 128, 1 << 20, 8
#: Pairs of one hub that a task verifies; the hub's text is sent to as many tasks as that takes.
SPLIT = 500
#: Signature agreement from which a pair of an unsettled bucket is verified: 0.8 less four standard errors.
AGREE = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)

_U = np.uint64


def weighted_shingles(texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of all distinct shingles of each row of an Arrow string array."""
    h, first = word_hashes(texts, plain=True)
    s, first = windows(h, first, k, whole=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(s):
        return row, s, np.zeros(0, int)
    order = np.argsort(mix(s + row.astype(_U) * _U(0x9E3779B97F4A7C15)))
    s, row = s[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (row[1:] != row[:-1]))))
    return row[new], s[new], np.diff(np.concatenate((new, [len(s)])))


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures of n rows as (n, k) hashes of the earliest darts; rows without shingles have zeros."""
    signature = np.zeros(n * k, _U)
    total = np.bincount(row, count, n)
    until = np.zeros(n)
    until[total > 0] = (math.log(k) + MARGIN) / total[total > 0]
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        level, cells, times, names = 0, [], [], []
        while len(live):
            lo = 0.0 if level == 0 else float(1 << (level - 1))
            width = 1.0 if level == 0 else lo
            x = live
            seed = mix(shingle[x] + mix(np.array([level + 1], _U)))
            time = np.zeros(len(x))
            throw = 0
            while len(x):
                seed = mix(seed + _U(0xE7037ED1A0B428DB))
                time = time - np.log(((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (k * width)
                on = time <= until[row[x]]
                x, seed, time = x[on], seed[on], time[on]
                if not len(x):
                    break
                dart = mix(seed ^ _U(0x589965CC75374CC3))
                hit = lo + (mix(dart).astype(np.float64) * 2.0**-64) * width < count[x]
                cells.append(row[x[hit]] * k + (dart[hit] % _U(k)).astype(np.int64))
                times.append(time[hit])
                names.append(dart[hit])
                throw += 1
            level += 1
            live = live[count[live] > (1 << (level - 1))]
        cell, time, name = np.concatenate(cells), np.concatenate(times), np.concatenate(names)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        signature[cell[won]] = name[won]
        todo = todo & ~np.isfinite(best.reshape(n, k)).all(1)
        until[todo] *= 2
    return signature.reshape(n, k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    parts = signature.reshape(len(signature), BANDS, DEPTH)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2]) * _U(0x2545F4914F6CDD1D)
    for j in range(DEPTH):
        keys = mix(keys + parts[:, :, j])
    return keys.view(np.int64)


def _sign(batches):
    """(id, text) to (id, copy, keys, sig, bytes); copy: hash of the word sequence, for exact copies; bytes of the text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for at, to, texts in rows(batch.column(1)):
            h, first = word_hashes(texts, plain=True)
            n = to - at
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            row_of = np.repeat(np.arange(n), np.diff(first))
            copy = np.zeros((2, n), _U)
            for j, c in enumerate((0x8EBC6AF09C88C6E3, 0x1D8E4E27C47D124F)):
                np.add.at(copy[j], row_of, mix(h ^ mix(place.astype(_U) + _U(c))))
            size = np.diff(first)
            row, shingle, count = weighted_shingles(texts)
            sig = signatures(row, shingle, count, n)
            keys = band_keys(sig)
            some = size > 0
            ids = batch.column(0).slice(at, n)
            text_key = pa.array([f"{a:016x}{b:016x}{s:x}" if s else None for a, b, s in zip(*copy.tolist(), size.tolist(), strict=True)], pa.string())
            lists = lambda m, kind, w: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(m.reshape(-1), kind))
            short = np.ascontiguousarray((sig & _U(0xFFFF)).astype("<u2"))
            sigs = pa.array([r.tobytes() for r in short], pa.binary())
            out = pa.RecordBatch.from_arrays([ids, text_key, lists(keys, pa.int64(), BANDS), sigs, pc.binary_length(texts).cast(pa.int64())], ["id", "copy", "keys", "sig", "bytes"])
            yield out.filter(pa.array(some))


def similarity(texts_a, texts_b) -> np.ndarray:
    """Exact weighted Jaccard similarity of rows of two Arrow string arrays; 0 where either has no word."""
    n = len(texts_a)
    row, shingle, count = (np.concatenate(x) for x in zip(weighted_shingles(texts_a), weighted_shingles(texts_b), strict=True))
    if not len(row):
        return np.zeros(n)
    order = np.lexsort((shingle, row))
    row, shingle, count = row[order], shingle[order], count[order]
    twin = np.flatnonzero((shingle[1:] == shingle[:-1]) & (row[1:] == row[:-1]))
    both = np.bincount(row[twin], np.minimum(count[twin], count[twin + 1]), n)
    total = np.bincount(row, count, n)
    return both / np.maximum(total - both, 1)


def _at_hub(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (hub, id, n) with the hub's column of values (id, column), null where it has none.

    The pairs of a hub are dealt out over n / SPLIT parts, n being the size of their largest bucket; its value goes to each.
    """
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    wide = pairs.groupBy("hub").agg(F.max("n").alias("n")).join(values.select(F.col("id").alias("hub"), column), "hub", "left")
    spread = wide.select("hub", column, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return pairs.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(spread, ["hub", "part"]).drop("part")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (hub, id, n), as (a, b) with a < b, those whose texts reach SIMILARITY."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield part.select(["hub", "id"]).filter(pa.array(similarity(part.column(2), part.column(3)) >= SIMILARITY - 1e-12))

    # a text is looked up once for its id, whatever the number of its hubs
    hubs = pairs.groupBy("id").agg(F.collect_list(F.struct("hub", "n")).alias("hubs")).join(texts, "id")
    joined = _at_hub(hubs.select("id", "text", F.explode("hubs").alias("x")).select("x.hub", "id", "x.n", "text"), texts.withColumnRenamed("text", "hub_text"), "hub_text")
    return joined.select("hub", "id", "text", "hub_text").mapInArrow(light(run), "hub bigint, id bigint").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists with counts."""
    (sa, ca), (sb, cb) = a, b
    at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
    same = sa[at] == sb
    both = int(np.minimum(ca[at[same]], cb[same]).sum())
    return both / max(int(ca.sum() + cb.sum()) - both, 1)


def _blocks(batches):
    """Pairs of blocks of one unsettled bucket to links that join components.

    A pair is looked at only in the first bucket that both members share. Pairs whose signatures agree enough are verified
    from the most alike on, unless links found before already join them.
    """
    import pyarrow as pa

    for batch in batches:
        for row in range(batch.num_rows):
            key, same, left, right = (batch.column(k)[row].as_py() for k in range(4))
            members = left if same else left + right
            split = 0 if same else len(left)
            ids = [x["id"] for x in members]
            component = np.array([x["component"] for x in members])
            sig = np.frombuffer(b"".join(x["sig"] for x in members), "<u2").reshape(-1, COORDINATES)
            keys = np.array([x["keys"] for x in members], np.int64)
            likely = []
            for i in range(split or len(members)):
                j = np.arange(split or i + 1, len(members))
                j = j[component[j] != component[i]]
                first = (keys[j] == keys[i]).argmax(1)
                j = j[keys[j, first] == key]
                alike = (sig[j] == sig[i]).mean(1)
                likely += [(-x, i, k) for x, k in zip(alike[alike >= AGREE].tolist(), j[alike >= AGREE].tolist(), strict=True)]
            if not likely:
                continue
            wanted = sorted({k for _, i, j in likely for k in (i, j)})
            row, shingle, count = weighted_shingles(pa.array([members[k]["text"] for k in wanted], pa.large_string()))
            order = np.lexsort((shingle, row))
            cut = np.searchsorted(row[order], np.arange(len(wanted) + 1))
            sets = {k: (shingle[order[lo:hi]], count[order[lo:hi]]) for k, lo, hi in zip(wanted, cut[:-1], cut[1:], strict=True)}
            parent = {c: c for c in component.tolist()}

            def root(c, parent=parent):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            found = []
            for _, i, j in sorted(likely):
                a, b = root(component[i]), root(component[j])
                if a != b and _overlap(sets[i], sets[j]) >= SIMILARITY - 1e-12:
                    parent[a] = b
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, links) for every row: class_id is the smallest id of the document's group, links the number of
    verified pairs between different texts that built the group, at the document's text.

    Texts of equal plain words are copies. Texts without a word (null, empty, signs only) and rows of null id are alone.
    Repeated rows of an id give a row each. Ids should name one text; else its texts count as one. Other columns are not read.
    """
    docs = lean(documents).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = staged(docs.where("id is not null").mapInArrow(light(_sign), "id bigint, copy string, keys array<bigint>, sig binary, bytes bigint"), "signed")
    first = signed.groupBy("copy").agg(F.min("id").alias("rep"))
    members = staged(signed.select("id", "copy").join(first, "copy").select("id", "rep"), "members")
    alone = signed.join(first.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    banded = alone.select("id", "bytes", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("id", "key"), "id")
    buckets = staged(banded.groupBy("key").agg(F.count("*").alias("n"), F.min(order)["id"].alias("hub"), F.max(order)["id"].alias("hub2"), F.sum("bytes").alias("bytes")).where("n > 1"), "buckets")
    inside = staged(banded.drop("bytes").join(buckets, "key"), "inside")
    stars = F.filter(F.array(F.struct("hub", "id", "n"), F.struct(F.when(F.col("id") != F.col("hub"), F.col("hub2")).alias("hub"), "id", "n")), lambda x: x["hub"] != x["id"])
    pairs = staged(inside.select(F.explode(stars).alias("x")).groupBy("x.hub", "x.id").agg(F.count("*").alias("shared"), F.max("x.n").alias("n")), "pairs")
    # texts of documents that stand in any bucket
    texts = staged(docs.join(inside.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    # first one pair for each document, its strongest; then only what still joins different groups
    best = staged(pairs.groupBy("id").agg(F.max(F.struct("shared", -F.col("hub"), "hub", "n")).alias("x")).select("x.hub", "id", "x.n"), "best")
    links = staged(_verified(best, texts), "links")
    groups = staged(components(links), "groups")
    rest = pairs.join(best.select("hub", "id"), ["hub", "id"], "left_anti").join(groups, "id", "left").select("hub", "id", "n", F.coalesce("component", "id").alias("own"))
    rest = _at_hub(rest, groups, "component").where(F.coalesce("component", "hub") != F.col("own")).select("hub", "id", "n")
    links = links.union(staged(_verified(rest, texts), "links"))
    groups = staged(components(links), "groups")
    # buckets of four or more that still hold several groups: compare blocks of members over signatures
    count = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    labelled = inside.where("n > 3").select("key", "id", count).join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("g1"), F.max("component").alias("g2")).where("g1 <> g2").select("key")
    mixed = staged(labelled.join(mixed, "key"), "mixed")
    # what a member brings along is put together once for all of its buckets
    brought = texts.join(mixed.select("id").distinct(), "id").join(alone.select("id", "sig", "keys"), "id")
    member = F.struct("id", "component", "sig", "keys", "text")
    places = mixed.groupBy("id", "component").agg(F.collect_list(F.struct("key", "blocks")).alias("places"))
    placed = places.join(brought, "id").select("id", "component", "sig", "keys", "text", F.explode("places").alias("x")).select("x.*", "id", "component", "sig", "keys", "text")
    blocks = placed.groupBy("key", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    blocks = staged(blocks, "blocks")
    parts = F.ceil(F.col("blocks") / BLOCKS).cast("int")
    left = blocks.select("key", F.col("block").alias("i"), F.pmod("block", parts).alias("part"), F.col("members").alias("l"))
    right = blocks.select("key", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("members").alias("r"))
    more = left.join(right, ["key", "part"]).where("i <= j").select("key", (F.col("i") == F.col("j")).alias("same"), "l", "r").mapInArrow(light(_blocks), "a bigint, b bigint")
    links = staged(links.union(more).distinct(), "links")
    groups = staged(components(links), "groups")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    classes = members.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("class")), "rep", "left").join(degree, "rep", "left")
    classes = classes.select("id", F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links")).dropDuplicates(["id"])
    return docs.select("id").join(classes, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
