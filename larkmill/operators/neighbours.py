"""Item neighbours and their scores for histories that no task can hold: blocks of items and of users meet, pairs are not shuffled.

Histories and cut lists lie packed in the shared folder, each task reads what it meets there. A task's memory follows the limits
below and the number of items (24 bytes each), not the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import scratch, staged

#: Pairs of an item and an item of a history with it that a task sorts at a time, and of which its k best are cut at a time.
PAIRS, CUT = 1 << 23, 1 << 17
#: Items of a block of neighbours (at most 2^16, so that a place in it takes two bytes), and pairs that bound its entries.
WIDTH, REACH = 1 << 16, 1 << 26
#: Places in histories of a packed row, and those that a task scores together.
ROW, HELD = 1 << 18, 1 << 22
#: Entries of lists (so few that they stay in the processor's cache), and users, that are summed at a time.
SUMMED, USERS = 1 << 16, 1 << 12


def _tables(files: list[str], columns: list[str]):
    """The tables of Parquet files in any store that pyarrow reaches, one by one."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        with store.open_input_file(path) as f:
            yield pq.ParquetFile(f).read(columns, use_threads=False)


def _column(files: list[str], name: str):
    import numpy as np

    found = [t.column(name).to_numpy() for t in _tables(files, [name])]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _gather(starts, counts):
    """The places of runs, one after the other."""
    import numpy as np

    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))


class Packed:
    """histories (user_id, items: distinct) as rows of places in the sorted list of all items.

    items: files of (item_id, n: its users, w: the lengths of their histories, summed), in order; rows: (users, sizes, items) packed.
    """

    def __init__(self, histories: DataFrame):
        self.spark = histories.sparkSession
        lone = histories.select(F.explode("items").alias("item_id"), F.size("items").cast("bigint").alias("h"))
        items = staged(lone.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("h").alias("w")).orderBy("item_id"), "items")
        self.items = files = sorted(items.inputFiles())
        self.pairs = items.agg(F.sum("w")).first()[0] or 0

        def pack(batches):
            import numpy as np
            import pyarrow as pa

            names = _column(files, "item_id")
            for batch in batches:
                users, lists = batch.column(0).to_numpy(), batch.column(1)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                places = np.searchsorted(names, lists.flatten().to_numpy()).astype(np.int32)
                ends = np.cumsum(sizes)
                cuts = np.flatnonzero(np.diff(ends // ROW, prepend=0)).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(users)], strict=True):
                    if a < b:
                        parts = users[a:b].astype(np.int64), sizes[a:b].astype(np.int32), places[ends[a] - sizes[a] : ends[b - 1]]
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["users", "sizes", "items"])

        path = scratch(self.spark, "histories")
        histories.select("user_id", "items").mapInArrow(pack, "users binary, sizes binary, items binary").write.option("compression", "none").parquet(path)
        self.rows = self.spark.read.schema("users binary, sizes binary, items binary").parquet(path)
        self.files = sorted(self.rows.inputFiles()) if self.pairs else []

    def lists(self, k: int, put, schema: str) -> DataFrame:
        """put(items, n, w, lo, hi, i, j, units) of each block of items lo .. hi - 1: its neighbours at or above the k-th in order of i and j.

        The blocks are dealt out; a task reads all histories for each of its blocks.
        """
        files, rows, step, cut = self.items, self.files, PAIRS, CUT
        blocks = -(-self.pairs // step)

        def run(batches):
            import numpy as np

            n, w = _column(files, "n").astype(float), _column(files, "w")
            first = (np.cumsum(w) - w) // step
            for batch in batches:
                for block in batch.column(0).to_numpy():
                    lo, hi = np.searchsorted(first, [block, block + 1])
                    if lo < hi:
                        yield from put(n, w, lo, hi, *_nearest(rows, n, int(lo), int(hi), k, step, cut))

        return self.spark.range(0, blocks, 1, max(1, min(blocks, 4 * self.spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)

    def neighbour_lists(self, k: int) -> DataFrame:
        """(i, js, units) of ids, as recommend.neighbour_lists."""
        files = self.items

        def put(n, w, lo, hi, i, j, units):
            import numpy as np
            import pyarrow as pa

            names = _column(files, "item_id")
            heads = np.flatnonzero(np.diff(i, prepend=-1))
            ends = np.append(heads, len(i))
            for a in range(0, len(heads), 1024):
                at = ends[a : a + 1025]
                to = slice(at[0], at[-1])
                flat = (pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x, pa.int64())) for x in (names[j[to]], units[to]))
                yield pa.RecordBatch.from_arrays([pa.array(names[i[at[:-1]]], pa.int64()), *flat], ["i", "js", "units"])

        return self.lists(k, put, "i bigint, js array<bigint>, units array<bigint>")

    def scored(self, k: int, near: int) -> DataFrame:
        """(user_id, item_id, score, rank): item_knn of neighbour_lists(near).

        Lists are written by blocks of neighbours. A task holds users with their best k so far and reads one block after the other.
        """
        width, reach, summed, users = WIDTH, REACH, SUMMED, USERS

        def put(n, w, lo, hi, i, j, units):
            import numpy as np
            import pyarrow as pa

            edges = _edges(w, width, reach)
            part = np.searchsorted(edges, j, "right") - 1
            order = np.argsort(part.astype(np.int32), kind="stable")
            ends = np.searchsorted(part[order], np.arange(len(edges)))
            for p in np.flatnonzero(np.diff(ends)):
                mine = order[ends[p] : ends[p + 1]]
                cols = np.bincount(i[mine] - lo, minlength=hi - lo).astype(np.uint32), (j[mine] - edges[p]).astype(np.uint16), units[mine].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([lo], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cols)], ["part", "lo", "counts", "js", "units"])

        path, schema = scratch(self.spark, "lists"), "part int, lo bigint, counts binary, js binary, units binary"
        self.lists(near, put, schema).write.partitionBy("part").option("compression", "zstd").parquet(path)
        parts: dict[int, list[str]] = {}
        for uri in sorted(self.spark.read.schema(schema).parquet(path).inputFiles()) if self.pairs else []:
            parts.setdefault(int(uri.rpartition("/part=")[2].partition("/")[0]), []).append(uri)
        files = self.items

        def run(batches):
            import numpy as np
            import pyarrow as pa

            names, w, held, size = None, None, [], 0

            def done():
                owner, items = (np.concatenate([x[c] for x in held]) for c in (0, 1))
                sizes = np.concatenate([x[2] for x in held])
                best = _best(items, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes), k, len(names), _edges(w, width, reach), parts, summed, users)
                at, rank = np.nonzero(best[0])
                return pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(names[best[1][at, rank]]), pa.array(best[0][at, rank] / 1e9), pa.array(rank + 1, pa.int32())], ["user_id", "item_id", "score", "rank"])

            for batch in batches:
                if names is None:
                    names, w = _column(files, "item_id"), _column(files, "w")
                for user, sizes, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append((np.frombuffer(user, np.int64), np.frombuffer(items, np.int32), np.frombuffer(sizes, np.int32)))
                    size += len(held[-1][1])
                    if size >= HELD:
                        yield done()
                        held, size = [], 0
            if held:
                yield done()

        places = self.rows.agg(F.sum(F.octet_length("items") / 4)).first()[0] or 0
        # each task reads all lists once for HELD places
        tasks = max(2 * self.spark.sparkContext.defaultParallelism, -(-int(places) // HELD))
        return self.rows.repartition(tasks).mapInArrow(run, "user_id bigint, item_id bigint, score double, rank int")


def _edges(w, width: int, reach: int):
    """Where blocks of neighbours begin, and the number of items: an item is in at most w lists, so that a block has some `reach` entries at most."""
    import numpy as np

    ends, edges = np.cumsum(w), [0]
    while edges[-1] < len(w):
        lo = edges[-1]
        edges.append(max(lo + 1, min(lo + width, len(w), int(np.searchsorted(ends, ends[lo] - w[lo] + reach, "right")))))
    return np.array(edges)


def _counted(keys, counts=None):
    """Distinct keys and how often each is there: of sorted keys, or the sums of their counts."""
    import numpy as np

    if counts is not None:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    many = np.diff(np.append(heads, len(keys)))
    return keys[heads], many if counts is None else np.add.reduceat(counts, heads) if len(heads) else counts


def _foremost(groups, values, k: int, bits: int):
    """Which of the values, below 2^bits, are at or above the k-th of their group (groups are counted from 0, in order)."""
    import numpy as np

    if not len(groups):
        return np.zeros(0, bool)
    top = (1 << bits) - 1
    ranked = groups.astype(np.int64) << bits | (top - values)
    ranked.sort()
    counts = np.bincount(groups)
    kth = np.minimum(np.cumsum(counts) - counts + k - 1, len(ranked) - 1)
    return values >= np.where(counts > k, top - (ranked[kth] & top), 0)[groups]


def _nearest(rows: list[str], n, lo: int, hi: int, k: int, step: int, cut: int):
    """(i, j, units) for items lo .. hi - 1, in order: similarities in billionths at or above an item's k-th."""
    import numpy as np

    bits = max(1, len(n) - 1).bit_length()
    held, size, old = [], 0, None
    for table in _tables(rows, ["sizes", "items"]):
        for sizes, items in zip(table.column(0), table.column(1), strict=True):
            sizes, items = np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(items.as_buffer(), np.int32)
            # one comparison: what lies before lo wraps round
            here = np.flatnonzero((items - np.int32(lo)).view(np.uint32) < np.uint32(hi - lo))
            if not len(here):
                continue
            ends = np.cumsum(sizes, dtype=np.int64)
            whose = np.searchsorted(ends, here, "right")
            long = sizes[whose].astype(np.int64)
            mine, other = np.repeat(items[here], long), items[_gather(ends[whose] - long, long)]
            apart = mine != other
            held.append((mine[apart] - lo).astype(np.int64) << bits | other[apart])
            size += len(held[-1])
            if size > 2 * step:  # only an item of very many users brings so many: its pairs are counted meanwhile
                new = _counted(np.sort(np.concatenate(held)))
                old = new if old is None else _counted(*(np.concatenate(x) for x in zip(old, new, strict=True)))
                held, size = [], 0
    keys = np.concatenate(held) if held else np.zeros(0, np.int64)
    del held
    keys.sort()
    if old is not None:
        old = _counted(*(np.concatenate(x) for x in zip(old, _counted(keys), strict=True)))
        keys = old[0]
    starts = np.searchsorted(keys, np.arange(hi - lo + 1) << bits)
    out, a = [], 0
    while a < hi - lo:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + cut, "right")) - 1)
        to = slice(starts[a], starts[b])
        pairs, co = _counted(keys[to]) if old is None else (keys[to], old[1][to])
        i, j = (pairs >> bits) + lo, (pairs & ((1 << bits) - 1))
        units = np.floor(co / np.sqrt(n[i] * n[j]) * 1e9 + 0.5).astype(np.int64)
        enough = _foremost(i - lo - a, units, k, 30)  # units are at most 10^9 < 2^30
        out.append((i[enough].astype(np.int32), j[enough].astype(np.int32), units[enough]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block(files: list[str], n: int):
    """(starts, js, units) of a block of neighbours: where the list of each of n items begins."""
    import numpy as np

    starts = np.zeros(n + 1, np.int32)
    for table in _tables(files, ["lo", "counts"]):
        for lo, counts in zip(*table.columns, strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.uint32)
            starts[lo.as_py() + 1 : lo.as_py() + 1 + len(counts)] = counts
    np.cumsum(starts, out=starts)
    js, units = np.empty(starts[-1], np.uint16), np.empty(starts[-1], np.int32)
    for table in _tables(files, ["lo", "js", "units"]):
        for lo, *found in zip(*table.columns, strict=True):
            at = starts[lo.as_py()]
            for to, x in zip((js, units), found, strict=True):
                x = np.frombuffer(x.as_buffer(), to.dtype)
                to[at : at + len(x)] = x
    return starts, js, units


def _best(items, owner, users: int, k: int, n: int, edges, parts: dict, summed: int, most: int):
    """(totals, places), both users x k: the best k neighbours of histories, unseen ones, the larger total and then the smaller place first; 0 is none."""
    import numpy as np

    total, place = np.zeros((users, k), np.int64), np.zeros((users, k), np.int64)
    begins = np.searchsorted(owner, np.arange(users + 1))
    starts = js = units = None
    for p in sorted(parts):
        del starts, js, units  # before the next ones are read
        starts, js, units = _block(parts[p], n)
        long = starts[items + 1] - starts[items]
        at = np.flatnonzero(long)
        whose, long, first = owner[at].astype(np.int64), long[at], starts[items[at]]
        ends = np.cumsum(long, dtype=np.int64)
        a = 0
        while a < len(at):
            # whole users, as many as fit
            b = min(int(np.searchsorted(ends, ends[a] - long[a] + summed, "right")), int(np.searchsorted(whose, whose[a] + most)))
            if b < len(at):
                b = int(np.searchsorted(whose, whose[b])) if whose[b] != whose[a] else int(np.searchsorted(whose, whose[a], "right"))
            u0, u1, src = int(whose[a]), int(whose[b - 1]), _gather(first[a:b], long[a:b])
            key = np.repeat((whose[a:b] - u0) << 46, long[a:b])
            key |= js[src].astype(np.int64) << 30
            key |= units[src]
            # what was seen gets an entry of 0, which comes first
            own = slice(begins[u0], begins[u1 + 1])
            seen = np.flatnonzero((items[own] >= edges[p]) & (items[own] < edges[p + 1]))
            key = np.concatenate((key, (owner[own][seen].astype(np.int64) - u0) << 46 | (items[own][seen] - edges[p]).astype(np.int64) << 30))
            key.sort()
            pair = key >> 30
            heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            pair, key = pair[heads], key & ((1 << 30) - 1)
            sums = np.diff(np.concatenate(([0], np.cumsum(key)[np.append(heads[1:], len(key)) - 1])))
            u = (pair >> 16) + u0
            # blocks come in order of the items: an equal total of a later one is behind
            better = np.flatnonzero((key[heads] > 0) & (sums > total[u, k - 1]))
            u, s, j = u[better], sums[better], (pair[better] & 0xFFFF) + edges[p]
            if len(s) and s.max() < 1 << 46:  # only those that can be among the best are ranked
                top = _foremost(u - u0, s, k, 46)
                u, s, j = u[top], s[top], j[top]
            if len(u):
                who = u[np.flatnonzero(np.diff(u, prepend=-1))]
                u, s, j = np.concatenate((u, np.repeat(who, k))), np.concatenate((s, total[who].ravel())), np.concatenate((j, place[who].ravel()))
                order = np.lexsort((j, -s, u))
                u, s, j = u[order], s[order], j[order]
                counts = np.unique(u, return_counts=True)[1]
                rank = _gather(np.zeros(len(counts), np.int64), counts)
                top = rank < k
                total[u[top], rank[top]], place[u[top], rank[top]] = s[top], j[top]
            a = b
    return total, place
