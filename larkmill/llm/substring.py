"""Removal of repeated 13-word passages by fixed-block anchors.

Any 13 consecutive words hold one whole aligned block of 7 words. Non-overlapping blocks of every document are the index,
and every rolling 7-word window of every document probes it. A window of 13 words can repeat only where it holds a hit, so
hits are extended there: the 13-word windows around hits are compared by hash, and runs of repeated windows form maximal
exact repeats. A word goes if a repeated window covers it, one that also starts in a document of a smaller id.

Both comparisons use the same exchange. Map tasks work on chunks of a few MB. A chunk sends each distinct window once, from
its smallest document, packed by hash bucket; what repeats within the chunk is settled there, so that a passage in a third
of all documents costs a bucket one entry per chunk. Buckets answer with one bit per entry, in the order sent.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, light, rows, staged, table
from .kernel import mix, windows, word_hashes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2

_U = np.uint64
#: Start of the second hash of words and windows, of which the deciding comparison uses 32 bits beside all 64 of the first.
SECOND = 0x5851F42D4C957F2D
_SENT = "bucket int, chunk bigint, head binary, body binary"
_HITS = "doc_id bigint, chunk bigint, ord int, bucket int, bits binary"


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(40)) % _U(buckets)).astype(np.int64)


def _ordinals(ids: np.ndarray) -> np.ndarray:
    """How many earlier rows have the same id."""
    order = np.argsort(ids, kind="stable")
    run = np.concatenate(([0], np.flatnonzero(np.diff(ids[order])) + 1))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.repeat(run, np.diff(np.concatenate((run, [len(ids)]))))
    return out


def _send(ids: np.ndarray, texts_hash: np.ndarray, keys: np.ndarray, first: np.ndarray, wanted: np.ndarray, block: np.ndarray | None, buckets: int, second: np.ndarray | None = None):
    """Rows of _SENT for one chunk: entries by bucket, and for each row with windows its masks (of bucket -1 in ord order).

    keys: window hashes; first: each row's offset into them; wanted: windows to compare; block: marks of aligned blocks for the
    probing comparison, None for the comparison by smallest document, which also has second hashes of the windows.
    """
    import pyarrow as pa

    n = len(ids)
    row = np.repeat(np.arange(n), np.diff(first))
    ords = _ordinals(ids)
    at = np.flatnonzero(wanted)
    order = at[np.argsort(keys[at]) if second is None else np.lexsort((second[at], keys[at]))]
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(order) else np.zeros(0, bool)
    if second is not None and len(order):
        new[1:] |= second[order][1:] != second[order][:-1]
    alone = new & np.append(new[1:], True) if len(order) else new
    if not alone.all():  # within equal windows: by id, then place
        many = order[~alone]
        order[~alone] = many[np.lexsort((many, ids[row[many]], keys[many]) if second is None else (many, ids[row[many]], second[many], keys[many]))]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = ids[row[order[start]]]
    local = np.zeros(len(keys), bool)
    if block is None:
        local[order] = ids[row[order]] > least[group]
    elif len(order):
        local[order] = (ids[row[order[np.concatenate((start[1:], [len(order)])) - 1]]] > least)[group]
    sent = np.zeros(len(keys), bool)
    sent[order[start]] = True
    flag = np.zeros(len(keys), bool)
    if block is not None and len(order):
        flag[order[start]] = np.bitwise_or.reduceat(block[order], start)
    chunk = int(mix(np.array([mix(ids.astype(_U) + ords.astype(_U)).sum(dtype=_U) + _U(n)], _U)).view(np.int64)[0])
    out = []
    place = np.flatnonzero(sent)
    home = _bucket_of(keys[place], buckets)
    by = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[by], np.arange(buckets + 1))
    for b in range(buckets):
        mine = place[by[cut[b] : cut[b + 1]]]
        if not len(mine):
            continue
        who, count = np.unique(row[mine], return_counts=True)
        head = np.concatenate((np.diff(ids[who], prepend=0), ords[who], count))
        if block is None:
            body = keys[mine].astype("<u8").tobytes() + second[mine].astype("<u4").tobytes()
        else:
            body = ((keys[mine].astype(np.uint32) & np.uint32(0xFFFFFFFE)) | flag[mine]).astype("<u4").tobytes()
        out.append((b, chunk, zlib.compress(head.astype("<i8").tobytes(), 1), body))
    for r in range(n):
        lo, hi = first[r], first[r + 1]
        if sent[lo:hi].any() or local[lo:hi].any():
            head = np.array([ids[r], ords[r], texts_hash[r].astype(np.int64)], "<i8").tobytes()
            out.append((-1 - int(ids[r]) % buckets, chunk, head, np.packbits(np.stack((sent[lo:hi], local[lo:hi]))).tobytes()))
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "head", "body"])


def _answer(probing: bool):
    """Of the rows of one bucket: bits for every entry; masks pass through."""

    def run(got):
        import pyarrow as pa

        bucket, chunks, heads, bodies = (c.to_pylist() for c in got.columns)
        out = []
        entries = [k for k, b in enumerate(bucket) if b >= 0]
        for k, b in enumerate(bucket):
            if b < 0:
                doc, ordinal, texts = np.frombuffer(heads[k], "<i8")
                out.append((int(doc), chunks[k], int(ordinal), -1, np.array([texts], "<i8").tobytes() + bodies[k]))
        if entries:
            head = [np.frombuffer(zlib.decompress(heads[k]), "<i8").reshape(3, -1) for k in entries]
            ids = [np.cumsum(h[0]) for h in head]
            cut = [len(bodies[k]) if probing else len(bodies[k]) // 12 * 8 for k in entries]
            keys = np.concatenate([np.frombuffer(bodies[k][:n], "<u4" if probing else "<u8") for k, n in zip(entries, cut, strict=True)])
            second = np.concatenate([np.frombuffer(bodies[k][n:], "<u4") for k, n in zip(entries, cut, strict=True)])
            if probing:
                order = np.argsort(keys, kind="stable")
                bare = keys[order] >> np.uint32(1)
                start = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1])))
                size = np.diff(np.concatenate((start, [len(keys)])))
                good = (size > 1) & (np.bitwise_or.reduceat(keys[order] & np.uint32(1), start) > 0)
                hit = np.zeros(len(keys), bool)
                hit[order] = np.repeat(good, size)
            else:
                whose = np.concatenate([np.repeat(i, h[2]) for i, h in zip(ids, head, strict=True)])
                order = np.lexsort((whose, second, keys))
                start = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1]))))
                size = np.diff(np.concatenate((start, [len(keys)])))
                hit = np.zeros(len(keys), bool)
                hit[order] = whose[order] > np.repeat(whose[order][start], size)
            at = 0
            for k, i, h in zip(entries, ids, head, strict=True):
                for doc, ordinal, count in zip(i.tolist(), h[1].tolist(), h[2].tolist(), strict=True):
                    if (x := hit[at : at + count]).any():
                        out.append((doc, chunks[k], ordinal, bucket[k], np.packbits(x).tobytes()))
                    at += count
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "chunk", "ord", "bucket", "bits"])

    return run


def _exchanged(sent: DataFrame, probing: bool) -> DataFrame:
    """(doc_id, hits): answers and masks of each document that has a hit."""
    home = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket")).alias("home")
    answers = sent.withColumn("home", home).groupBy("home").applyInArrow(lambda t: _answer(probing)(t.select(["bucket", "chunk", "head", "body"])), _HITS)
    return answers.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "ord", "bucket", "bits")).alias("hits"))


def _marks(found, text_hash: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which windows of one text are hits."""
    hit = np.zeros(len(keys), bool)
    masks, answers = {}, {}
    for x in found or ():
        where = (x["chunk"], x["ord"])
        if x["bucket"] < 0:
            if x["bits"][:8] == text_hash.to_bytes(8, "little"):
                masks[where] = np.unpackbits(np.frombuffer(x["bits"][8:], np.uint8), count=2 * len(keys)).reshape(2, -1).astype(bool)
        else:
            answers.setdefault(where, {})[x["bucket"]] = x["bits"]
    for where, (sent, local) in masks.items():
        hit |= local
        if where in answers:
            place = np.flatnonzero(sent)
            home = _bucket_of(keys[place], buckets)
            for b, bits in answers[where].items():
                mine = place[home == b]
                hit[mine] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
    if hit.any():
        hit = np.isin(keys, keys[hit])
    return hit


def _text_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, _U)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    np.add.at(out, np.repeat(np.arange(len(out)), np.diff(first)), mix(h ^ mix(place.astype(_U))))
    return out


def _probe(window: int, buckets: int):
    """Documents to the entries of the first comparison."""
    size = (window + 1) // 2

    def run(batches):
        for batch in batches:
            for at, to, texts in rows(batch.column(1)):
                h, first = word_hashes(texts, plain=False)
                ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)
                keys, win = windows(h, first, size, whole=False)
                place = np.arange(len(keys)) - np.repeat(win[:-1], np.diff(win))
                long = np.repeat(np.diff(first) >= window, np.diff(win))
                yield _send(ids, _text_hashes(h, first), keys, win, long, place % size == 0, buckets)

    return run


def _extend(window: int, buckets: int, finer: int):
    """Documents with hits to the entries of the second comparison: windows that hold a hit."""
    size = (window + 1) // 2

    def run(batches):
        for batch in batches:
            for at, to, texts in rows(batch.column(1)):
                h, first = word_hashes(texts, plain=False)
                ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)
                seen = _text_hashes(h, first)
                second, _ = windows(word_hashes(texts, plain=False, seed=SECOND)[0], first, window, whole=False)
                second &= _U(0xFFFFFFFF)
                small, s_first = windows(h, first, size, whole=False)
                keys, win = windows(h, first, window, whole=False)
                wanted = np.zeros(len(keys), bool)
                for r, found in enumerate(batch.column(2).slice(at, to - at)):
                    lo, hi = win[r], win[r + 1]
                    if hi > lo:
                        hit = _marks(found.as_py(), int(seen[r]), small[s_first[r] : s_first[r + 1]], buckets)
                        total = np.concatenate(([0], np.cumsum(hit)))
                        wanted[lo:hi] = total[window - size + 1 :][: hi - lo] > total[: hi - lo]
                yield _send(ids, seen, keys, win, wanted, None, finer, second)

    return run


def _cut(window: int, finer: int, kept_text: bool):
    """Documents with the second answers to the result."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, to, texts in rows(batch.column(1)):
                h, first = word_hashes(texts, plain=False)
                out = []
                seen = None
                for r, (doc, text, found) in enumerate(zip(batch.column(0).slice(at, to - at).to_pylist(), texts.to_pylist(), batch.column(2).slice(at, to - at), strict=True)):
                    parts = (text or "").encode().split()
                    gone = 0
                    if found.is_valid:
                        if seen is None:
                            seen = _text_hashes(h, first)
                        mine = h[first[r] : first[r + 1]]
                        keys, _ = windows(mine, np.array([0, len(mine)]), window, whole=False)
                        hit = _marks(found.as_py(), int(seen[r]), keys, finer)
                        if hit.any():
                            edge = np.zeros(len(parts) + 1, np.int64)
                            starts = np.flatnonzero(hit)
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + window, -1)
                            covered = np.cumsum(edge)[:-1] > 0
                            gone = int(covered.sum())
                            parts = [p for p, c in zip(parts, covered.tolist(), strict=True) if not c]
                    kept = b" ".join(parts)
                    out.append((doc, len(parts) + gone, gone, hashlib.sha256(kept).hexdigest()) + (kept.decode(),) * kept_text)
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * kept_text
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * kept_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, kept_text: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, where asked for, kept) for every row.

    Null and empty texts have no words. Texts shorter than a window keep all. Rows of a null id are not compared and keep all.
    Rows of equal id never remove each other's words; each gets its own result. Other columns are not read. Windows are equal if
    96 bits of two independent hashes of their words are: among 10^12 different windows two agree with a chance of 6e-6.
    """
    docs = lean(documents).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(32, 2 * docs.rdd.getNumPartitions())
    known = docs.where("doc_id is not null and text is not null")
    hits = _exchanged(known.mapInArrow(light(_probe(window, buckets)), _SENT), True)
    near = known.join(hits, "doc_id").select("doc_id", "text", "hits")
    hits = staged(_exchanged(near.mapInArrow(light(_extend(window, buckets, buckets)), _SENT), False), "repeats", sweep=True)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * kept_text
    return docs.join(hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(light(_cut(window, buckets, kept_text)), schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), kept_text=False)


def oracle() -> str:
    """DuckDB, window by window."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, hash(list_slice(w, p, p + {WINDOW - 1})) AS h1, md5(array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ')) AS h2
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h1, h2) AS least FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS k FROM f WHERE least < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
