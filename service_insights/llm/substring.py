"""Operator 8: exact repeated passages, found by fixed-block anchors.

A window is ``window`` consecutive words of one document. Each word is removed
that lies in a window whose word sequence also starts in a document with a
smaller id. With blocks of (window + 1) // 2 words, each window holds a whole
block of any split of its document into non-overlapping blocks. So:

1. Anchors. Each document's non-overlapping blocks are the index; its rolling
   windows of one block are the probes. Blocks and probes go, packed by hash
   bucket, to the bucket's task, which answers with the probes of each document
   that meet a block of another one.
2. Extension. Only windows around an answered probe are repeated, possibly. They
   are dealt out by their full hash (96 bits); the task answers each document
   with those that a smaller id has too.
3. The answered windows of a document are merged to maximal covered stretches,
   which go.

Hot groups: copies of whole texts meet in one aggregation and take no part in
1 and 2 (but for the smallest id, which stands for all). Sequences that are
frequent in a bounded sample of documents are not dealt out by hash at all: as
probes they count as answered, as windows their smallest id comes from an
aggregation over all documents with one row a slab. The sample steers the load
only; the result doesn't depend on it.

Null and empty texts have no words. A null id counts as the largest. Rows that
share an id are judged alike, each on its own text. Words are parted by ASCII
blanks only.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, packed
from .common import partitions, ship, thinned

#: Documents of the sample that shows frequent sequences, the share of them from
#: which a sequence is frequent, and the most sequences held.
SAMPLE_DOCS, FREQUENT_SHARE, MOST_FREQUENT = 2000, 0.004, 32768
LAST_ID = 2**63 - 1


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


class _Slab:
    """Window hashes of a slab: of block length (``probe``) and of full length (``full``, with a check of 32 bits)."""

    def __init__(self, batch: pa.RecordBatch, window: int, block: int):
        self.ids = batch.column(0).to_numpy()
        self.words = flat.Words(batch.column(1), flat.PLAIN)
        self.h = self.words.hashes()
        self.bounds = self.words.bounds
        self.window, self.block = window, block
        long = np.diff(self.bounds) >= window
        if batch.num_columns > 2 and "copy" in batch.schema.names:
            long &= ~batch.column(batch.schema.get_field_index("copy")).to_numpy(zero_copy_only=False)
        self.long = long

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = flat.window_rows(self.bounds, self.block)
        row = self.words.row()[at]
        own = self.long[row]
        return at[own], row[own], flat.windows(self.h, self.block)[at[own]]

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = flat.window_rows(self.bounds, self.window)
        row = self.words.row()[at]
        own = self.long[row]
        at, row = at[own], row[own]
        check = (flat.windows(self.h, self.window, seed=1)[at] >> np.uint64(32)).astype("<u4")
        return at, row, flat.windows(self.h, self.window)[at], check


def _told(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of a column of lists."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(col)), size), col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _frequent(docs: DataFrame, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blocks and windows that many documents of the sample have."""
    picked = thinned(docs, "id", SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            slab = _Slab(batch, window, block)
            _, row, h = slab.probes()
            _, row2, h2, _ = slab.full()
            for kind, r, x in ((0, row, h), (1, row2, h2)):
                order = np.lexsort((r, x))
                x, r = x[order], r[order]
                one = np.ones(len(x), bool)
                one[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
                x, n = np.unique(x[one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(n)], names=["kind", "h", "n"])

    counted = picked.mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(8, int(SAMPLE_DOCS * FREQUENT_SHARE))).orderBy(F.desc("n"), "kind", "h").limit(MOST_FREQUENT).collect()
    return tuple(np.sort(np.array([r["h"] for r in found if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))


def _smallest(docs: DataFrame, window: int, block: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each frequent window (at most MOST_FREQUENT rows), aligned with ``frequent``."""
    if not len(frequent):
        return frequent, np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full(len(frequent), LAST_ID)
        for batch in flat.pieces(batches, "text"):
            slab = _Slab(batch, window, block)
            _, row, h, _ = slab.full()
            own = _isin(h, frequent)
            np.minimum.at(low, np.searchsorted(frequent, h[own]), slab.ids[row[own]])
        seen = low < LAST_ID
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(low[seen])], names=["k", "low"])

    out = np.full(len(frequent), LAST_ID)
    for r in docs.mapInArrow(run, "k long, low long").groupBy("k").agg(F.min("low").alias("low")).collect():
        out[r["k"]] = r["low"]
    return frequent, out


def remove_repeats(docs: DataFrame, window: int = 13, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    block, buckets = (window + 1) // 2, 2 * n
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(column, F.lit("")).alias("text"))
    frequent_blocks, frequent_windows = _frequent(plain, window, block)
    frequent_windows, smallest = _smallest(plain, window, block, frequent_windows)

    # Whole texts that a smaller id has too: their digest meets in an aggregation, then goes back to the copies.
    digest = plain.select("id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    first = digest.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    copies = digest.join(first, ["d1", "d2"]).where("id > low").groupBy("id").agg(F.collect_set("d1").alias("copied"))

    base = plain.repartition(n, "id").join(copies, "id", "left")
    base = base.select("id", "text", F.coalesce(F.array_contains("copied", F.xxhash64("text")), F.lit(False)).alias("copy"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            slab = _Slab(batch, window, block)
            at, row, h = slab.probes()
            own = ~_isin(h, frequent_blocks)
            at, row, h = at[own], row[own], h[own]
            aligned = ((at - slab.bounds[row]) % block == 0).astype(np.uint8)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            yield from packed.pack(bucket, row, slab.ids, h.astype("<u4"), aligned)

    def meet(table: pa.Table) -> pa.Table:
        ids, keys, aligned = packed.unpack(table, "<u4", "u1")
        order = np.argsort(keys, kind="stable")
        ids_, aligned_, keys_ = ids[order], aligned[order], keys[order]
        cuts = np.flatnonzero(np.concatenate([[True], keys_[1:] != keys_[:-1]]))
        low, high = np.minimum.reduceat(ids_, cuts), np.maximum.reduceat(ids_, cuts)
        shared = (low < high) & (np.maximum.reduceat(aligned_, cuts) > 0)
        own = np.repeat(shared, np.diff(cuts, append=len(keys_)))
        bucket = np.uint64(table.column("bucket")[0].as_py())
        return packed.answers(ids_[own], ((bucket << np.uint64(32)) | keys_[own].astype(np.uint64)).astype("<u8"))

    hits = base.mapInArrow(anchors, packed.SCHEMA).groupBy("bucket").applyInArrow(meet, "id long, key long")
    hits = hits.groupBy("id").agg(F.collect_list("key").alias("keys"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            slab = _Slab(batch, window, block)
            answered = np.unique(_told(batch.column(3))[1])
            at, _, h = slab.probes()
            key = (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            hit = np.zeros(slab.words.n + 1, np.int64)
            hit[at + 1] = _isin(key, answered) | _isin(h, frequent_blocks)
            before = np.concatenate([np.cumsum(hit), np.zeros(window, np.int64)])
            at, row, h, check = slab.full()
            own = (before[at + window - block + 1] > before[at]) & ~_isin(h, frequent_windows)
            row, h, check = row[own], h[own], check[own]
            yield from packed.pack((h % np.uint64(buckets)).astype(np.int32), row, slab.ids, h.astype("<u8"), check)

    def repeated(table: pa.Table) -> pa.Table:
        ids, h, check = packed.unpack(table, "<u8", "<u4")
        order = np.lexsort((check, h))
        ids, h, check = ids[order], h[order], check[order]
        cuts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
        low = np.minimum.reduceat(ids, cuts)
        own = ids > np.repeat(low, np.diff(cuts, append=len(h)))
        return packed.answers(ids[own], h[own])

    later = base.join(hits, "id", "left").mapInArrow(extend, packed.SCHEMA).groupBy("bucket").applyInArrow(repeated, "id long, key long")
    later = later.groupBy("id").agg(F.collect_list("key").alias("keys"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            slab = _Slab(batch, window, block)
            words, bounds = slab.words, slab.bounds
            n_words = np.diff(bounds)
            whose, told = _told(batch.column(3))
            told = flat.mix(told ^ flat.mix(whose.astype(np.uint64)))
            at, row, h, _ = slab.full()
            gone = _isin(flat.mix(h ^ flat.mix(row.astype(np.uint64))), np.unique(told))
            if len(frequent_windows):
                known = _isin(h, frequent_windows)
                gone[known] |= slab.ids[row[known]] > smallest[np.searchsorted(frequent_windows, h[known])]
            cover = np.zeros(words.n + window + 1, np.int64)
            np.add.at(cover, at[gone], 1)
            np.add.at(cover, at[gone] + window, -1)
            removed = np.cumsum(cover)[:words.n] > 0
            copied = batch.column(2).to_numpy(zero_copy_only=False) & (n_words >= window)
            removed |= copied[words.row()]
            counts = np.concatenate([[0], np.cumsum(~removed)])
            n_kept = np.diff(counts[bounds])
            starts, size = words.starts[~removed], (words.ends - words.starts)[~removed]
            data = np.concatenate([words.raw, np.zeros(1, np.uint8)])[flat.gather_ranges(starts, size + 1)]
            ends = np.cumsum(size + 1)
            data[ends - 1] = 0x20
            last = np.cumsum(n_kept)[n_kept > 0]
            inside = np.ones(len(data), bool)
            inside[ends[last - 1] - 1] = False  # no blank after a document's last word
            total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_kept)])]
            total = total - np.concatenate([[0], np.cumsum(n_kept > 0)])
            text = pa.LargeStringArray.from_buffers(len(n_kept), pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(data[inside].tobytes())).cast(pa.string())
            ids = pa.array(slab.ids, pa.int64(), mask=slab.ids == LAST_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_words - n_kept), text], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return base.join(later, "id", "left").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
