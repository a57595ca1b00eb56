"""Operator 6: benchmark decontamination by a prefix-filtered set join.

A benchmark window is ``window`` consecutive words of an item (a shorter item is
one window). Its set is its word shingles. Containment is exact, so all shingles
of a window must occur, and of the shingles ordered by rarity in the documents a
prefix of one is enough: the rarest. Windows with a shingle that no document has
fall away. The documents' occurrences of benchmark shingles are joined to the
prefixes; the place of the shingle in the window gives the window's start, which
must not lie before the document's first word nor end after its last. What is
left is verified on the whole window.

Only one thing is sent to all tasks: a Bloom bitmap of the benchmark's shingles,
of fixed size. It saves work and decides nothing; the benchmark itself meets the
documents in joins, so it may be of any size.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. Null
and empty texts have no words, no hits and no windows. A null item_id marks hits
but isn't listed. A null doc_id is kept. Rows that share an id are judged each
by its text. Without benchmark rows nothing is hit.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, flat
from .common import saved, ship

_U = np.uint64
#: Bits of the bitmap; it takes 2^LOG_BITS / 8 bytes whatever the benchmark.
LOG_BITS = 23
NO_ID = -(2**63)


def _key(h: np.ndarray, size: int) -> np.ndarray:
    return flat.mix(h ^ flat.mix(np.full(1, 31 + size, _U)))


def _windows(benchmark: DataFrame, window: int, shingle: int, item_column: str, column: str) -> DataFrame:
    """(item, size, h, c, q, keys): one row per window of each item; h and c are its hash, keys those of its shingles in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            items = batch.column(0).to_pylist()
            words = flat.Words(batch.column(1), flat.ALNUM_LOWER)
            h = words.hashes()
            out: list[list] = [[], [], [], [], [], []]
            for k, item in enumerate(items):
                own = h[words.bounds[k]:words.bounds[k + 1]]
                size = min(window, len(own))
                if not size:
                    continue
                q = min(shingle, size)
                hs, cs = flat.windows(own, size).view(np.int64), flat.windows(own, size, seed=1).view(np.int64)
                keys = _key(flat.windows(own, q), q).view(np.int64)
                for i in range(len(hs)):
                    for cells, cell in zip(out, (item, size, int(hs[i]), int(cs[i]), q, keys[i:i + size - q + 1].tolist())):
                        cells.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), *(pa.array(out[k], pa.int64()) for k in (2, 3)), pa.array(out[4], pa.int32()), pa.array(out[5], pa.list_(pa.int64()))], names=["item", "size", "h", "c", "q", "keys"])

    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.coalesce(column, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item string, size int, h long, c long, q int, keys array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, id_column: str = "doc_id", item_column: str = "item_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, tag (hash of the text), n_words, n_hit (words inside an occurring window), items (array<string>, sorted)."""
    ship(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(column, F.lit("")).alias("text"))
    tagged = plain.withColumn("tag", F.xxhash64("text"))
    all_windows = saved(_windows(benchmark, window, shingle, item_column, column))
    kinds = all_windows.select("size", "h", "c", "q", "keys").dropDuplicates(["h", "c", "size"])
    keyed = kinds.select("size", "h", "c", F.size("keys").alias("n_keys"), F.posexplode("keys").alias("offset", "key"))
    bits = bitmap.build(keyed.select("key").distinct(), "key", LOG_BITS)
    lengths = sorted(r["q"] for r in all_windows.select("q").distinct().collect())  # 1 to ``shingle``

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            ids = batch.column(0).to_numpy()
            words = flat.Words(batch.column(1), flat.ALNUM_LOWER)
            h = words.hashes()
            for q in lengths:
                at = flat.window_rows(words.bounds, q)
                key = _key(flat.windows(h, q)[at], q)
                own = bitmap.may(bits, key)
                row = words.row()[at[own]]
                if len(row):
                    # One row for each key of the slab, however often it occurs there.
                    order = np.argsort(key[own], kind="stable")
                    mine, row, pos = key[own][order].view(np.int64), row[order], (at[own] - words.bounds[row])[order].astype(np.int32)
                    first = np.flatnonzero(np.diff(mine, prepend=~mine[0]))
                    bounds = np.append(first, len(mine))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[first]), pa.array(np.diff(bounds)), flat.list_array(ids[row], bounds, pa.int64()), flat.list_array(pos, bounds, pa.int32())], names=["key", "n", "ids", "places"])

    # A shingle's occurrences beside bits that others set are dropped by this join. A shingle that very many documents
    # have comes as a row for each slab of text, so no task gets a row for each of them.
    seen = plain.mapInArrow(occurrences, "key long, n long, ids array<long>, places array<int>")
    seen = saved(seen.join(keyed.select("key").distinct(), "key", "left_semi"))
    rarity = seen.groupBy("key").agg(F.sum("n").alias("n"))
    prefix = keyed.join(rarity, "key").groupBy("h", "c", "size", "n_keys").agg(F.count("*").alias("found"), F.min(F.struct("n", "key", "offset")).alias("rarest"))
    prefix = prefix.where("found = n_keys").select("h", "c", "size", "rarest.key", "rarest.offset")
    met = seen.drop("n").join(prefix, "key").select(F.explode(F.arrays_zip("ids", "places")).alias("at"), "offset", "size", "h", "c")
    candidates = met.select(F.col("at.ids").alias("id"), (F.col("at.places") - F.col("offset")).alias("start"), "size", "h", "c").where("start >= 0").distinct()
    by_doc = candidates.groupBy("id").agg(F.collect_list(F.struct("start", "size", "h", "c")).alias("cands"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            ids = batch.column(0).to_numpy()
            words = flat.Words(batch.column(1), flat.ALNUM_LOWER)
            h, counts = words.hashes(), words.counts()
            cands = batch.column(2)
            if isinstance(cands, pa.ChunkedArray):
                cands = cands.combine_chunks()
            per = np.diff(np.asarray(cands.offsets)) if len(cands) else np.zeros(0, np.int64)
            per = np.where(cands.is_null().to_numpy(zero_copy_only=False), 0, per)
            flat_c = cands.flatten()
            row = np.repeat(np.arange(len(per)), per)
            start, size, ch, cc = (flat_c.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ok = start + size <= counts[row]
            cover = np.zeros(words.n + 1, np.int64)
            good = np.zeros(len(row), bool)
            for s in np.unique(size[ok]):
                mine = np.flatnonzero(ok & (size == s))
                at = words.bounds[row[mine]] + start[mine]
                true = (flat.windows(h, int(s))[at].view(np.int64) == ch[mine]) & (flat.windows(h, int(s), seed=1)[at].view(np.int64) == cc[mine])
                good[mine[true]] = True
                np.add.at(cover, at[true], 1)
                np.add.at(cover, at[true] + s, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:words.n] > 0)])
            n_hit = np.diff(hit[words.bounds])
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[good], minlength=len(per)))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(3), pa.array(counts), pa.array(n_hit), flat.list_array(ch[good], bounds, pa.int64())], names=["id", "tag", "n_words", "n_hit", "found"])

    out = saved(tagged.join(by_doc, "id", "left").select("id", "text", "cands", "tag").mapInArrow(verify, "id long, tag long, n_words long, n_hit long, found array<long>"))
    named = out.select("id", "tag", F.explode("found").alias("h")).distinct().join(all_windows.where("item is not null").select("h", "item").distinct(), "h")
    named = named.groupBy("id", "tag").agg(F.array_sort(F.collect_set("item")).alias("items"))
    done = out.join(named, ["id", "tag"], "left")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "tag", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
