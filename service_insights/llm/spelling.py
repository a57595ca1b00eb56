"""Operator 13: spelling variants, by dense prefix and suffix tiles.

Two words are near if one inserted, deleted or replaced code point makes them equal.
With M the longer one's length that is so exactly if the length of their common
prefix and that of their common suffix come to M - 1 at least. A tile is a padded
matrix of code points: two blocks of its rows are compared at once, column after
column, forwards for the prefixes and backwards for the suffixes.

Only words that can be near are compared. A pair's edit stands at the end of its
common prefix, p, between 0 and M - 1. For an interval [lo, hi) of such places, the
words of M or M - 1 code points that agree in their first lo and their last M - hi
code points form a group: every pair with its edit in the interval is in one group
of it, and counted there only. Intervals start as two halves; a group of more than
``ROWS`` words is split by halving its interval, as often as needed. An interval of
one place leaves no more than one word for each character, so no group stays large,
whatever the words are.

Small groups share a tile, where only words of one key count. From each tile only
sums come back: for each of its words how many are near and the most frequent of
them. No pairs are shuffled.

Words: runs of letters of the documents, A-Z lower-cased. Counting starts inside
the slabs of text, so a word travels once for each slab. Null and empty texts hold
none; documents that share an id, and repeated ones, count each time. Without any
word there are no rows. Other columns are left out, whatever their names.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import partitions, saved, ship

#: Words of a group that isn't split; rows of a block, and code points in its matrix.
ROWS, BLOCK, CELLS = 2048, 256, 1 << 22
#: Runs of at most this many bytes are hashed together.
SHORT = 48

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

#: Letters A-Z, a-z and U+00C0 to U+00FF, the last as the two bytes C3 80 to C3 BF.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the row of each."""
    lead = data == 0xC3
    word = _LETTER[data] | lead
    word[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:], right[:-1] = ~word[:-1], ~word[1:]
    starts = np.flatnonzero(word & (left | edge[:-1]))
    ends = np.flatnonzero(word & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(rows, starts, "right") - 1


def _crcs(heads: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from ``heads``."""
    size = ends - starts
    out = heads ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SHORT))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(heads[k])) ^ 0xFFFFFFFF
    order = order[long:]
    crc, at, left = out[order], starts[order], -size[order]
    for k in range(SHORT):
        n = int(np.searchsorted(left, -k))  # the runs of more than k bytes come first
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> 8)
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def count_words(docs: DataFrame, id_column: str = "doc_id", column: str = "text", erode: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least ``least`` times.

    Where ``erode`` divides h, the crc32 of ``<id>:<run>`` (lower-cased), the run
    loses its code point h % length; 0: no run does. A null id is the text ``null``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("id"), F.col(column).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            raw, bounds = flat.flat_bytes(batch.column(1))
            data = _LOWER[raw]
            starts, ends, row = _runs(data, bounds)
            tail = []
            if erode:
                heads = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
                crc = _crcs(heads[row], data, starts, ends)
                for k in np.flatnonzero(crc % erode == 0).tolist():
                    run = data[starts[k]:ends[k]].tobytes().decode()
                    at = int(crc[k]) % len(run)
                    tail.append(run[:at] + run[at + 1:])
                whole = crc % erode != 0
                starts, ends = starts[whole], ends[whole]
            size = ends - starts
            long = size >= shortest  # no fewer bytes than code points
            starts, size = starts[long], size[long]
            cells = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()),
                                                     pa.py_buffer(data[flat.gather_ranges(starts, size)].tobytes()))
            words = pa.chunked_array([cells, pa.array(tail, pa.large_string())]).combine_chunks()
            words = words.filter(pc.greater_equal(pc.utf8_length(words), shortest))
            counts = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of a and each of b (padding differs from any code point and from the other's)."""
    alive, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def _matrix(words: list[np.ndarray], width: int, pad: int, backwards: bool) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for k, w in enumerate(words):
        out[k, :len(w)] = w[::-1] if backwards else w
    return out


def near_in_tile(words: list[str], keys: np.ndarray, longest: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of near words of one key, sorted by it; their common prefix has lo to hi - 1 code points, the longer ``longest``.

    A block of rows meets itself and those after it until the key of its last row ends.
    """
    points = [np.frombuffer(w.encode("utf-32-le"), np.int32) for w in words]
    size = np.array([len(p) for p in points])
    step = max(1, min(BLOCK, CELLS // longest))
    for i in range(0, len(words), step):
        own = [_matrix(points[i:i + step], longest, -1, back) for back in (False, True)]
        for j in range(i, len(words), step):
            if keys[j] != keys[min(i + step, len(keys)) - 1] and j > i:
                break
            other = [_matrix(points[j:j + step], longest, -2, back) for back in (False, True)]
            p, s = _common(own[0], other[0]), _common(own[1], other[1])
            near = (keys[i:i + step, None] == keys[None, j:j + step]) & ((size[i:i + step, None] == longest) | (size[None, j:j + step] == longest))
            near &= (p + s >= longest - 1) & (p >= lo) & (p < hi)
            if i == j:
                near &= np.arange(len(p))[:, None] < np.arange(len(p))[None, :]
            x, y = np.nonzero(near)
            yield x + i, y + j


def _sums(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each word of some whole groups of one interval: how many are near, and the most frequent of them (of equals the smallest)."""
    keys = table.column("key").to_numpy()
    many = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
    size = np.diff(many, append=len(keys))
    table = table.take(flat.gather_ranges(many[size > 1], size[size > 1]))
    if not table.num_rows:
        return
    longest, lo, hi = (table.column(c)[0].as_py() for c in ("longest", "lo", "hi"))
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])))  # best first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for x, y in near_in_tile(words, table.column("key").to_numpy(), longest, lo, hi):
        for a, b in ((x, y), (y, x)):
            count += np.bincount(a, minlength=len(words))
            np.minimum.at(best, a, place[b])
    own = np.flatnonzero(count)
    top = order[best[own]]
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in own], pa.string()), pa.array(count[own]), pa.array(n[top]), pa.array([words[k] for k in top], pa.string())],
                                         names=["word", "n_near", "top_n", "top"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows are gathered until some whole groups of one interval are there: about ``ROWS`` rows, and one group at the most beyond."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        key, longest, lo, hi = (held.column(c).to_numpy() for c in ("key", "longest", "lo", "hi"))
        other = (np.diff(longest) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
        ends = np.flatnonzero(other | (np.diff(key) != 0)) + 1  # places where a group ends
        jumps = np.flatnonzero(other) + 1
        at = 0
        while len(ends) and at < ends[-1]:
            stop = int(ends[min(np.searchsorted(ends, at + ROWS), len(ends) - 1)])
            jump = jumps[np.searchsorted(jumps, at, "right"):][:1]
            to = min([stop, *jump.tolist()])
            yield from _sums(held.slice(at, to - at))
            at = to
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield from _sums(held)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the group's key, a hash of all that its words share. Should two groups have one, the tile tells their words apart."""
    return rows.withColumn("key", F.xxhash64("longest", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.expr("right(word, longest - hi)")))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("word", "n", "longest", F.explode(two).alias("x")).select("word", "n", "longest", "x.lo", "x.hi").where("lo < hi")


def near_words(words: DataFrame, rows: int = ROWS) -> DataFrame:
    """(word, n_near, form, form_n) of words that have near ones; ``words`` (word, n) are distinct and stored."""
    spark, length = words.sparkSession, F.char_length("word")
    ship(spark)
    open_ = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest"))
    open_ = saved(_keyed(_halves(open_.withColumn("lo", F.lit(0)).withColumn("hi", F.col("longest")))))
    tiles = None
    while True:
        large = open_.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("width")).where((F.col("size") > rows) & (F.col("width") > 1))
        large = saved(large.select("key"))
        last = large.isEmpty()
        fit = open_ if last else open_.join(large, "key", "left_anti")
        tiles = fit if tiles is None else tiles.unionByName(fit)
        if last:
            break
        open_ = saved(_keyed(_halves(open_.join(large, "key", "left_semi"))))
    dealt = tiles.select("longest", "lo", "hi", "key", "word", "n").repartition(partitions(spark), "key").sortWithinPartitions("longest", "lo", "hi", "key")
    found = dealt.mapInArrow(_compared, "word string, n_near long, top_n long, top string")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def variants(words: DataFrame, times: int = 2, rows: int = ROWS) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of stored distinct ``words`` (word, n).

    The form is the most frequent near word (of equals the smallest in code-point
    order) if it occurs at least ``times`` as often; the root is where following
    forms ends. Counts grow along the way, so it does end, after as many steps as
    n can be doubled; pointers are doubled, so the rounds are few.
    """
    near = near_words(words, rows)
    out = words.join(near, "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    out = saved(out.select("word", "n", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))
    hops = saved(out.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        ahead = hops.select(F.col("word").alias("to"), F.col("to").alias("next"))
        after = saved(hops.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        hops = after.select("word", "to")
        if after.where("moved").isEmpty():
            break
    return out.join(hops, "word", "left").select("word", "n", "form", F.coalesce("to", "word").alias("root"), "n_near", "form_n")
