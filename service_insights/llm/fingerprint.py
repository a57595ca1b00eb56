"""Operator 10: document fingerprints by a randomised edit embedding.

A walk over the characters with shared random steps embeds a text: at place j it
shows the character it stands on and moves on if a random bit of (j, character)
says so. Texts of small edit distance take the same path again soon after each
edit, so edit distance becomes Hamming distance of the embeddings. A fingerprint
is the embedding's length and one bit (a random bit of place and character) at
each of the ``BITS`` places of the smallest shared random key; two lengths share
most of their places. The likeness of two fingerprints is the agreement of the
places that both have, less what chance gives, times the ratio of the lengths.

``near_duplicates`` bands such bits: each band takes the bits at some shared
places below a power of two that the embedding covers. Texts that agree in a band
are tried against the smallest of them, and then, in blocks, against those of the
band that still lie in other components. Links are verified by the likeness of
whole fingerprints. Bits and bands grow with the number of texts.

Null texts are empty. Two empty texts are wholly alike, an empty and another one
not at all. Equal texts have equal fingerprints. Null ids stand last in
descending order, ties are ordered by text. A single document is its own next
one. Whole texts are walked, however long.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import partitions, saved, ship, thinned
from .components import components

_U = np.uint64
BITS = 256
#: Characters fall into so many classes, and steps repeat after so many places.
CLASSES, PERIOD = 64, 4096
SLAB = 5 << 20
#: Below so many texts still walking, they are walked one by one.
FEW = 24
NO_ID = -(2**63)
#: Ids of which the ranges' bounds are quantiles.
RANGE_SAMPLE = 200_000
#: Texts of a band's group that are compared in one piece; larger groups are cut to blocks.
BLOCK = 2048


@lru_cache(1)
def _steps() -> np.ndarray:
    """By class and place: how many places a character of that class takes from that place on."""
    coin = (flat.mix(np.arange(CLASSES * PERIOD, dtype=_U) * flat._P + _U(5)) & _U(1)).reshape(CLASSES, PERIOD).astype(np.int64)
    coin[:, PERIOD // 2] = 1
    out = np.zeros((CLASSES, 2 * PERIOD), np.int32)
    run = np.zeros(CLASSES, np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        run = np.where(coin[:, j % PERIOD], 1, run + 1)
        out[:, j] = run
    return out[:, :PERIOD].copy()


@lru_cache(1)
def _step_lists() -> list[list[int]]:
    return _steps().tolist()


def walk(cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after each character of the texts cp[start:start + length], walked from place ``begin``.

    Returns them flat, text by text, and the bounds of the texts.
    """
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(int(bounds[-1]), np.int64)
    kind = (flat.mix(cp.astype(_U)) >> _U(58)).astype(np.int32)
    table = _steps().ravel()
    order = np.argsort(-lengths, kind="stable")
    size, src, dst, place = lengths[order], starts[order].copy(), bounds[:-1][order].copy(), begin[order].astype(np.int64)
    t, longest = 0, int(size[0]) if len(size) else 0
    ascending = size[::-1]
    while t < longest:
        live = len(size) - int(np.searchsorted(ascending, t, "right"))
        if live < FEW:
            lists = _step_lists()
            for k in range(live):
                at, got = int(place[k]), []
                for c in kind[src[k] + t:src[k] + int(size[k])].tolist():
                    at += lists[c][at & (PERIOD - 1)]
                    got.append(at)
                out[dst[k] + t:dst[k] + int(size[k])] = got
            break
        until = int(size[live - 1])
        now, s, d = place[:live], src[:live] + t, dst[:live] + t
        for _ in range(until - t):
            now += table[(kind[s] << 12) | (now & (PERIOD - 1))]
            out[d] = now
            s += 1
            d += 1
        t = until
    return out, bounds


@lru_cache(64)
def _candidates(power: int, seed: int, count: int) -> np.ndarray:
    """The ``count`` places below 2^power of the smallest random keys, in that order."""
    best_key, best = np.zeros(0, _U), np.zeros(0, np.int64)
    for a in range(0, 1 << power, 1 << 22):
        j = np.arange(a, min(a + (1 << 22), 1 << power))
        key = flat.mix(j.astype(_U) * flat._M2 + _U(seed))
        best_key, best = np.concatenate([best_key, key]), np.concatenate([best, j])
        top = np.argsort(best_key, kind="stable")[:count]
        best_key, best = best_key[top], best[top]
    return best


@lru_cache(4096)
def places(length: int) -> np.ndarray:
    """The sampled places of an embedding of that length: BITS of them, or all."""
    if length <= 0:
        return np.zeros(0, np.int64)
    power = max(0, int(length - 1).bit_length())
    found = _candidates(power, 3, 4 * BITS)
    return found[found < length][:BITS]


def _bits(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (flat.mix(cp.astype(_U) * flat._P + at.astype(_U) * flat._M1) >> _U(63)).astype(np.uint8)


def _text_of(length: int, bits: np.ndarray) -> str:
    return f"{length}:{np.packbits(bits).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """0 to 1."""
    (la, ha), (lb, hb) = a.split(":"), b.split(":")
    na, nb = int(la), int(lb)
    if not na or not nb:
        return float(na == nb)
    pa_, pb = places(na), places(nb)
    xa = np.unpackbits(np.frombuffer(bytes.fromhex(ha), np.uint8))[:len(pa_)]
    xb = np.unpackbits(np.frombuffer(bytes.fromhex(hb), np.uint8))[:len(pb)]
    if na == nb:
        agree = (xa == xb).mean()
    else:
        _, i, j = np.intersect1d(pa_, pb, assume_unique=True, return_indices=True)
        agree = (xa[i] == xb[j]).mean() if len(i) else 0.5
    return float(max(0.0, 2 * agree - 1) * min(na, nb) / max(na, nb))


def fingerprints(texts: list[str]) -> list[str]:
    cp, lens = _code_points(texts)
    starts = np.cumsum(lens) - lens
    ends, bounds = walk(cp, starts, lens, np.zeros(len(lens), np.int64))
    return _sampled(cp, starts, lens, ends, bounds)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _sampled(cp: np.ndarray, starts: np.ndarray, lens: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list[str]:
    out = []
    for k, n in enumerate(lens.tolist()):
        if not n:
            out.append("0:")
            continue
        own = ends[bounds[k]:bounds[k + 1]]
        at = places(int(own[-1]))
        out.append(_text_of(int(own[-1]), _bits(cp[starts[k] + np.searchsorted(own, at, "right")], at)))
    return out


def edited_fingerprints(cp: np.ndarray, lens: np.ndarray, ends: np.ndarray, own: np.ndarray, after: np.ndarray) -> list[str]:
    """Fingerprints of texts own[i] whose last half is replaced by the start of after[i]; the walk goes on from the kept half."""
    starts = np.cumsum(lens) - lens
    half = lens[own] // 2
    keep, take = lens[own] - half, np.minimum(half, lens[after])
    begin = np.where(keep > 0, ends[np.maximum(starts[own] + keep - 1, 0)] if len(ends) else 0, 0)
    more, bounds = walk(cp, starts[after], take, begin)
    out = []
    for i in range(len(own)):
        a, k = starts[own[i]], int(keep[i])
        if not k:
            out.append("0:")
            continue
        first, second = ends[a:a + k], more[bounds[i]:bounds[i + 1]]
        length = int(second[-1]) if len(second) else int(first[-1])
        at = places(length)
        which = np.searchsorted(first, at, "right")
        late = which >= k
        index = np.where(late, 0, a + np.minimum(which, k - 1))
        index[late] = starts[after[i]] + np.searchsorted(second, at[late], "right")
        out.append(_text_of(length, _bits(cp[index], at)))
    return out


def with_next(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents lie in ranges of ids, in descending order; the first of a range is
    also sent, marked, to the range before (that of the first to the last one), so
    that every document meets the next one in its own task.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(column, F.lit("")).alias("text"))
    highest = rows.agg(F.max("id").alias("hi")).first()["hi"]
    few = thinned(rows.select("id"), "id", RANGE_SAMPLE)
    mid = few.agg(F.percentile_approx("id", [k / (2 * n) for k in range(1, 2 * n)], 10_000).alias("mid")).first()["mid"]
    heads = np.array(sorted({highest, *(mid or [])}) if highest is not None else [0], np.int64)  # a range's largest id
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("also", T.IntegerType())])

    @F.pandas_udf(kind)
    def dealt(ids: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(heads, ids.to_numpy(), "left")
        head = heads[np.minimum(at, len(heads) - 1)] == ids.to_numpy()
        return pd.DataFrame({"part": at, "also": np.where(head, (at + 1) % len(heads), -1)})

    place = F.col("place")
    copies = F.when(place["also"] >= 0, F.array(F.struct(place["part"].alias("part"), F.lit(False).alias("tail")), F.struct(place["also"].alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(place["part"].alias("part"), F.lit(False).alias("tail"))))
    put = rows.withColumn("place", dealt("id")).select("id", "text", F.explode(copies).alias("to")).select("to.part", "to.tail", "id", "text")
    put = put.repartition(n, "part").sortWithinPartitions("part", "tail", F.desc("id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            cp, lens = _code_points(texts)
            starts = np.cumsum(lens) - lens
            ends, bounds = walk(cp, starts, lens, np.zeros(len(lens), np.int64))
            prints = _sampled(cp, starts, lens, ends, bounds)
            own = np.array([k for k in range(len(rows) - 1) if not rows[k][1]], np.int64)
            changed = edited_fingerprints(cp, lens, ends, own, own + 1)
            out: list[list] = [[] for _ in range(7)]
            for k, other in zip(own.tolist(), changed):
                text, half = texts[k], len(texts[k]) // 2
                for cells, cell in zip(out, (None if rows[k][2] == NO_ID else rows[k][2], len(text), text[:len(text) - half] + texts[k + 1][:half], prints[k], other, likeness(prints[k], other), likeness(prints[k], prints[k + 1]))):
                    cells.append(cell)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= SLAB and len(held) > 1:
                    yield done(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield done(held)

    return put.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def banding(count: int, threshold: float, bands: int, bits: int) -> tuple[int, int]:
    """Bands and bits for so many texts: a value of a band for each text, and bands to miss a pair no more often."""
    agree = (1 + threshold) / 2  # of the bits of a pair at the threshold
    more = max(bits, int(max(count, 1) - 1).bit_length())
    if not 0 < agree < 1:
        return bands, more
    return math.ceil(bands * math.log1p(-agree**bits) / math.log1p(-agree**more)), more


@lru_cache(64)
def _band_places(power: int, bands: int, bits: int) -> np.ndarray:
    """Each band's places below 2^power: those of the smallest keys, of a long embedding some random ones."""
    if power <= 12:
        return np.stack([_candidates(power, 100 + b, bits) for b in range(bands)])
    key = flat.mix(np.arange(bands * bits, dtype=_U) * flat._M2 + _U(100 + power))
    return (key & _U((1 << power) - 1)).astype(np.int64).reshape(bands, bits)


def _forest(prints: list[str], labels: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (by place in the lists) that join whatever links of the threshold and more join, texts of one label being joined already.

    From a joined text to all that are not joined yet, so there are fewer links
    than texts. A fingerprint is +1 or -1 at its places and 0 at others.
    """
    lengths = np.array([int(x.split(":")[0]) for x in prints], np.int64)
    every = np.unique(np.concatenate([places(n) for n in np.unique(lengths).tolist()]))
    signs = np.zeros((len(prints), len(every)), np.float32)
    for k, x in enumerate(prints):
        at = places(int(lengths[k]))
        signs[k, np.searchsorted(every, at)] = 1 - 2.0 * np.unpackbits(np.frombuffer(bytes.fromhex(x.split(":")[1]), np.uint8))[:len(at)]
    has = np.abs(signs)
    order = np.argsort(labels, kind="stable")
    same = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)
    group = np.zeros(len(prints), np.int64)
    for g, own in enumerate(same):
        group[own] = g
    out, rest, done = [], np.arange(len(prints)), np.zeros(len(same), bool)
    for first in range(len(same)):
        if done[first]:
            continue
        done[first] = True
        queue = same[first].tolist()
        rest = rest[~done[group[rest]]]
        while queue and len(rest):
            k = queue.pop()
            both = np.maximum(has[rest] @ has[k], 1)
            ratio = np.minimum(lengths[rest], lengths[k]) / np.maximum(np.maximum(lengths[rest], lengths[k]), 1)
            alike = np.maximum(signs[rest] @ signs[k] / both, 0) * ratio
            near = rest[alike >= threshold - 1e-5]
            found = [j for j in near.tolist() if likeness(prints[k], prints[j]) >= threshold]
            for j in found:
                if not done[group[j]]:
                    done[group[j]] = True
                    out.append((k, j))
                    queue += same[group[j]].tolist()
            if found:
                rest = rest[~done[group[rest]]]
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 24, bits: int = 12, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, class_id (smallest id reachable by verified links), n_links (links that gave the class).

    ``bands`` and ``bits`` are the least; ``banding`` raises them.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(column, F.lit("")).alias("text"))
    bands, bits = banding(rows.count(), threshold, bands, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            texts = batch.column(1).to_pylist()
            cp, lens = _code_points(texts)
            starts = np.cumsum(lens) - lens
            ends, bounds = walk(cp, starts, lens, np.zeros(len(lens), np.int64))
            keys = []
            for k, n in enumerate(lens.tolist()):
                own = ends[bounds[k]:bounds[k + 1]]
                mine = []
                if n:
                    top = int(own[-1]).bit_length() - 1  # 2^top places are covered
                    for power in (top, top - 1):
                        if power < 0:
                            continue
                        at = _band_places(power, bands, bits)
                        bit = _bits(cp[starts[k] + np.searchsorted(own, at.ravel(), "right")], at.ravel()).reshape(at.shape)
                        value = np.zeros(bands, _U)
                        for j in range(at.shape[1]):
                            value = value * _U(2) + bit[:, j]
                        mine += flat.mix(value * flat._P + (np.arange(bands) + bands * power).astype(_U)).view(np.int64).tolist()
                keys.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sampled(cp, starts, lens, ends, bounds)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fingerprint", "keys"])

    prints = saved(rows.mapInArrow(run, "id long, fingerprint string, keys array<long>"))
    # Equal fingerprints are one node; its smallest id stands for it.
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("node"))
    keyed = prints.join(nodes, "fingerprint").where("id = node").select("node", F.explode("keys").alias("key")).distinct()
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.count("*").alias("size")).where("hub < most")
    members = saved(keyed.join(hubs.drop("most"), "key"))
    pairs = members.where("node > hub").select("node", "hub").distinct()
    pairs = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("hub"), F.col("fingerprint").alias("other")), "hub")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    links = saved(pairs.where(alike("fingerprint", "other") >= threshold).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    labels = saved(components(links))

    # Members of one group that lie in different components: compared with one another, in blocks.
    placed = members.where("size > 2").join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_ = placed.join(split, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    open_ = open_.select("key", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    open_ = open_.select("key", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(nodes, "node")

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        got = np.array(_forest(table.column("fingerprint").to_pylist(), table.column("label").to_numpy(), threshold), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[got].min(1), pa.int64()), "b": pa.array(node[got].max(1), pa.int64())})

    more = saved(open_.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    own = prints.select("id", "fingerprint").join(nodes, "fingerprint", "left").join(labels, "node", "left").join(degree, "node", "left")
    return own.select(F.col("id").alias("doc_id"), "fingerprint", F.when(F.col("id").isNotNull(), F.coalesce("label", "node")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
