"""Operator 3: toxicity by the nearest labelled examples.

Features are whole words and word beginnings of 5 bytes, lower-cased.
The vocabulary holds every feature of a bounded sample of the labelled rows, and
examples and documents are TF-IDF vectors over it. Features that go with a label
(by chi-square, and at least 5 times as frequent in one class as in the other)
weigh ``LIFT`` times as much; no feature is left out. So the cosine is that of
TF-IDF with a supervised weight; with ``LIFT`` 1 it is the plain one.

The index is inverted and lies in shards, which tasks build and keep below the
checkpoint folder; neither postings nor vocabulary pass the driver. A shard holds
its examples in blocks, and for each term and block the highest weight, of all its
postings. The sums of these bound the cosine of any example of a block, and only
blocks that can reach the k-th best so far are scored: the commonest terms of a
shard by a dense matrix, the others by their postings. Documents meet one shard
after the other, and the best of all are merged by document. Cosines and
neighbours are exact.

A neighbour votes with weight cosine^4; a vote of the sample's rate joins in. The
share of toxic votes is then calibrated: one fold of five of the sample is scored
by an index of the others, and a logistic curve of its log odds is fitted to the
labels; the curve's value is the score.

Documents without any feature of the vocabulary (empty and null texts too) get the
toxic rate of such examples, with one vote of the sample's rate. Labels that are
null aren't used; a document with several labels counts as toxic if half of them
are. Without labels, or with labels of one class only, there are no neighbours and
every score is the sample's rate, one row of rate 1/4 added.
"""
from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .common import free_name, held, saved_at, ship, thinned

#: Labelled rows in the sample (picked by a hash of their id); examples of a shard on average, and most shards.
SAMPLE_ROWS, SHARD, SHARDS = 2048, 512, 16
#: Weight of a feature that goes with a label; terms of a shard kept dense; documents scored at a time.
LIFT, COMMON, CHUNK = 10.0, 1024, 64
#: More than single precision loses in a cosine.
ROUND = 1e-4
NEIGHBOURS, BLOCK, PRIOR_VOTES = 15, 64, 0.5
PREFIXES = (5,)
#: Folds of the sample, one of which calibrates, and the fewest of its rows of either class that do.
FOLDS, CALIBRATE = 5, 10


def held_out(id_column) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(col: pa.Array) -> tuple[flat.Words, list[np.ndarray]]:
    words = flat.Words(col, flat.ALNUM_LOWER)
    return words, [words.hashes(), *words.prefix_hashes(PREFIXES)]


def _counted(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in order, and how often each occurs."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.diff(at, append=len(row))


class Vectors:
    """TF-IDF vectors of length 1 over a sorted vocabulary of feature hashes (as signed numbers); ``idf`` includes the lift."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf

    def of(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of a column's texts, by row."""
        words, kinds = _features(col)
        rows, terms = [], []
        if len(self.vocabulary):
            owner = words.row()
            for h in kinds:
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                own = self.vocabulary[at] == h
                rows.append(owner[own])
                terms.append(at[own])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, term, tf = _counted(np.concatenate(rows), np.concatenate(terms))
        weight = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(col)))
        return row, term, weight / norm[row]


class Shard:
    """Block-max inverted index of some examples, given by (example, term, weight)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order].astype(np.float32)
        cuts = max(1, -(-len(ids) // BLOCK))
        self.ids, self.labels = ids, labels
        terms, first, df = np.unique(term, return_index=True, return_counts=True)
        common = np.sort(np.argsort(-df, kind="stable")[:COMMON])
        self.common = terms[common]
        dense = np.zeros((cuts * BLOCK, len(common)), np.float32)
        at = np.searchsorted(self.common, term)
        own = (at < len(self.common)) & (self.common[np.minimum(at, len(self.common) - 1)] == term) if len(common) else np.zeros(len(term), bool)
        dense[example[own], at[own]] = weight[own]
        self.dense, self.highest = dense, dense.reshape(cuts, BLOCK, -1).max(1)
        # The other terms: a row for each term and block, with its highest weight and the bounds of its postings.
        self.example, term, self.weight = example[~own].astype(np.int32), term[~own], weight[~own]
        block = self.example // BLOCK
        head = np.ones(len(term), bool)
        head[1:] = (np.diff(term) != 0) | (np.diff(block) != 0)
        start = np.flatnonzero(head)
        self.block, self.bounds = block[start].astype(np.int32), np.append(start, len(term))
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0, np.float32)
        self.rare, self.heads = np.unique(term[start], return_index=True)
        self.heads = np.append(self.heads, len(start))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, terms: int) -> Shard:
        """``terms`` is the size of the vocabulary."""
        out = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            vars(out).update({k: f[k] for k in f.files})
        out.place = np.full(terms, -1, np.int32)  # by term: its column of the matrix, or after these its row of heads
        out.place[out.common], out.place[out.rare] = np.arange(len(out.common)), len(out.common) + np.arange(len(out.rare))
        return out

    def met(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int) -> Met:
        return Met(self, row, term, weight, m)


class Met:
    """A shard and m vectors: ``bound`` limits the cosine of a vector (row) and any example of a block (column)."""

    def __init__(self, shard: Shard, row: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int):
        self.shard, cuts = shard, len(shard.highest)
        self.dense = np.zeros((m, len(shard.common)))
        at = shard.place[term]
        own = (at >= 0) & (at < len(shard.common))
        self.dense[row[own], at[own]] = weight[own]
        self.narrow = self.dense.astype(np.float32)
        some = np.flatnonzero(at >= len(shard.common))
        at = at[some] - len(shard.common)
        self.row, self.weight = row[some], weight[some]
        self.first, self.last = shard.bounds[shard.heads[at]], shard.bounds[shard.heads[at + 1]]  # all postings of a term
        n = shard.heads[at + 1] - shard.heads[at]
        self.entry = flat.gather_ranges(shard.heads[at], n)
        self.of, self.by = np.repeat(row[some], n), np.repeat(weight[some].astype(np.float32), n)
        self.block = shard.block[self.entry]
        rare = np.bincount(self.of * cuts + self.block, weights=shard.top[self.entry] * self.by, minlength=m * cuts)
        self.bound = self.narrow @ shard.highest.T + rare.reshape(m, cuts)

    def whole(self, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``best``, of all blocks: a term's postings lie in a row, and are taken as they lie."""
        shard, m = self.shard, len(rows)
        wide = len(shard.dense)
        rare, cuts = np.zeros((m, wide)), np.searchsorted(self.row, [rows, rows + 1]).T.tolist()
        for r, (a, b) in enumerate(cuts):
            if a < b:
                parts = [slice(i, j) for i, j in zip(self.first[a:b].tolist(), self.last[a:b].tolist())]
                cells = np.concatenate([shard.weight[x] for x in parts]) * np.repeat(self.weight[a:b], self.last[a:b] - self.first[a:b])
                rare[r] = np.bincount(np.concatenate([shard.example[x] for x in parts]), weights=cells, minlength=wide)
        return self._top(rows, self.narrow[rows] @ shard.dense.T + rare.astype(np.float32), rare, np.zeros(m), k)

    def best(self, rows: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some vectors the k best examples with a cosine over 0 and not below ``least``: places and cosines, ties by the smaller id.

        Only blocks whose bound reaches ``least`` are scored."""
        shard, m = self.shard, len(rows)
        wide, cuts = len(shard.dense), len(shard.highest)
        need = (self.bound[rows] > 0) & (self.bound[rows] >= least[:, None] - ROUND)
        place = np.full(len(self.bound), -1)
        place[rows] = np.arange(m)
        of = place[self.of]
        use = np.flatnonzero((of >= 0) & need[of, self.block])
        entry, of = self.entry[use], of[use]
        size = shard.bounds[entry + 1] - shard.bounds[entry]
        j = flat.gather_ranges(shard.bounds[entry], size)
        rare = np.bincount(np.repeat(of * wide, size) + shard.example[j], weights=shard.weight[j] * np.repeat(self.by[use], size), minlength=m * wide).reshape(m, wide)
        narrow, got = self.narrow[rows], np.zeros((m, cuts, BLOCK), np.float32)  # cosines but for rounding; 0 where a block isn't scored
        for c in np.flatnonzero(need.any(0)).tolist():
            r = np.flatnonzero(need[:, c])
            got[r, c] = narrow[r] @ shard.dense[c * BLOCK:(c + 1) * BLOCK].T + rare.reshape(got.shape)[r, c]
        return self._top(rows, got.reshape(m, wide), rare, least, k)

    def _top(self, rows: np.ndarray, cosines: np.ndarray, rare: np.ndarray, least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best of cosines in single precision, worked out again in double for those that may be among them."""
        shard, at = self.shard, max(0, cosines.shape[1] - k)
        least = np.maximum(least, np.partition(cosines, at, axis=1)[:, at]) - ROUND
        out = []
        for r in range(len(rows)):
            who = np.flatnonzero((cosines[r] >= least[r]) & (cosines[r] > 0))
            cosine = rare[r, who] + shard.dense[who].astype(float) @ self.dense[rows[r]]
            top = np.lexsort((shard.ids[who], -np.round(cosine, 12)))[:k]
            out.append((who[top], cosine[top]))
        return out


def _read(folder: str) -> pa.Table:
    fs, path = pafs.FileSystem.from_uri(folder)
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, filesystem=fs) for f in sorted(files)])


def _vectors(folder: str | None) -> Vectors:
    if folder is None:
        return Vectors(np.zeros(0, np.int64), np.zeros(0))
    table = _read(folder)
    h = table.column("h").to_numpy()
    order = np.argsort(h)
    return Vectors(h[order], table.column("idf").to_numpy()[order])


class Index:
    """A model's vocabulary and shards, as a worker reads them."""

    def __init__(self, model: Model):
        self.vectors = _vectors(model.vocabulary)
        self.shards = [Shard.from_bytes(x.as_py(), len(self.vectors.vocabulary)) for x in _read(model.shards).column("data")] if model.shards else []

    def neighbours(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, labels and cosines of the k best examples of m vectors, ties by the smaller id."""
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * m
        least = np.zeros(m)
        if not self.shards:
            return best
        met = [shard.met(row, term, weight, m) for shard in self.shards]
        bound = np.stack([x.bound.max(1) for x in met])
        home = bound.argmax(0)
        # Each vector meets the shard of its highest bound first, as a whole: most of its blocks would be needed.
        # What it finds there lets it pass over others, or over most of their blocks.
        for first in (True, False):
            for k_shard, x in enumerate(met):
                rows = np.flatnonzero(((home == k_shard) == first) & (bound[k_shard] > 0) & (bound[k_shard] >= least - ROUND))
                found = [] if not len(rows) else x.whole(rows, k) if first else x.best(rows, least[rows], k)
                for r, (who, cosine) in zip(rows.tolist(), found):
                    if not len(who):
                        continue
                    ids, labels, all_ = (np.concatenate(x) for x in zip(best[r], (x.shard.ids[who], x.shard.labels[who], cosine)))
                    top = np.lexsort((ids, -np.round(all_, 12)))[:k]
                    best[r] = ids[top], labels[top], all_[top]
                    if len(top) == k:
                        least[r] = all_[top[-1]]
        return best

    def votes(self, col: pa.Array, rate: float) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Toxic share of the neighbours' votes (nan without any feature), and the neighbours' ids and cosines."""
        row, term, weight = self.vectors.of(col)
        share = np.full(len(col), np.nan)
        who: list[list[int]] = [[] for _ in range(len(col))]
        how: list[list[float]] = [[] for _ in range(len(col))]
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(cuts[1:], len(row))
        for k in range(0, len(cuts), CHUNK):
            mine = cuts[k:k + CHUNK]
            a, b = int(mine[0]), int(ends[k + len(mine) - 1])
            local = np.repeat(np.arange(len(mine)), ends[k:k + CHUNK] - mine)
            for r, (ids, labels, cosine) in zip(row[mine].tolist(), self.neighbours(local, term[a:b], weight[a:b], len(mine))):
                power = cosine ** 4
                share[r] = (power @ labels + PRIOR_VOTES * rate) / (power.sum() + PRIOR_VOTES)
                who[r], how[r] = ids.tolist(), np.round(cosine, 6).tolist()
        return share, who, how


@dataclass(frozen=True)
class Model:
    """Where vocabulary and shards lie, the rate of examples without features and that of all, and the calibrating curve."""

    vocabulary: str | None
    shards: str | None
    empty_rate: float
    rate: float
    slope: float = 1.0
    shift: float = 0.0

    def index(self) -> Index:
        """Kept by the Python worker until another one, or another operator's large object, is used."""
        return held(("toxicity", self.shards), lambda: Index(self))

    def score(self, col: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        share, who, how = self.index().votes(col, self.rate)
        curve = 1 / (1 + np.exp(-(self.slope * _log_odds(share) + self.shift)))
        return np.where(np.isnan(share), self.empty_rate, curve), who, how


def _log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def calibrated(share: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (over 0) and shift of the logistic curve that fits labels to log odds, by Newton steps.

    The labels are softened as if each class had one row more, so that the curve stays finite where the classes lie apart.
    """
    x, pos = _log_odds(share), y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    cells = np.stack([x, np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(cells @ w, -30, 30)))
        hess = cells.T @ (cells * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, cells.T @ (p - target) + 1e-3 * (w - [1, 0]))
        w -= np.clip(step, -1, 1)
    return max(float(w[0]), 0.05), float(w[1])


def _built(sample: DataFrame, lift: float) -> Model:
    """Vocabulary and shards of stored (id, text, y) rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            batch = batch.select(["id", "text", "y"])
            y = batch.column(2).to_numpy()
            words, kinds = _features(batch.column(1))
            row, term, _ = _counted(np.concatenate([words.row()] * len(kinds)), np.concatenate(kinds))
            row, term = row[term != 0], term[term != 0]
            h, where = np.unique(term, return_inverse=True)
            pos = np.bincount(where, weights=y[row], minlength=len(h)).astype(np.int64)
            every = np.bincount(where, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), 0)), pa.array(np.append(pos, y.sum()).astype(np.int64)), pa.array(np.append(every, len(y)).astype(np.int64))], names=["h", "pos", "every"])

    # h = 0 counts the documents themselves
    counted = sample.mapInArrow(count, "h long, pos long, every long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("every").alias("every"))
    counted, _ = saved_at(counted)
    totals = counted.where("h = 0").first()
    pos, every = (totals["pos"], totals["every"]) if totals else (0, 0)
    neg, rate = every - pos, (pos + 0.25) / (every + 1)
    if not pos or not neg:
        return Model(None, None, rate, rate)
    a, b = F.col("pos"), F.col("every") - F.col("pos")
    rate1, rate0 = (a + 0.25) / (pos + 0.5), (b + 0.25) / (neg + 0.5)
    expected = F.col("every") * pos / every
    chi = (a - expected) ** 2 / expected + (b - (F.col("every") - expected)) ** 2 / (F.col("every") - expected)
    apart = F.coalesce((F.col("every") >= 3) & (chi >= 12) & ((rate1 >= 5 * rate0) | (rate0 >= 5 * rate1)), F.lit(False))
    idf = (F.log(F.lit(every + 1.0) / (F.col("every") + 1)) + 1) * F.when(apart, lift).otherwise(1.0)
    _, vocabulary = saved_at(counted.where("h <> 0").select("h", idf.alias("idf")))

    # Shards are the examples nearest to one of a few of them, so that a shard's texts share their commonest terms (those of a language, say).
    _, leaders = saved_at(sample.orderBy(F.xxhash64(F.col("id") + 7), "id").limit(max(1, min(SHARDS, round(every / SHARD)))).select("id", "text"))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _vectors(vocabulary)
        texts = _read(leaders).sort_by("id")
        row, term, weight = vectors.of(texts.column("text"))
        lead = np.zeros((texts.num_rows, len(vectors.vocabulary)), np.float32)
        lead[row, term] = weight
        for batch in flat.pieces(batches, "text"):
            batch = batch.select(["id", "text", "y"])
            n = batch.num_rows
            row, term, weight = vectors.of(batch.column(1))
            bounds = np.searchsorted(row, np.arange(n + 1))
            shard = np.argmax([np.bincount(row, weights=weight * own[term], minlength=n) for own in lead], axis=0)
            term, weight = term.astype("<i4"), weight.astype("<f4")
            cells = [pa.array([x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()) for x in (term, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shard.astype(np.int32)), *cells], names=["id", "y", "shard", "terms", "weights"])

    def build(table: pa.Table) -> pa.Table:
        size = np.array([len(x) // 4 for x in table.column("terms").to_pylist()])
        order = np.lexsort((table.column("id").to_numpy(), size))  # texts of like length in one block: their weights are of like height
        table, size = table.take(order), size[order]
        term, weight = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("terms", "<i4"), ("weights", "<f4")))
        ids, y = table.column("id").to_numpy(), table.column("y").to_numpy().astype(float)
        own = Shard(ids, y, np.repeat(np.arange(len(ids)), size), term, weight)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "data": pa.array([own.to_bytes()], pa.binary())})

    rows, _ = saved_at(sample.mapInArrow(vectorise, "id long, y int, shard int, terms binary, weights binary"))
    bare = rows.where(F.octet_length("terms") == 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    # A group holds no more than the sample.
    _, folder = saved_at(rows.where(F.octet_length("terms") > 0).groupBy("shard").applyInArrow(build, "shard int, data binary"))
    return Model(vocabulary, folder, (bare["pos"] + rate) / (bare["n"] + 1), rate)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", column: str = "text", sample_rows: int = SAMPLE_ROWS, lift: float = LIFT) -> Model:
    """Learns from at most ``sample_rows`` labelled documents that aren't held out."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).cast("long").alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(column, F.lit("")).alias("text"))
    picked, _ = saved_at(thinned(saved_at(known)[0], "id", sample_rows).orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # One row for each id: the text of the smallest hash, and one of its copies. Broadcast: sample_rows rows of two or three numbers.
    texts = texts.withColumn("hash", F.xxhash64("text"))
    first = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("hash").alias("hash"))
    sample, _ = saved_at(texts.join(F.broadcast(first), ["id", "hash"]).select("id", "text", "y").dropDuplicates(["id"]))
    model = _built(sample, lift)
    fold = F.pmod(F.xxhash64(F.col("id") + 1), F.lit(FOLDS)) == 0
    part = _built(sample.where(~fold), lift) if model.shards else model
    if not part.shards:
        return model

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            batch = batch.select(["text", "y"])
            share, _, _ = part.index().votes(batch.column(0), part.rate)
            yield pa.RecordBatch.from_arrays([pa.array(share), batch.column(1)], names=["share", "y"])

    got = sample.where(fold).mapInArrow(vote, "share double, y int").toArrow()  # two numbers for each row of a fold of the sample
    share, y = got.column("share").to_numpy(), got.column("y").to_numpy()
    share, y = share[~np.isnan(share)], y[~np.isnan(share)]
    if min(y.sum(), len(y) - y.sum()) < CALIBRATE:
        return model
    slope, shift = calibrated(share, y)
    return replace(model, slope=slope, shift=shift)


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Appends score (0 to 1), neighbours (ids of the examples) and cosines. Row-local; other columns pass unchanged."""
    ship(docs.sparkSession)
    names = [free_name(docs, x) for x in ("score", "neighbours", "cosines")]
    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.array(F.lit(0).cast("long")).alias(names[1]), F.array(F.lit(0.0)).alias(names[2])).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, column):
            got, who, how = model.score(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array(who, pa.list_(pa.int64())), pa.array(how, pa.list_(pa.float64()))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
