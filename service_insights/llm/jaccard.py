"""Operator 5: exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word shingles. Sizes are split into bands of
ratio 1 / threshold, so two similar sets lie in one band or in neighbouring ones;
a set works in the instance of its own band and in the next. In an instance, sets
at the threshold differ in at most k features. The features' domain is dealt to
k + 1 + e parts by a hash, so that similar sets agree in at least 1 + e parts
whole; each part that isn't empty gives a signature (hash of its features).
With e empty parts at most, one common signature is certain. A set with more
empty parts works on under the next hash as well, until one has few enough; of
two sets the one that ends first shares that hash with the other, so nothing is
lost. At the last hash empty parts give signatures too.

Signatures go to their hash bucket, packed. There each group of sets with one
signature links its members to one of them only (the one with the most company in all
groups), not to one another. Links are verified on the whole sets and joined to
components. Members of one group that still lie in different components are then
compared by parity sketches, whose difference is never larger than that of the
sets, in blocks, and the few pairs within reach are verified too. No pairs within
a component are made. Equal sets are one node throughout.

Null ids link with nothing and have no component. Null texts and texts without
words have no shingles, and are their own component. Rows that share an id are
one node: what links with one of their texts links with that id. Empty tables
give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, flat, packed
from .common import partitions, saved, ship
from .components import components

#: Hashes a set with empty parts tries in turn.
LEVELS = 8
_U = np.uint64
_LOW = _U((1 << 52) - 1)


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a column's rows (4095 at most): keys row << 52 | hash in order, and the bounds of rows.

    Rows with 1 to n - 1 words have their whole sequence as one shingle.
    """
    words = flat.Words(col, flat.PLAIN_LOWER)
    h, counts = words.hashes(), words.counts()
    at = flat.window_rows(words.bounds, n)
    keys = (words.row()[at].astype(_U) << _U(52)) | (flat.windows(h, n)[at] >> _U(12))
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        whole = flat.range_hash(h, words.bounds[few], words.bounds[few + 1])
        keys = np.concatenate([keys, (few.astype(_U) << _U(52)) | (whole >> _U(12))])
    keys = np.sort(keys)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.searchsorted(keys, np.arange(len(col) + 1).astype(_U) << _U(52))


def _digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, whatever the order."""
    out = []
    for seed in (0x51, 0xA7):
        acc = np.zeros(len(keys) + 1, _U)
        np.cumsum(flat.mix((keys & _LOW) ^ flat.mix(np.full(1, seed, _U))), out=acc[1:])
        out.append(flat.mix(acc[bounds[1:]] - acc[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band up to that of ``largest``, and one more."""
    first, last, at = [], [], 1
    while True:
        to = max(at, at * den // num)
        first.append(at)
        last.append(to)
        if at > largest:
            return np.array(first), np.array(last)
        at = to + 1


def plan(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By instance: last size of its band, number of parts, and empty parts allowed (e)."""
    first, last = bands(num, den, largest)
    k = 2 * last * (den - num) // (den + num)
    e = np.zeros(len(k), np.int64)
    low = np.maximum(np.concatenate([first[:1], first[:-1]]), 1)
    for _ in range(4):
        m = k + 1 + e
        empty = m * np.exp(-low / m)
        e = np.where(m > 1, np.ceil(empty + 2 * np.sqrt(empty)), 0).astype(np.int64)
    return last, k + 1 + e, e


def signatures(keys: np.ndarray, bounds: np.ndarray, rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the sets in ``rows``."""
    size = np.diff(bounds)
    rows = rows[size[rows] > 0]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    last, parts, allowed = plan(num, den, int(size.max()))
    band = np.searchsorted(last, size[rows])
    out_row, out_sig = [], []
    for shift in (0, 1):
        todo, inst = rows, band + shift
        for level in range(LEVELS):
            n, m = size[todo], parts[inst]
            feature = keys[flat.gather_ranges(bounds[todo], n)] & _LOW
            seed = flat.mix(np.full(1, 977 + level, _U))
            base = np.cumsum(m) - m
            place = np.repeat(base, n) + (flat.mix(feature ^ seed) % np.repeat(m, n).astype(_U)).astype(np.int64)
            value = flat.mix(feature + seed)
            total = int(m.sum())
            low = np.bincount(place, weights=(value & _U(0xFFFFFFFF)).astype(np.float64), minlength=total)
            high = np.bincount(place, weights=(value >> _U(32)).astype(np.float64), minlength=total)
            full = np.bincount(place, minlength=total) > 0
            owner = np.repeat(np.arange(len(todo)), m)
            part = np.arange(total) - base[owner]
            sig = flat.mix(low.astype(_U) + flat.mix(high.astype(_U) + flat.mix((inst[owner] * LEVELS + level).astype(_U) * flat._P + part.astype(_U))))
            more = m - np.bincount(owner[full], minlength=len(todo)) > allowed[inst]
            use = full | (more[owner] if level == LEVELS - 1 else False)
            out_row.append(todo[owner[use]])
            out_sig.append(sig[use])
            todo, inst = todo[more], inst[more]
            if not len(todo):
                break
    return np.concatenate(out_row), np.concatenate(out_sig)


def signed_slabs(batches: Iterator[pa.RecordBatch], shingle: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, signature) and the digests of the rows, of so many slabs at a time that they have ``SIGNATURES``, or of the rest."""
    rows, ids, sigs, at, size = [], [], [], 0, 0
    for batch in flat.pieces(batches, "text"):
        keys, bounds = shingle_sets(batch.column(1), shingle)
        s1, _ = _digests(keys, bounds)
        _, first = np.unique(s1, return_index=True)  # copies in one slab sign once
        row, sig = signatures(keys, bounds, first, num, den)
        rows.append(row + at)
        ids.append(s1)
        sigs.append(sig)
        at, size = at + len(s1), size + len(sig)
        if size >= SIGNATURES:
            yield np.concatenate(rows), np.concatenate(ids), np.concatenate(sigs)
            rows, ids, sigs, at, size = [], [], [], 0, 0
    if size:
        yield np.concatenate(rows), np.concatenate(ids), np.concatenate(sigs)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    one = np.ones(len(first), bool)
    one[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[one], second[one]


def groups(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, member, size) of the sets that share a signature, two and more.

    A group's name is a hash of its members: groups of the same members say the
    same, and one of them stays.
    """
    sigs, nodes = _distinct(sigs, nodes)
    cuts = np.flatnonzero(np.diff(sigs.astype(np.int64), prepend=-1))
    size = np.diff(cuts, append=len(sigs))
    many = np.repeat(size > 1, size)
    nodes, size = nodes[many], size[size > 1]
    if not len(nodes):
        return (np.zeros(0, np.int64),) * 3
    head = np.cumsum(size) - size
    member = np.zeros(len(nodes) + 1, _U)
    np.cumsum(flat.mix(nodes.view(_U)), out=member[1:])
    name = flat.mix(member[head + size] - member[head]).view(np.int64)
    _, first = np.unique(name, return_index=True)
    chosen = np.zeros(len(size), bool)
    chosen[first] = True
    own = np.repeat(chosen, size)
    return np.repeat(name, size)[own], nodes[own], np.repeat(size, size)[own]


def sketches(keys: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: each feature flips one bit, so two sketches differ in no more bits than the sets in features.

    1024 bits for sets of up to 1000 features, four times as many for each further factor of four.
    """
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = 1024
        while (b - a) > bits:
            bits *= 4
        place = (flat.mix((keys[a:b] & _LOW) * flat._P) & _U(bits - 1)).astype(np.int64)
        out.append(np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").tobytes())
    return out


def _signs(cells: list[bytes]) -> np.ndarray:
    """Sketches as rows of +1 and -1, folded to the shortest one's length (folding keeps the bound)."""
    size = min(map(len, cells))
    out = np.empty((len(cells), size * 8), np.float32)
    for k, cell in enumerate(cells):
        x = np.frombuffer(cell, np.uint8)
        out[k] = np.unpackbits(np.bitwise_xor.reduce(x.reshape(-1, size), axis=0), bitorder="little")
    return 1 - 2 * out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, all rows of x against all of y."""
    return (x.shape[1] - x @ y.T) / 2


#: Members of a group that are compared in one piece; larger groups are cut to blocks.
BLOCK = 2048
#: Bits of the bitmaps of grouped documents and of ends of pairs: half a million rows at most, whatever the table.
LOG_BITS = 25
#: Signatures of a task that are packed at a time. A row for each bucket costs the same however few it holds.
SIGNATURES = 1 << 17


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links of num / den and more)."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(column, F.lit("")).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            keys, bounds = shingle_sets(batch.column(1), shingle)
            s1, s2 = _digests(keys, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2)], names=["id", "n", "s1", "s2"])

    digests = saved(plain.mapInArrow(digest, "id long, n long, s1 long, s2 long"))
    nodes = digests.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("node"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, sigs in signed_slabs(batches, shingle, num, den):
            bucket = ((sigs >> _U(32)) % _U(n)).astype(np.int32)
            yield from packed.pack(bucket, rows, ids, sigs.astype("<u4"), np.zeros(len(sigs), np.uint8))

    def meet(table: pa.Table) -> pa.Table:
        ids, sigs, _ = packed.unpack(table, "<u4", "u1")
        group, member, size = groups(ids, sigs)
        return pa.table({"grp": group, "s1": member, "size": size})

    signed = plain.where("id is not null").mapInArrow(sign, packed.SCHEMA)
    members = saved(signed.groupBy("bucket").applyInArrow(meet, "grp long, s1 long, size long").distinct())

    # Texts and sketches of the sets in any group, under their node (the smallest id of equal sets).
    # The bitmap lets a few others through, which no pair names: no text is shuffled to tell them apart.
    of = saved(nodes.join(members.select("s1").distinct(), "s1").select("s1", "node", "n"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.pieces(batches, "text"):
            keys, bounds = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(sketches(keys, bounds), pa.binary())], names=["node", "text", "n", "sketch"])

    few = bitmap.kept(plain.where("id is not null").select(F.col("id").alias("node"), "text"), of, "node", LOG_BITS)
    texts = saved(few.mapInArrow(sketch, "node long, text string, n long, sketch binary").where("n > 0"))
    drawn = texts.select("node", "n", "sketch")

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(name), *[F.col(c).alias(c + name) for c in columns])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, na, nb, sketches) whose sizes and sketches allow a link."""
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            own = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for k in np.flatnonzero(own).tolist():
                size = min(len(x[k]), len(y[k]))
                bits = np.bitwise_xor.reduce(np.concatenate([np.frombuffer(x[k], "<u8").reshape(-1, size // 8), np.frombuffer(y[k], "<u8").reshape(-1, size // 8)]), axis=0)
                own[k] = int(np.bitwise_count(bits).sum()) * (den + num) <= (na[k] + nb[k]) * (den - num)
            keep = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, texts) that meet the threshold, on their whole sets."""
        for whole in flat.pieces(batches, "texta"):
            for batch in flat.pieces(iter([whole]), "textb"):
                x, xb = shingle_sets(batch.column(2), shingle)
                y, yb = shingle_sets(batch.column(3), shingle)
                both = np.sort(np.concatenate([x, y]))
                same = both[1:][both[1:] == both[:-1]]
                inter = np.bincount((same >> _U(52)).astype(np.int64), minlength=batch.num_rows)
                union = np.diff(xb) + np.diff(yb) - inter
                own = pa.array((inter * den >= union * num) & (inter > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(own), batch.column(1).filter(own)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        own = bitmap.kept(texts.select("node", "text"), ends, "node", LOG_BITS)
        rows = pairs.join(side(own, "b", "text"), "b").join(side(own, "a", "text"), "a")
        return saved(rows.select("a", "b", "texta", "textb").mapInArrow(test, "a long, b long").distinct())

    # Each group's hub is its member with the most company in all groups; the others are tried against it.
    score = members.groupBy("s1").agg((F.sum("size") * (1 << 20) + F.pmod(F.xxhash64("s1"), F.lit(1 << 20))).alias("score"))
    hubs = members.join(score, "s1").groupBy("grp").agg(F.max_by("s1", "score").alias("hub"))
    pairs = members.join(hubs, "grp").where("s1 <> hub").select(F.col("s1").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(of.select(F.col("s1").alias("a"), F.col("node").alias("u")), "a").join(of.select(F.col("s1").alias("b"), F.col("node").alias("v")), "b")
    pairs = saved(pairs.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    maybe = pairs.join(side(drawn, "b", "n", "sketch"), "b").join(side(drawn, "a", "n", "sketch"), "a").select("a", "b", "na", "nb", "sketcha", "sketchb")
    links = verified(saved(maybe.mapInArrow(near, "a long, b long").distinct()))
    labels = saved(components(links))

    # Members of one group that lie in different components: compared by their sketches, in blocks.
    placed = members.where("size > 2").select("grp", "s1").join(of.select("s1", "node"), "s1").select("grp", "node").distinct()
    placed = placed.join(labels, "node", "left").select("grp", "node", F.coalesce("label", "node").alias("label"))
    split = placed.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_ = placed.join(split.select("grp", blocks.alias("blocks")), "grp")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_ = open_.select("grp", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    open_ = open_.select("grp", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    open_ = open_.join(drawn, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, label, block, size = (table.column(c).to_numpy() for c in ("node", "label", "own", "n"))
        signs = _signs(table.column("sketch").to_pylist())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(left), 512):
            rows = left[k:k + 512]
            total = size[rows][:, None] + size[right][None, :]
            ok = _apart(signs[rows], signs[right]) * (den + num) <= total * (den - num)
            ok &= (label[rows][:, None] != label[right][None, :]) & (node[rows][:, None] != node[right][None, :])
            low = np.minimum(size[rows][:, None], size[right][None, :])
            ok &= low * den >= (total - low) * num
            x, y = np.nonzero(ok)
            out.append(np.stack([node[rows[x]], node[right[y]]], 1))
        both = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    rest = open_.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long").distinct()
    rest = saved(rest.join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = verified(rest)
        if not more.isEmpty():
            labels = saved(components(links.union(more)))

    done = digests.join(nodes, ["s1", "s2", "n"], "left").join(labels, "node", "left")
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("component_id"))
