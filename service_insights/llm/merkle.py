"""Operator 11: a Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

A row's leaf is the digest of its fields. The leaves of a group (a language) are
taken in the order of their ids; eight consecutive nodes at a time become their
digest until one is left, the group's subroot. The subroots, ordered by group, make
the root in the same way.

The rank of a leaf comes from a range sort and prefix sums of the parts' counts, a
row for each part and group. ``SPAN`` consecutive nodes are a superblock. Going up,
each superblock becomes one node, which a task works out from its own rows; so the
few tiers of superblocks shrink by that factor each, however large a group is. Going
down, the superblocks' nodes meet in a cogroup the row that tells what lies
outside: the siblings from their superblock's top to the root. One function then
reduces the block, joins each proof and folds the offered leaf back to a root. A
task never holds more than one superblock, and only digests are shuffled, no text.

Null fields are written as ``-``, so a null and an empty text differ. Rows without
id come first, those without group are a group of their own (the first). Rows that
share an id are ordered by their leaf; rows alike in all fields are leaves of their
own and interchangeable. An empty table has no root and gives no rows. Other columns
of the table, whatever their names, are left out.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import duck
from .common import partitions, saved, ship

#: Nodes that make one node of the next level, and levels that a superblock spans.
FAN, LEVELS = 8, 4
#: Characters of a digest.
_HEX = 64

_PROVED = ("id long, group string, rank long, leaf string, subroot string, root string, proof array<struct<before: string, after: string>>, "
           "proof_sha256 string, folded_root string")
_PATH = "group string, rank long, before array<string>, after array<string>, subroot string, root string"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (from 0, in the group's order) and ``size`` (of the group). ``rows`` are stored ones, as they are read twice.

    Equal rows are told apart by their place in the input, so that many of them can lie in several parts.
    """
    keys = ["group", *order, "_tie"]
    by = [F.col(k).asc_nulls_first() for k in keys]
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_tie")
    schema = laid.withColumn("part", F.lit(0)).withColumn("place", F.lit(0).cast("long")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index("group")).dictionary_encode()
            codes = groups.indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            place = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
            if groups.dictionary[codes[0]].as_py() == last:
                place[:first[1] if len(first) > 1 else len(codes)] += seen
            last, seen = groups.dictionary[codes[-1]].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"])

    numbered = saved(laid.mapInArrow(number, schema))
    group, before = Window.partitionBy("group"), Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("group", "part").agg(F.count("*").alias("n"))  # no more rows than parts and groups
    base = base.select("group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(group).alias("size"))
    return numbered.join(base, ["group", "part"]).select(*rows.columns, (F.col("base") + F.col("place")).alias("rank"), "size")


def _digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


class Blocks:
    """What a task does with one superblock of ``levels`` levels."""

    def __init__(self, levels: int):
        self.levels, self.span = levels, FAN**levels

    def number(self) -> Column:
        return F.floor(F.col("rank") / self.span).alias("block")

    def reduced(self, block: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
        """The block in order, and the digests of each level, joined, from its nodes to its top."""
        block = block.sort_values("rank")
        out, n = [b"".join(x.encode() for x in block["digest"])], int(block["size"].iloc[0])
        for _ in range(self.levels):
            if n == 1:
                break
            low, step = out[-1], FAN * _HEX
            out.append(b"".join(_digest(low[k:k + step]) for k in range(0, len(low), step)))
            n = -(-n // FAN)
        return block, out

    def siblings(self, levels: list[bytes], rank: int) -> list[tuple[bytes, bytes]]:
        """What stands before and after a node in its run, level by level."""
        out, k = [], rank % self.span
        for own in levels[:-1]:
            run, at = k // FAN * FAN * _HEX, k * _HEX
            out.append((own[run:at], own[at + _HEX:run + FAN * _HEX]))
            k //= FAN
        return out

    def up(self, block: pd.DataFrame) -> pd.DataFrame:
        """The superblock as a node of the next tier."""
        block, levels = self.reduced(block)
        first = block.iloc[0]
        return pd.DataFrame({"group": [first["group"]], "rank": [int(first["rank"]) // self.span], "size": [-(-int(first["size"]) // self.span)], "digest": [levels[-1].decode()]})

    def down(self, block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        """The paths of the superblock's nodes: their own siblings, then those outside."""
        block, levels = self.reduced(block)
        top = outside.iloc[0]
        paths = [self.siblings(levels, int(r)) for r in block["rank"]]
        before, after = ([[side[k].decode() for side in path] + list(top[name]) for path in paths] for k, name in enumerate(("before", "after")))
        return pd.DataFrame({"group": block["group"], "rank": block["rank"], "before": before, "after": after, "subroot": top["subroot"], "root": top["root"]})

    def prove(self, block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        """The leaves' proofs, and what the offered leaves fold to."""
        block, levels = self.reduced(block)
        top = outside.iloc[0]
        outer = [(a.encode(), b.encode()) for a, b in zip(top["before"], top["after"])]
        proofs, digests, folded = [], [], []
        for rank, own, offered in zip(block["rank"], block["digest"], block["offered"]):
            path = [*self.siblings(levels, int(rank)), *outer]
            proofs.append([{"before": a.decode(), "after": b.decode()} for a, b in path])
            digests.append(sha256(b"".join(a + b for a, b in path)).hexdigest())
            folded.append(reduce(lambda h, side: _digest(side[0] + h + side[1]), path, (offered or own).encode()).decode())
        return pd.DataFrame({"id": block["id"], "group": block["group"], "rank": block["rank"], "leaf": block["digest"], "subroot": top["subroot"], "root": top["root"],
                             "proof": proofs, "proof_sha256": digests, "folded_root": folded})

    def tiers(self, nodes: DataFrame, largest: int) -> list[DataFrame]:
        """Tier 0 and the tiers of superblocks above it, up to where every group is one node; nodes of size 1 are tops."""
        out = [nodes]
        while True:
            below = out[-1] if len(out) == 1 else out[-1].where("size > 1")
            out.append(saved(below.select("group", "rank", "size", "digest").groupBy("group", self.number()).applyInPandas(lambda block: self.up(block), "group string, rank long, size long, digest string")))
            largest = -(-largest // self.span)
            if largest <= 1:
                return out

    def exchange(self, nodes: DataFrame, outside: DataFrame, function, schema: str) -> DataFrame:
        """Superblocks and the rows that tell what lies outside them, cogrouped."""
        return nodes.groupBy("group", self.number()).cogroup(outside.groupBy("group", F.col("rank").alias("block"))).applyInPandas(lambda block, top: function(block, top), schema)

    def outside(self, tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
        """The paths of tier 1: what lies outside each superblock of tier 0. ``tops``: the paths of the groups' tops."""
        path = None
        for tier in reversed(tiers[1:]):
            own = tier.where("size = 1").select("group", "rank").join(tops.drop("rank"), "group").select("group", "rank", "before", "after", "subroot", "root")
            if path is not None:
                own = own.unionByName(self.exchange(tier.where("size > 1").select("group", "rank", "size", "digest"), path, self.down, _PATH))
            path = saved(own)
        return path


def manifest(docs: DataFrame, fields: list[str], id_column: str = "doc_id", group: str | None = "lang", offered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: id, group, rank, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    ``fields`` make the leaf, in this order. ``offered`` is a leaf that is held
    against the manifest in the row's place (null or not given: the row's own).
    ``proof`` lists the siblings before and after the node at each level up to the
    root, ``proof_sha256`` is the digest of all of them in a row, ``folded_root``
    is what the offered leaf and the proof come to, and ``verified`` tells whether
    that is the root.
    """
    ship(docs.sparkSession)
    blocks = Blocks(levels)
    name = F.col(group).cast("string") if group else F.lit(None).cast("string")
    # Groups as text that is never null: '' for null, else '=' and the name. Its order is that of the names, null first.
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("group"),
                       leaf(*map(F.col, fields)).alias("digest"), (F.lit(None).cast("string") if offered is None else offered).alias("offered"))
    leaves = saved(ranked(saved(rows), "id", "digest"))
    largest = leaves.agg(F.max("size")).first()[0] or 1
    tiers = blocks.tiers(leaves, largest)
    subroots = reduce(DataFrame.unionByName, [t.where("size = 1").select(F.lit("").alias("group"), F.col("group").alias("of"), "digest") for t in tiers[1:]])
    subroots = saved(ranked(saved(subroots), "of"))
    upper = blocks.tiers(subroots, subroots.agg(F.max("size")).first()[0] or 1)
    none = F.array().cast("array<string>")
    root = upper[-1].where("size = 1").select("group", none.alias("before"), none.alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root"), F.lit(0).alias("rank"))
    above = blocks.exchange(subroots.select("group", "rank", "size", "digest"), blocks.outside(upper, root), blocks.down, _PATH)
    tops = saved(subroots.select("rank", F.col("of").alias("group"), "digest").join(above.select("rank", "before", "after", "root"), "rank")
                 .select("group", "rank", "before", "after", F.col("digest").alias("subroot"), "root"))
    out = blocks.exchange(leaves, blocks.outside(tiers, tops), blocks.prove, _PROVED)
    shown = F.when(F.col("group") == "", F.lit(None)).otherwise(F.substring("group", 2, 1 << 30))
    return out.select(F.col("id").alias(id_column), shown.alias("group"), "rank", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql(leaf_levels: int = 8, group_levels: int = 4) -> str:
    """DuckDB SQL of the query, with its levels written out: up to 8^8 documents a language and 8^4 languages."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def of(text: str) -> str:
        cells = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in (text if f == "text" else f for f in fields)]
        return f"sha256({' || '.join(cells)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [duck.CRC_TABLE, f"""d as materialized (
  select row_number() over (order by lang nulls first, doc_id nulls first, {of('text')}) as r, doc_id, lang, {of('text')} as leaf,
    case when {duck.crc("doc_id::varchar")} % 3 = 0 then {of(lowered)} else {of('text')} end as offered
  from documents, crc_table)"""]
    ctes.append("""k0 as materialized (select r, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by r) - 1 as i,
  offered as f, '' as proof from d)""")
    ctes.append("n0 as materialized (select g, i, leaf as h, count(*) over (partition by g) as n from k0 join d using (r))")

    def level(k: int) -> list[str]:
        """Nodes, runs and folded rows of the level above level k."""
        return [f"""u{k} as materialized (select g, i // 8 as p, list(h order by i) as hs, any_value(n) as n from n{k} group by g, i // 8)""",
                f"""n{k + 1} as materialized (select g, p as i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h, (n + 7) // 8 as n from u{k})""",
                f"""k{k + 1} as materialized (select r, k{k}.g, i // 8 as i,
  case when n > 1 then sha256(array_to_string(hs[1:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], '')) else f end as f,
  proof || array_to_string(hs[1:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') as proof from k{k} join u{k} on k{k}.g = u{k}.g and i // 8 = p)"""]

    for k in range(leaf_levels):
        ctes += level(k)
    a = leaf_levels
    ctes.append(f"s as materialized (select g, h, row_number() over (order by g) - 1 as i, count(*) over () as n from n{a})")
    ctes.append(f"n{a + 1} as materialized (select '' as g, i, h, n from s)")
    ctes.append(f"k{a + 1} as materialized (select r, '' as g, s.i, f, proof from k{a} join s using (g))")
    for k in range(a + 1, a + 1 + group_levels):
        ctes += level(k)
    z = a + 1 + group_levels
    return f"""with {', '.join(ctes)}
select doc_id, leaf, s.h as subroot, n{z}.h as root, sha256(proof) as proof_sha256, f as folded_root, f = n{z}.h as verified
from d join k{z} using (r) join k0 using (r) join s on k0.g = s.g cross join n{z}""".replace("f as folded_root, f =", f"k{z}.f as folded_root, k{z}.f =").replace("sha256(proof)", f"sha256(k{z}.proof)")
