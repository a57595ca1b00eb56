"""Operator 1 [native]: repeated stretches of lines, by overlapping three-line windows.

A window is three consecutive lines of a document, as they are. Its place is
(id, line). Every window that isn't the first with its text, in the order of
places, covers its three lines; the covered lines of a document are merged and
go. The window's text is stood for by 128 bits of hash.

A window's first place is found by one hash aggregation (smallest id), which
combines before the shuffle; repeats within one document are found in its own
row. Only windows that several documents have are joined back, and that join's
hot keys can be split at run time, since both sides are read from a shuffle.

Null and empty texts have no lines and stay empty. Texts of fewer than three
lines have no window and stay as they are. Null ids come after all others. Rows
that share an id share a place: none is later than the other, and rows that are
alike in id and text are treated alike. Empty tables give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

LAST_ID = 2**63 - 1


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """(id, th, pos, a, b, again): each window, and whether its document has it before.

    Windows are zipped from shifted slices and compared with their neighbours in
    sorted order, so that a row's work grows with its lines and no array is
    carried along with each of its windows.
    """
    n = F.greatest(F.size("lines") - (size - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("lines", F.lit(k + 1), n) for k in range(size)])
    part = lambda x: [x[str(k)] for k in range(size)]
    hashed = F.array_sort(F.transform(shifted, lambda x, i: F.struct(F.xxhash64(*part(x)).alias("a"), F.xxhash64(F.lit(1), *reversed(part(x))).alias("b"), i.alias("pos"))))
    none = F.array(F.lit(None).cast("struct<a: bigint, b: bigint, pos: int>"))
    pairs = F.arrays_zip(hashed, F.slice(F.concat(none, hashed), F.lit(1), n))
    same = lambda y: F.coalesce((y["0"]["a"] == y["1"]["a"]) & (y["0"]["b"] == y["1"]["b"]), F.lit(False))
    marked = F.transform(pairs, lambda y: F.struct(y["0"]["a"].alias("a"), y["0"]["b"].alias("b"), y["0"]["pos"].alias("pos"), same(y).alias("again")))
    # the outer form keeps the optimizer from working out the array once more in a filter on its size
    return rows.select("id", "th", F.explode_outer(marked).alias("w")).where("w is not null").select("id", "th", "w.pos", "w.a", "w.b", "w.again")


def dedup_lines(docs: DataFrame, size: int = 3, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Appends kept_text, n_lines and n_removed; the text itself and all other columns pass unchanged."""
    names = [free_name(docs, x) for x in ("kept_text", "n_lines", "n_removed")]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(column)
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(text).alias("th"),
        F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1)).alias("lines"),
        own,
    )
    windows = _windows(rows.select("id", "th", "lines"), size)
    first = saved(windows.where(~F.col("again")).groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a", "b", "low"))
    later = windows.where(~F.col("again")).join(first, ["a", "b"]).where("id > low").select("id", "th", "pos")
    gone = later.union(windows.where("again").select("id", "th", "pos"))
    covered = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))
    merged = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))
    joined = rows.join(covered.select("id", "th", merged.alias("covered")), ["id", "th"], "left")
    kept = F.when(F.size("lines") > 0, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("covered", F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>"))
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    out = joined.select("row", text.alias("__text"), F.size("lines").cast("long").alias("__n"), F.coalesce(F.array_size("covered"), F.lit(0)).cast("long").alias("__removed"))
    return out.select("row.*", F.col("__text").alias(names[0]), F.col("__n").alias(names[1]), F.col("__removed").alias(names[2]))


ORACLE_SQL = """
with l as (
  select doc_id, case when coalesce(text, '') = '' then []::varchar[] else string_split(text, chr(10)) end as ls from documents
), w as (
  select doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] as k
  from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as p from l)
), r as (
  select doc_id, p, row_number() over (partition by k order by doc_id, p) as rn from w
), c as (
  select distinct doc_id, p + o as q from r, (values (0), (1), (2)) as v(o) where rn > 1
), x as (
  select doc_id, q, ls[q] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as q from l)
), kept as (
  select x.doc_id, string_agg(x.line, chr(10) order by x.q) as t, count(*) as n from x anti join c on x.doc_id = c.doc_id and x.q = c.q group by x.doc_id
)
select l.doc_id, len(ls)::bigint as n_lines, (len(ls) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from l left join kept on l.doc_id = kept.doc_id
"""
