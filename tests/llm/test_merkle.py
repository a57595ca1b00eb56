"""The Merkle manifest against a plain recursive version."""
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from service_insights.llm import merkle

from . import helpers as H

FIELDS = ["doc_id", "lang", "text"]
COLUMNS = "doc_id long, lang string, text string"


def digest(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """Root of the nodes, and each one's siblings (before, after) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8:p // 8 * 8 + 8]
            paths[k].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
        at = [p // 8 for p in at]
        nodes = [digest("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    """Sorted (id, leaf, subroot, root, proof)."""
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in itertools.groupby(order, key=lambda r: r[1])]
    done = [climb([leaf(r) for r in g]) for g in groups]
    root, upper = climb([top for top, _ in done])
    return sorted(((r[0], leaf(r), top, root, p + upper[k]) for k, (g, (top, paths)) in enumerate(zip(groups, done)) for r, p in zip(g, paths)), key=str)


def got(spark, rows, levels, **more):
    out = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(3), FIELDS, levels=levels, **more).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]]) for r in out), key=str), out


MANY = [(k * 7 % 601, "en", f"text {k}") for k in range(601)] + [(k, "dé", "x") for k in range(65)] + [(1, f"l{k}", "") for k in range(70)]
ODD = [(3, None, None), (3, None, ""), (None, None, "a"), (None, "en", "a"), (5, "en", "é漢😀"), (5, "en", "é漢😀"), (5, "en", "other"), (6, "", "y" * 100_000)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_is_the_plain_tree(spark, levels):
    rows = MANY + ODD
    own, out = got(spark, rows, levels)
    assert own == plain(rows)
    for r in out:
        assert r["proof_sha256"] == digest("".join(s["before"] + s["after"] for s in r["proof"]))
        assert r["folded_root"] == r["root"] and r["verified"]


@pytest.mark.parametrize("rows", [[(1, "en", "one")], [(k, "en", "t") for k in range(8)], [(k, "en", "t") for k in range(9)], [(1, None, "a"), (1, "", "a")], [(7, "en", "same")] * 20])
def test_small_and_equal(spark, rows):
    assert got(spark, rows, 1)[0] == plain(rows)


def test_offered_leaves(spark):
    """What is offered in a row's place is folded with the row's own siblings."""
    rows = MANY[:100]
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf(F.col("doc_id"), F.col("lang"), F.lit("changed")))
    _, out = got(spark, rows, 1, offered=changed)
    for r in out:
        h = leaf((r["doc_id"], "en", "changed")) if r["doc_id"] % 3 == 0 else r["leaf"]
        for s in r["proof"]:
            h = digest(s["before"] + h + s["after"])
        assert r["folded_root"] == h and r["verified"] == (r["doc_id"] % 3 != 0)


def test_empty_and_clashing(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS), FIELDS).collect() == []
    rows = MANY[:20]
    frame = spark.createDataFrame(rows, COLUMNS).select("*", *[F.lit(k).alias(c) for k, c in enumerate([*H.CLASHING, "digest", "group", "rank", "size", "part", "offered"])])
    out = merkle.manifest(frame, FIELDS).collect()
    assert sorted((r["doc_id"], r["leaf"]) for r in out) == sorted((r[0], leaf(r)) for r in rows) and {r["root"] for r in out} == {plain(rows)[0][3]}
    assert {r["group"] for r in merkle.manifest(frame, FIELDS, group=None).collect()} == {None}
