"""Spelling variants against a plain version over all pairs."""
import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from service_insights.llm import spelling
from service_insights.llm.common import saved

from . import helpers as H


def plain_counts(rows, erode=97):
    out = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(H.LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if erode and h % erode == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts, times=2):
    out, words = {}, sorted(counts)
    for w in words:
        own = [v for v in words if near(w, v)]
        top = min(own, key=lambda v: (-counts[v], v), default=None)
        out[w] = [top if top is not None and counts[top] >= times * counts[w] else None, len(own)]
    roots = {}
    for w in words:
        at = w
        while out[at][0] is not None:
            at = out[at][0]
        roots[w] = at
    return {w: (counts[w], form, roots[w], n, counts.get(form)) for w, (form, n) in out.items()}


def got(spark, counts, rows):
    words = saved(spark.createDataFrame([*counts.items()] or [], "word string, n long").repartition(3))
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(words, rows=rows).collect()}


def vocabulary(kind, n, seed):
    rnd = random.Random(seed)
    if kind == "dense":  # nearly all are near many
        return {"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 9))): rnd.randint(3, 40) for _ in range(n)}
    if kind == "one prefix":  # a hot group that halving must split
        return {"interna" + "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 6))): rnd.randint(3, 500) for _ in range(n)}
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 30))) for _ in range(n // 4)]
    return {w[:k] + x + w[k + d:]: rnd.randint(3, 99) for w in base for k, x, d in [(0, "", 0), (rnd.randrange(len(w)), "z", 0), (rnd.randrange(1, len(w)), "y", 1), (0, "", 1)] if len(w[:k] + x + w[k + d:]) >= 5}


@pytest.mark.parametrize("kind,n,rows", [("dense", 300, 16), ("dense", 300, 2048), ("one prefix", 500, 32), ("mixed", 400, 2), ("mixed", 400, 2048)])
def test_variants_equal_all_pairs(spark, kind, n, rows):
    counts = vocabulary(kind, n, len(kind))
    assert got(spark, counts, rows) == plain_variants(counts)


def test_ties_chains_and_odd_words(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "baaaaaaaa": 48, "caaaaaaaa": 48, "ééééé": 3, "éééé😀": 9, "x" * 5000: 4, "x" * 4999: 8, "lonely": 5}
    out = got(spark, counts, 2048)
    assert out == plain_variants(counts)
    assert out["aaaaa"][2] == "baaaaaaaa" and out["aaaaaaaa"][1] == "baaaaaaaa" and out["x" * 5000][2] == "x" * 4999
    assert got(spark, {}, 2048) == {} and got(spark, {"single": 3}, 2048) == {"single": (3, None, "single", 0, None)}


def test_tiles_hold_whole_groups_across_batches():
    """Batches may cut a group anywhere."""
    import pyarrow as pa

    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("ab") for _ in range(8)) for _ in range(200)})
    rows = sorted((hash(w[:4]) & 3, w) for w in words)
    table = pa.table({"longest": pa.array([8] * len(rows), pa.int32()), "lo": pa.array([4] * len(rows), pa.int32()), "hi": pa.array([8] * len(rows), pa.int32()),
                      "key": pa.array([k for k, _ in rows], pa.int64()), "word": [w for _, w in rows], "n": pa.array([1] * len(rows), pa.int64())})
    for size in (1, 7, 1000):
        out = collections.Counter()
        for b in spelling._compared(iter(table.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                out[r["word"]] += r["n_near"]
        want = {w: sum(near(w, v) and v[:4] == w[:4] for v in words) for w in words}
        assert dict(out) == {w: n for w, n in want.items() if n}


@pytest.mark.parametrize("clashing", [False, True])
def test_counts(spark, clashing):
    rnd = random.Random(4)
    rows = [*H.ODD, *[(k, " ".join(rnd.choice(["Wörter", "hello", "HELLO", "there", "× ÷ß", "naïveté", "a1b2c3", "漢字words漢"]) for _ in range(40)) + "\n") for k in range(100, 160)], (500, "y" * 90 + " " + "y" * 90), (501, "z" * 200_000 + " " + "q" * 90 + "-" + "y" * 90)]
    for erode in (97, 3, 0):
        out = spelling.count_words(H.frame(spark, rows, clashing), erode=erode).collect()
        assert {r["word"]: r["n"] for r in out} == plain_counts(rows, erode)
    assert spelling.count_words(H.empty(spark)).collect() == []


def test_crc_of_many_runs():
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 123, 4000).astype(np.uint8)
    starts = np.arange(0, 3000, 10)
    ends = starts + rnd.integers(1, 120, len(starts))
    heads = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(starts))], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(h)) for a, b, h in zip(starts, ends, heads)]
    assert spelling._crcs(heads, data, starts, ends).tolist() == want
