"""Plain Python versions of the operators, and frames of odd rows."""
from __future__ import annotations

import collections
import re

from pyspark.sql import functions as F

BLANKS, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "Alpha beta gamma delta epsilon zeta eta theta"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta"),
    (None, "Alpha beta gamma delta epsilon zeta eta theta"),
    (6, "éàü 漢字 😀  x　y\x00z"),
    (7, "one"),
    (8, "word " * 5000),
    (9, "a\nb\nc\nd\na\nb\nc\nd"),
]
#: Names that the operators use themselves.
CLASHING = ["id", "row", "h", "score", "ids", "decoded", "kept_text", "n", "lines", "node", "label", "pii", "bucket"]


def frame(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if clashing:
        df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text, pattern, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


def jaccard(rows, k, num, den):
    """{id: (set size, component)}, by all pairs that share a shingle."""
    sets, out = {}, {}
    for d, t in rows:
        w = tuple(words(t, BLANKS, True))
        sets[d] = {w[i:i + k] for i in range(len(w) - k + 1)} if len(w) >= k else ({w} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for a, b in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        c = len(sets[a] & sets[b])
        if den * c >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for d, s in sets.items():
        out[d] = (len(s), find(d))
    return out


def repeats(rows, window=13):
    """{id: (words, kept words)} of rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t, BLANKS)
        keys = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
        gone = {j for i, k in enumerate(keys) if k in seen for j in range(i, i + window)}
        seen.update(keys)
        out[d] = (len(w), [x for j, x in enumerate(w) if j not in gone])
    return out


def contained(rows, items, window=10):
    """{id: (words, hit words, item names)}."""
    own = collections.defaultdict(set)
    for name, t in items:
        w = words(t, ALNUM, True)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            own[tuple(w[i:i + size])].add(name)
    out = {}
    for d, t in rows:
        w = words(t, ALNUM, True)
        hit, names = set(), set()
        for size in {len(k) for k in own}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in own:
                    names |= own[tuple(w[i:i + size])]
                    hit |= set(range(i, i + size))
        out[d] = (len(w), len(hit), sorted(names))
    return out


def lines(rows, size=3):
    """{id: kept text} of rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        own = (t or "").split("\n") if t else []
        gone = set()
        for i in range(len(own) - size + 1):
            k = tuple(own[i:i + size])
            if k in seen:
                gone |= set(range(i, i + size))
            seen.add(k)
        out[d] = "\n".join(x for j, x in enumerate(own) if j not in gone)
    return out
