"""Later-wins dedupe and keyed comparison: NULL and huge orders, ties, NULL keys."""
import random

import pytest

from service_insights.operators import assess, compare

COLUMNS = "service_id long, component_key string, classification string, reasoning string, pos long, run long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


def plain(rows, seq=True):
    """{key: winner}: the last by (run, pos, class, reasoning), NULL first."""
    def order(r):
        return [(x is not None, x if x is not None else 0 if k < 2 else "") for k, x in enumerate([r[5] if seq else 0, r[4], r[2], r[3]])]

    out = {}
    for r in sorted(rows, key=order):
        out[r[0], r[1]] = (r[2], r[3])
    return out


def drawn(n, seed):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    return [(pick(None, 0, 1, 2, 2**40), pick(None, "", "tires"), pick(None, "Good", "Urgent", "é"), pick(None, "", "r1", "r2"),
             pick(None, 0, 1, 2**33), pick(None, 0, 1, 1_764_700_000, 1_764_700_000_000)) for _ in range(n)]


CASES = [
    [(1, "tires", "Good", "r", None, None)] * 3,  # NULL run and position: the group stays
    [(1, "tires", "Good", "old", 0, 1_764_700_000), (1, "tires", "Urgent", "new", 0, 1_764_700_001), (1, "tires", "Good", "null", 9, None)],
    [(1, "tires", "Good", f"text {k}", 0, 0) for k in range(500)],  # one run and position: one row all the same
    [],
]


@pytest.mark.parametrize("rows", [*CASES, drawn(300, 1), drawn(300, 2)])
def test_dedupe_is_the_plain_one(spark, rows):
    for seq in ("run", None):
        got = assess.dedupe_latest(frame(spark, rows), seq_col=seq).collect()
        assert len(got) == len({(r.service_id, r.component_key) for r in got})
        assert {(r.service_id, r.component_key): (r.classification, r.reasoning) for r in got} == plain(rows, seq is not None)


@pytest.mark.parametrize("a,b", [(drawn(200, 3), drawn(150, 4)), (CASES[0], []), ([], CASES[1]), ([], [])])
def test_compare_is_the_plain_one(spark, a, b):
    got = compare.compare_keyed(frame(spark, a), frame(spark, b), seq_col="run").collect()
    left, right = plain(a), plain(b)
    assert len(got) == len(left | right)
    for r in got:
        key = (r.service_id, r.component_key)
        x, y = left.get(key, (None, None)), right.get(key, (None, None))
        assert (r.in_a, r.a_classification, r.a_reasoning, r.b_classification, r.b_reasoning, r.differs) == (key in left, *x, *y, x[0] != y[0])
