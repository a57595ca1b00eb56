"""Line dedup, substring dedup, Jaccard join, decontamination and licences against plain Python."""
import random

import pytest

from service_insights.llm import decontaminate, jaccard, licenses, line_dedup, substring

from . import helpers as H


def invented(seed, groups=25):
    """Groups of near copies, shared passages and short texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(2000)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 20, 60, 200]))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + len(w) // 30)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w) + 1)
                w[at:at] = passage[rnd.randrange(10):]
            rows.append((len(rows), "".join(x + rnd.choice([" ", " ", "\n"]) for x in w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shingle,num", [(4, 85), (5, 80)])
def test_jaccard_finds_every_link(spark, shingle, num):
    rows = invented(shingle)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(H.frame(spark, rows), shingle, num, 100).collect()}
    assert got == H.jaccard(rows, shingle, num, 100)


def test_jaccard_links_variants_that_only_the_original_links(spark):
    """Each variant is near to the original, no two variants are near to one another."""
    base = [f"w{i}" for i in range(100)]
    rows = [(50, " ".join(base))]
    for k in range(20):
        w = list(base)
        w[k * 4 + 8] = f"x{k}"  # to the original 93 of 101 shingles, between variants 89 of 105
        rows.append((100 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(H.frame(spark, rows)).collect()}
    assert got == H.jaccard(rows, 4, 85, 100)
    assert {c for _, c in got.values()} == {50}


def test_partenum_misses_no_pair_at_the_threshold():
    """Sets that are as far apart as the threshold allows share a signature, at every size."""
    import numpy as np

    rnd = np.random.default_rng(3)
    for n in [1, 2, 5, 6, 7, 12, 13, 14, 40, 90, 333, 1000]:
        for _ in range(20):
            a = np.sort(rnd.choice(2**40, n, replace=False).astype(np.uint64))
            gone = int(n * 15 // 100)  # |a & b| / |a| = 0.85 and more
            b = a[gone:]
            keys = np.concatenate([a, b | (np.uint64(1) << np.uint64(52))])
            row, sig = jaccard.signatures(keys, np.array([0, n, n + len(b)]), np.arange(2), 85, 100)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), n


def test_substring_equals_plain(spark):
    rows = invented(7)
    expected = H.repeats(rows)
    got = {r["doc_id"]: r for r in substring.remove_repeats(H.frame(spark, rows)).collect()}
    assert set(got) == set(expected)
    for d, (n, kept) in expected.items():
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_text"]) == (n, n - len(kept), " ".join(kept))


def test_substring_frequent_passage_and_copies(spark, monkeypatch):
    """With a tiny sample bound every passage is frequent, or none: the result is the same."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, f"{' '.join(rnd.choice('abcdefg') + str(rnd.randrange(99)) for _ in range(rnd.randrange(60)))} {passage} tail{k}") for k in range(60)]
    rows += [(100 + k, passage) for k in range(30)]
    expected = H.repeats(rows)
    for share, most in ((0.004, 32768), (0.004, 5), (2.0, 32768)):
        monkeypatch.setattr(substring, "FREQUENT_SHARE", share)
        monkeypatch.setattr(substring, "MOST_FREQUENT", most)
        got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(H.frame(spark, rows)).collect()}
        assert got == {d: " ".join(kept) for d, (_, kept) in expected.items()}


def test_decontaminate_equals_plain(spark):
    rows = invented(9)
    rnd = random.Random(2)
    some = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(str(k), " ".join(rnd.choice(some).upper().split()[k % 5:][:rnd.choice([1, 2, 4, 10, 14, 30])])) for k in range(30)]
    items += [("none", None), ("blank", " "), ("away", "this is nowhere in them")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = H.contained(rows, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(H.frame(spark, rows), bench).collect()}
    assert got == expected
    assert any(x[1] for x in expected.values())


def test_line_dedup_equals_plain(spark):
    rnd = random.Random(4)
    pool = [f"line {i}" for i in range(12)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14)))) for k in range(80)]
    rows += [(100, "x\nx\nx\nx\nx"), (101, "a\nb\nc\n"), (102, "a\nb\nc\n"), (103, None)]
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(H.frame(spark, rows)).collect()}
    assert got == H.lines(rows)
    assert got[100] == "x" and got[102] == ""


def test_line_dedup_plan_has_no_python(spark):
    plan = line_dedup.dedup_lines(H.frame(spark, [(1, "a\nb\nc")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_public_licence_texts(spark):
    from service_insights.llm import licence_texts as L

    whole = [("Apache-2.0", L.APACHE_2_0), ("GPL-1.0", L.GPL_1_0), ("GPL-2.0", L.GPL_2_0), ("GPL-3.0", L.GPL_3_0), ("LGPL-2.0", L.LGPL_2_0), ("LGPL-2.1", L.LGPL_2_1), ("LGPL-3.0", L.LGPL_3_0), ("MPL-2.0", L.MPL_2_0), ("CC0-1.0", L.CC0_1_0), ("GFDL-1.3", L.GFDL_1_3)]
    rows = [(k, "\n\n" + text.replace("    ", "\t").upper()) for k, (_, text) in enumerate(whole)]
    lines = [("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("MPL-2.0", "# SPDX-License-Identifier: MPL-2.0"), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")]
    rows += [(100 + k, "text\n" + line) for k, (_, line) in enumerate(lines)]
    got = {r["doc_id"]: r for r in licenses.scan(H.frame(spark, rows)).collect()}
    assert [got[k]["licence"] for k in range(len(whole))] == [name for name, _ in whole]
    assert [got[100 + k]["notices"] for k in range(len(lines))] == [[name] for name, _ in lines]
    for known, name in ((licenses.LICENCES, "licence"), (licenses.NOTICES, "notice")):
        table = licenses._known(spark, known, name).collect()
        assert len(table) == len({r["digest"] for r in table})


def test_licences(spark):
    mit = licenses.LICENCES[0][1]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper()),
        (3, mit.replace("sublicense", "sub-licence").replace(" ", "\n")), (4, mit + " And more."),
        (5, "prose\n  released under the MIT Licence!\nmore"), (6, None), (7, ""), (8, "licence"),
    ]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licenses.scan(H.frame(spark, rows)).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: ("MIT", []), 4: (None, []), 5: (None, ["MIT"]), 6: (None, []), 7: (None, []), 8: (None, [])}


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    docs = H.frame(spark, H.ODD, clashing)
    n = len(H.ODD)
    bench = spark.createDataFrame([(1, "beta gamma delta epsilon"), (None, "theta"), (2, None)], "item_id long, text string")
    rows = jaccard.jaccard_components(docs).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == n and by[5] == 1 and by[None] is None and by[2] == 2 and by[8] == 8
    rows = substring.remove_repeats(docs).collect()
    assert len(rows) == n and all(r["n_removed"] == 0 for r in rows if r["doc_id"] != 8)
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert len(rows) == n and {(r["doc_id"], r["n_hit"]) for r in rows if r["n_hit"]} == {(1, 5), (5, 5), (None, 5)}
    rows = line_dedup.dedup_lines(docs).collect()
    kept = "_kept_text" if clashing else "kept_text"
    assert len(rows) == n and {r["doc_id"]: r[kept] for r in rows}[9] == "a\nb\nc\nd"
    assert len(licenses.scan(docs).collect()) == n


def test_empty_tables(spark):
    docs, bench = H.empty(spark), spark.createDataFrame([], "item_id long, text string")
    for df in (jaccard.jaccard_components(docs), substring.remove_repeats(docs), decontaminate.decontaminate(docs, bench), line_dedup.dedup_lines(docs), licenses.scan(docs)):
        assert df.collect() == []
    assert [r["n_hit"] for r in decontaminate.decontaminate(H.frame(spark, [(1, "a b")]), bench).collect()] == [0]


def test_decontaminate_with_shared_windows_and_a_full_bitmap(spark, monkeypatch):
    """Two items of one window, one very common shingle, and a bitmap that lets everything through."""
    monkeypatch.setattr(decontaminate, "LOG_BITS", 7)
    common = "the same common words"
    items = [("a", "one two three four five six seven eight nine ten eleven"), ("b", "one two three four five six seven eight nine ten"), ("c", common), ("d", common + " again and " + common), ("e", "one two")]
    docs = [(k, f"x{k} {common} y{k} {common}") for k in range(300)] + [(1000, "so one two three four five six seven eight nine ten end"), (1001, f"{common} again and {common}"), (1002, "one  TWO"), (1003, " ".join([common] * 400))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(H.frame(spark, docs), bench).collect()}
    assert got == H.contained(docs, items)
