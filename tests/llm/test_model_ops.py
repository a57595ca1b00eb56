"""BPE, token files, toxicity, personal data and fingerprints."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from service_insights.llm import bpe, fingerprint, pii, token_files, toxicity
from service_insights.llm.common import scratch

from . import helpers as H

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Tokenizer(PATH)
BY_LIBRARY = token_files.LibraryWords(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


SPECIAL = "<|endoftext|>"
#: Marks and letters whose normal form, lower case or order the encoders must leave to the library's rules.
COMBINING = "\u0130\u094d\u0f73\u0301\u0323\u0345\u1e9b\u212bIi\u0307J\u030cWHT\u030a\u0331\u0308éÉü"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("'stmdrevl aAéÉß1.!\n<|endoftext|>İΣ", max_size=40), st.text(COMBINING + " a", max_size=12),
                          st.lists(st.sampled_from([SPECIAL, "<|startoftext|>", "hello", " ", "a" + SPECIAL, "İ\u094d"]), max_size=6).map("".join)), min_size=1, max_size=5),
       st.sampled_from([OWN, BY_LIBRARY]))
def test_encoders_equal_the_library(texts, own):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, rows = own.encode(texts)
    for k, t in enumerate(texts):
        got = ids[rows[k]:rows[k + 1]]
        assert got.tolist() == ids_of(t)
        assert own.decode(got) == LIBRARY.decode(ids_of(t), skip_special_tokens=False)


@pytest.mark.parametrize("texts", [[SPECIAL], [SPECIAL * 2], [SPECIAL, None, ""], ["hello world", f"hello {SPECIAL} world"], [f"{SPECIAL} {SPECIAL}"], ["\u0130\u094d", "\u0130\u0f73"]])
def test_special_tokens_alone_and_beside_remembered_words(spark, texts):
    rows = list(enumerate(texts))
    want = {k: ids_of(t or "") for k, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_decode(docs, PATH).collect()} == want
    folder = scratch(spark)
    got = token_files.read(spark, folder, token_files.write(docs, folder, PATH)).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids_u32"], "<u4").tolist() for r in got} == {k: [*x, 1] for k, x in want.items()}
    for coder in (OWN, BY_LIBRARY):
        coder._forget()
        for k, t in rows:  # one after the other: later texts meet remembered parts
            assert coder.encode([t or ""])[0].tolist() == want[k]


def test_bpe_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_IDS", 10)
    own = bpe.Tokenizer(PATH)
    for _ in range(3):
        ids, rows = own.encode(["hello there wonderful world", "and hello again", ""])
        assert ids[rows[0]:rows[1]].tolist() == ids_of("hello there wonderful world")
        assert ids[rows[1]:rows[2]].tolist() == ids_of("and hello again")


@pytest.mark.parametrize("clashing", [False, True])
def test_bpe_rows(spark, clashing):
    docs = H.frame(spark, H.ODD, clashing)
    ids, decoded = ("_ids", "_decoded") if clashing else ("ids", "decoded")
    rows = bpe.encode_decode(docs, PATH).collect()
    assert len(rows) == len(H.ODD)
    for r in rows:
        assert r[ids] == ids_of(r["text"] or "") and r[decoded] == LIBRARY.decode(r[ids], skip_special_tokens=False)
    assert bpe.encode_decode(H.empty(spark), PATH).collect() == []


def test_token_files_round_trip(spark):
    rows = [r for r in H.ODD if r[0] is not None] + [(k, f"text number {k} " * (k % 7)) for k in range(20, 120)]
    folder = scratch(spark)
    manifest = token_files.write(H.frame(spark, [*rows, (None, "no id")], True), folder, PATH)
    got = sorted(token_files.read(spark, folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(d for d, _ in rows)]
    at, texts = 0, {d: t for d, t in rows} | {None: "no id"}
    for r in got:
        want = np.array([*ids_of(texts[r["doc_id"]] or ""), 1], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(want) and bytes(r["ids_u32"]) == want.tobytes()
        assert zlib.crc32(bytes(r["ids_u32"])) == zlib.crc32(want.tobytes())
        at += len(want)
    folder = scratch(spark)
    assert token_files.read(spark, folder, token_files.write(H.empty(spark), folder, PATH)).collect() == []


def labelled(n=400, seed=1):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice(["ra", "mi", "to", "len", "as"]) for _ in range(3)) for _ in range(300)]
    bad = ["idiotra", "scumlen", "trashto", "moronas"]
    docs, labels = [], []
    for k in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = int(rnd.random() < 0.2)
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        docs.append((k, " ".join(w)))
        labels.append((k, toxic))
    return docs, labels


def example_ids(model):
    return [i for s in toxicity.Index(model).shards for i in s.ids.tolist()]


def test_toxicity_held_out_accuracy(spark):
    docs, labels = labelled()
    frame = H.frame(spark, [*docs, (9001, None), (9002, ""), (None, "idiotra scumlen trashto")])
    model = toxicity.fit(frame, spark.createDataFrame([*labels, (3, None), (77777, 1)], "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    truth = dict(labels)
    assert not set(example_ids(model)) & set(held)
    assert np.mean([(rows[d]["score"] >= 0.5) == bool(truth[d]) for d in held]) > 0.95
    assert rows[None]["score"] > 0.5 and rows[9001]["score"] == rows[9002]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in rows.values())


@pytest.mark.parametrize("shard", [40, 1024])
def test_toxicity_neighbours_are_exact(spark, monkeypatch, shard):
    """Of one shard or several, the best by a dense product."""
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "SHARD", shard)
    docs, labels = labelled(seed=2)
    frame = H.frame(spark, docs)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    index = toxicity.Index(model)
    assert (len(index.shards) > 2) == (shard == 40)
    known = dict(docs)
    ids = np.concatenate([s.ids for s in index.shards])
    row, term, weight = index.vectors.of(pa.array([known[i] for i in ids.tolist()]))
    dense = np.zeros((len(ids), len(index.vectors.vocabulary)), np.float32)
    dense[row, term] = weight
    row, term, weight = index.vectors.of(pa.array([t for _, t in docs]))
    got = index.neighbours(row, term, weight, len(docs))
    for r in range(len(docs)):
        every = dense[:, term[row == r]].astype(float) @ weight[row == r]
        want = np.lexsort((ids, -np.round(every, 12)))[:toxicity.NEIGHBOURS]
        want = want[every[want] > 0]
        assert np.allclose(got[r][2], every[want], atol=1e-6)
        sure = np.abs(np.diff(every[want], append=0)) > 1e-6  # places that rounding can't swap
        assert all(got[r][0][k] == ids[want[k]] for k in range(len(want)) if sure[k] and (k == 0 or sure[k - 1]))


def test_toxicity_blocks_bound_their_examples():
    """Every block's bound is at least its best cosine, for dense and for other terms, and skipped blocks change nothing."""
    rnd = np.random.default_rng(3)
    n, terms = 500, 3000
    example = np.repeat(np.arange(n), 30)
    term = (rnd.zipf(1.3, len(example)) % terms).astype(np.int64)
    pairs = np.unique(np.stack([example, term]), axis=1)
    weight = rnd.random(pairs.shape[1]).astype(np.float32) / 5
    shard = toxicity.Shard(np.arange(n) * 3, np.zeros(n), pairs[0], pairs[1], weight)
    dense = np.zeros((n, terms))
    dense[pairs[0], pairs[1]] = weight
    again = toxicity.Shard.from_bytes(shard.to_bytes(), terms)
    for least in (0.0, 0.3):
        met = again.met(pairs[0][:2000], pairs[1][:2000], weight[:2000].astype(float), n)
        for r in range(40):
            best = [(dense[c * toxicity.BLOCK:(c + 1) * toxicity.BLOCK] @ dense[r]).max() for c in range(met.bound.shape[1])]
            assert (met.bound[r] >= np.array(best) - 1e-5).all()
        got = met.best(np.arange(n), np.full(n, least), 5)
        for r in range(40):
            every = dense @ dense[r] if r < pairs[0][1999] else None
            if every is not None:
                want = np.sort(every)[::-1][:5]
                want = want[want > max(least, 0)]
                assert np.allclose(np.sort(got[r][1])[::-1][:len(want)], want, atol=1e-6)


def test_calibration_follows_the_labels():
    rnd = np.random.default_rng(1)
    true = rnd.random(4000)
    y = (rnd.random(4000) < true).astype(int)
    share = 1 / (1 + np.exp(-3 * np.log(true / (1 - true)) - 1))  # far too sure, and shifted
    slope, shift = toxicity.calibrated(share, y)
    assert slope == pytest.approx(1 / 3, abs=0.05) and shift == pytest.approx(-1 / 3, abs=0.15)
    apart = toxicity.calibrated(np.array([0.1] * 50 + [0.9] * 50), np.array([0] * 50 + [1] * 50))
    assert np.isfinite(apart).all()


def test_toxicity_finds_examples_by_rare_words(spark):
    """Words of a single example are in no selection by label, and yet its near copies find it."""
    docs, labels = labelled()
    rare = "zorbulate quindrax vemtilo harbwick"
    ids = [d for d in range(5000, 5020) if zlib.crc32(str(d).encode()) % 5][:2]
    docs += [(ids[0], rare), (ids[1], "plinkert osswald"), (6000, rare + " fenn"), (6001, "plinkert osswald")]
    labels += [(ids[0], 1), (ids[1], 0)]
    frame = H.frame(spark, docs)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    assert rows[6000]["neighbours"][0] == ids[0] and rows[6000]["score"] > 0.5
    assert rows[6001]["neighbours"][0] == ids[1] and rows[6001]["score"] < 0.5
    assert all(r["neighbours"] for r in rows.values())


def test_toxicity_learns_one_row_of_an_id(spark):
    docs, labels = labelled()
    one = next(d for d in range(400) if zlib.crc32(str(d).encode()) % 5)
    docs += [(one, f"many rows of one id {k % 30}") for k in range(300)]
    model = toxicity.fit(H.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert one in example_ids(model)
    assert len(example_ids(model)) == len(set(example_ids(model)))


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(H.frame(spark, H.ODD, True), none)
    rows = toxicity.score(H.frame(spark, H.ODD, True), model).collect()
    assert len(rows) == len(H.ODD) and len({r["_score"] for r in rows}) == 1
    assert toxicity.score(H.empty(spark), model).collect() == []


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in re.finditer(PATTERNS[0], text)]
    out += [(1, *m.span()) for m in re.finditer(PATTERNS[1], text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(PATTERNS[2], text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(PATTERNS[3], text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("a1.@ +-()2%é94", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_field_is_exact_and_learns():
    field = pii.trained()
    test = pii.labelled(200, seed=99)
    got = field.decode([pii.features(w) for w, _ in test])
    assert np.mean([g.tolist() == y for g, (_, y) in zip(got, test)]) > 0.95
    words = test[0][0][:4]
    e, _ = field.emissions([pii.features(words)])
    import itertools

    score = lambda p: field.first[p[0]] + sum(e[0, t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=score)
    assert score(tuple(field.decode([pii.features(words)])[0])) == pytest.approx(score(best))


SPELLED = ["write to john(at)example.com", "please write to maria[at]site.org or not", "left (at) home [at] last", "é (at)"]


def test_spelled_addresses_without_digits():
    got = pii.spans(SPELLED, pii.trained())
    assert got[0] == [(0, 9, 28, False)] and got[1] == [(0, 16, 33, False)] and got[2] == got[3] == []


def test_pii_rows_with_spelled_addresses(spark):
    rows = [*enumerate(SPELLED), (10, "(at"), (11, ")"), (12, "("), (13, "at)x")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["pii"]] for r in pii.find(H.frame(spark, rows)).collect()}
    assert got == {k: [("email", 9, 28, False)] if k == 0 else [("email", 16, 33, False)] if k == 1 else [] for k, _ in rows}


def test_words_are_trimmed_whole():
    for n in (1, 9, 300):
        assert pii.trimmed('"' * n + "212.555.0199" + "!" * n, 5) == ("212.555.0199", 5 + n)
        text = "call me at " + "(" * n + "212.555.0199" + '"' * n + " today"
        assert pii.spans([text], pii.trained())[0] == [(3, 11 + n, 23 + n, False)]
    assert pii.trimmed("<" * 100_000, 0) == ("", 100_000)


def test_pii_rows(spark):
    rows = [*H.ODD, (20, "call +1 (269) 555-3296 4524132264652876 now"), (21, "mail a.b@c.example, at 10.0.0.1 or 300.1.1.1"), (22, "1" * 100000 + "@" * 1000)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["_pii"]] for r in pii.find(H.frame(spark, rows, True)).collect()}
    assert got[20] == [("card", 23, 39, False), ("phone", 5, 22, False)]
    assert got[21] == [("email", 5, 18, True), ("ip", 23, 31, True)]
    assert got[1] == got[2] == got[3] == got[22] == []
    assert pii.find(H.empty(spark)).collect() == []


def test_fingerprints_next_document(spark):
    rnd = random.Random(8)
    rows = [(k * 3, "".join(rnd.choice("abcdef ghé") for _ in range(rnd.choice([0, 1, 2, 40, 900])))) for k in range(60)] + [(1, None), (None, "the last one")]
    got = {r["doc_id"]: r for r in fingerprint.with_next(H.frame(spark, rows, True)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [(None, "the last one")]
    texts = [t or "" for _, t in order]
    for k, (d, _) in enumerate(order):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = fingerprint.fingerprints([text, edited, after])
        r = got[d]
        assert (r["n_chars"], r["edited_text"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), edited, a, b)
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert fingerprint.with_next(H.empty(spark)).collect() == []
    assert [r["edited_text"] for r in fingerprint.with_next(H.frame(spark, [(7, "abcd")])).collect()] == ["abab"]


def test_walk_is_the_plain_walk():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh ijk") for _ in range(n)) for n in [0, 1, 5, 300, 301, 2000] * 8]
    steps = fingerprint._steps()
    for text, print_ in zip(texts, fingerprint.fingerprints(texts)):
        at, shown = 0, []
        for ch in text:
            kind = int(fingerprint.flat.mix(np.array([ord(ch)], np.uint64))[0] >> np.uint64(58))
            step = int(steps[kind, at % fingerprint.PERIOD])
            shown += [ch] * step
            at += step
        places = fingerprint.places(len(shown))
        bits = fingerprint._bits(np.array([ord(shown[p]) for p in places], np.uint32), places) if text else np.zeros(0, np.uint8)
        assert print_ == (fingerprint._text_of(len(shown), bits) if text else "0:")


def test_likeness_falls_with_edits():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ijklmno") for _ in range(3000))

    def edited(n):
        x = list(text)
        for _ in range(n):
            x[rnd.randrange(len(x))] = "q"
        return "".join(x)

    a, few, many, other = fingerprint.fingerprints([text, edited(2), edited(800), text[::-1]])
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, few) > 0.9
    assert fingerprint.likeness(a, few) > fingerprint.likeness(a, many) and fingerprint.likeness(a, other) < 0.3
    assert fingerprint.likeness("0:", "0:") == 1 and fingerprint.likeness("0:", a) == 0


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ijklmno") for _ in range(400)) for _ in range(10)]
    rows = [(k * 10 + j, t if j < 2 else t[:380] + "x" + t[381:]) for k, t in enumerate(base) for j in range(3)] + [(900, None), (901, "")]
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(H.frame(spark, rows)).collect()}
    assert all(got[k * 10 + j] == k * 10 for k in range(10) for j in range(2)) and got[900] == got[901] == 900
    assert sum(got[k * 10 + 2] == k * 10 for k in range(10)) >= 9


def test_near_duplicates_of_nothing_and_of_one(spark):
    assert fingerprint.near_duplicates(H.empty(spark)).collect() == []
    assert [r["class_id"] for r in fingerprint.near_duplicates(H.frame(spark, [(4, "alone")])).collect()] == [4]


def test_very_long_texts(spark):
    """One text of two million characters among short ones, and one of a single letter."""
    rnd = random.Random(9)
    docs, labels = labelled(200)
    long = " ".join("".join(rnd.choice("abcdefghijk") for _ in range(6)) for _ in range(300_000))
    docs += [(7001, long + " idiotra scumlen"), (7002, "z" * 300_000)]
    model = toxicity.fit(H.frame(spark, docs), spark.createDataFrame(labels + [(7001, 1)], "doc_id long, toxic int"))
    rows = {r["doc_id"]: r for r in toxicity.score(H.frame(spark, docs), model).collect()}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows.values())
    prints = {r["doc_id"]: r for r in fingerprint.with_next(H.frame(spark, docs)).collect()}
    assert prints[7001]["n_chars"] == len(docs[-2][1]) and prints[7001]["near_edited"] > prints[7001]["near_next"]


def test_near_duplicates_behind_an_unlike_hub(spark):
    """Thousands of texts share a head (unlike as wholes) and fill the bands' groups; the planted pairs have the largest ids."""
    rnd = random.Random(12)
    some = lambda n: "".join(rnd.choice("abcdefgh ijklmno") for _ in range(n))
    head = some(120)
    rows = [(k, head + some(80)) for k in range(3000)]
    for k in range(30):
        text = head + some(80)
        rows += [(10_000 + 2 * k, text), (10_001 + 2 * k, text[:190] + "x" + text[191:])]
    prints = dict(zip([d for d, _ in rows], fingerprint.fingerprints([t for _, t in rows])))
    alike = [d for d in range(10_000, 10_060, 2) if fingerprint.likeness(prints[d], prints[d + 1]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(H.frame(spark, rows)).collect()}
    assert len(alike) >= 25 and sum(got[d] == got[d + 1] for d in alike) >= len(alike) - 1
    assert len({got[k] for k in range(3000)}) > 2900


def test_forest_joins_what_all_pairs_join():
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh") for _ in range(150))
    texts = [base[:rnd.randint(60, 150)] + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    prints = fingerprint.fingerprints(texts)
    labels = np.array([k // 2 if k < 6 else k for k in range(len(texts))])

    def classes(links):
        root = labels.tolist()
        for a, b in links:
            root = [root[a] if x == root[b] else x for x in root]
        return {tuple(k for k in range(len(root)) if root[k] == r) for r in root}

    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if fingerprint.likeness(prints[a], prints[b]) >= 0.7]
    got = fingerprint._forest(prints, labels, 0.7)
    assert 5 < len(got) < len(texts) and classes(got) == classes(pairs)


def test_banding_grows_with_the_texts():
    assert fingerprint.banding(0, 0.8, 24, 12) == fingerprint.banding(4096, 0.8, 24, 12) == (24, 12)
    for count in (20_000, 200_000, 1_000_000, 1_000_000_000):
        bands, bits = fingerprint.banding(count, 0.8, 24, 12)
        assert count <= 2**bits and (1 - 0.9**bits) ** bands <= (1 - 0.9**12) ** 24 * 1.0001


def test_queries_digest(spark):
    """The registered digests are those of the operators' real outputs."""
    from service_insights.llm import queries

    row = queries.op2_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()["text"]
    own = ids_of(text)
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(own, skip_special_tokens=False).encode()).hexdigest()
