"""Operator 9: personal data by a linear-chain conditional random field.

Four kinds: email, ip, card, phone. The base rules give spans by fixed patterns
and checks. A conditional random field over word shapes adds what their
leftmost-longest matching misses, such as a card beside another number or a phone
without a country code. It is trained by its exact likelihood on a small labelled
table that ``labelled`` makes from a seed, and decoded by Viterbi in numpy
batches. Its sequences are the words of a text that hold a digit, @, (at) or [at],
with two words on either side; no span passes its kind's check without such a
word. An added span must pass that check and touch no base span.

Places are code points, ends exclusive. Null and empty texts have no spans.
Repeated rows are marked alike. Row-local: nothing is shuffled.
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat
from .common import free_name, ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Rows of the labelled table, steps of training, words on either side of a candidate.
ROWS, STEPS, SIDE = 500, 120, 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, in order of kind and start."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append((0, at, m.end()))
            last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def passes(kind: int, text: str) -> bool:
    """The check that an added span must pass."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text) is not None
    if kind == 1:
        return (m := _IP.fullmatch(text)) is not None and all(map(_part, m.groups()))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9\x20-]+", text) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9().\x20-]+", text) is not None


# -- words and features ------------------------------------------------------

_WORD = re.compile(r"\S+")
_HOT = re.compile(r"[0-9@]|\(at\)|\[at\]")
_RUNS = re.compile(r"[0-9]+|[A-Za-z\u0080-\U0010ffff]+|.", re.DOTALL)


def trimmed(word: str, start: int) -> tuple[str, int]:
    """Without the punctuation around it; a bracket stays if its partner does."""
    a, b, paired = 0, len(word), "(" in word and ")" in word
    while a < b and (word[a] in ".,;:!?\"'<>|*" or word[a] == "(" and not paired):
        a += 1
    while b > a and (word[b - 1] in ".,;:!?\"'<>|*" or word[b - 1] == ")" and not paired):
        b -= 1
    return word[a:b], start + a


@lru_cache(200_000)
def shape_features(word: str) -> tuple[str, ...]:
    """A word's shape (runs of digits with their length, letters, signs), coarse shape, and checks."""
    if len(word) > 64:
        return ("long",)
    runs = _RUNS.findall(word)
    fine = "".join(f"d{len(r)}" if r[0].isdigit() and r[0] < ":" else "a" if r[0].isalpha() else r for r in runs)
    coarse = re.sub(r"d[0-9]+", "d", fine)
    digits = _NOT_DIGIT.sub("", word)
    out = [f"f:{fine}", f"c:{coarse}", f"n:{len(digits)}"]
    if 16 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if coarse == "d.d.d.d":
        out.append(f"quad:{all(map(_part, word.split('.')))}")
    if "@" in word or "at)" in word or "at]" in word:
        out.append(f"mail:{passes(0, word)}")
    return tuple(out)


#: Neighbours that a word's features tell of, by their distance.
AROUND = {"p": -1, "q": -2, "s": 1, "t": 2}


def fours(words: list[str]) -> Iterator[int]:
    """Places of four groups of four that pass the card check."""
    short = [len(w) == 4 and w.isdecimal() and w.isascii() for w in words]
    for k in range(len(words) - 3):
        if short[k] and all(short[k:k + 4]) and luhn("".join(words[k:k + 4])):
            yield k


def features(words: list[str]) -> list[list[str]]:
    own = [shape_features(w) for w in words]
    out = []
    for k, x in enumerate(own):
        f = ["bias", *x]
        for name, step in AROUND.items():
            f += [f"{name}:{y}" for y in own[k + step][:2]] if 0 <= k + step < len(own) else [f"{name}:none"]
        out.append(f)
    for k in fours(words):
        for j in range(4):
            out[k + j].append(f"four:{j}")
    return out


# -- the labelled table ------------------------------------------------------

def labelled(rows: int = ROWS, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, labels): sentences of invented words around personal data and around what only looks like it."""
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choice(["ra", "mi", "to", "len", "as", "ver", "que", "on", "ti", "sch"]) for _ in range(rnd.randint(1, 4)))
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    some = lambda n: str(rnd.randint(1, 9)) + num(n - 1)

    def card(n: int, good: bool = True) -> str:
        while True:
            x = some(n)
            if luhn(x) == good:
                return x

    def quad(most: int) -> str:
        return ".".join(str(rnd.randint(0, most)) for _ in range(4))

    def site() -> str:
        return f"{name()}.{rnd.choice(['com', 'org', 'net', 'example', 'co.uk'])}"

    def four(x: str) -> list[str]:
        return [x[i:i + 4] for i in range(0, 16, 4)]

    finds = [
        (0, lambda: [f"{name()}{rnd.choice(['.', '_', '', '+'])}{name()}{rnd.choice(['', num(2)])}@{site()}"]),
        (0, lambda: [f"{name()}{rnd.choice(['(at)', '[at]'])}{site()}"]),
        (0, lambda: [name(), "@", site()]),
        (0, lambda: [name(), rnd.choice(["(at)", "[at]"]), site()]),
        (1, lambda: [quad(255)]),
        (2, lambda: [card(rnd.choice([16, 16, 16, 17, 18, 19]))]),
        (2, lambda: ["-".join(four(card(16)))]),
        (2, lambda: four(card(16))),
        (3, lambda: [f"+{some(rnd.randint(1, 2))}", f"({some(3)})", f"{some(3)}-{num(4)}"]),
        (3, lambda: [f"+{some(2)}", some(2), some(7)]),
        (3, lambda: [f"+{some(11)}"]),
        (3, lambda: [f"({some(3)})", f"{some(3)}-{num(4)}"]),
        (3, lambda: [f"{some(3)}{rnd.choice('-.')}{some(3)}-{num(4)}"]),
        (3, lambda: [f"{some(3)}.{some(3)}.{num(4)}"]),
    ]
    others = [
        lambda: [str(rnd.randint(1900, 2100))], lambda: [f"{some(2)}.{num(2)}"], lambda: [f"{some(1)},{num(3)}"],
        lambda: [f"{some(1)}.{num(1)}.{num(1)}"], lambda: [f"{rnd.randint(1990, 2030)}-{num(2)}-{num(2)}"],
        lambda: [f"{num(2)}:{num(2)}:{num(2)}"], lambda: [f"{name()}{num(3)}"], lambda: [card(16, False)],
        lambda: [".".join(str(rnd.randint(256, 999)) for _ in range(4))], lambda: [f"{some(2)}-{some(2)}"],
        lambda: [f"{some(3)}-{num(2)}"], lambda: [f"@{name()}"], lambda: [f"{name()}@{name()}"], lambda: [some(rnd.randint(1, 12))],
        lambda: [some(rnd.randint(20, 30))], lambda: [f"{some(2)}%"], lambda: [f"#{num(4)}"], lambda: [some(1), some(2), some(3)],
        lambda: four(card(16, False)), lambda: [f"{quad(255)}.{some(1)}"], lambda: [name(), "@", name()],
        lambda: [name(), rnd.choice(["(at)", "[at]"]), name()],
    ]
    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rnd.randint(1, 3)):
            for _ in range(rnd.choice([0, 1, 2, 3])):
                words.append(name())
                labels.append(0)
            if rnd.random() < 0.6:
                kind, make = rnd.choice(finds)
                new = make()
                words += new
                labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(new) - 1)
            else:
                new = rnd.choice(others)()
                words += new
                labels += [0] * len(new)
        for _ in range(rnd.choice([0, 1, 2])):
            words.append(name())
            labels.append(0)
        out.append((words, labels))
    return out


# -- the field ---------------------------------------------------------------

class Field:
    """Weights of features by label, of a label after another, and of the first label."""

    def __init__(self, names: dict[str, int], state: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.names, self.state, self.move, self.first = names, state, move, first

    def emissions(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (sequence, place, label) and the mask of places."""
        size = [len(s) for s in sequences]
        rows, ids = [], []
        width = max(size)
        for b, seq in enumerate(sequences):
            for t, fs in enumerate(seq):
                own = [self.names[f] for f in fs if f in self.names]
                ids += own
                rows += [b * width + t] * len(own)
        out = np.zeros((len(sequences) * width, len(LABELS)))
        np.add.at(out, rows, self.state[ids])
        return out.reshape(len(sequences), width, -1), np.arange(width) < np.array(size)[:, None]

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.state[[self.names[f] for f in names if f in self.names]].sum(0)

    def scores(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """What ``emissions`` gives for the words' features: each distinct word's part is summed up once, as itself and as a neighbour."""
        known: dict[str, int] = {}
        ids = [known.setdefault(w, len(known)) for words in sequences for w in words]
        parts = {name: np.zeros((len(known) + 1, len(LABELS))) for name in ("", *AROUND)}
        for word, k in known.items():
            own = shape_features(word)
            parts[""][k] = self._sum(["bias", *own])
            for name in AROUND:
                parts[name][k] = self._sum([f"{name}:{y}" for y in own[:2]])
        for name in AROUND:
            parts[name][-1] = self._sum([f"{name}:none"])
        size = np.array([len(words) for words in sequences])
        width = int(size.max())
        mask = np.arange(width) < size[:, None]
        place = np.full((len(sequences), width + 4), len(known))  # two places without a word on either side
        place[:, 2:-2][mask] = ids
        out = parts[""][place[:, 2:-2]]
        for name, step in AROUND.items():
            out += parts[name][place[:, 2 + step:width + 2 + step]]
        for j in range(4):
            four = self._sum([f"four:{j}"])
            for b, words in enumerate(sequences):
                for k in fours(words):
                    out[b, k + j] += four
        out[~mask] = 0
        return out, mask

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The best paths of sequences of features."""
        return self.paths(*self.emissions(sequences))

    def paths(self, e: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """Viterbi over all sequences at once (of like length, as ``spans`` deals them)."""
        n, width, _ = e.shape
        best, back = self.first + e[:, 0], np.zeros((n, width, len(LABELS)), np.int8)
        for t in range(1, width):
            cand = best[:, :, None] + self.move
            back[:, t] = cand.argmax(1)
            best = np.where(mask[:, t, None], cand.max(1) + e[:, t], best)
        label = best.argmax(1)
        path = np.zeros((n, width), np.int64)
        for t in range(width - 1, -1, -1):
            path[:, t] = label
            if t:
                label = np.where(mask[:, t], back[np.arange(n), t, label], label)
        return [p[:m] for p, m in zip(path, mask.sum(1))]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@lru_cache(1)
def trained(rows: int = ROWS, steps: int = STEPS, penalty: float = 0.002) -> Field:
    """Maximum likelihood by Adam with exact gradients from forward and backward sums."""
    table = labelled(rows)
    seqs = [features(words) for words, _ in table]
    names: dict[str, int] = {}
    for seq in seqs:
        for fs in seq:
            for f in fs:
                names.setdefault(f, len(names))
    k, n, width = len(LABELS), len(seqs), max(map(len, seqs))
    mask = np.arange(width) < np.array([len(s) for s in seqs])[:, None]
    gold = np.zeros((n, width), np.int64)
    place, ids = [], []
    for b, seq in enumerate(seqs):
        gold[b, :len(seq)] = table[b][1]
        for t, fs in enumerate(seq):
            ids += [names[f] for f in fs]
            place += [b * width + t] * len(fs)
    place, ids = np.array(place), np.array(ids)
    order = np.argsort(ids, kind="stable")
    by_feature, cuts = place[order], np.searchsorted(ids[order], np.arange(len(names)))
    heads = np.searchsorted(place, np.arange(n * width))
    used = np.flatnonzero(np.diff(heads, append=len(place)) > 0)
    barred = np.zeros((k, k))
    start_barred = np.zeros(k)
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            barred[[i for i, x in enumerate(LABELS) if x[2:] != name[2:]], j] = -1e4
            start_barred[j] = -1e4
    weights = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    hot = np.eye(k)[gold] * mask[..., None]
    pairs = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    for step in range(1, steps + 1):
        state, move, first = weights[0], weights[1] + barred, weights[2] + start_barred
        e = np.zeros((n * width, k))
        e[used] = np.add.reduceat(state[ids], heads[used])
        e = e.reshape(n, width, k)
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + move, 1) + e[:, t], alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        edge = np.zeros((k, k))
        for t in range(width - 1):
            x = np.exp(alpha[:, t, :, None] + move + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None])
            edge += (x * mask[:, t + 1, None, None]).sum(0)
        gap = (hot - node).reshape(n * width, k)
        grads = [np.add.reduceat(gap[by_feature], cuts) / n, (pairs - edge) / n, (hot[:, 0] - node[:, 0]).sum(0) / n]
        for i, g in enumerate(grads):
            g = g - penalty * weights[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            weights[i] = weights[i] + 0.1 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Field(names, weights[0], weights[1] + barred, weights[2] + start_barred)


def _segments(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Words with a digit, @, (at) or [at] and their neighbours, as runs of (words, starts)."""
    at, end, hot = 0, len(text), _HOT.search(text)
    while hot:
        a = hot.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        words = []
        left = a
        for _ in range(SIDE):  # words before
            b = left
            while b > at and text[b - 1].isspace():
                b -= 1
            c = b
            while c > at and b - c < 80 and not text[c - 1].isspace():
                c -= 1
            if c == b:
                break
            words.insert(0, trimmed(text[c:b], c))
            left = c
        since = 0
        for m in _WORD.finditer(text, a):
            warm = _HOT.search(text, m.start(), m.end()) is not None
            since = 0 if warm else since + 1
            words.append(trimmed(m.group(), m.start()))
            at = m.end()
            if since == SIDE:
                break
        else:
            at = end
        words = [w for w in words if w[0]]
        if words:
            yield [w for w, _ in words], [s for _, s in words]
        hot = _HOT.search(text, at)


def _hot_bytes(raw: np.ndarray) -> np.ndarray:
    """Bytes at which _HOT matches."""
    out = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    if len(raw) > 3:
        at = (raw[1:-2] == ord("a")) & (raw[2:-1] == ord("t"))
        out[:-3] |= at & (((raw[:-3] == ord("(")) & (raw[3:] == ord(")"))) | ((raw[:-3] == ord("[")) & (raw[3:] == ord("]"))))
    return out


def spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, base) of each text, in order of kind and start."""
    base = [base_spans(t) for t in texts]
    owner, words, starts = [], [], []
    for k, text in enumerate(texts):
        for w, s in _segments(text):
            owner.append(k)
            words.append(w)
            starts.append(s)
    added: dict[int, list[tuple[int, int, int]]] = {}
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    while order:
        longest = max(2 * len(words[order[0]]), 16)
        cut = next((i for i, j in enumerate(order) if len(words[j]) > longest), len(order))
        part, order = order[:cut], order[cut:]
        for i, path in zip(part, field.paths(*field.scores([words[j] for j in part]))):
            t = 0
            while t < len(path):
                if path[t] and path[t] % 2:
                    to = t + 1
                    while to < len(path) and path[to] == path[t] + 1:
                        to += 1
                    a, b = starts[i][t], starts[i][to - 1] + len(words[i][to - 1])
                    kind = int(path[t]) // 2
                    if passes(kind, texts[owner[i]][a:b]):
                        added.setdefault(owner[i], []).append((kind, a, b))
                    t = to
                else:
                    t += 1
    out = []
    for k, own in enumerate(base):
        all_ = [(*s, True) for s in own]
        if new := added.get(k):
            taken = sorted((a, b) for _, a, b in own)
            ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
            heads = [a for a, _ in taken]
            for kind, a, b in new:
                before = int(np.searchsorted(heads, b))
                if not before or ends[before - 1] <= a:
                    all_.append((kind, a, b, False))
        out.append(sorted(all_))
    return out


def find(docs: DataFrame, column: str = "text") -> DataFrame:
    """Appends ``pii``: array of (kind, start, end, base), ordered by kind as in KINDS, then start."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trained())  # some thousand weights
    name = free_name(docs, "pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in flat.pieces(batches, column):
            col = batch.column(batch.schema.get_field_index(column))
            raw, rows = flat.flat_bytes(col)
            sign = np.concatenate([[0], np.cumsum(_hot_bytes(raw))])
            own = np.flatnonzero(np.diff(sign[rows]))
            got: list[list[dict]] = [[] for _ in range(len(col))]
            for k, s in zip(own.tolist(), spans(col.take(pa.array(own)).to_pylist(), field)):
                got[k] = [{"kind": KINDS[x], "start": a, "end": b, "base": base} for x, a, b, base in s]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, name])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(item))]))
