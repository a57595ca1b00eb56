"""Operator 12: SentencePiece (BPE) encoding and decoding by a table of each prefix's last token.

Merging takes, again and again, the adjacent pair whose joined piece scores best
(the leftmost of equals). What it does inside a stretch of text doesn't depend on
what lies outside as long as no merge crosses the stretch's ends. Hence tokens in a
row are the encoding of their text exactly if every two neighbours are, and the
encoding of a prefix is that of a shorter prefix and one last token, which is
unique. So one pass over the text suffices: at each place an automaton lists the
pieces that end there; the one that is compatible with the last token of the prefix
before it is the last token of this prefix. The ids are then read off backwards.

Two tokens are compatible if no merge crosses their seam. That is tested by
replaying both tokens' own merges, best score first, and looking at the pair of
symbols at the seam whenever it is the next one's turn. Pieces that merging their
own characters doesn't give can't occur and are left out.

Text is cut before where two adjacent characters occur side by side in no piece;
each distinct stretch is encoded once and remembered. A character that no piece
knows is its bytes. Null and empty texts give the begin and end ids only, and an
empty decoded text. Repeated rows are encoded alike; texts of any length take time
in proportion.

Models are taken whose text is normalised by nothing but the blank before it, and
whose pieces are of the normal, byte, control and unknown kind; others raise.
"""
from __future__ import annotations

import codecs
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flat
from .common import free_name, ship

BLANK = "▁"
#: No merge: later than every score.
NEVER = 1 << 30
#: A Python worker remembers 2^SLOT_BITS stretches at most, no more than CACHE_IDS ids, and PAIRS tested pairs.
SLOT_BITS, CACHE_IDS, PAIRS = 19, 3_000_000, 1_000_000

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Merges:
    """A model's pieces, and for each token the course of its own merges. Its size is that of the vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer, kinds = model.normalizer_spec, model.trainer_spec, pb.ModelProto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("the model normalises its text")
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback:
            raise ValueError("not a BPE model with bytes for unknown characters")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        self.begin, self.end, self.unknown = trainer.bos_id, trainer.eos_id, trainer.unk_id
        self.size = len(model.pieces)
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = np.zeros(256, np.int32)
        #: What an id stands for in decoded text; control ids stand for nothing.
        self.shown = [b""] * self.size
        for k, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = k
                self.shown[k] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.NORMAL:
                self.shown[k] = p.piece.replace(BLANK, " ").encode()
        self.shown[self.unknown] = trainer.unk_surface.encode()
        self.opens = np.array([p.type == kinds.NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        # Characters that only occur inside pieces are symbols too, with ids after the vocabulary's.
        bare = sorted({c for piece in normal for c in piece} - set(normal))
        self.text = {k: piece for piece, k in normal.items()} | {self.size + k: c for k, c in enumerate(bare)}
        ids = {piece: k for k, piece in self.text.items()}
        places = {s: k for k, s in enumerate(sorted({model.pieces[k].score for k in normal.values()}, reverse=True))}
        turn = {k: places[model.pieces[k].score] for k in normal.values()}
        #: Turn of the merge of two symbols, and what it makes.
        self.pair: dict[tuple[int, int], int] = {}
        makes: dict[tuple[int, int], int] = {}
        for piece, k in normal.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    self.pair[a, b], makes[a, b] = turn[k], k
        #: By token: turns of its merges in their order (then NEVER), and its first and last symbol before each of them and at last.
        self.course: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for k, piece in self.text.items():
            symbols, turns, left, right = [ids[c] for c in piece], [], [ids[piece[0]]], [ids[piece[-1]]]
            while len(symbols) > 1:
                now, at = min((self.pair.get(two, NEVER), i) for i, two in enumerate(zip(symbols, symbols[1:])))
                if now == NEVER:
                    break
                symbols[at:at + 2] = [makes[symbols[at], symbols[at + 1]]]
                turns.append(now)
                left.append(symbols[0])
                right.append(symbols[-1])
            if symbols == [k]:
                self.course[k] = ([*turns, NEVER], left, right)


class Coder:
    """Encodes and decodes with bounded memory of stretches and pairs."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.automaton = ahocorasick.Automaton()
        for k in merges.course:
            self.automaton.add_word(merges.text[k], (k, len(merges.text[k])))
        self.automaton.make_automaton()
        beside = sorted({c for k in merges.course for c in merges.text[k] if len(merges.text[k]) > 1})
        kind = {c: k for k, c in enumerate(beside, 1)}
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in beside]] = np.arange(1, len(beside) + 1)
        self.joins = np.zeros((len(beside) + 1,) * 2, bool)
        for k in merges.course:
            own = [kind[c] for c in merges.text[k]] if len(merges.text[k]) > 1 else []
            self.joins[own[:-1], own[1:]] = True
        self.random = flat.mix(np.arange(1, 0x110001, dtype=np.uint64) * flat._P)
        size = np.array([len(x) for x in merges.shown])
        self.shown, self.shown_size, self.shown_at = np.frombuffer(b"".join(merges.shown), np.uint8), size, np.cumsum(size) - size
        self.tested: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int64)
        self.len = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(0, np.int32)

    def compatible(self, a: int, b: int) -> bool:
        """No merge crosses the seam of the two tokens: both are replayed side by side, the better turn (of equals the left one) first."""
        (own, _, right), (others, left, _) = self.m.course[a], self.m.course[b]
        pair, i, j = self.m.pair, 0, 0
        while True:
            x, y, seam = own[i], others[j], pair.get((right[i], left[j]), NEVER)
            if seam < x and seam <= y:
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def encode_stretch(self, text: str) -> list[int]:
        last, tested = [-1] * len(text), self.tested
        for at, (token, size) in self.automaton.iter(text):
            if last[at] >= 0:
                continue
            if size <= at:
                two = last[at - size], token
                fits = tested.get(two)
                if fits is None:
                    if len(tested) >= PAIRS:
                        tested.clear()
                    fits = tested[two] = self.compatible(*two)
                if not fits:
                    continue
            last[at] = token
        out, at = [], len(text) - 1
        while at >= 0:
            token = last[at]
            if 0 <= token < self.m.size:
                out.append(token)
                at -= len(self.m.text[token])
            else:  # a character without an id of its own
                out += self.m.bytes[[*text[at].encode()]].tolist()[::-1]
                at -= 1
        return out[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (begin and end ids included) and the n + 1 bounds of the texts' ids."""
        texts = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(texts)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        first = np.ones(len(cp) + 1, bool)
        first[1:-1] = ~self.joins[kind[:-1], kind[1:]]
        first[rows] = True
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], len(cp))
        h = flat.range_hash(self.random[cp], starts, ends)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, lens = self.at[slot], self.len[slot].astype(np.int64)
        miss = np.flatnonzero(self.known[slot] != h)
        store = self.ids
        if len(miss):
            uniq, index, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = [self.encode_stretch(joined[a:b]) for a, b in zip(starts[miss[index]].tolist(), ends[miss[index]].tolist())]
            size = np.array([len(x) for x in new], np.int64)
            begin = np.cumsum(size) - size + len(store)
            at[miss], lens[miss] = begin[back], size[back]
            store = np.concatenate([store, np.array([x for own in new for x in own], np.int32)])
            if len(store) > CACHE_IDS:
                self._forget()
            else:
                to = slot[miss[index]]
                self.known[to], self.at[to], self.len[to], self.ids = uniq, begin, size, store
        total = np.concatenate([[0], np.cumsum(lens)])
        n = np.diff(total[np.searchsorted(starts, rows)])
        bounds = np.concatenate([[0], np.cumsum(n + 2)]).astype(np.int64)
        out = np.empty(int(bounds[-1]), np.int32)
        out[bounds[:-1]], out[bounds[1:] - 1] = self.m.begin, self.m.end
        out[flat.gather_ranges(bounds[:-1] + 1, n)] = store[flat.gather_ranges(at, lens)]
        return out, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of flat ids. The blank that opens a text goes; bytes that are no UTF-8 become U+FFFD, each one."""
        size = self.shown_size[ids]
        data = self.shown[flat.gather_ranges(self.shown_at[ids], size)]
        rows = np.concatenate([[0], np.cumsum(size)])[bounds]
        loud = np.flatnonzero(~self.m.silent[ids])
        at = np.searchsorted(loud, bounds)
        some = at[:-1] < at[1:]
        opens = np.zeros(len(bounds) - 1, bool)
        opens[some] = self.m.opens[ids[loud[at[:-1][some]]]]
        keep = np.ones(len(data), bool)
        keep[rows[:-1][opens]] = False
        data, rows = data[keep], rows - np.concatenate([[0], np.cumsum(opens)])
        raw = data.tobytes()
        heads = rows[:-1][rows[:-1] < len(data)]
        parted = self.m.silent[ids[1:-1]] & self.m.byte[ids[:-2]] & self.m.byte[ids[2:]]
        try:
            whole = not parted.any() and not ((data[heads] & 0xC0) == 0x80).any() and raw.decode("utf-8") is not None
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self._decode_runs(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())
        return pa.StringArray.from_buffers(len(rows) - 1, pa.py_buffer(rows.astype(np.int32).tobytes()), pa.py_buffer(raw))

    def _decode_runs(self, ids: np.ndarray) -> str:
        """One text; a control id ends a run of bytes."""
        runs = np.split(ids, np.flatnonzero(self.m.silent[ids]))
        out = "".join(b"".join(self.m.shown[i] for i in run.tolist()).decode("utf-8", "each_byte") for run in runs)
        loud = ids[~self.m.silent[ids]]
        return out[1:] if len(loud) and self.m.opens[loud[0]] else out


def encode_decode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids_u32", decoded: str = "decoded") -> DataFrame:
    """Appends ``ids_u32`` (binary: little-endian unsigned 32-bit ids, with begin and end) and ``decoded`` (string).

    Row-local: no shuffle; other columns pass unchanged. A name that the input
    has already gets underscores in front.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Merges(path))  # of the vocabulary's size
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, shared)
        for batch in flat.pieces(batches, column):
            got, bounds = coder.encode(batch.column(batch.schema.get_field_index(column)).to_pylist())
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(got.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, cells, coder.decode(got, bounds)], names=[*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)


_LOADED: dict[str, Coder] = {}


def _coder(path: str, shared) -> Coder:
    """One per Python worker and model."""
    if path not in _LOADED:
        _LOADED[path] = Coder(shared.value)
    return _LOADED[path]
