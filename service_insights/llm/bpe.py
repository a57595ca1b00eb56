"""Operator 2: byte-level BPE with word ends, encoded in batched numpy merge rounds.

A slab of texts is split into words on one flat array of code points. Each
distinct word is encoded once: the symbols of all such words lie in one flat
array, every adjacent pair gets its merge rank by binary search over the sorted
pair keys, and a round merges, in every word at once, the pair of the word's
lowest rank. Ids are then gathered back in text order. Decoding joins the ids'
vocabulary entries by a space, as the library does for a file without decoder.

Null and empty texts give no ids and an empty decoded text. Repeated rows are
encoded alike. The text of special tokens is read as their id.
"""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library

from . import flat
from .common import free_name, held, ship

_NONE = np.int32(np.iinfo(np.int32).max)
#: A Python worker remembers 2^SLOT_BITS parts of text at most, and no more than CACHE_IDS ids.
SLOT_BITS, CACHE_IDS = 19, 3_000_000


#: White space of Unicode, as the split pattern's \\s takes it.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _unicode_tables(library: Library) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class (0 blank, 1 letter, 2 number, 3 other), lower case, random word, and whether Python's Unicode lacks it.

    The library's Unicode may be newer than Python's. Of the characters that
    Python doesn't know, those that might be letters or numbers are put to the
    library's own pre-tokenizer.
    """
    category = np.fromiter((int.from_bytes(unicodedata.category(chr(c)).encode()) for c in range(0x110000)), np.uint16, 0x110000)
    first, unknown = category >> 8, category == int.from_bytes(b"Cn")
    kind = np.full(0x110000, 3, np.uint8)
    kind[first == ord("L")], kind[first == ord("N")], kind[_SPACES] = 1, 2, 0
    for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, np.flatnonzero(unknown).tolist()))):
        if len(library.pre_tokenizer.pre_tokenize_str("a" + c)) == 1:
            kind[ord(c)] = 1
        elif len(library.pre_tokenizer.pre_tokenize_str(":" + c)) == 2:
            kind[ord(c)] = 2
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(np.isin(first, [ord(c) for c in "LNS"])).tolist():
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return kind, low, flat.mix(np.arange(1, 0x110001, dtype=np.uint64) * flat._P), unknown


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Vocabulary, sorted pair keys and a bounded cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = np.full(size, "", object)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = np.int64(size)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        if (np.diff(self.keys) == 0).any():
            raise ValueError("a pair is listed twice")
        born = np.full(size, -1, np.int64)
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol that a later merge makes; rounds would not be exact")
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        library = Library.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.kind, self.low, self.random, self.unknown = _unicode_tables(library)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int64)
        self.len = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(0, np.int32)

    # -- words ---------------------------------------------------------------

    def _words(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased code points, starts and ends of words, and bounds of words by text.

        ``joined`` holds texts of ``sizes`` characters in normal form C, without the letter İ (its lower case has two characters).
        """
        rows = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=rows[1:])
        cp = self.low[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        n = len(cp)
        kind = np.zeros(n + 3, np.uint8)
        kind[:n] = self.kind[cp]
        edge = np.zeros(n + 4, bool)
        edge[rows] = True
        start = np.zeros(n + 3, bool)
        start[:n] = (kind[:n] != 0) & (edge[:n] | (kind[:n] == 2))
        start[1:n] |= (kind[1:n] != 0) & (kind[1:n] != kind[:n - 1])
        marks = np.flatnonzero((cp == 39) & start[:n])
        if len(marks):
            own = np.concatenate([cp, np.zeros(3, cp.dtype)])
            one = np.where(edge[marks + 1], 0, own[marks + 1])
            two = np.where((one == 0) | edge[marks + 2], 0, own[marks + 2])
            short = marks[np.isin(one, [ord(c) for c in "stmd"])]
            long = marks[((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))]
            for at, length in ((short, 2), (long, 3)):
                start[at + 1] = False
                start[at + length] = (kind[at + length] != 0)
        stop = np.ones(n + 1, bool)
        stop[:n] = start[:n] | (kind[:n] == 0) | edge[:n]
        starts = np.flatnonzero(start[:n])
        ends = np.flatnonzero(stop[1:] & (kind[:n] != 0)) + 1
        return cp, starts, ends, np.searchsorted(starts, rows)

    # -- merge rounds --------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, by binary search."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words given as flat symbols; returns flat ids and their numbers by word."""
        words = len(lengths)
        word, lens = np.arange(words), lengths.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sym = symbols.copy()
        first = np.cumsum(lens) - lens
        rank = np.full(len(sym), _NONE)
        inner = np.ones(len(sym), bool)
        inner[first + lens - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self._rank(sym[at], sym[at + 1])
        while len(word):
            low = np.minimum.reduceat(rank, first)
            ended = low == _NONE
            if ended.any():
                out = np.repeat(ended, lens)
                done.append((word[ended], lens[ended], sym[out]))
                sym, rank = sym[~out], rank[~out]
                word, lens, low = word[~ended], lens[~ended], low[~ended]
                if not len(word):
                    break
                first = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(word)), lens)
            hit = np.flatnonzero(rank == low[owner])
            fresh = np.ones(len(hit), bool)
            fresh[1:] = np.diff(hit) > 1
            if not fresh.all():  # aaa: the pair starts at every other symbol
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            lens = lens - np.bincount(owner[hit], minlength=len(word))
            new = np.cumsum(keep) - 1
            sym, rank = sym[keep], rank[keep]
            first = np.cumsum(lens) - lens
            final = np.zeros(len(sym), bool)
            final[first + lens - 1] = True
            head = np.zeros(len(sym), bool)
            head[first] = True
            here = new[hit]
            changed = np.zeros(len(sym), bool)
            changed[here] = True
            changed[here[~head[here]] - 1] = True
            touched = np.flatnonzero(changed)
            open_ = touched[~final[touched]]
            rank[touched] = _NONE
            rank[open_] = self._rank(sym[open_], sym[open_ + 1])
        ids_by = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        n_by = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int32)
        start = np.cumsum(n_by) - n_by
        order = np.argsort(ids_by, kind="stable")
        return ids[flat.gather_ranges(start[order], n_by[order])], n_by[order]

    def encode_words(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words (each taken as a new one)."""
        n_cp = ends - starts
        own = cp[flat.gather_ranges(starts, n_cp)]
        data = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        width = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        lens = np.add.reduceat(width, np.cumsum(n_cp) - n_cp)
        sym = self.first[data]
        tail = np.cumsum(lens) - 1
        sym[tail] = self.last[data[tail]]
        return self.merge(sym, lens)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the n + 1 bounds of the texts' ids."""
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of a string column (null: empty).

        Parts between blanks are looked up in a table of remembered parts first;
        no normal form, word or special token reaches across an ASCII blank.
        """
        parts = flat.Words(col, flat.PLAIN)
        if not parts.n:
            return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64)
        h = parts.hashes()
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, lens = self.at[slot], self.len[slot]
        miss = np.flatnonzero(self.known[slot] != h)
        store = self.ids
        if len(miss):
            uniq, index, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[index]
            ids, bounds = self._encode_parts(parts.raw, parts.starts[first], parts.ends[first])
            begin = bounds[:-1] + len(store)
            at[miss], lens[miss] = begin[back], np.diff(bounds)[back]
            store = np.concatenate([store, ids])
            if len(store) > CACHE_IDS:
                self._forget()
            else:
                to = slot[first]
                self.known[to], self.at[to], self.len[to], self.ids = uniq, begin, np.diff(bounds), store
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        return store[flat.gather_ranges(at, lens)], total[parts.bounds]

    def _encode_parts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of UTF-8 text, and their bounds."""
        size = ends - starts
        data = raw[flat.gather_ranges(starts, size)]
        joined = data.tobytes().decode("utf-8")
        chars = np.add.reduceat((data & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        odd = "<|" in joined
        if not joined.isascii() and not odd:
            odd = "İ" in joined or not unicodedata.is_normalized("NFC", joined) or self.unknown[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].any()
        if odd:
            cut = np.concatenate([[0], np.cumsum(chars)])
            return self._encode_odd([joined[a:b] for a, b in zip(cut[:-1], cut[1:])])
        return self._encode_plain(joined, chars)

    def _encode_plain(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
        cp, starts, ends, rows = self._words(joined, sizes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
        h = flat.range_hash(self.random[cp], starts, ends)
        _, index, back = np.unique(h, return_index=True, return_inverse=True)
        ids, lens = self.encode_words(cp, starts[index], ends[index])
        at = (np.cumsum(lens) - lens)[back]
        lens = lens[back]
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        return ids[flat.gather_ranges(at, lens)], total[rows]

    def _encode_odd(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may hold special tokens or that Python can't bring to normal form alone; what lies between special tokens stands for itself."""
        pieces = [self.split.split(t) for t in texts]
        clean = [self.normalize(p) if not k % 2 else "" for x in pieces for k, p in enumerate(x)]
        ids, rows = self._encode_plain("".join(clean), np.array([len(c) for c in clean], np.int64))
        out, bounds, at = [np.zeros(0, np.int32)], [0], 0
        for x in pieces:
            n = 0
            for k, p in enumerate(x):
                out.append(np.array([self.special[p]], np.int32) if k % 2 else ids[rows[at]:rows[at + 1]])
                n += len(out[-1])
                at += 1
            bounds.append(bounds[-1] + n)
        return np.concatenate(out), np.array(bounds, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


def tokenizer(path: str) -> Tokenizer:
    """Kept by the Python worker until another operator's large object is used."""
    return held(("bpe", path), lambda: Tokenizer(path))


def encode_decode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Appends ``ids`` (array<int>) and ``decoded`` (string). Row-local: no shuffle; other columns pass unchanged.

    A name that the input has already gets underscores in front.
    """
    ship(docs.sparkSession)
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in flat.pieces(batches, column):
            got, rows = coder.encode_column(batch.column(batch.schema.get_field_index(column)))
            back = pa.array([coder.decode(got[a:b]) for a, b in zip(rows[:-1], rows[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, flat.list_array(got, rows, pa.int32()), back], names=[*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)
