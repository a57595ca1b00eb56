"""Operator 4: token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id; each task writes one flat file
of unsigned ids (16 bits where the vocabulary fits, else 32) and one of document
ids and lengths. The totals of the parts, one row each, give every part's base by
a prefix sum; a second pass writes each part's offsets as unsigned 64-bit global
positions. Readers memory-map the files and take any document by its offsets.

A file is written under a name of the attempt's own and then moved, so that a
repeated or speculative task leaves the same bytes. Null texts are empty: they
hold the end id only. Null ids come first, and are kept as -2^63 in the files.
Rows with the same id keep an order given by their text. An empty table gives an
empty manifest.
"""
from __future__ import annotations

import itertools
import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer as LibraryTokenizer

from . import bpe, flat
from .common import partitions, saved, ship

NULL_ID = -(2**63)
#: Tokens that a reader hands over at a time.
READ_TOKENS = 1 << 20


class LibraryWords(bpe.Tokenizer):
    """Parts between blanks are remembered as in ``bpe``; the tokenizers library encodes every new one.

    No normal form, word or special token of the library reaches across an ASCII
    blank, so a text's ids are those of its parts in a row. Parts that the library's
    normal form leaves alone, before and after lower-casing, go to it as lower-cased
    words, many to a line; every other part as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        super().__init__(path)
        self.library = LibraryTokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends_word = np.array([str(x).endswith("</w>") for x in self.names])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in got], np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n.sum())), n

    def _encode_parts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        data = raw[flat.gather_ranges(starts, size)]
        first = np.cumsum(size) - size
        odd = np.logical_or.reduceat(data >= 0x80, first)
        if odd.any() and self._settled(data[np.repeat(odd, size)].tobytes().decode("utf-8")):
            odd[:] = False
        odd |= np.logical_or.reduceat(data == ord("<"), first)
        lengths, ids = np.zeros(len(size), np.int64), []
        for own, encode in ((np.flatnonzero(~odd), super()._encode_parts), (np.flatnonzero(odd), self._encode_as_they_stand)):
            if len(own):
                got, bounds = encode(raw, starts[own], ends[own])
                lengths[own] = np.diff(bounds)
                ids.append(got)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        at = np.zeros(len(size), np.int64)
        at[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(ids)[flat.gather_ranges(at, lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def _settled(self, text: str) -> bool:
        """The library's normal form changes nothing, neither now nor after lower-casing."""
        if "İ" in text or not unicodedata.is_normalized("NFC", text):
            return False
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return not self.unknown[cp].any() and unicodedata.is_normalized("NFC", self.low[cp].astype("<u4").tobytes().decode("utf-32-le"))

    def _encode_as_they_stand(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self._ids([raw[a:b].tobytes().decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())])
        return ids, np.concatenate([[0], np.cumsum(n)])

    def encode_words(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sixty-four words to a line, set apart by blanks; an id that ends a word closes it."""
        text = cp.astype("<u4").tobytes().decode("utf-32-le")
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        ids, _ = self._ids([" ".join(words[i:i + 64]) for i in range(0, len(words), 64)])
        last = np.flatnonzero(self.ends_word[ids])
        return (ids, np.diff(last, prepend=-1)) if len(last) == len(words) else self._ids(words)


_LOADED: dict[str, LibraryWords] = {}


def library_words(path: str) -> LibraryWords:
    if path not in _LOADED:
        _LOADED[path] = LibraryWords(path)
    return _LOADED[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def _put(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    own = f"{top}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(own, f"{top}/{name}")


def _file(folder: str, name: str):
    """Memory-mapped where the folder is local; else opened for reads at a place."""
    fs, top = _open(folder)
    path = f"{top}/{name}"
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def _read(f, dtype: str, start: int, count: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(f.read_at(count * size, start * size), dtype)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Writes the files below ``folder`` (a path or URI that all executors share).

    Returns the manifest, one row per part: part, width (bytes of an id), docs, tokens, base.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    text = F.coalesce(F.col(column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"), "text")

    def ids_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = library_words(path), TaskContext.get().partitionId()
        width = 2 if max(int(coder.size), end_id + 1) <= 1 << 16 else 4
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def chunks():
            for batch in flat.pieces(batches, "text"):
                ids, bounds = coder.encode_column(batch.column(1))
                n = np.diff(bounds)
                out = np.full(len(ids) + len(n), end_id, f"<u{width}")
                out[flat.gather_ranges(bounds[:-1] + np.arange(len(n)), n)] = ids
                seen.append((batch.column(0).fill_null(NULL_ID).to_numpy(), n + 1))
                yield out.tobytes()

        _put(folder, f"ids-{part:06d}.bin", chunks())
        if seen:
            doc, n = (np.concatenate(x) for x in zip(*seen))
            _put(folder, f"docs-{part:06d}.bin", iter([np.stack([doc, n]).astype("<i8").tobytes()]))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "width": pa.array([width], pa.int32()), "docs": [len(n)], "tokens": [int(n.sum())]})

    parts = saved(rows.mapInArrow(ids_file, "part int, width int, docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    based = parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))

    def offsets_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _file(folder, f"docs-{row['part']:06d}.bin") as f:
                    n = _read(f, "<i8", row["docs"], row["docs"])
                offsets = np.full(len(n) + 1, row["base"], np.uint64)
                offsets[1:] += np.cumsum(n).astype(np.uint64)
                _put(folder, f"offsets-{row['part']:06d}.bin", iter([offsets.astype("<u8").tobytes()]))
            yield batch

    return saved(based.repartition(n).mapInArrow(offsets_file, based.schema))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document from the mapped files: doc_id, start, n_tokens, ids_u32 (little-endian unsigned 32-bit ids)."""
    ship(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, width = f"{row['part']:06d}.bin", row["width"]
                with _file(folder, f"docs-{part}") as d, _file(folder, f"offsets-{part}") as o, _file(folder, f"ids-{part}") as i:
                    at = 0
                    while at < row["docs"]:
                        offsets = _read(o, "<u8", at, min(row["docs"] - at, 1 << 16) + 1)
                        take = max(1, int(np.searchsorted(offsets, offsets[0] + np.uint64(READ_TOKENS), "right")) - 1)
                        offsets = offsets[:take + 1]
                        doc = _read(d, "<i8", at, take)
                        ids = _read(i, f"<u{width}", int(offsets[0]) - row["base"], int(offsets[-1] - offsets[0])).astype("<u4")
                        local = (offsets - offsets[0]).astype(np.int32) * 4
                        data = pa.BinaryArray.from_buffers(pa.binary(), take, [None, pa.py_buffer(local.tobytes()), pa.py_buffer(ids.tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(offsets[:-1].astype(np.int64)), pa.array(np.diff(offsets).astype(np.int64)), data], names=["doc_id", "start", "n_tokens", "ids_u32"])
                        at += take

    return manifest.repartition(partitions(spark)).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_u32 binary")
