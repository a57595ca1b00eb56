"""Entries dealt out to tasks by hash bucket, many to a row, as flat arrays."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, ids binary, counts binary, keys binary, extra binary"


def pack(bucket: np.ndarray, row: np.ndarray, ids: np.ndarray, keys: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; within it the entries of a document follow one another."""
    order = np.argsort(bucket, kind="stable")
    bucket, row, keys, extra = bucket[order], row[order], keys[order], extra[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        first = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        cells = (int(bucket[a]), ids[row[a:b][first]].astype("<i8").tobytes(), np.diff(first, append=b - a).astype("<i4").tobytes(), keys[a:b].tobytes(), extra[a:b].tobytes())
        for column, cell in zip(out, cells):
            column.append(cell)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "ids", "counts", "keys", "extra"])


def unpack(table: pa.Table, key: str, extra: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def flat_of(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    return np.repeat(flat_of("ids", "<i8"), flat_of("counts", "<i4")), flat_of("keys", key), flat_of("extra", extra)


def answers(ids: np.ndarray, keys: np.ndarray) -> pa.Table:
    """Distinct (id, key), a row each."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    one = np.ones(len(ids), bool)
    one[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    return pa.table({"id": pa.array(ids[one], pa.int64()), "key": pa.array(keys[one].astype(np.uint64).view(np.int64))})
