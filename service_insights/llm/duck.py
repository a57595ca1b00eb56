"""Pieces of DuckDB SQL: unsigned crc32 of text, which DuckDB has no function for."""
from __future__ import annotations

#: A CTE of one row: the list ``t`` of the 256 steps.
CRC_TABLE = "crc_table as materialized (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from range(256) r(i))"


def crc(text: str) -> str:
    """crc32 of a text expression of code points below U+0800, where ``t`` of ``crc_table`` is in scope."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x)::bigint >> 6), 128 + (unicode(x)::bigint & 63)] end))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
