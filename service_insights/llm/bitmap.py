"""A Bloom bitmap of fixed size, to spare tasks rows that can't match. It decides nothing: a join follows."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def _place(key: Column, log_bits: int) -> tuple[Column, Column]:
    """Word and bit of a key: its top bits."""
    bit = F.shiftrightunsigned(key, 64 - log_bits)
    return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def _words(keys: DataFrame, key: Column, log_bits: int) -> DataFrame:
    word, one = _place(key, log_bits)
    return keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))


def kept(df: DataFrame, of: DataFrame, column: str, log_bits: int = 23) -> DataFrame:
    """Rows of ``df`` whose value may be among those of the same column of ``of``.

    The bitmap is broadcast, 2^log_bits / 64 rows of two numbers at most, so no row of ``df`` is shuffled.
    """
    words = F.broadcast(_words(of, F.xxhash64(column), log_bits).toDF("_word", "_bits"))
    word, one = _place(F.xxhash64(column), log_bits)
    return df.join(words, (word == F.col("_word")) & (F.col("_bits").bitwiseAND(one) != 0), "left_semi")


def build(keys: DataFrame, column: str, log_bits: int = 23) -> np.ndarray:
    """2^log_bits bits, one set by the top bits of each key (a random 64-bit number).

    At most 2^log_bits / 64 rows of two numbers come to the driver, whatever the keys.
    """
    words = _words(keys, F.col(column), log_bits).toArrow()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(_U)


def may(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where the key isn't among those the bitmap was built of."""
    bit = keys >> _U(64 - int(len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) > 0
