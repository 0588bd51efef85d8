"""Membership bitmaps of 64-bit hashes, of a size fixed by parameters and so safe to broadcast."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.session import ship

#: At most 2 ** 26 bits, 8 MB, whatever the input; with more members than bits more non-members pass, never fewer members.
MOST_BITS = 26


def bits_for(n: int) -> int:
    """log2 of the bits for ``n`` members: sixteen a member, up to the bound."""
    return int(min(MOST_BITS, max(16, np.ceil(np.log2(max(1, n) * 16)))))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Set bit ``hash >>> (64 - bits)`` of each hash. Only the at most 2 ** (bits - 6) distinct 64-bit cells reach the driver."""
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    cells = (
        hashes.select(F.shiftrightunsigned(at, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 AS int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("word"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[cells.column("cell").to_numpy()] = cells.column("word").to_numpy().view(np.uint64)
    return words


def has(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be members."""
    at = hashes >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def may_be_in(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test whether a row's 64-bit hash may be among those in ``column`` of ``members`` (a written table). What can't be needs no join, and so isn't shuffled, whatever its size."""
    ship(members.sparkSession)
    bits = bits_for(members.count())
    sent = members.sparkSession.sparkContext.broadcast(bitmap(members, column, bits))

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(has(sent.value, bits, hashes.to_numpy().astype(np.int64).view(np.uint64)))

    return test


def without(docs: DataFrame, key: Callable[[DataFrame], Column], bad: DataFrame, column: str) -> DataFrame:
    """The rows whose ``key`` isn't in ``column`` of ``bad`` (a written table). Only rows that may be in it are joined; all columns pass, whatever their names."""
    may = may_be_in(bad.select(F.xxhash64(column).alias("hash")), "hash")(F.xxhash64(key(docs)))
    return docs.where(~may).unionByName(docs.where(may).join(bad, key(docs) == bad[column], "left_anti"))
