"""Indel similarity, 200 * common / (length + length): of sorted characters in closed form, of sequences and best windows by an Arrow UDF."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.functions.text import let

ALIGNMENT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])


def sorted_similarity(a: Column, b: Column) -> Column:
    """Similarity of the sorted characters: their common subsequence is the multiset intersection. 100 for two empty texts."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    # A character beyond the basic plane is one code point for length() too.
    common = let(a, lambda x: let(b, lambda y: F.aggregate(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")), F.lit(0), lambda n, c: n + F.least(count(x, c), count(y, c)))))
    return F.when(F.length(a) + F.length(b) == 0, 100.0).otherwise(200.0 * common / (F.length(a) + F.length(b)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one word of bits a character of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    v = all_
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & all_
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def _columns(texts: list[str], size: int, pad: int) -> np.ndarray:
    """Code points, a column for each text."""
    out = np.full((size, len(texts)), pad, np.uint32)
    for i, x in enumerate(texts):
        out[: len(x), i] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _combed(shorts: list[str], longs: list[str]) -> np.ndarray:
    """For each pair where the strand that leaves the comparison grid under each character of the long text has entered it: above a character, or (less than 0) at the side.

    Strands run through the grid of both texts from its upper and left to its lower and right side. Two that meet bounce off where the characters are equal and else cross
    once, unless they have crossed before. A part of the long text has as many characters in common with the short one as strands leave under it that have not entered above it:
    one pass answers for all parts. Cells of one diagonal don't depend on each other, nor do pairs, so they are stepped together. Padding crosses nothing.
    """
    m, n = max(map(len, shorts)), max(map(len, longs))
    both, codes = np.unique(np.concatenate([_columns(shorts, m, 0xFFFFFFFF), _columns(longs, n, 0xFFFFFFFE)[::-1]]), return_inverse=True)
    codes = codes.reshape(m + n, -1).astype(np.uint8 if len(both) < 256 else np.uint16 if len(both) < 65536 else np.uint32)
    a, b = codes[:m], codes[m:]
    kind = np.int16 if max(m, n) < 1 << 15 else np.int32
    side = np.repeat(-1 - np.arange(m, dtype=kind)[:, None], a.shape[1], 1)
    above = np.repeat(np.arange(n - 1, -1, -1, dtype=kind)[:, None], a.shape[1], 1)
    for d in range(m + n - 1):
        i, j, at = max(0, d - n + 1), min(m, d + 1), n - 1 - d
        x, y = side[i:j], above[at + i : at + j]
        equal = a[i:j] == b[at + i : at + j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.copyto(high, x, where=equal)
        np.copyto(low, y, where=equal)
        side[i:j], above[at + i : at + j] = low, high
    return above[::-1]


def _best(entered: np.ndarray, m: int, n: int) -> tuple[float, int, int]:
    """The window of the best score by the strands under a long text of ``n`` characters; of equals the first start, then the longer."""
    k, entered = np.arange(n), entered[:n].astype(np.int64)

    def covering(first: np.ndarray) -> np.ndarray:
        """How many of the ranges from ``first`` to ``k`` hold each place."""
        steps = np.bincount(first, minlength=n + 1) - np.bincount(k + 1, minlength=n + 1)
        return np.cumsum(steps)[:n]

    after = np.minimum(np.maximum(entered + 1, 0), k + 1)
    inner = covering(np.maximum(after, np.maximum(k - m + 1, 0)))[: n - m + 1]
    ending = covering(after)[n - m + 1 :]
    beginning = np.cumsum(entered < 0)[: m - 1]
    start = np.concatenate([np.zeros(m - 1, np.int64), np.arange(n)])
    end = np.concatenate([np.arange(1, m), np.arange(m, n + 1), np.full(m - 1, n)])
    score = 200 * np.concatenate([beginning, inner, ending]) / (m + end - start)
    best = np.flatnonzero(score == score.max())
    best = best[start[best] == start[best].min()]
    i = best[end[best].argmax()]
    return float(score[i]), int(start[i]), int(end[i])


#: Pairs are stepped together while they have at most so many characters.
TOGETHER = 1 << 20


def best_windows(pairs: list[tuple[str, str]]) -> list[tuple[float, int, int]]:
    """Of each pair of texts, the first not empty and not longer, the part of the second most similar to the first: windows of its length, and shorter ones at both ends.

    Pairs of about the same lengths are compared together, in time of the product of their lengths and memory of the sum.
    """
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (short, long) in enumerate(pairs):
        alike.setdefault((len(short).bit_length() * 4 + (len(short) << 3 >> len(short).bit_length()), len(long).bit_length() * 4 + (len(long) << 3 >> len(long).bit_length())), []).append(i)
    out: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(pairs)
    for group in alike.values():
        size = max(1, TOGETHER // max(len(pairs[i][0]) + len(pairs[i][1]) for i in group))
        for at in range(0, len(group), size):
            part = group[at : at + size]
            entered = _combed([pairs[i][0] for i in part], [pairs[i][1] for i in part])
            for column, i in enumerate(part):
                out[i] = _best(entered[:, column], len(pairs[i][0]), len(pairs[i][1]))
    return out


def _rescued(anchor: str, caption: str, start: int, end: int) -> tuple[int, int]:
    """The window, or that as long as the anchor around it whose characters are most like the anchor's, if they are more like; counts roll from shift to shift."""
    missing, n = len(anchor) - (end - start), len(caption)
    want, have, common = Counter(anchor), Counter(), 0
    most = 200 * sum((want & Counter(caption[start:end])).values()) / (len(anchor) + end - start)
    chosen, s, e = (start, end), start, start
    for before in range(missing + 1):
        to = max(0, start - before), min(n, end + missing - before)
        while s > to[0]:
            s -= 1
            common += have[caption[s]] < want[caption[s]]
            have[caption[s]] += 1
        while e < to[1]:
            common += have[caption[e]] < want[caption[e]]
            have[caption[e]] += 1
            e += 1
        while e > to[1]:
            e -= 1
            have[caption[e]] -= 1
            common -= have[caption[e]] < want[caption[e]]
        if (now := 200 * common / (len(anchor) + e - s)) > most:
            most, chosen = now, (s, e)
    return chosen


Alignment = tuple[float | None, int | None, int | None, str | None]


def align_all(rows: list[tuple[str | None, str | None, str | None]]) -> list[Alignment]:
    """``score, start, end, label`` of each anchor, normalised caption and original caption: the caption's window for the anchor, and its text taken from the original, widened
    where letters at its borders are variants.

    The score is that before widening, to one decimal. Anchor or original empty: no label, score 0. Normalised and original caption of different lengths: nulls.
    """
    out: list[Alignment] = [(0.0, 0, 0, "")] * len(rows)
    pairs: list[tuple[str, str]] = []
    open_ = []
    for i, (anchor, caption, original) in enumerate(rows):
        if not anchor or not original:
            continue
        if caption is None or len(caption) != len(original):
            out[i] = (None,) * 4
            continue
        open_.append((i, len(pairs)))
        pairs.append((anchor, caption) if len(anchor) <= len(caption) else (caption, anchor))
        if len(anchor) == len(caption):
            pairs.append((caption, anchor))
    found = best_windows(pairs)
    for i, at in open_:
        anchor, caption, original = rows[i]
        score, start, end = found[at]
        if len(anchor) > len(caption):
            start, end = 0, len(caption)
        elif len(anchor) == len(caption) and found[at + 1][0] > score:
            score, start, end = found[at + 1][0], 0, len(caption)
        chosen = _rescued(anchor, caption, start, end) if end - start < min(len(anchor), len(caption)) else (start, end)
        out[i] = (round(score, 1), start, end, original[chosen[0] : chosen[1]])
    return out


@F.pandas_udf(ALIGNMENT)
def aligned(anchor: pd.Series, caption: pd.Series, original: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(align_all(list(zip(anchor, caption, original))), columns=["score", "start", "end", "label"]).astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
