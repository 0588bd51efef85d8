"""Word arithmetic inside a task: split the texts of an Arrow batch and name words and word sequences by 64-bit hashes.

Works on the UTF-8 bytes of a few megabytes of text at a time, so memory is bounded by the longest single text: about five bytes for each of its
bytes and 40 for each of its words.
Both word definitions used by the operators only separate on ASCII bytes, so cutting bytes cuts code points correctly.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this are hashed one by one.
_LONG = 256
#: Masks of the first 0 to 8 bytes of a little-endian word of memory.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)
#: Bytes of ``[^\x20\x09-\x0D]``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True



def ascii_lower(text: Column) -> Column:
    """``A`` to ``Z`` in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        more, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            h[more] = mix(h[more] * _BASE + (eight[starts[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


class Words:
    """The words of some texts: byte spans, hashes, and where each text's words begin.

    ``first[i]:first[i + 1]`` are the words of text ``i``; a null text has none.
    """

    def __init__(self, texts: pa.Array, lower: bool, letters: np.ndarray, hashes: bool = True):
        self.buf, self.offsets = text_bytes(texts)
        if lower:
            self.buf = LOWER[self.buf]
        is_word = letters[self.buf]
        n = len(self.buf)
        begin, end = is_word.copy(), is_word.copy()
        begin[1:] &= ~is_word[:-1]
        end[:-1] &= ~is_word[1:]
        cuts = np.unique(self.offsets)
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] = is_word[cuts]
        end[cuts - 1] = is_word[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        if hashes:
            self.h = span_hashes(self.buf, self.starts, self.ends)

    def stems(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of each word."""
        return span_hashes(self.buf, self.starts, np.minimum(self.ends, self.starts + n))

    @property
    def of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def place(self) -> np.ndarray:
        """The position of each word in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def text(self, i: int, j: int) -> str:
        """Words ``i`` to ``j - 1``, joined by single spaces."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j])).decode()


def grams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of all ``n`` successive words; callers leave out those that run over the end of a text."""
    n, seed = int(n), int(seed)
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(int(_STEP), k, 1 << 64))
    with np.errstate(over="ignore"):
        # The polynomial of n words from those of 1, 2, 4, ... words.
        part, size, g, taken = h ^ np.uint64(seed * 0x9E3779B1), 1, None, 0
        while True:
            if n & size:
                g = part if g is None else part[: len(g) - size] * power(taken) + g[size:]
                taken += size
            if taken == n:
                return mix(g + np.uint64(seed) * power(n))
            part = part[:-size] * power(size) + part[size:]
            size *= 2


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0] if len(at) else np.zeros(1, np.int64)


def give_back() -> None:
    """Workers live on from task to task, and what allocators keep of the largest piece adds up over an executor's workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``size`` bytes of text, or a single longer text. After each batch, and at the end, memory that is free goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, at = text_bytes(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        give_back()


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's bigint."""
    return x.view(np.int64)
