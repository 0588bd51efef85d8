"""Substring dedup by recompression.

Two rounds name, alike everywhere, first the runs of equal symbols and then pairs of neighbours (a left and a right one, told apart by a hash of the symbol), beginning with
words. Which pairs join depends on the symbols alone, so all occurrences of a window of words have the same symbols inside; only those near its borders depend
on what stands around. Each window is therefore represented by one interior pair of symbols, the longest; successive windows with the same one
make an occurrence of that symbol, with the words around it as its context.

Spark groups occurrences by symbol. One that is in a single document repeats nothing. One with the same context everywhere decides all its windows at once;
only where contexts differ are single windows compared. Both comparisons are on 128 bits of hash and need just the smallest
document of each group. What tasks know of other documents are two bitmaps of bounded size; a wrong hit costs a row, never a result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm import bitmap as bm
from glosswright.llm.words import CHUNK, NON_SPACE, Words, grams, mix, pieces, signed
from glosswright.session import ship, written

WINDOW = 13
ROUNDS = 2
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = (1 << 63) - 1


def recompress(symbols: np.ndarray, starts: np.ndarray, border: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the next symbols and the words at which they start. ``border`` tells at which words a text begins; symbols don't join over those."""
    if not len(symbols):
        return symbols, starts
    with np.errstate(over="ignore"):
        same = (symbols[1:] == symbols[:-1]) & ~border[starts[1:]]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        base, starts, length = symbols[first], starts[first], np.diff(np.append(first, len(symbols)))
        runs = np.where(length > 1, mix(base * _A + length.astype(np.uint64)), base)
        # Sides are of the repeated symbol, so that they don't depend on how long a run at a window's border is.
        right = mix(base + np.uint64(level) * _B) >> np.uint64(63) == 1
        joins = ~right[:-1] & right[1:] & ~border[starts[1:]]
        named = runs.copy()
        named[:-1][joins] = mix(runs[:-1][joins] * _B + mix(runs[1:][joins] + np.uint64(level)))
        kept = np.concatenate([[True], ~joins])
    return named[kept], starts[kept]


def occurrences(w: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``key, context, text, low, n`` of the symbol occurrences, and the two hashes of every window: windows ``low`` to ``low + n - 1`` share the symbol."""
    n = len(w.starts)
    first, second = grams(w.h, window, seed=3), grams(w.h, window, seed=5)
    of, place = w.of, w.place()
    p = np.flatnonzero(place + window <= w.counts[of]) if n else np.zeros(0, np.int64)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z, first, second
    border = np.zeros(n + 1, bool)
    border[w.first] = True
    symbols, starts = w.h, np.arange(n)
    low, high = p, p + window
    for level in range(1, ROUNDS + 1):
        symbols, starts = recompress(symbols, starts, border, level)
        bounds = np.append(starts, n)
        rank = np.zeros(n + 2, np.int64)
        rank[bounds + 1] = 1
        rank = np.cumsum(rank)  # bounds before each word
        low = np.where(low <= n, bounds[np.minimum(rank[np.minimum(low + 1, n + 1)], len(bounds) - 1)], n)
        high = bounds[np.maximum(rank[high] - 1, 0)]
    inside = (low < high) & (low > p) & (high < p + window)
    # Two neighbouring symbols are named together: one alone is often a few common words that many documents share by chance.
    begin, end = rank[low], rank[high] - 1
    length = np.diff(bounds).astype(np.uint64)
    length[:-1] += length[1:]
    with np.errstate(over="ignore"):
        symbols = mix(symbols * _A + np.append(symbols[1:], np.uint64(0)))
    inside &= begin < end
    weight = (np.minimum(length, np.uint64(255)) << np.uint64(56)) | (symbols >> np.uint64(8))
    best = np.where(inside, begin, 0)
    live = np.flatnonzero(inside)
    for step in range(1, window):
        live = live[begin[live] + step < end[live]]
        at = begin[live] + step
        better = weight[at] > weight[best[live]]
        best[live[better]] = at[better]
    # Windows without a sure symbol inside stand for themselves.
    chosen = np.where(inside, best, -1 - p)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(p) != 1)]))
    count = np.diff(np.append(new, len(p)))
    a, b = p[new], p[new] + count - 1
    with np.errstate(over="ignore"):
        key = np.where(inside[new], mix(symbols[np.where(inside, best, 0)[new]] ^ _A), mix(first[a] ^ _B))
        context = mix(mix(first[a] * _A + first[b]) * _B + second[a] + second[b] * _A + count.astype(np.uint64))
    return key, context, of[a], place[a], count, first, second


def _symbols(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column(1), False, NON_SPACE)
            key, context, of, *_ = occurrences(w, window)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(context)), batch.column(0).take(pa.array(of))], names=["key", "context", "id"])

    return run


def _compared(shared, split, bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The occurrences of symbols that several documents may have; those with several contexts, window by window."""
        for batch in pieces(batches):
            w = Words(batch.column(1), False, NON_SPACE)
            key, context, of, low, n, first, second = occurrences(w, window)
            singly, kept = bm.has(split.value, bits, key), bm.has(shared.value, bits, key)
            whole, part = kept & ~singly, np.flatnonzero(kept & singly)
            each = np.repeat(part, n[part])
            at = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            word = at + w.first[of[each]]
            row = np.concatenate([of[whole], of[each]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([key[whole], first[word]]))),
                    pa.array(signed(np.concatenate([context[whole], second[word]]))),
                    batch.column(0).take(pa.array(row)),
                    batch.column(2).take(pa.array(row)),
                    pa.array(np.concatenate([low[whole], at]).astype(np.int32)),
                    pa.array(np.concatenate([n[whole], np.ones(len(each), np.int64)]).astype(np.int32)),
                ],
                names=["k1", "k2", "id", "version", "low", "n"],
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress((t or "").encode(), 1) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2), batch.column(3)], names=["id", "packed", "version", "doc_id"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows with their texts, some ``CHUNK`` bytes of them at a time, or a single longer one."""
    for batch in batches:
        texts, held = [], 0
        for i, packed in enumerate(batch.column(1)):
            texts.append(zlib.decompress(packed.as_py()))
            held += len(texts[-1])
            if held >= CHUNK or i + 1 == batch.num_rows:
                yield batch.slice(i + 1 - len(texts), len(texts)), pa.array(texts, pa.large_binary()).view(pa.large_string())
                texts, held = [], 0


def joined(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, one space apart: the bytes of all texts, and where each begins."""
    k, before = np.flatnonzero(kept), np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[w.first]
    starts, ends = w.starts[k], w.ends[k]
    inner = np.zeros(len(w.buf) + 1, np.int8)
    inner[starts] += 1
    inner[ends] -= 1
    spaced = np.ones(len(k), bool)
    spaced[before[1:][before[1:] > before[:-1]] - 1] = False  # last of a text
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts + spaced)])
    out, letters = np.full(at[-1], 0x20, np.uint8), np.ones(at[-1], bool)
    letters[at[1:][spaced] - 1] = False
    out[letters] = w.buf[np.cumsum(inner[:-1], dtype=np.int8) > 0]
    return out, at[before]


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            w = Words(texts, False, NON_SPACE, hashes=False)
            lists = batch.column(2)
            spans, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            low, n = (spans.field(i).to_numpy() for i in range(2))
            change = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(change, w.first[of] + low, 1)
            np.add.at(change, w.first[of] + low + n + window - 1, -1)
            kept = np.cumsum(change[:-1]) == 0
            out, at = joined(w, kept)
            digest = [hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:])]
            removed = w.counts - np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[w.first])
            left = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digest, pa.string()), left], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller integer ``doc_id``. Null ids count as larger than all others and
    as equal; rows that share an id don't remove each other's words (texts of rows without an id are told apart by 64 bits, those of one id by 32). Null and empty texts have no words. ``kept`` holds the words left, one space apart. Other
    columns are ignored; an empty table gives an empty result. Whole texts are compared: a task holds some 200 bytes for each word of the longest.
    """
    spark = docs.sparkSession
    ship(spark)
    # `version` tells rows that share an id apart: by 64 bits those without an id, of which there may be any number, by 32 bits others, whose upper half of zeros isn't shuffled for long.
    text = F.coalesce("text", F.lit(""))
    version = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text", version.alias("version"), "doc_id")
    texts = rows.select("id", "text", "version")
    found = texts.mapInArrow(_symbols(window), "key bigint, context bigint, id bigint")
    found = found.groupBy("key").agg(F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("id").alias("i0"), F.max("id").alias("i1")).where("i0 < i1")
    found = written(found.select("key", (F.col("c0") != F.col("c1")).alias("split")), "symbols")
    bits = bm.bits_for(found.count())
    shared, split = (spark.sparkContext.broadcast(bm.bitmap(x, "key", bits)) for x in (found, found.where("split")))
    parts = texts.mapInArrow(_compared(shared, split, bits, window), "k1 bigint, k2 bigint, id bigint, version bigint, low int, n int")
    least = parts.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("k1", "k2", "least")
    spans = parts.join(least, ["k1", "k2"]).where("id > least").groupBy("id", "version").agg(F.collect_list(F.struct("low", "n")).alias("spans"))
    packed = T.StructType([T.StructField("id", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("version", T.LongType()), rows.schema["doc_id"]])
    joined = rows.mapInArrow(_pack, packed).join(spans, ["id", "version"], "left").select("doc_id", "packed", "spans")
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_words bigint, n_removed bigint, kept_sha256 string, kept string").fields])
    return joined.mapInArrow(_cut(window), schema)
