"""N-gram Jaccard join: size-aware, heavy-light.

A document's set is its distinct word shingles; equal sets are one node, named by a hash of the set, so copies cost nothing. Two sets that are similar enough share
tokens among the first of each in any common order of all tokens; here the order is rarity (a counting sketch of fixed size over all documents), then
hash. Sets up to a boundary are light: they list all subsets of a fixed size of a prefix long enough to hold that many shared tokens, and meet other light
sets in a subset. Larger sets are heavy: they are found by scanning the inverted lists of the single tokens of a shorter prefix, which light sets near the
boundary also enter. Boundary and subset size are those of least cost, which is the sum of the squared lengths of all lists as sketched over the small texts.

Keys are shuffled once; lists of frequent tokens are dealt out over several parts, which meet in a list of their least members. Lists are not expanded into all
pairs. First every member is compared with the least member of its list, then, where a list still has several components of the links found, with the member of the
fullest lists. Lists that still have several components are cut into blocks, and pairs of blocks are compared by parity bitmaps in arrays: of sizes s and
t, similar enough sets differ in at most (s + t) * (100 - percent) / (100 + percent) tokens, and their bitmaps in no more bits. Only pairs of different
components within that bound become rows. Candidates are verified on the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm import bitmap as bm
from glosswright.llm.components import components
from glosswright.llm.words import NON_SPACE, Words, grams, mix, pieces, signed
from glosswright.session import scratch_scope, ship, written

SHINGLE = 5
PERCENT = 75
CELL_BITS = 19
PARITY_LONGS = 8
#: Light sets are looked for up to this size, in steps of ``STEP``, with subsets of these sizes.
MOST_LIGHT, STEP, SUBSETS = 48, 4, (2, 3)
#: Bytes of text up to which texts are looked at for the costs: 24 for each shingle.
SMALL_TEXT = 24 * MOST_LIGHT
SKETCH_BITS = 10
#: Members of a part of a list of a frequent token, and of a block.
PART, BLOCK = 50_000, 1024
#: Rows of two names that are broadcast, at most: some megabytes. More are joined.
MOST_SENT = 200_000
NONE = np.zeros(0, np.uint64)
_SUBSET, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Sets:
    """The distinct tokens of ``k`` texts of a batch: ``doc`` and ``token``, sorted by text and there by token, with ``counts`` by rarity first."""

    def __init__(self, doc: np.ndarray, token: np.ndarray, k: int, counts: np.ndarray | None = None):
        by = np.lexsort((token, doc) if counts is None else (token, counts[_cell(token)], doc))
        doc, token = doc[by], token[by]
        new = np.ones(len(doc), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.token = doc[new], token[new]
        self.size = np.bincount(self.doc, minlength=k)
        self.first = np.cumsum(self.size) - self.size

    def names(self, taken: np.ndarray = NONE, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set; the first is its name. Those in ``taken`` are the names of several sets, which are told apart by the second."""
        with np.errstate(over="ignore"):
            one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(self.token), mix(self.token ^ _SECOND)))
            last = self.first + self.size
            one = mix(one[last] - one[self.first] + self.size.astype(np.uint64)) >> np.uint64(64 - bits)
            two = mix(two[last] - two[self.first])
            if len(taken):
                same = np.isin(one, taken)
                one[same] = mix(one[same] ^ two[same])
        return one, two

    def rank(self) -> np.ndarray:
        """The place of each token in its set."""
        return np.arange(len(self.doc)) - self.first[self.doc]


class Shingles:
    """Makes the sets of word shingles of texts; of fewer words than a shingle has, the whole sequence is one."""

    #: Whether lists hold sets of about the same size only.
    by_size = False

    def __init__(self, n: int):
        self.n = n

    def __call__(self, texts: pa.Array, counts: np.ndarray | None = None) -> Sets:
        w, n = Words(texts, True, NON_SPACE), self.n
        g, k = grams(w.h, n, seed=n), len(w.counts)
        m = np.maximum(w.counts - n + 1, 0)
        doc = np.repeat(np.arange(k), m)
        token = g[np.arange(len(doc)) + np.repeat(w.first[:-1] - (np.cumsum(m) - m), m)]
        short = np.flatnonzero((w.counts > 0) & (w.counts < n))
        if len(short):
            doc = np.concatenate([doc, short])
            token = np.concatenate([token, *[grams(w.h[w.first[i] : w.first[i + 1]], w.counts[i], seed=w.counts[i]) for i in short]])
        return Sets(doc, token, k, counts)


def _least_overlap(size, percent: int):
    """Of a set with any set that is similar enough."""
    return -(-percent * size // 100)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _subsets(s: Sets, docs: np.ndarray, size: int, length: int, c: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of one size: keys of all subsets of ``c`` of the first ``length`` tokens, the owners, the rooms, and the least count of a token in each."""
    if len(docs) == 0 or length < c:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    at = np.array(list(combinations(range(length), c)))
    prefix = s.token[s.first[docs][:, None] + np.arange(length)]
    each = np.sort(prefix[:, at], axis=2)
    key = np.full(each.shape[:2], np.uint64(c))
    with np.errstate(over="ignore"):
        for j in range(c):
            key = mix(key * _SUBSET + each[:, :, j])
    # The last of the subset stands at place p: the sets share at most what follows it, itself, and the others of the subset.
    room = np.broadcast_to(size - at[:, -1] + c - 1, key.shape)
    least = counts[_cell(prefix)][:, at].min(axis=2)
    return key.reshape(-1), np.repeat(docs, len(at)), room.reshape(-1), least.reshape(-1)


def _measure(sets: Callable[..., Sets], name_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, then the task's token counts by cell."""
        counts = np.zeros(1 << CELL_BITS, np.int64)
        fields = ["doc_id", "hash", "n_shingles", "name", "second", "cell", "count"]
        id_type = pa.int64()
        for batch in pieces(batches):
            id_type, n = batch.column(0).type, batch.num_rows
            s = sets(batch.column(2))
            counts += np.bincount(_cell(s.token), minlength=len(counts))
            names = [pa.array(signed(x), mask=s.size == 0) for x in s.names(bits=name_bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.size), *names, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=fields)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            nothing = [pa.nulls(len(part), t) for t in (id_type, *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(part.astype(np.int32)), pa.array(counts[part])], names=fields)

    return run


def _sketches(counts, sets: Callable[..., Sets], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signed counts of the keys that small sets would have: by subset size (1: single tokens), class of set sizes and cell."""
        sums = np.zeros((1 + max(SUBSETS), MOST_LIGHT // STEP, 1 << SKETCH_BITS), np.int64)
        done: set[int] = set()
        for batch in pieces(batches):
            s = sets(batch.column(0), counts.value)
            fresh = _fresh(s, s.names()[0], done)
            for size in range(1, MOST_LIGHT + 1):
                docs = np.flatnonzero(fresh & (s.size == size))
                spare = size - _least_overlap(size, percent)
                for c in (1, *SUBSETS):
                    key, *_ = _subsets(s, docs, size, min(size, spare + c), c, counts.value)
                    cell = (key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    sign = 1 - 2 * (key & np.uint64(1)).astype(np.int64)
                    sums[c, (size - 1) // STEP] += np.bincount(cell, sign, 1 << SKETCH_BITS).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums.reshape(-1)[at])], names=["cell", "count"])

    return run


def _fresh(s: Sets, names: np.ndarray, done: set[int]) -> np.ndarray:
    """Which sets are the first with their names in this task."""
    fresh = np.zeros(len(names), bool)
    for i in np.flatnonzero(s.size):
        if (name := int(names[i])) not in done:
            done.add(name)
            fresh[i] = True
    return fresh


def cheapest(sums: np.ndarray, percent: int) -> tuple[int, int]:
    """Boundary and subset size for which the squared lengths of all lists come to least, from the signed sums by subset size, class and cell."""
    squares = lambda x: float((x.sum(axis=0) ** 2).sum())  # noqa: E731  an unbiased estimate of the sum of squared lengths
    best = (squares(sums[1].astype(np.float64)), 0, SUBSETS[0])
    for c in SUBSETS:
        for k in range(1, sums.shape[1] + 1):
            singles = (percent * (k * STEP + 1) // 100) // STEP
            best = min(best, (squares(sums[c, :k].astype(np.float64)) + squares(sums[1, singles:].astype(np.float64)), k * STEP, c))
    return best[1:]


def _boundary(texts: DataFrame, counts, sets: Callable[..., Sets], percent: int) -> tuple[int, int]:
    signs = texts.where(F.octet_length("text") <= SMALL_TEXT).mapInArrow(_sketches(counts, sets, percent), "cell int, count bigint").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    sums = np.zeros((1 + max(SUBSETS), MOST_LIGHT // STEP, 1 << SKETCH_BITS), np.int64)
    sums.reshape(-1)[signs["cell"].to_numpy()] = signs["count"].to_numpy()
    return cheapest(sums, percent)


def parts_of(counts: np.ndarray, usual: float, part: int = PART) -> np.ndarray:
    """How many parts lists have whose rarest token's cell has these counts: one, but where a count stands out from the usual one, one for each ``part`` more."""
    return 1 + (np.maximum(0, counts - usual - 4 * np.sqrt(usual)) // part).astype(np.int64)


def _keys(counts, naming: tuple[np.ndarray, int], boundary: int, c: int, sets: Callable[..., Sets], percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of each set: ``key, part, name, size, room``. ``room`` bounds the overlap with a set that shares the key."""
        by, done = counts.value, set()
        usual = float(np.median(by))
        for batch in pieces(batches):
            s = sets(batch.column(0), by)
            names, overlap = s.names(*naming)[0], _least_overlap(s.size, percent)
            fresh = _fresh(s, names, done)
            light = fresh & (s.size <= boundary)
            single = fresh & ~(light & (100 * s.size < percent * (boundary + 1)) & (overlap >= c))
            rank = s.rank()
            at = np.flatnonzero(single[s.doc] & (rank <= (s.size - overlap)[s.doc]))
            found = [(s.token[at], s.doc[at], (s.size[s.doc] - rank)[at], by[_cell(s.token[at])])]
            for size in np.unique(s.size[light]):
                spare = int(size - _least_overlap(size, percent))
                found.append(_subsets(s, np.flatnonzero(light & (s.size == size)), int(size), min(int(size), spare + c), c, by))
            key, doc, room, count = (np.concatenate(x) for x in zip(*found))
            if sets.by_size:
                # Sets that are similar enough are in one band of sizes or in two that follow each other: each set is in the lists of its band and of the next.
                band = np.floor(np.log(np.maximum(s.size[doc], 1)) / np.log(100 / percent) + 1e-9).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.concatenate([mix(key ^ mix(band + up)) for up in (np.uint64(0), np.uint64(1))])
                doc, room, count = (np.tile(x, 2) for x in (doc, room, count))
            name, parts = names[doc], parts_of(count, usual, most)
            part = np.where(parts > 1, 1 + (name >> np.uint64(8)).astype(np.int64) % parts, 0).astype(np.int32)
            columns = [signed(key), part, signed(name), s.size[doc].astype(np.int32), room.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "part", "name", "size", "room"])

    return run


def parity(tokens: np.ndarray, size: int) -> np.ndarray:
    """Of the tokens of each bit, whether they are odd in number; two bits a token at least. A bit is the low end of a hash."""
    longs = PARITY_LONGS << int(np.ceil(np.log2(max(size / (32 * PARITY_LONGS), 1))))
    odd = np.bincount((mix(tokens) & np.uint64(longs * 64 - 1)).astype(np.int64), minlength=longs * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(bitmaps: np.ndarray, longs: int) -> np.ndarray:
    """Bitmaps of the same sets with fewer bits: the halves, which a shorter low end puts together, are joined."""
    while bitmaps.shape[-1] > longs:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] ^ bitmaps[..., half:]
    return bitmaps


def _members(filter_, bits: int, naming: tuple[np.ndarray, int], sets: Callable[..., Sets]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names, sizes, parity bitmaps (one of a fixed length, one that grows with the set) and packed texts of the sets in lists."""
        done: set[int] = set()
        for batch in pieces(batches):
            texts, rows = batch.column(0), []
            s = sets(texts)
            names = s.names(*naming)[0]
            listed = _fresh(s, names, done) & bm.has(filter_.value, bits, names)
            for i in np.flatnonzero(listed):
                own = parity(s.token[s.first[i] : s.first[i] + s.size[i]], int(s.size[i]))
                rows.append((int(names[i : i + 1].view(np.int64)[0]), int(s.size[i]), folded(own, PARITY_LONGS).tobytes(), own.tobytes(), zlib.compress(texts[i].as_py().encode(), 1)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["name", "size", "bits", "own", "packed"])

    return run


def _distinct_members(members: DataFrame) -> DataFrame:
    """One row a name: several tasks may have found the same set. Where few names are affected, only those are told to the tasks."""
    members = written(members.withColumn("task", F.spark_partition_id()), "members")
    again = members.groupBy("name").agg(F.count("*").alias("n"), F.min("task").alias("stays")).where("n > 1").select(F.col("name").alias("again"), "stays")
    again = written(again, "again")
    if again.count() > MOST_SENT:
        return written(members.drop("task").dropDuplicates(["name"]), "members")
    return members.join(F.broadcast(again), (F.col("name") == F.col("again")) & (F.col("task") != F.col("stays")), "left_anti").drop("task")


def _verify(sets: Callable[..., Sets], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``a``, so a batch has few different ones; each is cut into shingles once."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                _, first, which = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
                packed = [*batch.column(2).take(pa.array(first)), *batch.column(3)]
                texts = pa.array([zlib.decompress(x.as_py()).decode() for x in packed], pa.large_string())
                s = sets(texts)
                k = len(first)
                with np.errstate(over="ignore"):
                    own = mix(s.token ^ mix(s.doc.astype(np.uint64)))
                    b = s.doc >= k
                    met = np.isin(mix(s.token[b] ^ mix(which[s.doc[b] - k].astype(np.uint64))), own[~b])
                both = np.bincount(s.doc[b][met] - k, minlength=batch.num_rows)
                linked = 100 * both >= percent * (s.size[which] + s.size[k:] - both)
                yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sizes and own bitmaps allow that they are similar enough."""
        for batch in (b for b in batches if b.num_rows):
            sizes = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)]
            owns = [batch.column(k).to_pylist() for k in (4, 5)]
            close = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            width = np.array([[len(x) // 8 for x in own] for own in owns])
            for w in np.unique(width[:, close], axis=1).T if close.any() else ():
                at = np.flatnonzero(close & (width[0] == w[0]) & (width[1] == w[1]))
                left, right = (folded(np.frombuffer(b"".join(own[i] for i in at), np.uint64).reshape(len(at), k), int(w.min())) for own, k in zip(owns, w))
                close[at] = _within(left, right, sizes[0][at] + sizes[1][at], percent)
            yield batch.select([0, 1]).filter(pa.array(close))

    return run


def _within(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps differ in few enough bits for sets of these sizes in sum."""
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) * (100 + percent) <= sizes * (100 - percent)


def _links(pairs: DataFrame, members: DataFrame, sets: Callable[..., Sets], percent: int) -> DataFrame:
    """The pairs ``a, b`` that are similar enough."""
    pairs = written(pairs, "pairs")
    if pairs.count() <= MOST_SENT:
        names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        members = members.join(F.broadcast(names), "name", "left_semi")
    side = lambda x, *cols: members.select(F.col("name").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    rows = pairs.join(side("a", "size", "own"), "a").join(side("b", "size", "own"), "b").select("a", "b", "size_a", "size_b", "own_a", "own_b")
    pairs = written(rows.mapInArrow(_bounded(percent), "a bigint, b bigint"), "bounded")
    texts = pairs.join(side("b", "packed"), "b").join(side("a", "packed"), "a").select("a", "b", "packed_a", "packed_b")
    return texts.mapInArrow(_verify(sets, percent), "a bigint, b bigint")


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by ``key, i, j`` (a pair of blocks) and block; of each pair of blocks, the pairs of members of different components within all bounds."""
        rest: pa.RecordBatch | None = None
        for batch in (b for b in batches if b.num_rows):
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = _groups(rows)
            last = int(group[-1])
            if last:
                yield from _compared(rows.slice(0, last), percent)
            rest = rows.slice(last)
        if rest is not None:
            yield from _compared(rest, percent)

    return run


def _groups(rows: pa.RecordBatch) -> np.ndarray:
    """The first row of each pair of blocks."""
    keys = np.column_stack([rows.column(k).to_numpy() for k in range(3)])
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])


def _compared(rows: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    n, starts = rows.num_rows, _groups(rows)
    i, j, block, name, root, size, room = (rows.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "block", "name", "root", "size", "room"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(n, PARITY_LONGS)
    at, end = np.arange(n), np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    # In a block with itself, each member meets those after it; in two blocks, those of the first meet those of the second.
    second = end - np.repeat(np.add.reduceat((block == j).astype(np.int64), starts), np.diff(np.append(starts, n)))
    low = np.where(i == j, at + 1, np.where(block == i, second, end))
    upto = np.concatenate([[0], np.cumsum(end - low)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 20), "right")) - 1)
        count = (end - low)[a:b]
        x = np.repeat(at[a:b], count)
        y = np.arange(len(x)) + np.repeat(low[a:b] - (np.cumsum(count) - count), count)
        ok = (root[x] != root[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
        ok &= (100 + percent) * np.minimum(room[x], room[y]) >= percent * (size[x] + size[y])
        x, y = x[ok], y[ok]
        close = _within(bits[x], bits[y], size[x] + size[y], percent)
        x, y = name[x[close]], name[y[close]]
        if len(x):
            pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        a = b


def _block_pairs(rooted: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of members of different components that share a list and may be similar enough."""
    sizes = rooted.groupBy("key").agg(F.count("*").alias("n"))
    at = rooted.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    at = at.withColumn("block", F.pmod(F.shiftright("name", 8), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at = at.join(members.select("name", "bits"), "name").withColumn("other", other)
    at = at.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "name", "root", "size", "room", "block", "bits")
    at = at.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("block") == F.col("j"))
    return at.mapInArrow(_blocks(percent), "a bigint, b bigint")


def _linked(docs: DataFrame, sets: Callable[..., Sets], percent: int, name_bits: int = 64) -> DataFrame:
    """One row per document row: ``doc_id, hash`` (of the text), ``n_shingles``, and ``root``, the name of its component, null without tokens."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("hash bigint, n_shingles bigint, name bigint, second bigint, cell int, count bigint").fields])
    first = written(docs.mapInArrow(_measure(sets, name_bits), schema), "sets")
    sums = first.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[sums["cell"].to_numpy()] = sums["count"].to_numpy()
    counts = spark.sparkContext.broadcast(counts)
    # Names that several sets have by chance: hardly any.
    taken = first.where("name IS NOT NULL").groupBy("name").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("name").toArrow()
    taken = np.sort(taken["name"].to_numpy().view(np.uint64))
    naming = (taken, name_bits)
    texts = docs.select("text")
    boundary, c = (0, SUBSETS[0]) if sets.by_size else _boundary(texts, counts, sets, percent)
    keys = texts.mapInArrow(_keys(counts, naming, boundary, c, sets, percent, PART), "key bigint, part int, name bigint, size int, room int")
    of_key = Window.partitionBy("key", "part")
    lists = keys.withColumn("least", F.min("name").over(of_key)).withColumn("most", F.max("name").over(of_key))
    lists = written(lists.where("part > 0 OR least <> most").drop("most"), "lists")
    listed = lists.select("name").distinct()
    bits = bm.bits_for(listed.count())
    filter_ = spark.sparkContext.broadcast(bm.bitmap(listed, "name", bits))
    members = _distinct_members(texts.mapInArrow(_members(filter_, bits, naming, sets), "name bigint, size int, bits binary, own binary, packed binary"))
    stars = lists.where("name <> least").select(F.col("least").alias("a"), F.col("name").alias("b"))
    parts = lists.where("part > 0").select("key", "least").distinct()
    tops = parts.groupBy("key").agg(F.min("least").alias("a"))
    stars = stars.unionByName(parts.join(tops, "key").where("least <> a").select("a", F.col("least").alias("b")))
    tested = written(stars.distinct(), "stars")
    roots = components(written(_links(tested, members, sets, percent), "links"))
    # Lists that still hold several components: first all are compared with the member of the fullest lists, mostly what others were copied from.
    rooted = _rooted(lists, tested, roots)
    fullness = rooted.join(rooted.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("name").agg(F.sum("n").alias("fullness"))
    hubs = rooted.join(fullness, "name").groupBy("key").agg(F.max_by(F.struct("name", "root", "size", "room"), F.struct("fullness", "name")).alias("hub"))
    pairs = rooted.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & ((100 + percent) * F.least("room", "hub.room") >= percent * (F.col("size") + F.col("hub.size"))))
    pairs = pairs.select(F.least("name", "hub.name").alias("a"), F.greatest("name", "hub.name").alias("b")).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    roots = _grown(roots, _links(pairs, members, sets, percent))
    blocks = _block_pairs(_rooted(lists, tested, roots), members, percent).distinct()
    tested = tested.unionByName(pairs)
    roots = _grown(roots, _links(blocks.join(tested, ["a", "b"], "left_anti"), members, sets, percent))
    name = _renamed(taken) if len(taken) else F.col("name")
    named = first.where("cell IS NULL").select("doc_id", "hash", "n_shingles", name.alias("name"))
    return named.join(roots, named["name"] == roots["node"], "left").select("doc_id", "hash", "n_shingles", F.coalesce("root", "name").alias("root"))


def _renamed(taken: np.ndarray) -> Column:
    """The names of all sets, those of ``taken`` as in ``Sets.names``."""

    @F.arrow_udf(T.LongType())
    def rename(name: pa.Array, second: pa.Array) -> pa.Array:
        one, two = (x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64).copy() for x in (name, second))
        same = np.isin(one, taken)
        with np.errstate(over="ignore"):
            one[same] = mix(one[same] ^ two[same])
        return pa.array(one.view(np.int64), mask=name.is_null().to_numpy(zero_copy_only=False))

    return rename("name", "second")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links."""
    return components(written(links, "links").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _rooted(lists: DataFrame, stars: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, name, size, room, root`` of the lists whose members are in several components: in some, a member and the least aren't linked."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    apart = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    apart = written(apart, "apart")
    keys = lists.join(apart, (F.col("least") == F.col("a")) & (F.col("name") == F.col("b"))).select("key")
    # Parts of a list are open together where their least members aren't linked.
    parts = lists.where("part > 0").select("key", F.col("least").alias("part_least")).distinct()
    tops = parts.groupBy("key").agg(F.min("part_least").alias("top"))
    keys = keys.unionByName(parts.join(tops, "key").join(apart, (F.col("top") == F.col("a")) & (F.col("part_least") == F.col("b"))).select("key"))
    open_ = written(keys.distinct(), "open")
    at = lists.join(open_, "key", "left_semi").select("key", "name", "size", "room").distinct()
    return written(at.join(roots, at["name"] == roots["node"], "left").select("key", "name", "size", "room", F.coalesce("root", "name").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id``.

    Documents link if 100 * shared shingles >= ``percent`` * all shingles of both; ``component_id`` is the smallest ``doc_id`` reachable by links. Null
    texts and those without words have no shingles, link with nothing and are their own component. Rows with a null ``doc_id`` link like others but never
    name a component that has an id. Repeated rows and extra columns don't matter; an empty table gives an empty result. A task's memory is bounded by
    the longest text, of which some 60 bytes a word are held.
    """
    return grouped(docs, Shingles(shingle), percent)


def grouped(docs: DataFrame, sets: Callable[..., Sets], percent: int) -> DataFrame:
    """As ``near_duplicates``, for sets of any tokens; ``n_shingles`` is the size of a set."""
    named = _linked(docs, sets, percent)
    ids = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    with_words = named.where("root IS NOT NULL").join(ids, "root").select("doc_id", "n_shingles", "component_id")
    return with_words.unionByName(named.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest ``doc_id`` (null is largest), of rows that share it the one with the smallest hash
    of its text, and of equal rows any one. Documents without words, null texts among them, are all kept. Other columns pass through, whatever their names. An empty table gives an empty
    result. Texts are compared whole, as ``near_duplicates`` says."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    with scratch_scope(docs.sparkSession) as keep:
        named = written(_linked(docs, Shingles(SHINGLE), PERCENT), "named").where("root IS NOT NULL")
        groups = named.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
        first = groups.groupBy("root").agg(F.min(rank).alias("first")).select("root", F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"))
        stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
        judged = groups.join(first, "root").select("doc_id", "hash", "n", stays.alias("stays"))
        acts = keep(written(judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias("at_id"), F.col("hash").alias("at_hash"), "stays"), "acts"))
    hash_ = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    may = bm.may_be_in(acts.select(F.xxhash64("at_id", "at_hash").alias("key")), "key")(F.xxhash64(docs["doc_id"], hash_))
    # Rows that none of this concerns aren't shuffled; of the others those that go have gone when equal rows become one.
    found = docs.where(may)

    def those(which: str, how: str) -> DataFrame:
        keys = acts.where(which).select("at_id", "at_hash")
        return found.join(keys, found["doc_id"].eqNullSafe(keys["at_id"]) & (hash_ == keys["at_hash"]), how)

    each = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    once = those("stays", "left_semi").groupBy("doc_id", "text").agg(F.first(F.struct(*each)).alias("one")).select("one.*")
    return docs.where(~may).unionByName(those("true", "left_anti")).unionByName(once)
