"""Toxicity: class-conditional Kneser-Ney bigram models of toxic and of ordinary text, compared by length-normalised log-likelihood.

From every labelled text of folds 1 to 3 Spark counts, for each class, how many texts hold a pair of a word and its predecessor (the beginning of a text counts as one). With discounts D
below 1, estimated from the numbers of what is counted once and twice (``discount``), the likelihood of a word after its predecessor is, for either class,

* p(w | v) = max(n(v, w) - D, 0) / n(v) + D * t(v) / n(v) * p(w), n(v) the sum and t(v) the number of the class's pairs after v; p(w) where it has none;
* p(w) = max(k(w) - D, 0) / k + D * words / k * q(w), k(w) the number of distinct predecessors in the class, k their sum;
* q(w) the same from the pairs of both classes together, which the classes share, and below that equal likelihoods of all words and of one more for those unknown.

All words and pairs of either class are in its model, whatever their counts. A text is compared by the sum over all its positions of log p(w | v, toxic) - log p(w | v, ordinary), divided by
their number: ``likelihood``. That sum is one of values of words, contexts and pairs (``values``). The table of them is as long as the corpus makes it; the most frequent, at most
``MOST_BROADCAST``, are read whole by each task from the shared folder (``_sorted``), so that none pass through the driver. All others are joined to the texts' positions, in ``PARTS`` passes of
which each has a part of the keys, so that shuffle files of one are gone before the next.

Beside the likelihoods, expressions that at least two toxic texts, contexts or words attest are compared one by one (``log_ratios``): pairs back off to words by predecessors, those to stems by
words, each in the proportion in which the next lower order is shared between the classes. That table is read by tasks or joined likewise, with the same result.

Fold = crc32(doc_id as text) mod 5. Fold 0 is held out; folds 1 to 3 train the models, fold 4 fits the five numbers that turn the comparison of likelihoods, the mean and the largest log ratio
of attested expressions, and the length, by which the latter grows, into a score, on at most ``CALIBRATION`` of its labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm import bitmap as bm
from glosswright.llm.words import LETTERS, Words, mix, pieces, signed, span_hashes
from glosswright.session import drop_scratch, read_columns, scratch_scope, ship, shuffles_dropped, written

#: Bytes of a stem.
STEM = 5
DISCOUNT = 1
#: Shared occurrences given back to each stem and word, and to each pair.
SHARED, SHARED_PAIR = 3.0, 10.0
#: Occurrences by which a word's share of a class, as a context, leans to that of all words.
LEANING = 10.0
MOST_RATIO = 6.0
#: Rows of fold 4 on which the score is fitted, at most; the smallest by digest of doc_id.
CALIBRATION = 50_000
#: Rows of a model that every task reads: at most 24 bytes each.
MOST_BROADCAST = 4_000_000
#: Files of such a model.
FILES = 8
#: Passes over labelled texts and over all texts, each for a part of the keys: a power of 2.
PARTS = 2
#: Expressions a task holds before it hands them on.
HELD = 1 << 20
_PAIR, _STEM, _CONTEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)).cast("int")


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before) * _PAIR + word)


def context_key(before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before ^ _CONTEXT)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place where each is, how often, and of each element which it is."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[at], order[at], np.diff(np.append(at, len(x))), which


class Expressions:
    """The distinct pairs of each text of a batch, which they are ``of``, and at how many positions (``times``); their words are told as places among the distinct ``words`` of the batch, with
    their ``stems``, and their predecessors as places among ``contexts``: the words, and 0 for the beginning of a text."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, True, LETTERS)
        self.n_texts = len(w.counts)
        self.words, first, _, which = distinct(w.h)
        self.contexts = np.append(self.words, np.uint64(0))
        before = np.concatenate([np.zeros(1, np.int64), which])[: len(which)]
        before[w.first[:-1][w.counts > 0]] = len(self.words)
        of = w.of
        with np.errstate(over="ignore"):
            self.stems = mix(span_hashes(w.buf, w.starts[first], np.minimum(w.ends[first], w.starts[first] + STEM)) ^ _STEM)
            pair = mix((mix(self.contexts) * _PAIR)[before] + w.h)
            # Once a text: an expression that one text repeats is no more telling.
            _, once, self.times, _ = distinct(mix(pair ^ mix(of.astype(np.uint64))))
        self.pair, self.word_at, self.before_at, self.of = pair[once], which[once], before[once], of[once]

    word = property(lambda self: self.words[self.word_at])
    stem = property(lambda self: self.stems[self.word_at])
    before = property(lambda self: self.contexts[self.before_at])


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            some = batch.slice(i, rows)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.decompress(x.as_py()).decode() for x in some.column(0)], pa.large_string()), some.column(1)], names=["text", "toxic"])


def _counted(part: int, parts: int):
    """``kind, a, b, n1, n0``: the pairs (kind 0) of a predecessor and a word in this part, with the toxic and the ordinary texts that hold them; with the first part also each word and its stem (1)."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, a, b, n1, n0 = map(np.concatenate, zip(*held))
        key, first, _, which = distinct(key)
        return key, a[first], b[first], *[np.bincount(which, n, len(key)).astype(np.int64) for n in (n1, n0)]

    def rows(kind: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, a, b, n1, n0 = merged(held)
        for i in range(0, len(key), 100_000):
            at = slice(i, i + 100_000)
            columns = [np.full(len(key[at]), kind, np.int32), signed(a[at]), signed(b[at]), n1[at], n0[at]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["kind", "a", "b", "n1", "n0"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in pieces(_unpacked(batches)):
            e = Expressions(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[e.of]
            own = e.pair & np.uint64(parts - 1) == part
            held[0].append((e.pair[own], e.before[own], e.word[own], toxic[own], 1 - toxic[own]))
            if part == 0:
                none = np.zeros(len(e.words), np.int64)
                held[1].append((e.words, e.words, e.stems, none, none))
            for kind in (0, 1):
                if sum(len(x[0]) for x in held[kind]) > HELD:
                    held[kind][:] = [merged(held[kind])]
                    if len(held[kind][0][0]) > HELD // 2:
                        yield from rows(kind, held[kind])
                        held[kind].clear()
        for kind in (0, 1):
            if held[kind]:
                yield from rows(kind, held[kind])

    return run


def discount(once: int, twice: int) -> float:
    """The usual estimate of what a count is too high by: below 1, so that what is counted once keeps a part of it."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once + twice else 0.5


def _words(pairs: DataFrame) -> DataFrame:
    """``key`` of each word and context, and of both classes (1, 0) ``k``: distinct predecessors, ``n``: texts of its pairs as a context, ``t``: distinct pairs as a context; ``k`` alone: of both together."""
    has = lambda n: (F.col(n) > 0).cast("long")
    none = [F.lit(0).cast("long")] * 4
    names = ["key", "k", "k1", "k0", "n1", "t1", "n0", "t0"]
    word = [F.col("b"), F.lit(1).cast("long"), has("n1"), has("n0"), *none]
    context = [F.col("a"), *none[:3], F.col("n1"), has("n1"), F.col("n0"), has("n0")]
    rows = [pairs.select(*[c.alias(x) for c, x in zip(columns, names)]) for columns in (word, context)]
    return written(rows[0].unionByName(rows[1]).groupBy("key").agg(*[F.sum(x).alias(x) for x in names[1:]]), "words")


def _sorted(rows: DataFrame, name: str) -> DataFrame:
    """A written table of few rows in the order of ``key``, from file to file, as tasks read it (``read_columns``) and search in it."""
    return written(rows.repartitionByRange(FILES, "key").sortWithinPartitions("key"), name)


def values(pairs: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """``key, value, n`` of what adds to a position's log ratio of likelihoods, and the log ratio of an unknown word, which every position has.

    A word adds what its likelihoods differ from that, a context the ratio of the shares it gives to the lower order, a pair what its own counts add to both; ``n`` tells how frequent they are.
    """
    # Single rows of sums.
    s = words.agg(
        *[F.sum(x).alias(x) for x in ("k", "k1", "k0")], *[F.count_if(F.col(x) > 0).alias(f"w_{x}") for x in ("k", "k1", "k0")],
        *[F.count_if(F.col(x) == i).alias(f"{x}_{i}") for x in ("k", "k1", "k0") for i in (1, 2)],
    ).first()
    c = pairs.agg(*[F.count_if(F.col(x) == i).alias(f"{x}_{i}") for x in ("n1", "n0") for i in (1, 2)]).first()
    off = {x: discount(s[f"{x}_1"], s[f"{x}_2"]) for x in ("k", "k1", "k0")} | {x: discount(c[f"{x}_1"], c[f"{x}_2"]) for x in ("n1", "n0")}
    given = {x: off[x] * s[f"w_{x}"] / s[x] if s[x] else 1.0 for x in ("k", "k1", "k0")}
    left = lambda x: F.greatest(F.col(x) - off[x], F.lit(0.0)) / (s[x] or 1)
    shared = left("k") + given["k"] / (s.w_k + 1)
    p1, p0 = (left(x) + given[x] * shared for x in ("k1", "k0"))
    unknown = float(np.log(given["k1"] / given["k0"]))
    lower = lambda x: F.when(F.col(f"t{x}") > 0, off[f"n{x}"] * F.col(f"t{x}") / F.col(f"n{x}")).otherwise(1.0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(context_key(unsigned(batch.column(0))))), *batch.columns[1:]], names=["key", "value", "n"])

    def compared(path: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if path:
                keys, *facts = read_columns(path, "key", "t1", "t0", "p1", "p0")
            for batch in batches:
                a, b = unsigned(batch.column(0)), unsigned(batch.column(1))
                n1, n0, *more = (x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns[2:])
                if path:
                    i, j = np.searchsorted(keys, signed(a)), np.searchsorted(keys, signed(b))
                    more = [facts[0][i], facts[1][i], facts[2][j], facts[3][j]]
                t1, t0, p1, p0 = (x.astype(float) for x in more)
                of_toxic, of_ordinary = (np.log1p(np.maximum(n - d, 0) / (d * np.maximum(t, 1) * p)) for n, d, t, p in ((n1, off["n1"], t1, p1), (n0, off["n0"], t0, p0)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(pair_key(a, b))), pa.array((of_toxic - of_ordinary).astype(np.float32)), pa.array((n1 + n0).astype(np.int64))], names=["key", "value", "n"])

        return run

    facts = words.select("key", *[F.col(x).cast("float").alias(x) for x in ("t1", "t0")], p1.cast("float").alias("p1"), p0.cast("float").alias("p0"))
    schema = "key bigint, value float, n bigint"
    path = None
    if words.count() <= MOST_BROADCAST:
        path = _sorted(facts, "facts").scratch_path
        of_pairs = pairs.select("a", "b", "n1", "n0").mapInArrow(compared(path), schema)
    else:
        both = pairs.join(facts.select(F.col("key").alias("a"), "t1", "t0"), "a").join(facts.select(F.col("key").alias("b"), "p1", "p0"), "b")
        of_pairs = both.select("a", "b", "n1", "n0", "t1", "t0", "p1", "p0").mapInArrow(compared(None), schema)
    of_words = words.where("k > 0").select("key", (F.log(p1 / p0) - unknown).cast("float").alias("value"), F.col("k").alias("n"))
    of_contexts = words.where("t1 + t0 > 0").select("key", F.log(lower(1) / lower(0)).cast("float").alias("value"), (F.col("n1") + F.col("n0")).alias("n")).mapInArrow(keyed, schema)
    out = written(of_pairs.unionByName(of_words).unionByName(of_contexts), "values")
    if path:
        drop_scratch(pairs.sparkSession, path)
    return out, unknown


def _attested(pairs: DataFrame, stems: DataFrame, words: DataFrame) -> DataFrame:
    """``level, key, parent, before, n1, n0`` of what toxic texts leave with a count: pairs by texts (level 0, ``parent`` is the word), words by distinct predecessors (1, the stem), stems by distinct words (2)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = unsigned(batch.column(0)), unsigned(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(signed(pair_key(a, b))), batch.column(1), batch.column(0), *batch.columns[2:]], names=["level", "key", "parent", "before", "n1", "n0"])

    schema = "level int, key bigint, parent bigint, before bigint, n1 bigint, n0 bigint"
    nothing, kept = F.lit(None).cast("long"), F.when(F.col("n0") > DISCOUNT, F.col("n0")).otherwise(0).alias("n0")
    of_pairs = pairs.where(F.col("n1") > DISCOUNT).select("a", "b", "n1", "n0").mapInArrow(keyed, schema)
    known = stems.select(F.col("a").alias("key"), F.col("b").alias("parent")).join(words.select("key", "k1", "k0"), "key")
    of_words = known.select(F.lit(1).alias("level"), "key", "parent", nothing.alias("before"), F.col("k1").alias("n1"), F.col("k0").alias("n0"))
    of_stems = known.groupBy(F.col("parent").alias("key")).agg(F.count_if(F.col("k1") > 0).alias("n1"), F.count_if(F.col("k0") > 0).alias("n0"))
    of_stems = of_stems.select(F.lit(2).alias("level"), "key", nothing.alias("parent"), nothing.alias("before"), "n1", "n0")
    rows = of_pairs.unionByName(of_words).unionByName(of_stems).where(F.col("n1") > DISCOUNT)
    return written(rows.select("level", "key", "parent", "before", "n1", kept), "counts")


def log_ratios(counts: DataFrame) -> DataFrame:
    """``key, ratio`` of attested expressions: log of p(expression | toxic) / p(expression | ordinary), from the counts of both classes as of ``_attested``."""
    sums = {r.level: (r.a, r.b) for r in counts.groupBy("level").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).collect()}  # three rows
    share = {level: a / (a + b) for level, (a, b) in sums.items()}

    def compared(rows: DataFrame, of_toxic: Column, shared: float) -> DataFrame:
        """Adds ``q1`` and ``q0``: the likelihoods in either class as multiples of the shared one, from those of the lower order, ``up1`` and ``up0``."""
        one = (F.greatest(F.col("n1") - DISCOUNT, F.lit(0)) + shared * of_toxic * F.col("up1")) / of_toxic
        two = (F.greatest(F.col("n0") - DISCOUNT, F.lit(0)) + shared * (1 - of_toxic) * F.col("up0")) / (1 - of_toxic)
        rows = rows.withColumn("one", one).withColumn("two", two).withColumn("both", of_toxic * F.col("one") + (1 - of_toxic) * F.col("two"))
        return rows.withColumn("q1", F.col("one") / F.col("both")).withColumn("q0", F.col("two") / F.col("both"))

    level = lambda k: counts.where(F.col("level") == k)
    usual = lambda k: min(max(share.get(k, 0.5), 1e-6), 1 - 1e-6)
    stems = compared(level(2).select("key", "n1", "n0", F.lit(1.0).alias("up1"), F.lit(1.0).alias("up0")), F.lit(usual(2)), SHARED).select("key", "q1", "q0")
    up = stems.select(F.col("key").alias("parent"), F.col("q1").alias("s1"), F.col("q0").alias("s0"))
    words = level(1).join(up, "parent", "left").select("key", "n1", "n0", F.coalesce("s1", F.lit(1.0)).alias("up1"), F.coalesce("s0", F.lit(1.0)).alias("up0"))
    words = written(compared(words, F.lit(usual(1)), SHARED).select("key", "n1", "n0", "q1", "q0"), "words")
    up = words.select(F.col("key").alias("parent"), F.col("q1").alias("up1"), F.col("q0").alias("up0"))
    context = words.select(F.col("key").alias("before"), ((F.col("n1") + LEANING * usual(1)) / (F.col("n1") + F.col("n0") + LEANING)).alias("context"))
    # The word of a pair that two toxic texts hold may have one predecessor only; it then has no count.
    pairs = level(0).join(up, "parent", "left").join(context, "before", "left")
    pairs = pairs.select("key", "n1", "n0", F.coalesce("up1", F.lit(1.0)).alias("up1"), F.coalesce("up0", F.lit(1.0)).alias("up0"), F.coalesce("context", F.lit(usual(1))).alias("context"))
    pairs = compared(pairs, F.col("context"), SHARED_PAIR).select("key", "q1", "q0")
    ratio = F.greatest(F.lit(-MOST_RATIO), F.least(F.lit(MOST_RATIO), F.log(F.col("q1") / F.col("q0"))))
    return written(pairs.unionByName(words.select("key", "q1", "q0")).unionByName(stems).select("key", ratio.alias("ratio")), "ratios")


def _found(keys: np.ndarray, x: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """What each column has for the keys, else nan."""
    if not len(keys):
        return [np.full(len(x), np.nan)] * len(columns)
    x = signed(x)
    order = np.argsort(x)  # neighbours are looked up together
    x = x[order]
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    out, known = [np.empty(len(x)) for _ in columns], keys[at] == x
    for found, column in zip(out, columns):
        found[order] = np.where(known, column[at], np.nan)
    return out


def _features(path: str):
    """``doc_id, at`` with the comparison of attested expressions (the log ratio of the pair, else of the word, else of the stem, else 0), the number of positions, and the sum of the values of
    words, contexts and pairs that are in the table of frequent ones at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ratios, values = read_columns(path, "key", "ratio", "value")
        for batch in pieces(batches):
            e = Expressions(batch.column(2))
            (of_stem,), (of_word, word), (context,) = _found(keys, e.stems, ratios), _found(keys, e.words, ratios, values), _found(keys, context_key(e.contexts), values)
            of_pair, pair = _found(keys, e.pair, ratios, values)
            of_word = np.where(np.isnan(of_word), of_stem, of_word)[e.word_at]
            ratio, n = np.nan_to_num(np.where(np.isnan(of_pair), of_word, of_pair)), np.bincount(e.of, minlength=e.n_texts)
            most = np.full(e.n_texts, -np.inf)
            np.maximum.at(most, e.of, ratio)
            mean = np.bincount(e.of, ratio, e.n_texts) / np.maximum(n, 1)
            added = np.nan_to_num(word)[e.word_at] + np.nan_to_num(context)[e.before_at] + np.nan_to_num(pair)
            facts = [mean, np.where(n > 0, most, 0.0), np.log1p(n), np.bincount(e.of, e.times, e.n_texts), np.bincount(e.of, e.times * added, e.n_texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x.astype(float)) for x in facts]], names=["doc_id", "at", "f0", "f1", "f2", "positions", "added"])

    return run


def _rare(filters, bits: int, part: int):
    """``at, key`` of the words, contexts and pairs of this part, at each position, that may be among those in the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column(1), True, LETTERS)
            at, before = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), w.counts), np.concatenate([np.zeros(1, np.uint64), w.h])[: len(w.h)]
            before[w.first[:-1][w.counts > 0]] = 0
            for x in (w.h, context_key(before), pair_key(before, w.h)):
                own = np.flatnonzero((x & np.uint64(PARTS - 1) == part) & bm.has(filters[0].value, bits, x))
                own = own[bm.has(filters[1].value, bits, x[own] << np.uint64(bits))]
                yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(signed(x[own]))], names=["at", "key"])

    return run


def _rare_sums(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """``at, more``: the sum of the values in ``rare`` that a text's words, contexts and pairs have, for texts with any. ``docs``: ``at, text``; equal rows add up."""
    spark = docs.sparkSession
    bits = bm.bits_for(rare.count())
    # By the first and by the next bits of the keys.
    both = [rare.select("key"), rare.select(F.shiftleft("key", bits).alias("key"))]
    filters, sums = [spark.sparkContext.broadcast(bm.bitmap(x, "key", bits)) for x in both], None
    for part in range(PARTS):
        own = rare.where(F.col("key").bitwiseAND(F.lit(PARTS - 1)) == part)
        found = docs.mapInArrow(_rare(filters, bits, part), "at bigint, key bigint").join(own.select("key", "value"), "key")
        found = written(found.groupBy("at").agg(F.sum(F.col("value").cast("double")).alias("more")), "rare")
        sums = found if sums is None else sums.unionByName(found)
    for x in filters:
        x.destroy()
    return sums.groupBy("at").agg(F.sum("more").alias("more"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, size=1 << 18):
        e = Expressions(batch.column(1))
        n, of = len(e.pair), pa.array(e.of)
        keys = np.concatenate([e.pair, e.word, e.stem])
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([batch.column(0).take(of)] * 3), pa.array(signed(np.tile(e.pair, 3))), pa.array(np.repeat(np.arange(3, dtype=np.int32), n)), pa.array(signed(keys))],
            names=["at", "pair", "rank", "key"],
        )


def _joined_features(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """``at, f0, f1`` as ``_features`` gives them, by a join of all expressions with the model. Rows equal in id and text share what is found."""
    found = docs.mapInArrow(_occurrences, "at bigint, pair bigint, rank int, key bigint").join(ratios, "key", "left").groupBy("at", "pair")
    found = found.agg(F.coalesce(F.min_by("ratio", F.when(F.col("ratio").isNotNull(), F.col("rank"))), F.lit(0.0)).alias("ratio"))
    return found.groupBy("at").agg(F.avg("ratio").alias("f0"), F.max("ratio").alias("f1"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with intercept (last), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The packed texts of the documents with these labels, and whether they are ``toxic``. Only texts that may be labelled are shuffled for the join."""
    spark = docs.sparkSession
    bits = bm.bits_for(labels.count())
    filter_ = spark.sparkContext.broadcast(bm.bitmap(labels, "hash", bits))

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(bm.has(filter_.value, bits, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))
            packed = [zlib.compress((t or "").encode()) for t in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    packed = T.StructType([docs.schema["doc_id"], T.StructField("packed", T.BinaryType())])
    rows = docs.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(may_be, packed).join(labels.select("doc_id", "toxic"), "doc_id")
    return written(rows.select("packed", "toxic"), "labelled")


def counts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From all documents with ``labels`` (``doc_id, toxic, hash``): all pairs (``a, b, n1, n0``), the words' stems (``a, b``), and what ``_words`` tells of all words and contexts."""
    texts, out = _labelled(docs, labels), []
    for part in range(PARTS):
        rows = texts.mapInArrow(_counted(part, PARTS), "kind int, a bigint, b bigint, n1 bigint, n0 bigint")
        out.append(written(rows.groupBy("kind", "a", "b").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "pairs"))
    drop_scratch(docs.sparkSession, texts.scratch_path)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    pairs = every.where("kind = 0").drop("kind")
    return pairs, out[0].where("kind = 1").select("a", "b"), _words(pairs)


def _lookup(ratios: DataFrame, values: DataFrame) -> DataFrame:
    """``key, ratio, value``: the keys of both in order, null where one has none."""
    none = F.lit(None).cast("float")
    both = values.select("key", none.alias("ratio"), "value").unionByName(ratios.select("key", F.col("ratio").cast("float"), none.alias("value")))
    return _sorted(both.groupBy("key").agg(F.max("ratio").alias("ratio"), F.max("value").alias("value")), "frequent")


def _least_frequent(model: DataFrame, most: int, bound: int = 1000) -> int:
    """The least ``n`` of rows that at most ``most`` rows have or exceed."""
    sizes = {x.n: x.rows for x in model.groupBy(F.least("n", F.lit(bound)).alias("n")).agg(F.count("*").alias("rows")).collect()}  # ``bound`` rows at most
    least, rows = bound + 1, 0
    for n in sorted(sizes, reverse=True):
        if (rows := rows + sizes[n]) > most:
            return least if least <= bound else 1 << 62
        least = n
    return 0


def toxicity(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: ``doc_id, held_out, score, predicted``; ``likelihood``: the difference of its log-likelihoods as toxic and as ordinary text, by position; ``f0, f1, f2``: mean and largest
    log ratio of its attested expressions, and log of their number; last the columns ``carried``.

    A null or empty text has 0 in all four and the score of that. A null ``doc_id`` is never trained on and not held out. Of several labels of a
    document the largest counts; null labels and labels without a document don't. Where folds 1 to 4 lack either class there is nothing to compare: every
    score is 0. Repeated rows are scored each and, if labelled, counted each. Other columns are ignored, an empty table gives an empty
    result, and texts are scored whole: memory is bounded by the longest text, of which some 120 bytes a word are held.
    """
    spark = docs.sparkSession
    ship(spark)
    with shuffles_dropped(spark):
        return _scored(docs, labels, carried)


def _scored(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select((F.struct("doc_id", *carried) if carried else F.col("doc_id")).alias("doc_id"), "text")
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("at"), "text")
    docs = docs.select("doc_id", "text")
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))).where("fold > 0")
    labels = written(labels.withColumn("hash", F.xxhash64("doc_id")), "labels")
    with scratch_scope(spark) as keep:
        pairs, stems, words = counts(docs, labels.where("fold < 4"))
        model, unknown = values(pairs, words)
        keep(model)
        ratios = keep(log_ratios(_attested(pairs, stems, words)))
    joined = ratios.count() > MOST_BROADCAST
    least = _least_frequent(model, MOST_BROADCAST)
    frequent = _lookup(ratios.limit(0) if joined else ratios, model.where(F.col("n") >= least))
    if not joined:
        drop_scratch(spark, ratios.scratch_path)
    schema = T.StructType([keyed.schema["doc_id"], *T._parse_datatype_string("at bigint, f0 double, f1 double, f2 double, positions double, added double").fields])
    scored = written(keyed.mapInArrow(_features(frequent.scratch_path), schema), "compared")
    drop_scratch(spark, frequent.scratch_path)
    rows, more = scored, F.lit(0.0)
    if joined:
        found = _joined_features(keyed.select("at", "text"), ratios.select("key", F.col("ratio").cast("float").cast("double").alias("ratio")))
        rows = rows.drop("f0", "f1").join(found, "at", "left").fillna(0.0, ["f0", "f1"])
    if least:
        copies = scored.groupBy("at").agg(F.count("*").alias("copies"))
        sums = _rare_sums(keyed.select("at", "text"), model.where(F.col("n") < least)).join(copies, "at")
        rows, more = rows.join(sums, "at", "left"), F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    likelihood = F.when(F.col("positions") > 0, unknown + (F.col("added") + more) / F.col("positions")).otherwise(0.0).alias("likelihood")
    features = ["likelihood", "f0", "f1", "f2"]
    scored = written(rows.select("doc_id.*" if carried else "doc_id", likelihood, "f0", "f1", "f2"), "scored")
    fit = scored.join(labels.where("fold = 4").select("doc_id", "toxic"), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string"))).select(*features, "toxic").limit(CALIBRATION).toPandas()
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    if fit["toxic"].nunique() < 2 or labels.where("fold < 4").select("toxic").distinct().count() < 2:
        score = F.lit(0.0)
    else:
        b = _logistic(fit[features].to_numpy(), fit["toxic"].to_numpy())
        score = 1 / (1 + F.exp(-(sum(float(v) * F.col(x) for x, v in zip(features, b)) + float(b[-1]))))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *features, *carried)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, whatever their names. A prediction is of a text: rows of equal texts (told by a digest of 128 bits) stay or go together,
    rows that share a ``doc_id``, null ones too, don't. Null and empty texts have the score of no expressions, which is low where most labelled texts
    are ordinary. Repeated rows stay repeated; an empty table gives an empty result. Texts are scored whole, as ``toxicity`` says."""
    digest = lambda df: F.md5(F.coalesce(df["text"], F.lit("")))
    with scratch_scope(docs.sparkSession) as keep:
        bad = toxicity(docs.select("doc_id", "text", digest(docs).alias("bad_digest")), labels, ("bad_digest",)).where("predicted = 1").select("bad_digest").distinct()
        bad = keep(written(bad, "toxic"))
    return bm.without(docs, digest, bad, "bad_digest")
