"""Spelling variants: words one edit apart, found by a pigeonhole join, and grouped under their most frequent spelling.

A word is cut into two even segments. One edit leaves one of the two as it is: the first at the beginning of the other word, the second at its end, shifted by the difference of the
lengths. Each word is indexed under both of its segments, and probes with its beginnings and ends as the segments of words that are as long or a character shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.llm.words import ascii_lower
from glosswright.session import written

LEAST_LENGTH, LEAST_COUNT, FACTOR, CUT = 5, 3, 2, 97
_LETTER = "[A-Za-zÀ-ÿ]"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, cut: int = CUT) -> DataFrame:
    """``word, n``: lower-cased runs of letters, of which one in ``cut`` (by a checksum of document and run) has lost a character.

    Counted before the shuffle; words in fewer than ``least_count`` places go after the sum over all documents. A null ``doc_id`` is an empty one.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{_LETTER}{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode_outer(runs).alias("run")).where("run IS NOT NULL")  # a plain explode would extract twice, for an inferred filter too
    rows = rows.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % cut == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keys(length: Column) -> Column:
    """The keys of a word under which those of a length differ from it in one segment: ``size``, the other ``part`` and its ``segment``, and the character at one ``side`` of what differs.

    One edit of two characters or more leaves the first or the last of them, so that words meet which share more than a segment.
    """
    first = F.floor(length / 2).cast("int")
    word, long = F.col("word"), F.length("word")
    parts = [(1, F.left(word, first), first + 1, long), (2, F.right(word, length - first), F.lit(1), long - (length - first))]
    each = [(part, segment, side, F.substring(word, at, F.lit(1))) for part, segment, *ends in parts for side, at in enumerate(ends)]
    return F.array(*[F.struct(length.alias("size"), F.lit(part).alias("part"), segment.alias("segment"), F.lit(side).alias("side"), c.alias("c")) for part, segment, side, c in each])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` with their counts: each pair of different words that are one inserted, deleted or replaced character apart, once; ``a`` isn't the longer one. Words have
    four characters at least."""
    size = F.length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(size)).alias("key"))
    probes = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(_keys(size), _keys(size - 1))).alias("key"))
    index, probes = (df.select(*df.columns[:2], "key.*") for df in (index, probes))
    # Spark takes exploded rows for as small as the words that they come of, and would send them all through the driver.
    pairs = index.join(probes.hint("merge"), ["size", "part", "segment", "side", "c"])
    # Words of one length meet in either order, a word meets itself, and a pair may have both segments or both sides in common.
    half = F.floor(F.col("size") / 2).cast("int")
    once = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    segment = (F.col("part") == 1) | ~F.startswith("b", F.left("a", half))
    place = F.when(F.col("part") == 1, half + 1).otherwise(1)
    side = (F.col("side") == 0) | (F.substring("a", place, F.lit(1)) != F.substring("b", place, F.lit(1)))
    return pairs.where(once & segment & side & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of each chain of forms. Each round doubles the way; a chain is at most as long as counts can double, so there are few."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(roots.join(step.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        roots = after.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, cut: int = CUT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word: its most frequent near word, if that is ``factor`` times as frequent, and the last of the forms of forms.

    Null and empty texts have no words; repeated rows and ids count each; of near words with the same count the smallest is the form. Other columns are ignored; an empty
    table gives an empty result. Texts are read whole.
    """
    found = written(words(docs.select("doc_id", "text"), least_length, least_count, cut), "words")
    both = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{x}").alias("n"), F.col(f"n_{y}").alias("near_n"))
    near = near_pairs(found).select(F.explode(F.array(both("a", "b"), both("b", "a"))).alias("x")).select("x.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"), F.first("n").alias("own"))
    enough = -F.col("best.m") >= factor * F.col("own")
    best = written(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "near")
    roots = _roots(best.where("form IS NOT NULL"))
    out = found.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
