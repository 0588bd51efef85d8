"""Source divergence audit: how far the sources of a language are apart in their terms, and which terms set a source apart.

Tasks count the terms of their own texts; only these counts are shuffled, once, by language and term. Each term of a language becomes a wide vector, an array of its counts by source. Higher-order functions turn a vector into contributions to pairs of sources,
which are summed before the shuffle. Terms that neither source of a pair has contribute the same amount each: that part is multiplied, not emitted, so that
a term of few sources emits pairs with those sources only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.llm.words import give_back
from glosswright.session import ship, written

#: Bytes of texts: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` with A to Z in lower case, spaces in place of all others.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms of languages and sources that a task holds before it hands them on.
HELD = 1 << 20
LEAST_DOCS, PRIOR, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50


def _share(count: Column, total: Column, terms: Column, prior: int, scale: int) -> Column:
    """``1 + floor(scale * (count + prior) / (total + prior * terms))`` in whole numbers of up to 38 digits; 0 without terms."""
    part = lambda x: F.lit(x).cast("decimal(38,0)")
    return F.when(terms > 0, 1 + F.call_function("div", part(scale) * (count + prior), (total + prior * terms).cast("decimal(20,0)"))).otherwise(F.lit(0).cast("long"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs``: how often the task's texts of a language and source have a term, and how many have it; a term comes again where a task holds more than ``HELD``."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        while held:
            (lang, source), (times, docs) = held.popitem()
            terms, n, of = pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64()), pa.array([docs[x] for x in times], pa.int64())
            for i in range(0, len(terms), 50_000):
                some = terms.slice(i, 50_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), some.view(pa.string()), n.slice(i, 50_000), of.slice(i, 50_000)], names=["lang", "source", "term", "n", "docs"])
        give_back()

    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            terms = text.as_py().translate(TERM).split()
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            times.update(terms)
            docs.update(set(terms))
        if sum(len(times) for times, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, cells``: the terms in at least ``least_docs`` documents of a language, with their counts by source (an array of ``source, n``)."""
    ship(docs.sparkSession)
    rows = docs.select("text", "lang", "source").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # Tasks have summed up their own rows, so those of a frequent term are few; both sums need no further shuffle.
    counts = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return vectors.where(F.col("docs") >= least_docs).drop("docs")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, prior: int = PRIOR, scale: int = SCALE, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language its distance to each other one (``pair``) and its most overused terms (``term``).

    Null and empty values of ``text``, ``lang`` and ``source`` are the same; a source without terms still has its pairs, a language without kept terms has
    distances of 0, a source alone in its language has none. Every row counts as a document, repeated or not; other columns are ignored; an empty table gives an empty result. Ties are ordered by
    item. Texts of any length are counted whole, in memory of the order of the longest text. A row of vectors holds a count for each source of
    its language, as many pairs as the result has itself at most.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    vectors = written(term_vectors(docs, least_docs), "vectors")
    totals = vectors.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("g"))
    groups = groups.join(kept, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    share = lambda count, total: _share(count, total, F.col("terms"), prior, scale)
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    groups = groups.withColumn("unseen", F.transform("totals", lambda n: share(F.lit(0).cast("long"), n))).withColumn("all", add(F.col("totals")))
    groups = written(groups, "groups")

    wide = vectors.join(groups, "lang").withColumn("own", F.map_from_entries("cells")).withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("own", s), F.lit(0).cast("long"))))
    wide = wide.withColumn("p", F.transform("counts", lambda c, i: share(c, F.get("totals", i)))).withColumn("q", share(add(F.col("counts")), F.col("all"))).drop("cells", "own")

    places = F.sequence(F.lit(0), F.size("sources") - 1)
    apart = lambda values, i, j: F.abs(F.get(values, i) - F.get(values, j))
    pair = lambda i, j, value: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), value.alias("value"))
    others = lambda i: F.filter(places, lambda j: (F.get("counts", j) == 0) | (j > i))
    more = lambda i, j: apart("p", i, j) - apart("unseen", i, j)
    has = F.filter(places, lambda i: F.get("counts", i) > 0)
    contributed = wide.select("lang", F.explode(F.flatten(F.transform(has, lambda i: F.transform(others(i), lambda j: pair(i, j, more(i, j)))))).alias("x"))
    base = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: pair(i, j, F.col("terms") * apart("unseen", i, j)))))
    pairs = contributed.unionByName(groups.select("lang", F.explode(base).alias("x"))).groupBy("lang", "x.a", "x.b").agg(F.sum("x.value").alias("value"))
    pairs = pairs.join(groups.select("lang", "sources"), "lang")
    name = lambda i: F.get("sources", F.col(i))
    pairs = pairs.select("lang", "value", F.explode(F.array(*[F.struct(name(x).alias("source"), name(y).alias("item")) for x, y in ("ab", "ba")])).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    over = F.transform(F.filter(has, lambda i: F.get("p", i) > F.col("q")), lambda i: F.struct(F.get("sources", i).alias("source"), (F.get("p", i) - F.col("q")).alias("value")))
    terms = wide.select("lang", "term", F.explode(over).alias("x")).select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), "x.value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows: rows.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= most_terms))
