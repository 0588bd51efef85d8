"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

A window is ``window`` successive words of a benchmark item, or all words of a shorter item. Since a document must hold
*every* shingle of a window, a prefix of one shingle is necessary: the one that is rarest in all documents. Only that shingle is joined;
length and position bounds drop candidates whose window would not fit in the text, and the words around each candidate are compared with the
window's words. All occurrences of all windows are found.

Documents are read twice (shingle counts, then candidates) and never shuffled. What is broadcast is a bitmap of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm import bitmap as bm
from glosswright.llm.words import LETTERS, Words, grams, pieces, signed
from glosswright.session import scratch_scope, ship, written

WINDOW = 10
SHINGLE = 3


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column(1), True, LETTERS)
            out: list[tuple] = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, count = int(w.first[i]), int(w.counts[i])
                n = min(window, count)
                for s in range(a, a + count - n + 1) if n else ():
                    k = min(shingle, n)
                    out.append((item, w.text(s, s + n), n, signed(grams(w.h[s : s + n], k, seed=k)).tolist()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))],
                names=["item_id", "words", "n", "shingles"],
            )

    return run


def _counts(sizes: list[int], filter_, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = filter_.value
        for batch in pieces(batches):
            w = Words(batch.column(0), True, LETTERS)
            left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts))
            for k in sizes:
                g = grams(w.h, k, seed=k)
                g = g[(left[: len(g)] >= k)]
                found, count = np.unique(g[bm.has(words, bits, g)], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(count)], names=["shingle", "count"])

    return run


def _candidates(sizes: list[int], filter_, bits: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = filter_.value, TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            w = Words(batch.column(1), True, LETTERS)
            of, place = w.of, w.place()
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k in sizes:
                g = grams(w.h, k, seed=k)
                for s in np.flatnonzero(bm.has(words, bits, g) & (place[: len(g)] + k <= w.counts[of[: len(g)]])):
                    i = of[s]
                    low, high = max(int(w.first[i]), s - window + k), min(int(w.first[i + 1]), s + window)
                    found[i].append({"shingle": int(signed(g[s : s + 1])[0]), "at": int(place[s]), "low": int(place[low]), "around": w.text(low, high)})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)),
                    batch.column(0),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(found, pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("around", pa.string())]))),
                ],
                names=["row", "doc_id", "n_words", "found"],
            )
            row += batch.num_rows

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits``.

    ``hits`` lists the covered word spans as ``(start, end)``. Null and empty texts have no words, are never hit and hit nothing; repeated
    document rows each get their own result; repeated items count once per ``item_id``, and a null ``item_id`` is no item. With an empty
    benchmark nothing is hit, and no documents give no rows. Columns other than the ids and texts are ignored; null ids are like others. Texts are read whole: a task
    holds some 60 bytes for each word of the longest.
    """
    spark = docs.sparkSession
    ship(spark)
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("item_id IS NOT NULL")
    id_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    windows = written(
        benchmark.mapInArrow(_windows(window, shingle), T.StructType([T.StructField("item_id", item_type), *T._parse_datatype_string("words string, n int, shingles array<bigint>").fields])),
        "windows",
    )
    sizes = sorted({min(r.n, shingle) for r in windows.select("n").distinct().collect()})  # at most `window` lengths
    shingles = windows.dropDuplicates(["words"]).select("words", "n", F.posexplode("shingles").alias("offset", "shingle"))
    bits = bm.bits_for(windows.count())
    seen = (
        docs.select("text")
        .mapInArrow(_counts(sizes, spark.sparkContext.broadcast(bm.bitmap(shingles, "shingle", bits)), bits), "shingle bigint, count bigint")
        .groupBy("shingle")
        .agg(F.sum("count").alias("count"))
    )
    # A window with a shingle that no document has can't occur; of the others the rarest shingle is the prefix.
    prefixes = written(
        shingles.join(seen, "shingle", "left")
        .groupBy("words", "n")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("rarest"))
        .where("rarest.count > 0")
        .select("words", "n", "rarest.shingle", "rarest.offset"),
        "prefixes",
    )
    bits = bm.bits_for(prefixes.count())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), *T._parse_datatype_string("n_words bigint, found array<struct<shingle:bigint,at:int,low:int,around:string>>").fields])
    texts = written(docs.mapInArrow(_candidates(sizes, spark.sparkContext.broadcast(bm.bitmap(prefixes, "shingle", bits)), bits, window), schema), "candidates")
    start = F.col("at") - F.col("offset")
    hits = written(
        texts.select("row", "n_words", F.explode("found").alias("f"))
        .select("row", "n_words", "f.*")
        .join(prefixes, "shingle")
        .where((start >= F.col("low")) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split("around", " "), start - F.col("low") + 1, F.col("n")), " ") == F.col("words"))
        .select("row", "words", start.alias("start"), (start + F.col("n")).alias("end"))
        .distinct(),
        "hits",
    )
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        hits.select("row", "start", "end")
        .distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))))
        .groupBy("row")
        .agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))
    )
    items = (
        hits.select("row", "words")
        .distinct()
        .join(windows.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words")
        .select("row", "item")
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        texts.select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "hits",
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns, whatever their names.

    Texts are judged: rows of equal texts (told by a digest of 128 bits) stay or go together, rows that share a ``doc_id``, null ones too, don't. Null and empty texts stay; repeated
    rows stay repeated; an empty table gives an empty result. Texts are read whole, as ``contamination`` says.
    """
    digest = lambda df: F.md5(F.coalesce(df["text"], F.lit("")))
    with scratch_scope(docs.sparkSession) as keep:
        bad = contamination(docs.select(digest(docs).alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("bad_digest")).distinct()
        bad = keep(written(bad, "contaminated"))
    return bm.without(docs, digest, bad, "bad_digest")
