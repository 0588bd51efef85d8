"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source documents are sorted by key in key ranges ("buckets"), prefix sums of sizes are
taken first over buckets and then inside each, and the source is cut at its exact budget: whole epochs first, then the documents in key order
until the words left are used up; the document at the cut is taken in part. No group of rows is larger than a bucket, whatever a source's share.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswright.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 500
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _positions(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last: range-sorted, with counts of the ranges before each."""
    ranged = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "before")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(F.broadcast(counts), "part").withColumn("position", F.col("before") + F.row_number().over(inside) - 1).drop("part", "before")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source, source_size, n_rows, target``.

    The excess over ``most`` times a source's size is shared again by weight among the others until no source is above. Only sums reach the driver.
    """
    sources = _positions(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("position") % len(weights)).cast("int") + 1)
    sources = written(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weights")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at_cap = F.col("cap") <= level * F.col("weight")
        held, open_weight, n = sources.agg(F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))), F.count_if(at_cap)).first()
        if n == full or not open_weight:
            break
        level, full = (total - held) / open_weight, n
    return sources.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).select("source", "source_size", "n_rows", "target")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: ``doc_id, source, size, source_size, target, taken, epochs, part``, and the ``carried`` columns.

    ``size`` is the number of words, 0 for null; ``taken`` = ``epochs * size + part`` words. A null source is a source of its own, sorted last. Rows that
    share a ``doc_id``, null ones too, are separate documents; equal rows may swap their ``taken``. Other columns are ignored, whatever their names. An empty
    table gives an empty result. The key is a digest of ``doc_id`` and ``seed``, so reruns agree. Words are counted in the whole text, however long.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    sized = written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *carried), "sizes")
    sources = written(targets(sized, weights, share, most), "targets")
    largest = sources.agg(F.max("n_rows")).first()[0] or 1
    buckets = ceil(largest / max(BUCKET_ROWS, isqrt(largest)))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sums, sources = sums.alias("b"), sources.alias("s")
    sums = sums.join(sources, F.expr("b.source <=> s.source")).selectExpr("b.source AS at_source", "b.bucket AS at_bucket", "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(sums, F.expr("source <=> at_source AND bucket = at_bucket"))
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs)
    start = F.col("before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - start)).cast("long")
    return placed.withColumn("part", part).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", *carried
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: each document as often as it has epochs, and once more cut after its first ``part`` words where the budget ends, with all columns of the documents and
    ``size, source_size, target, taken`` (the words of this copy) and ``copy`` (from 0), which replace columns of the same names.

    Documents without words, null texts among them, are kept once; of others those of which nothing is taken go. Equal rows are separate documents. The one
    document of a source that is cut has single spaces between its words. Other columns pass through, whatever their names; an empty table gives an empty result. Texts are counted whole, and
    only that of a cut is taken apart.
    """
    new = ["size", "source_size", "target", "taken", "copy"]
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.drop(*new).withColumn(row, F.monotonically_increasing_id()), "rows")
    shares = mixture(rows, carried=(row,)).alias("m")
    copies = F.when(F.col("m.size") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.concat(F.array_repeat(F.col("m.size"), F.col("m.epochs").cast("int")), F.when(F.col("m.part") > 0, F.array("m.part")).otherwise(F.array().cast("array<bigint>")))
    )
    shares = shares.select(F.col(f"m.{row}").alias("at"), *[F.col(f"m.{c}").alias(c) for c in new[:3]], F.posexplode(copies).alias("copy", "taken"))
    rows, shares = rows.alias("d"), shares.alias("s")
    whole = F.col("s.taken") >= F.col("s.size")
    text = F.when(whole, F.col("d.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("d.text", F.lit(WORD), 0), 1, F.col("s.taken").cast("int")), " "))
    out = rows.join(shares, F.col(f"d.{row}") == F.col("s.at"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("d.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    kept = [changed.get(c, F.col(f"d.`{c.replace('`', '``')}`")).alias(c) for c in docs.columns if c not in new]
    return out.select(*kept, *[F.col(f"s.{c}").alias(c) for c in new])
