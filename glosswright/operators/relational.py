"""Joins, windows and counters of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswright.functions import text as t


def with_scrape_time(posts: DataFrame, seen: DataFrame) -> DataFrame:
    """Each post with the time in the seen table, null where it isn't there; Spark broadcasts the table only where it is small."""
    return posts.join(seen.select("post_id", F.col("timestamp").alias("scrape_time")), "post_id", "left")


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` of the keys that are neither empty nor repeated."""
    return df.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def resolve_provenance(merged: DataFrame, origin: DataFrame) -> DataFrame:
    """``merged`` (``source, caption``) with ``post_id, folder, resolved_by`` from ``origin`` (``folder, post_id, caption``).

    First by the folder at the end of ``source``; a folder found whose id is empty ends the search unresolved. Then by a caption that occurs once in ``origin``.
    """
    by_folder = origin.select(F.col("folder").alias("f"), F.coalesce("post_id", F.lit("")).alias("f_id"))
    by_caption = unique_by(origin.select("folder", t.strip(F.col("caption")).alias("c")), "c", "folder").withColumnRenamed("folder", "c_folder")
    ids = origin.select(F.col("folder").alias("c_folder"), F.col("post_id").alias("c_id"))
    out = merged.withColumn("tail", t.path_tail(F.col("source"))).withColumn("own", t.strip(F.col("caption")))
    out = out.join(by_folder, F.col("tail") == F.col("f"), "left").join(by_caption.join(ids, "c_folder"), F.col("own") == F.col("c"), "left")
    how = F.when(F.col("f_id") != "", "source_index").when(F.col("f_id").isNull() & (F.col("c_id") != ""), "caption_match").otherwise("unresolved")
    out = out.withColumn("resolved_by", how)
    pick = lambda a, b: F.when(how == "source_index", F.col(a)).when(how == "caption_match", F.col(b))
    return out.withColumn("post_id", pick("f_id", "c_id")).withColumn("folder", pick("f", "c_folder")).drop("tail", "own", "f", "f_id", "c", "c_folder", "c_id")


def trace_index(origin: DataFrame, merged: DataFrame) -> DataFrame:
    """One row per id of either side: ``origin`` (``id, author_id, post_url, scrape_time, folder``) upserted with ``merged`` (``…, folder, label``).

    Of several rows of an id that of the greatest folder counts. ``has_label`` is the merged side's.
    """
    cols = ("author_id", "post_url", "scrape_time")
    last = lambda df, extra: df.where("id IS NOT NULL AND id <> ''").groupBy("id").agg(*[F.max_by(c, "folder").alias(c) for c in (*cols, *extra)], F.max("folder").alias("folder"))
    a, b = last(origin, ()).alias("a"), last(merged, ("label",)).alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    return both.select(
        F.coalesce("b.id", "a.id").alias("post_id_numeric"),
        *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols],
        F.col("a.folder").alias("v11_folder"),
        F.col("b.folder").alias("merged_folder"),
        t.has_label(F.col("b.label")).alias("has_label"),
    )


def lookup(index: DataFrame, wanted: Column | str | int, key: str = "post_id_numeric") -> DataFrame:
    """The rows of an id; the filter reaches the Parquet scan."""
    return index.where(F.col(key) == wanted)


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``seen``: new posts, unfinished work, outputs to make."""
    return rows.join(seen.select(key), key, "left_anti")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in an order, by a partial aggregate."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("x_")).select(*key, "x_.*")


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key isn't in it, one a key."""
    return old.unionByName(unseen(new.dropDuplicates([key]), old, key))


def lookup_or_scan(index: DataFrame, documents: DataFrame, wanted: str, key: str = "post_id_numeric") -> DataFrame:
    """The rows of an id in the index, else those of the documents themselves, with ``found_by``; both filters reach the scans."""
    hit = lookup(index, wanted, key)
    scanned = unseen(lookup(documents, wanted, key), hit, key)
    return hit.withColumn("found_by", F.lit("index")).unionByName(scanned.withColumn("found_by", F.lit("scan")))


def cache_probe(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """Posts (``post_id``) with their detections (``num_columns``, …); those without columns or not in the cache with a ``reason`` to fail."""
    out = ids.join(cache, "post_id", "left")
    return out.withColumn("reason", F.when(F.coalesce("num_columns", F.lit(0)) <= 0, "no columns"))


def numeric_folders(rows: DataFrame, name: str, low: int, high: int) -> DataFrame:
    """Rows whose name is a number from ``low`` to ``high``, by number."""
    number = F.when(F.col(name).rlike("^[0-9]+$"), F.col(name)).try_cast("long")
    return rows.where(number.between(low, high)).orderBy(number)


def with_prefix(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    return rows.where(F.col(name).startswith(prefix))


def projected(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The columns of ``keys`` (names and types), null where ``rows`` has none."""
    return rows.select(*[(F.col(k) if k in rows.columns else F.lit(None)).cast(kind).alias(k) for k, kind in keys.items()])


def at_most(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order; all for a target of 0."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def tallies(rows: DataFrame, **conditions: Column) -> DataFrame:
    """``n`` rows, and how many meet each condition, in one pass."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def greatest_folder(name: Column) -> Column:
    """The greatest number among names; others don't count, and without any it is 0."""
    return F.coalesce(F.max(F.when(name.rlike("^[0-9]+$"), name).try_cast("long")), F.lit(0))


def zip_replies(order: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each ``job, ordinal, post_id`` with the job's reply at that place of ``replies``; missing replies are empty, surplus ones go."""
    replies = jobs.select("job", F.posexplode("replies").alias("ordinal", "reply"))
    return order.join(replies, ["job", "ordinal"], "left").withColumn("reply", F.coalesce("reply", F.lit("")))


def duplicate_streak(arrivals: DataFrame, session: str, order: list[str], key: str, known: Column, stop: int = 300, start: int = 0) -> DataFrame:
    """Arrivals with ``status`` (new, duplicate, repeated), the length of the running streak of duplicates, and whether it reaches ``stop``.

    ``known`` tells ids seen before. What a session repeats doesn't count; a new id ends a streak. Sessions are independent, and begin with a streak of ``start``. No
    session is one task's work: arrivals are sorted into ranges, and each range goes on from the streak in which those before it end.
    """
    from glosswright.session import written

    first = F.row_number().over(Window.partitionBy(session, key).orderBy(*order)) == 1
    out = arrivals.withColumn("first", first)
    out = out.withColumn("status", F.when(~F.col("first"), "repeated").when(known, "duplicate").otherwise("new")).drop("first")
    out = written(out.repartitionByRange(session, *order).withColumn("part_", F.spark_partition_id()), "arrivals")
    new, duplicate = F.col("status") == "new", F.col("status") == "duplicate"
    upto = Window.partitionBy(session, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(session, "part_", "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("island_", F.count_if(new).over(upto)).withColumn("streak", F.count_if(duplicate).over(inside))
    # A row for each session and range: the streak at its end, and which of its predecessors go on into it.
    ends = out.groupBy(session, "part_").agg(F.max_by("streak", F.struct("island_", "streak")).alias("tail"), (F.max("island_") > 0).cast("int").alias("ended"))
    by = Window.partitionBy(session).orderBy("part_")
    ends = ends.withColumn("run", F.sum("ended").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("sum_", F.sum("tail").over(Window.partitionBy(session, "run").orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("run") == 0, start).otherwise(0))
    ends = ends.select(F.col(session).alias("of_"), F.col("part_").alias("at_"), F.coalesce(F.lag("sum_").over(by), F.lit(start)).alias("carried_"))
    out = out.join(ends, F.col(session).eqNullSafe(F.col("of_")) & (F.col("part_") == F.col("at_")))
    out = out.withColumn("streak", F.col("streak") + F.when(F.col("island_") == 0, F.col("carried_")).otherwise(0)).drop("part_", "island_", "of_", "at_", "carried_")
    return out.withColumn("stop", (F.col("streak") >= stop) & (F.col("status") == "duplicate"))


def silences(events: DataFrame, key: list[str], ts: str, seconds: int = 120) -> DataFrame:
    """Sessions of ``key`` ended by more than ``seconds`` without an event: ``key, session, started, ended, n``."""
    order = Window.partitionBy(*key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp")) > seconds * 1_000_000
    out = events.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    out = out.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def numbered(rows: DataFrame, order: list[str], start: int | Column = 0, column: str = "number", within: int = 1000) -> DataFrame:
    """Rows numbered from ``start`` + 1 in a total order, without one task that sees them all: ranges are sorted and counted, then numbered inside."""
    from glosswright.session import written

    ranged = written(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = ranged.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("part_").orderBy(*order)
    at = F.lit(start) if isinstance(start, int) else start
    return ranged.join(F.broadcast(counts), "part_").withColumn(column, at + F.col("before_") + F.row_number().over(inside)).drop("part_", "before_")


def numbered_after(rows: DataFrame, order: list[str], most: DataFrame, column: str = "number") -> DataFrame:
    """Rows numbered on from the one value of ``most``."""
    start = most.limit(1).select(F.col(most.columns[0]).alias("start_"))
    out = numbered(rows, order, 0, column).crossJoin(F.broadcast(start))
    return out.withColumn(column, F.col(column) + F.col("start_")).drop("start_")


def chunked(rows: DataFrame, order: list[str], size: int = 80) -> DataFrame:
    """Rows with ``chunk`` and ``ordinal`` in it, by order."""
    out = numbered(rows, order, column="n_")
    return out.withColumn("chunk", F.floor((F.col("n_") - 1) / size)).withColumn("ordinal", (F.col("n_") - 1) % size).drop("n_")


def lexical_slice(rows: DataFrame, name: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by name as text."""
    return rows.orderBy(F.col(name).cast("string")).offset(offset).limit(limit)


def first_image(files: DataFrame) -> DataFrame:
    """Of each post (``post_id, name``) the first ``.jpg`` by name, else the first file."""
    return files.groupBy("post_id").agg(F.min(F.struct((~F.col("name").endswith(".jpg")).alias("k"), F.col("name")))["name"].alias("name"))


def seeded_sample(rows: DataFrame, key: str, n: int = 100, seed: int = 100) -> DataFrame:
    """``n`` rows in the order of a hash of their key: the same for each run."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def corpus_stats(rows: DataFrame, text: str, score: str, kept: str = t.HAN) -> DataFrame:
    """``posts, passed, mean_score, median_score, distinct_chars``; scores of null are rejects.

    Each text's characters are made distinct in its row; the median is found among the range of scores that holds it, not in one task.
    """
    own = F.array_distinct(F.split(t.keep_chars(F.col(text), kept), ""))
    chars = rows.select(F.explode(own).alias("c")).where("c <> ''").agg(F.count_distinct("c").alias("distinct_chars"))
    stats = rows.agg(F.count("*").alias("posts"), F.count(score).alias("passed"), F.avg(score).alias("mean_score"))
    ranked = numbered(rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score_")), ["score_"], column="at_")
    half = stats.select(F.floor((F.col("passed") + 1) / 2).alias("low_"), F.ceil((F.col("passed") + 1) / 2).alias("high_"))
    median = ranked.join(F.broadcast(half), F.col("at_").between(F.col("low_"), F.col("high_"))).agg(F.avg("score_").alias("median_score"))
    return stats.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(chars))


def fix_deltas(before: DataFrame, after: DataFrame, caption: str = "caption") -> DataFrame:
    """Counters of a fixing pass over ``post_id, label, columns`` and the caption: changed labels and columns, characters gained, labels that gained any, captions with
    bracketed annotations, skipped."""
    b = before.select("post_id", F.col("label").alias("l0"), F.col("columns").alias("c0"), F.coalesce(F.col(caption), F.lit("")).alias("caption_"))
    both = b.join(after.select("post_id", "label", "columns"), "post_id", "left")
    changed = F.coalesce(F.col("label") != F.col("l0"), F.lit(False))
    return both.agg(
        F.count_if(changed).alias("labels_changed"),
        F.count_if(F.coalesce(F.col("columns") != F.col("c0"), F.lit(False))).alias("columns_changed"),
        F.coalesce(F.sum(F.when(changed, F.length("label") - F.length("l0"))), F.lit(0)).alias("chars_gained"),
        F.count_if(F.coalesce(F.length("label") > F.length("l0"), F.lit(False))).alias("labels_longer"),
        F.count_if(t.strip_annotations(F.col("caption_")) != F.col("caption_")).alias("annotated"),
        F.count_if(F.col("label").isNull()).alias("skipped"),
    )


def cache_counts(cache: DataFrame) -> DataFrame:
    """How many posts a cache of detections has, with and without columns."""
    n = F.coalesce("num_columns", F.lit(0))
    return tallies(cache, with_columns=n > 0, without_columns=n <= 0)


def best_by(rows: DataFrame, key: list[str], measure: str, *ties: Column) -> DataFrame:
    """Of the rows of each key that of the greatest measure, then of the greatest ``ties``, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(measure), *ties)).alias("x_")).select(*key, "x_.*")
