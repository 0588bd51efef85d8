"""Feed ingestion as a stream of landed responses: walk, drop seen ids, append posts, then mark them seen."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswright.functions import text as t
from glosswright.operators import jsontree as j
from glosswright.operators.relational import duplicate_streak, unseen
from glosswright.session import written
from glosswright.sources import files, sinks


def walked_responses(responses: DataFrame, key: str) -> DataFrame:
    """The walk of the lines of landed responses; ``key`` and ``line_no`` order them."""
    return j.walked(files.response_lines(responses, [key]), [key, "line_no"])


def posts_in(tree: DataFrame, key: str, group: str, kept: str = t.HAN_EXT, require_height: bool = True, bare_ids: bool = True) -> DataFrame:
    """The posts of walked responses: ids in order of appearance, captions, pictures, metadata and disposition."""
    found = j.posts(tree, [key, "line_no"], bare_ids)
    found = written(found.groupBy("post_id").agg(F.min(F.struct(key, "line_no", "first_pos")).alias("at"), F.min_by("node", F.struct(F.col("node").isNull(), key, "line_no")).alias("node")), "found")
    facts = j.post_facts(j.walked(found.where("node IS NOT NULL"), ["post_id"], "node", ()), ["post_id"], "post_id", group, require_height)
    out = found.select("post_id", "at", j.caption(F.col("node")).alias("caption")).join(facts, "post_id", "left")
    out = out.withColumn("image_urls", F.coalesce("image_urls", F.array().cast("array<string>"))).withColumn("img_count", F.size("image_urls"))
    return out.withColumn("disposition", t.disposition(F.col("image_urls"), t.skip_reason(F.col("caption"), kept)))


def posts_of(responses: DataFrame, key: str, group: str, kept: str = t.HAN_EXT, require_height: bool = True, bare_ids: bool = True) -> DataFrame:
    """The posts of landed responses, whose lines are walked once."""
    return posts_in(walked_responses(responses, key), key, group, kept, require_height, bare_ids)


def streak_of(posts: DataFrame, seen: DataFrame, stop: int, start: int = 0) -> DataFrame:
    """Arrivals of a batch with the running streak of already seen ids, which goes on from ``start``."""
    known = seen.select("post_id").distinct().withColumn("known", F.lit(True))
    rows = posts.select("post_id", "at", F.lit("batch").alias("session")).join(known, "post_id", "left")
    return duplicate_streak(rows, "session", ["at"], "post_id", F.coalesce("known", F.lit(False)), stop, start)


def _streak_before(spark: SparkSession, path: str, batch: int) -> int:
    """The streak that the batches before have left."""
    rows = files.results(spark, path, "streak long, batch long").where(F.col("batch") < batch)
    found = rows.agg(F.max_by("streak", "batch").alias("streak")).first()
    return found["streak"] or 0


def ingest(responses: DataFrame, posts_path: str, seen_path: str, cursor_path: str, checkpoint: str, group: str, key: str = "received_at", stop: int = 300, on_stop: Callable[[], None] | None = None, kept: str = t.HAN_EXT) -> StreamingQuery:
    """Runs the stream until its input is used up. Posts and marks of a batch are partitions that a repeat of the batch overwrites, and the repeat doesn't take its own marks
    for seen: however often a batch is begun, each of its posts is there once. Then the batch is put on the manifest (``<posts_path>-batches``), which ``files.whole_batches`` reads.

    Two streams with checkpoints of their own may share posts and a seen table. The streak of duplicates goes on from batch to batch and over restarts: it is kept by batch
    beside the checkpoint. ``on_stop`` is called when it reaches ``stop``.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        spark, label = rows.sparkSession, f"{stream}-{number:09d}"
        tree = written(walked_responses(rows, key), "tree")
        posts = written(posts_in(tree, key, group, kept), "posts")
        seen = files.seen_near(spark, seen_path, posts, label)
        new = written(unseen(posts, seen, "post_id"), "new")
        sinks.append_posts(new.where("disposition = 'kept'").drop("at", "disposition"), posts_path, batch=label)
        cursors = j.end_cursors(tree, [key]).agg(F.max_by("cursor", key).alias("cursor"))
        if cursors.where("cursor IS NOT NULL").count():
            sinks.store_cursor(cursors, cursor_path)
        ends = None
        if on_stop:
            before = _streak_before(spark, f"{checkpoint.rstrip('/')}-streak", number)
            ends = streak_of(posts, seen, stop, before).agg(F.max_by("streak", "at").alias("last"), F.coalesce(F.bool_or("stop"), F.lit(False)).alias("stop")).first()
            last = before if ends["last"] is None else ends["last"]
            spark.createDataFrame([(last,)], "streak long").write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}-streak/batch={number}")
        sinks.mark_seen(new, seen, seen_path, label)
        sinks.commit_batch(spark, f"{posts_path.rstrip('/')}-batches", label)
        if ends and ends["stop"]:
            on_stop()

    return responses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """A stream's first event of each key; state older than ``late`` is dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def supervise(start: Callable[[], StreamingQuery], runs: int, seconds: float) -> int:
    """Starts a query again until it ends by itself in time; how many runs it took."""
    for n in range(1, runs + 1):
        query = start()
        if query.awaitTermination(seconds):
            return n
        query.stop()
    return runs
