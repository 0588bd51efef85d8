"""Sinks of the corpus tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from glosswright.functions.text import safe_id
from glosswright.operators.relational import appended, unseen
from glosswright.session import dealt, in_store, ship, written

#: The index's columns in their order.
INDEX_COLUMNS = ("post_id_numeric", "author_id", "post_url", "v11_folder", "merged_folder", "scrape_time", "has_label")
INDEX = ", ".join(f"{c} {'boolean' if c == 'has_label' else 'string'}" for c in INDEX_COLUMNS)
INDEX_KEYS, INDEX_BUCKETS = ("post_id_numeric", "post_url", "v11_folder"), 64

#: How names of archives of small files end; files and bytes that one holds at most, or one file.
ARCHIVE, ARCHIVED, ARCHIVED_BYTES = ".files.zip", 4096, 1 << 24

#: The seen table's columns, and the number of buckets it is dealt out to.
SEEN, SEEN_BUCKETS = "post_id string, timestamp timestamp, batch string, bucket int", 256


def append_posts(posts: DataFrame, path: str, with_images_only: bool = False, batch: str | None = None) -> None:
    """Appends posts as newline-delimited JSON, with their folder name. Those of a ``batch`` are a partition of their own, which a repeat overwrites."""
    if with_images_only:
        posts = posts.where(F.size("image_urls") > 0)
    posts = posts.withColumn("folder", safe_id(F.col("post_id")))
    if batch is None:
        posts.write.mode("append").json(path)
    else:
        posts.write.mode("overwrite").json(f"{path}/batch={batch}")


def commit_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Puts a batch on the manifest of a table: readers of whole batches see it from now on. A repeat changes nothing."""
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").json(f"{path}/batch={batch}")


def export_posts(posts: DataFrame, path: str) -> None:
    """Each post as a document in a folder of its own, under its sanitised id."""
    write_files(posts.select(safe_id(F.col("post_id")).alias("folder"), F.lit("post_info.json").alias("name"), F.to_json(F.struct(*posts.columns)).alias("content")), path)


def write_files(rows: DataFrame, path: str) -> None:
    """Each row (``folder, name, content``; text or bytes) as a file of its own. A repeated task writes the same files again."""
    ship(rows.sparkSession)
    rows = dealt(rows.select("folder", "name", F.col("content").cast("binary").alias("content")), "folder", "name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = in_store(path)
        for batch in batches:
            for folder, name, content in zip(*[c.to_pylist() for c in batch.columns]):
                store.create_dir(f"{at}/{folder}")
                with store.open_output_stream(f"{at}/{folder}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Archives of rows (``folder, name, content``) in their order; of rows of one file the first counts."""
    held, archive, last = io.BytesIO(), None, None
    for batch in batches:
        for folder, name, content in zip(*[c.to_pylist() for c in batch.columns]):
            if (folder, name) == last:
                continue
            archive, last = archive or zipfile.ZipFile(held, "w"), (folder, name)
            archive.writestr(zipfile.ZipInfo(f"{folder}/{name}"), content or b"")
            if len(archive.infolist()) >= ARCHIVED or held.tell() >= ARCHIVED_BYTES:
                archive.close()
                yield held.getvalue()
                held, archive = io.BytesIO(), None
    if archive:
        archive.close()
        yield held.getvalue()


def write_archives(rows: DataFrame, path: str) -> None:
    """Each row (``folder, name, content``; text or bytes) as a file in one of many archives in one folder, as ``files.images`` reads them.

    A folder and a file of its own for each of millions of small files needs more inodes and blocks than a disk has. A repeated task writes the same archives again.
    """
    ship(rows.sparkSession)
    rows = dealt(rows.select("folder", "name", F.col("content").cast("binary").alias("content")), "folder", "name").sortWithinPartitions("folder", "name", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = in_store(path)
        store.create_dir(at)
        task = TaskContext.get()
        for k, data in enumerate(_archives(batches)):
            name = f"{task.partitionId():05}-{k:05}{ARCHIVE}"
            made = f"{at}/.{task.taskAttemptId()}-{name}"
            with store.open_output_stream(made, compression=None) as out:
                out.write(data)
            store.move(made, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def export_samples(passes: DataFrame, pictures: DataFrame, path: str) -> None:
    """Each pass (``post_id, label, caption`` and what else its document holds) as a folder: its picture (``post_id, name, content``), label, caption and document.

    Rejects have no label and aren't written; a pass without a picture has the rest.
    """
    passes = passes.where("label IS NOT NULL").withColumn("folder", safe_id(F.col("post_id")))
    text = lambda name, content: F.struct(F.lit(name).alias("name"), F.coalesce(content, F.lit("")).cast("binary").alias("content"))
    document = F.to_json(F.struct(*[c for c in passes.columns if c != "folder"]))
    files = passes.select("folder", F.explode(F.array(text("label.txt", F.col("label")), text("metadata.txt", F.col("caption")), text("post_info.json", document))).alias("f")).select("folder", "f.*")
    own = pictures.join(passes.select("post_id", "folder"), "post_id").select(F.concat("folder", F.lit("/images")).alias("folder"), "name", "content")
    write_files(files.unionByName(own), path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ensure_table(spark: SparkSession, path: str, schema: str) -> None:
    """Makes an empty table where there is none."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def append_errors(rows: DataFrame, path: str) -> None:
    """Appends unreadable documents (``folder``, ``_corrupt_record``) to an error table, with the time."""
    rows.select("folder", F.col("_corrupt_record").alias("text"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def seen_bucket(post_id: Column, buckets: int = SEEN_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(post_id), F.lit(buckets)).cast("int")


def mark_seen(ids: DataFrame, seen: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends the ids that aren't in the seen table, by buckets of their hash and sorted, so that readers skip files and row groups; a repeat changes nothing.

    The marks of a ``batch`` are a partition of their own, which a repeat overwrites; ``seen`` then holds those of other batches.
    """
    new = unseen(ids.select("post_id").distinct(), seen, "post_id").withColumn("timestamp", F.current_timestamp()).withColumn("bucket", seen_bucket(F.col("post_id")))
    new = new.repartition("bucket").sortWithinPartitions("bucket", "post_id")
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def compact_seen(spark: SparkSession, path: str, into: str) -> None:
    """The marks of all batches as one, each id with its first time: a new table beside the old."""
    rows = spark.read.schema(SEEN).parquet(path).groupBy("post_id").agg(F.min("timestamp").alias("timestamp"))
    rows = rows.withColumn("bucket", seen_bucket(F.col("post_id"))).repartition("bucket").sortWithinPartitions("bucket", "post_id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/batch=compact")


def store_cursor(cursor: DataFrame, path: str) -> None:
    cursor.select("cursor").write.mode("overwrite").text(path)


def store_batch_state(rows: DataFrame, path: str) -> None:
    """The state of submitted chunks (``job, chunk, ordinal, post_id``): a document for each job with its number of posts and their order, as many as a chunk holds."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "post_id"))), lambda x: x["post_id"])
    jobs = rows.groupBy("chunk", F.col("job").alias("name")).agg(F.count("*").cast("int").alias("count"), order.alias("order"))
    jobs.write.mode("overwrite").json(path)


def store_detections(cache: DataFrame, path: str) -> None:
    """A cache of detections (``post_id, num_columns, best_image, columns, signatures``) as a document for each post."""
    cache.write.mode("overwrite").json(path)


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """Passes and rejects, one partition a status."""
    outcomes.write.mode("overwrite").partitionBy("status").parquet(path)


def write_rejects(outcomes: DataFrame, path: str) -> None:
    outcomes.where("status <> 'SUCCESS'").select(F.col("post_id").alias("folder"), F.col("leven_score").alias("score"), F.col("ocr").alias("ocr"), "caption").write.mode("overwrite").json(path)


def merge_results(old: DataFrame, new: DataFrame, path: str) -> None:
    """The results of earlier runs and those of this one that they lack."""
    appended(old, new, "post_id").write.mode("overwrite").parquet(path)


def _with_filters(writer: DataFrameWriter, keys: tuple[str, ...]) -> DataFrameWriter:
    """Parquet Bloom filters on key columns: a lookup of a value that a row group lacks doesn't read it, sorted or not."""
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def write_index(index: DataFrame, path: str, as_csv: bool = False) -> None:
    """The trace index, sorted within files by id and with filters on ids and addresses so that lookups skip row groups; as CSV with a byte-order mark before the header of every file."""
    if not as_csv:
        ranged = index.repartitionByRange("post_id_numeric").sortWithinPartitions("post_id_numeric")
        _with_filters(ranged.write.mode("overwrite"), INDEX_KEYS).parquet(path)
        return
    first, *rest = INDEX_COLUMNS
    index.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", True).csv(path)


def upsert_index(new: DataFrame, path: str) -> int:
    """Merges rows (``INDEX_COLUMNS``) into the index kept by buckets of the id's hash. Only buckets that have one of the new ids are read and rewritten; how many.

    What a new row leaves null keeps its old value; of several new rows of an id the greatest counts. A repeat changes nothing. Readers of a bucket see it before or after.
    """
    spark, key = new.sparkSession, INDEX_COLUMNS[0]
    rows = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*INDEX_COLUMNS[1:])).alias("x")).select(key, "x.*")
    rows = written(rows.withColumn("bucket", seen_bucket(F.col(key), INDEX_BUCKETS)), "new")
    buckets = [x.bucket for x in rows.select("bucket").distinct().collect()]  # INDEX_BUCKETS at most
    schema = f"{INDEX}, bucket int"
    old = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(buckets)) if exists(spark, path) else spark.createDataFrame([], schema)
    a, b = old.alias("a"), rows.alias("b")
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    merged = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.bucket") == F.col("b.bucket")), "full_outer").select(*[pick(c) for c in (*INDEX_COLUMNS, "bucket")])
    merged = written(merged, "merged").repartition("bucket").sortWithinPartitions("bucket", key)
    _with_filters(merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket"), INDEX_KEYS).parquet(path)
    return len(buckets)


def write_documents(rows: DataFrame, path: str) -> None:
    """Documents as JSON lines; a new version beside the old, never in place."""
    rows.write.mode("overwrite").json(path)
