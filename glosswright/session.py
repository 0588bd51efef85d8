"""Session helpers shared by every operator: shipping the package, shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: The scopes of scratch tables that a thread has open.
_open = threading.local()

#: Texts are long: Arrow batches are bounded by bytes, not by the usual ten thousand rows alone.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

#: Spark's setting for the shuffle files of a query that has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed where the driver put the repository on ``sys.path`` itself and the executors know nothing of it.
    """
    spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if scopes := getattr(_open, "scopes", None):
        scopes[-1].append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables that this thread makes inside go at the end, but those (as ``written`` gives them) that the function it yields is called for."""
    scopes = _open.__dict__.setdefault("scopes", [])
    made: list[str] = []
    kept: list[str] = []
    scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for path in made:
            if path not in kept:
                drop_scratch(spark, path)
        if scopes:
            scopes[-1] += kept


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has run, not when the driver next collects its garbage."""
    old = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if old is None else spark.conf.set(SHUFFLES_GO, old)


def in_store(path: str):
    """A path's file system and its path there, for tasks that read or write files of their own."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), rest if colon else path.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{known.get(scheme, scheme)}://{quote(rest, safe='/:@')}")


def read_columns(path: str, *names: str) -> list:
    """Columns of a table that ``written`` made, in the order of its files, as numpy arrays with nan for null numbers: read by the task that calls this, so that the driver never holds them."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = in_store(path)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet"))
    parts = []
    for file in files:
        with store.open_input_file(file) as f:
            parts.append(pq.ParquetFile(f).read(list(names), use_threads=False))
    table = pa.concat_tables(parts)
    return [table[x].to_numpy() for x in names]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by the hash of ``keys`` to as many tasks as a shuffle has: a small compressed table is one split, however much work its rows are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out
