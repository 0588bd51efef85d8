"""WARC archives: write, normalise monolithic gzip files, read back by offset.

A monolithic file is one gzip stream over many records: a single record can't be read without inflating all before it. The normaliser inflates each
file once as a stream, rewrites every record as its own gzip member and writes an index of member offsets beside the archive; the reader then
seeks. Memory is bounded by one record. Tasks write files under names of their own, so a repeated task leaves a spare file but no wrong
one: only what the index table names counts.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.session import scratch_path, ship, written

#: Shorter payloads are stored each time.
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20
#: Names that Spark's file systems have for those of pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}
INDEX = "archive string, offset bigint, length bigint, type string, record string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds ``payload, payload_bytes, payload_digest, first``: the page a revisit refers to, null for responses.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest ``page_id`` is the response. Rows with that same id are responses as
    well; a row with a null id is a response unless an equal payload has an id.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    pages = pages.join(firsts, "payload_digest", "left")
    return pages.withColumn("first", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("page_id").isNull()), F.col("first")))


def record(pages: DataFrame) -> Column:
    """The text of a WARC record: of a response with an HTTP head and the payload as its block; revisits have no block."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(pages[c].cast("string"), F.lit("")), F.lit(">"))
    revisit, size = pages["first"].isNotNull(), pages["payload_bytes"].cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", size), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), pages["payload_digest"])),
        line("WARC-Payload-Length", size),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("first")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, "0").otherwise((pages["payload_bytes"] + F.octet_length(head)).cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.concat(head, pages["payload"])),
    )


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Writes rows of ``with_revisits`` as gzip files, one stream each, through Spark's own committer."""
    pages.select(record(pages).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _inflated(read) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members, at most ``_READ`` at a time however well they were compressed."""
    inflate = zlib.decompressobj(31)
    while chunk := read(_READ):
        while chunk:
            out = inflate.decompress(chunk, _READ)
            yield out
            # What a full piece leaves inside the decompressor comes with the next calls.
            while len(out) == _READ and not inflate.unconsumed_tail and not inflate.eof:
                out = inflate.decompress(b"", _READ)
                yield out
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)


def _records(read) -> Iterator[bytes]:
    """Records, without their closing line ends, of a gzip stream."""
    data, want = bytearray(), -1
    for piece in _inflated(read):
        data += piece
        done = 0
        while True:
            if want < 0:
                head = data.find(b"\r\n\r\n", done)
                if head < 0:
                    break
                want = head + 4 + int(fields(bytes(data[done:head]))["Content-Length"])
            if len(data) < want + 4:
                break
            yield bytes(data[done:want])
            done, want = want + 4, -1
        if done:
            del data[:done]
            want = want - done if want >= 0 else -1
    if data:
        raise ValueError(f"the archive ends inside a record: {bytes(data[:80])!r}")


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _open(path: str):
    from pyarrow.fs import FileSystem

    path = path if "://" in path else path.replace("file:", "file://", 1)
    scheme, sep, rest = path.partition("://")
    return FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


def _normalise(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                fs, where = _open(source)
                target = posixpath.join(out, f"{uuid.uuid4().hex}.warc.gz")
                to_fs, to = _open(target)
                to_fs.create_dir(posixpath.dirname(to), recursive=True)
                rows, at = [], 0
                with fs.open_input_stream(where, compression=None) as stream, to_fs.open_output_stream(to, compression=None) as sink:
                    for rec in _records(stream.read):
                        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = squeeze.compress(rec + b"\r\n\r\n") + squeeze.flush()
                        sink.write(member)
                        names = fields(rec[: rec.index(b"\r\n\r\n")])
                        rows.append((target, at, len(member), names["WARC-Type"], names["WARC-Record-ID"]))
                        at += len(member)
                with to_fs.open_output_stream(f"{to}.idx", compression=None) as sidecar:
                    for row in rows:
                        sidecar.write("\t".join(map(str, row[1:])).encode() + b"\n")
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i : i + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4])], names=["archive", "offset", "length", "type", "record"])

    return run


def normalised(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Normalises every gzip file under ``path`` into ``out``, a folder that executors share; the index: ``archive, offset, length, type, record``.

    One task a file, since a stream can't be split. ``path`` and ``out`` are in a store that pyarrow's file systems reach (local, S3,
    GCS, HDFS, Azure; Spark's names of these are translated).
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")
    n = max(1, files.count())
    return written(files.repartition(n).mapInArrow(_normalise(out), INDEX), "index")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, stream = None, None
    for batch in batches:
        rows = []
        for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if archive != name:
                fs, where = _open(archive)
                name, stream = archive, fs.open_input_file(where)
            stream.seek(offset)
            rec = zlib.decompress(stream.read(length), 31)
            cut = rec.index(b"\r\n\r\n")
            f = fields(rec[:cut])
            block, digest = rec[cut + 4 : -4], f["WARC-Payload-Digest"].removeprefix("sha256:")
            payload = block[block.index(b"\r\n\r\n") + 4 :] if f["WARC-Type"] == "response" else b""
            if f["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
            page = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
            rows.append((page(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], page(f.get("WARC-Refers-To", "")), payload if f["WARC-Type"] == "response" else None))
        if rows:
            cols = list(zip(*rows))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"])


def read_archives(index: DataFrame) -> DataFrame:
    """The records an index names: ``page, url, payload_bytes, payload_digest, record_type, refers, payload``; payloads are checked against their digests."""
    ship(index.sparkSession)
    return index.mapInArrow(_read_back, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Pages through monolithic archives, the normaliser and the reader: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    One row per page row; a null html is an empty payload, null ids and URLs come back null and empty. An empty table gives no archive and no rows. Repeated ids and
    extra columns don't matter. The join that finds revisits moves payloads by digest; Spark splits a digest that many pages have, as the other side has one row for it.
    """
    spark = pages.sparkSession
    raw, out = scratch_path(spark, "warc"), scratch_path(spark, "members")
    write_monolithic(with_revisits(pages), raw)
    index = normalised(spark, raw, out)
    kind: T.DataType = pages.schema["page_id"].dataType
    return read_archives(index).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to")
    )
