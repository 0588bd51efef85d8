"""SpotSigs fingerprints: each common word is an anchor, and the chain of content words that follow it is a signature. So that short texts and those of other
languages have a fingerprint too, and texts of any two lengths can be compared, each word's chain of the words that follow it and each word alone are signatures as well.

A fingerprint is the sorted set of a text's 64-bit signature hashes, in hex or, in a third of the characters, ``compact``. ``fingerprints`` compares each text with two others by Jaccard similarity;
``near_duplicates`` finds all near-duplicates: signature sets are partitioned into bands of set lengths, meet in their band's and the next one's inverted lists of rare signatures,
and are compared through Jaccard similarity pruned by lengths and bitmaps.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm.similar import Sets, grouped
from glosswright.llm.words import LETTERS, Words, mix, pieces
from glosswright.session import ship

#: Common words of four languages.
ANCHORS = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "der die das den dem des ein eine einer und in im zu zur mit von für auf ist sind nicht sich als auch aus bei nach "
    "le la les l un une des du de et en est que qui dans pour par sur au aux avec ce il elle ne pas plus se "
    "el los las unos y es del al por con para como su se lo no más una"
)
CHAIN = 2
PERCENT = 75
BUCKET_ROWS = 200
MOST_BUCKETS = 1 << 16


def _anchor_hashes() -> np.ndarray:
    return np.unique(Words(pa.array([ANCHORS]), True, LETTERS).h)


def _chains(h: np.ndarray, anchors: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The signature of each anchor position: the anchor with the ``CHAIN`` content words after it, fewer at the end of the text."""
    following = np.concatenate([h[content], np.zeros(CHAIN, np.uint64)])
    at = np.searchsorted(content, anchors, "right")
    g = h[anchors]
    with np.errstate(over="ignore"):
        for j in range(CHAIN):
            g = mix(g * np.uint64(31) + following[at + j])
    return g


def signatures(texts: pa.Array, common: np.ndarray) -> list[np.ndarray]:
    """The sorted signature set of each text. A text without words that isn't empty has one signature, its own digest."""
    w = Words(texts, True, LETTERS)
    is_common = np.isin(w.h, common)
    out = []
    for i, (a, n) in enumerate(zip(w.first[:-1], w.counts)):
        if not n:
            raw = w.buf[w.offsets[i] : w.offsets[i + 1]].tobytes()
            out.append(np.frombuffer(hashlib.sha256(raw).digest()[:8], ">u8").astype(np.uint64) if raw else np.zeros(0, np.uint64))
            continue
        h, c = w.h[a : a + n], is_common[a : a + n]
        every = np.arange(n)
        out.append(np.unique(np.concatenate([_chains(h, np.flatnonzero(c), np.flatnonzero(~c)), _chains(h, every, every), h])))
    return out


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, 0 where the lengths alone rule out ``least``. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


class Spots:
    """Makes the signature sets of texts for a near-duplicate join."""

    by_size = True

    def __call__(self, texts: pa.Array, counts: np.ndarray | None = None) -> Sets:
        found = signatures(texts, _anchor_hashes())
        return Sets(np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.uint64), *found]), len(found), counts)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document row: ``doc_id, n_signatures, component_id``, the smallest ``doc_id`` reachable by links: of texts whose signature sets have a Jaccard similarity
    of ``percent`` / 100 or more. Null and empty texts have no signatures and are their own component; null and repeated ids, extra columns and empty tables
    are as for ``similar.near_duplicates``."""
    return grouped(docs, Spots(), percent).withColumnRenamed("n_shingles", "n_signatures")


def _hex(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def _compact(s: np.ndarray) -> str:
    """A set in a third of the characters, by base64: the first 64 bits of the SHA-256 of its signatures, so that only equal sets look equal, and the first 32 bits of each, in their order."""
    raw = s.astype(">u8")
    return b64encode(hashlib.sha256(raw.tobytes()).digest()[:8] + raw.view(">u4")[::2].tobytes()).decode() if len(s) else ""


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch], as_text: Callable[[np.ndarray], str] = _hex) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in descending order, each bucket's last row being the first row of the next: a guest, compared with but not returned."""
    common = _anchor_hashes()
    last: tuple | None = None
    for batch in pieces(batches):
        bucket, guest = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows = ([last] if last else []) + list(zip(bucket, guest, ids, texts))
        last = rows[-1]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not pairs:
            continue
        sets = signatures(pa.array([r[3] for r in rows]), common)
        new = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
        new_sets = signatures(pa.array(new), common)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], batch.column(0).type),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                pa.array([as_text(sets[i]) for i in pairs]),
                pa.array([as_text(s) for s in new_sets]),
                pa.array([pruned_jaccard(sets[i], s) for i, s in zip(pairs, new_sets)]),
                pa.array([pruned_jaccard(sets[i], sets[i + 1]) for i in pairs]),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprints(docs: DataFrame, compact: bool = False) -> DataFrame:
    """One row per document row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The next document is the one with the next smaller integer ``doc_id``; after the last comes the first. Null ids come last; rows with equal ids are
    ordered by a hash of the text; of rows equal in both the order doesn't matter. A single row is its own next. Null texts are empty; an empty text has an
    empty fingerprint, like only to another empty one. Other columns are ignored; an empty table gives an empty result. Texts are shuffled once, into key ranges with
    bounds from quantiles; the first row of each range also goes to the range before it. A range of one id, or of no id, that has many rows is divided by their
    hashes. Whole texts are fingerprinted: a task holds some 100 bytes for each word of the longest.

    Fingerprints are 16 characters a signature; with ``compact`` they are some 5.3, of which the likeness (always that of the whole signatures) can still be had, but
    for the chance, 2^-32 for any two, that different signatures look equal.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    n = docs.count()
    buckets = int(min(MOST_BUCKETS, max(1, n // BUCKET_ROWS)))
    found = docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets) if buckets > 1 else []
    # An id that is several quantiles has a range of its own.
    bounds = sorted({*found, *[q + 1 for q, later in zip(found, found[1:]) if q == later]})
    splits = [-float("inf"), *(bounds or [0.0]), float("inf")]
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("as_double", F.col("doc_id").cast("double"))
    keyed = Bucketizer(splits=splits, inputCol="as_double", outputCol="range", handleInvalid="keep").transform(keyed)
    # Null ids get the number past the last; descending, the first range is that of the largest ids.
    keyed = keyed.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(len(splits) - F.col("range")).cast("int")).drop("as_double")
    sizes = keyed.groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one_id")).collect()  # a row for each range
    # Parts of all ranges together are at most as many as buckets may be, and one for each range.
    rows = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    many = [(r.range, -(-r.n // rows)) for r in sizes if r.one_id and r.n > 4 * rows]
    most = max([1, *[k for _, k in many]])
    many = F.broadcast(spark.createDataFrame(many, "of_range int, parts bigint"))
    part = F.floor((0.5 - F.col("hash") / F.lit(2.0**64)) * F.col("parts"))
    keyed = keyed.join(many, F.col("range") == F.col("of_range"), "left")
    part = F.greatest(F.lit(0), F.least(F.col("parts") - 1, part))
    keyed = keyed.withColumn("bucket", F.col("range").cast("long") * most + F.coalesce(part, F.lit(0))).drop("range", "of_range", "parts")
    heads = sorted((r.bucket, r.head) for r in keyed.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("head")).collect())  # a row for each bucket
    guests = [(heads[i - 1][0], head.doc_id, head.hash) for i, (_, head) in enumerate(heads)]
    id_type = docs.schema["doc_id"].dataType
    guests = F.broadcast(spark.createDataFrame(guests, T.StructType([T.StructField("guest_of", T.LongType()), T.StructField("head_id", id_type), T.StructField("head_hash", T.LongType())])))
    keyed = keyed.join(guests, F.expr("doc_id <=> head_id AND hash = head_hash"), "left")
    places = F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("at"), F.lit(True).alias("guest")))
    dealt = keyed.select("doc_id", "text", "hash", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p")).select("doc_id", "text", "p.at", "p.guest", "hash")
    dealt = dealt.repartition("at").sortWithinPartitions("at", "guest", F.col("doc_id").desc_nulls_last(), F.col("hash").desc())
    schema = T.StructType(
        [T.StructField("doc_id", id_type), *T._parse_datatype_string("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields]
    )
    return dealt.mapInArrow(partial(_compare, as_text=_compact if compact else _hex), schema)
