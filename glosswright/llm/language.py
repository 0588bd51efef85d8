"""Language identification by cross-parsing: a text is parsed into the longest phrases that occur in a language's sample; the language that needs the fewest wins.

A suffix automaton of each language's sample holds every phrase of it: following a text through the automaton from its root until no transition is left
gives the longest match, and the next phrase begins there. A phrase costs as many bits as it takes to point into the sample. The automata are
transition tables; many stretches of text step through all of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm.toxicity import fold
from glosswright.llm.words import pieces, text_bytes
from glosswright.session import ship, written

#: Of each language at most so many labelled rows are sampled, a stretch of at most so many letters of each.
SAMPLE_ROWS, SAMPLE_LETTERS = 512, 128
#: At most so many cells of four bytes are in all tables together; with many languages the samples are shorter.
CELLS = 1 << 24
#: Texts are parsed in stretches of so many bytes; a phrase ends where its stretch ends.
STRETCH = 2048
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Letters and their marks in lower case, each run of all else a space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_LETTERS) -> dict[str, list[str]]:
    """Stretches of labelled rows by language: bounded by ``rows`` and ``size``, chosen and placed by a hash of the row.

    Rows are first thinned to about twice as many as are wanted by their hash, for which only counts by language are needed, so that no language's rows meet in one task.
    """
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) > 0).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = named.groupBy("lang").count().collect()  # a row for each language, of which the tables hold more
    share = F.create_map(*[F.lit(v) for x in counts for v in (x.lang, 2.0 * rows / x["count"])])
    thin = named.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)) if counts else named
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    thin = thin.withColumn("k", first).where(F.col("k") <= rows).withColumn("text", letters(F.col("text"))).where("text <> ''")
    at = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    found: dict[str, list[str]] = {}
    for x in thin.select("lang", F.substring("text", at, F.lit(size)).alias("text"), "h").orderBy("lang", "h", "text").collect():
        found.setdefault(x.lang, []).append(x.text)
    return found


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root, and exactly the parts of ``text`` can be followed from it."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, new
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at < 0:
            continue
        to = moves[at][c]
        if length[to] == length[at] + 1:
            link[new] = to
            continue
        copy = len(moves)
        moves.append(dict(moves[to]))
        link.append(link[to])
        length.append(length[at] + 1)
        while at >= 0 and moves[at].get(c) == to:
            moves[at][c] = copy
            at = link[at]
        link[to] = link[new] = copy
    return moves


class Automata:
    """Tables of several languages' automata, one after the other.

    A cell holds twice the place of the next state's row, and 1 more where a phrase begins: where no transition is left the phrase goes on from the root
    with the same letter. Letters that a sample lacks are phrases of their own.
    """

    def __init__(self, samples: dict[str, list[str]], cells: int = CELLS):
        self.langs = sorted(samples, key=str.encode)
        data = {k: [x.encode() for x in v] for k, v in samples.items()}
        used = sorted({b for parts in data.values() for x in parts for b in x})
        self.symbol = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width, most = len(used) + 1, max(256, cells // (2 * (len(used) + 1) * max(1, len(samples))))
        tables, self.roots, self.bits, rows = [], [], [], 0
        for lang in self.langs:
            text: list[int] = []
            for part in data[lang]:
                if len(text) + len(part) >= most and text:
                    break
                text += [*self.symbol[np.frombuffer(part, np.uint8)].tolist(), -1]
            moves = suffix_automaton(text)
            root = np.full(width, rows * width * 2 + 1, np.int64)
            for c, to in moves[0].items():
                if c >= 0:
                    root[c] = (rows + to) * width * 2 + 1
            table = np.tile(root, (len(moves), 1))
            at, by, to = (np.array(x, np.int64) for x in zip(*[(s, c, t) for s, m in enumerate(moves[1:], 1) for c, t in m.items() if c >= 0] or [(0, 0, 0)]))
            real = at > 0
            table[at[real], by[real]] = (rows + to[real]) * width * 2
            tables.append(table.ravel().astype(np.int32))
            self.roots.append(rows * width)
            self.bits.append(np.log2(max(2, len(text))))
            rows += len(moves)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.width = width

    def phrases(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many phrases each stretch has in each language."""
        order = np.argsort(starts - ends, kind="stable")
        size, at = (ends - starts)[order], starts[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        count = np.zeros(state.shape, np.int32)
        symbols = self.symbol[buf].astype(np.int32)
        still = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, k in enumerate(still.tolist()):
            x = self.table.take(state[:, :k] + symbols.take(at[:k] + t))
            count[:, :k] += x & 1
            state[:, :k] = x >> 1
        out = np.empty_like(count)
        out[:, order] = count
        return out


def _parsed(sent, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Automata = sent.value
        for batch in pieces(batches, "letters", 4 << 20):
            buf, offsets = text_bytes(batch.column(batch.schema.get_field_index("letters")))
            size = np.diff(offsets)
            parts = -(-size // STRETCH)
            of = np.repeat(np.arange(len(size)), parts)
            starts = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
            counts = model.phrases(buf, starts, np.minimum(starts + STRETCH, offsets[1:][of]))
            bits = np.stack([np.bincount(of, row, len(size)) * b for row, b in zip(counts, model.bits)])
            best = bits.argmin(0)
            least = bits[best, np.arange(len(size))]
            bits[best, np.arange(len(size))] = np.inf
            other = bits.min(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(np.isinf(other), 1.0, other / (least + other))
            lang = pa.array(model.langs).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lang, pa.array(score), pa.array(least / np.maximum(size, 1))], schema=schema)

    return run


def languages(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_LETTERS, cells: int = CELLS) -> DataFrame:
    """One row per document row: ``doc_id, held_out, lang_pred, score, bits`` (of the winner, per byte of letters).

    ``score`` is the share of the runner-up in both costs: 0.5 for a tie (the smaller name wins), 1 where one language was learned. Null texts and those without a letter are
    ``und`` with score 0, and so is everything where nothing was learned. A null ``doc_id`` is neither held out nor learned from, nor is a null ``lang``; repeated rows are
    parsed each. Only ``doc_id``, ``text`` and ``lang`` are read, ``lang`` for the samples alone; an empty table gives an empty result. Texts are parsed whole,
    in memory of some ten bytes for each of theirs. Nothing is shuffled but the sampled rows.
    """
    spark = docs.sparkSession
    ship(spark)
    model = Automata(sample(docs.select("doc_id", "text", "lang"), rows, size), cells)
    own = letters(F.col("text"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    texts = docs.select("doc_id", held_out, F.coalesce(own, F.lit("")).alias("letters"))
    some = F.col("letters").rlike(r"\p{L}")
    nothing = lambda df: df.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    if not model.langs:
        return nothing(texts)
    sent = spark.sparkContext.broadcast(model)
    kinds = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("held_out boolean, lang_pred string, score double, bits double").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = texts.withColumn("letters", F.when(some, F.col("letters")).otherwise("")).mapInArrow(_parsed(sent, to_arrow_schema(kinds)), kinds)
    none = F.col("bits") == 0
    return parsed.select("doc_id", "held_out", F.when(none, UNKNOWN).otherwise(F.col("lang_pred")).alias("lang_pred"), F.when(none, 0.0).otherwise(F.col("score")).alias("score"), F.when(~none, F.col("bits")).alias("bits"))
