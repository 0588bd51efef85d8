"""Conversion by phrases: at each place the longest phrase of a table is replaced, else the character by its own rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.session import ship

#: Tables of rules are configuration; larger ones are an error, not an unbounded broadcast.
MOST_RULES = 1_000_000
_END = ""


def phrase_trie(rules: dict[str, str]) -> dict:
    """Nested tables of characters; what a phrase becomes is under the empty text."""
    root: dict = {}
    for phrase, to in rules.items():
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[_END] = to
    return root


def converted(text: str, trie: dict) -> str:
    """``text`` with the longest phrase at each place replaced, from left to right; what has been replaced isn't looked at again."""
    out, at, n = [], 0, len(text)
    while at < n:
        node, end, found, i = trie, at, None, at
        while i < n and (node := node.get(text[i])) is not None:
            i += 1
            if _END in node:
                found, end = node[_END], i
        if found is None:
            found, end = text[at], at + 1
        out.append(found)
        at = end
    return "".join(out)


def _run(sent) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = phrase_trie(sent.value)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else converted(x, trie), na_action="ignore")

    return run


def simplified(rows: DataFrame, column: str, rules: DataFrame, into: str | None = None, most: int = MOST_RULES) -> DataFrame:
    """``rows`` with ``column`` converted by landed ``rules`` (``phrase, becomes``; phrases of one character are the characters' rules), in ``into`` or in place.

    Of several rules of a phrase the smallest counts; null and empty phrases are none, a null ``becomes`` is empty. Null texts stay null. Rules are sent to every task: their number is checked.
    """
    spark = rows.sparkSession
    ship(spark)
    rules = rules.where("phrase <> ''").groupBy("phrase").agg(F.coalesce(F.min("becomes"), F.lit("")).alias("becomes"))
    found = rules.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    sent = spark.sparkContext.broadcast({x.phrase: x.becomes for x in found})
    return rows.withColumn(into or column, F.pandas_udf(_run(sent), "string")(F.col(column)))
