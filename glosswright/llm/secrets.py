"""Secret scan: all rules are compiled into minimised deterministic automata and found in one pass over the bytes of each text.

The automata tell where matches end; an automaton of the reversed rule, read back from an end, tells where the leftmost match begins.
A key block is found by its first line; what follows it up to its last line is part of the match.
Matches of one rule never overlap: the next one begins after the last, also after one that is dropped for being short.

Rules that may begin anywhere multiply each other's states where the tokens of one may hold the beginning of another, so those with "-" and "_" in their tokens begin
where no letter, digit, "-" or "_" stands before: inside a token no other rule can then begin. They have an automaton of their own, which is stepped beside the first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswright.llm.automaton import Scanner, alt, at_least, backwards, chars, maybe, plus, seq, star, tables, word
from glosswright.llm.words import pieces, text_bytes
from glosswright.session import ship

_ALNUM = chars("a-z", "A-Z", "0-9")
_VALUE = chars("a-z", "A-Z", "0-9", "+/_.=-")
_QUOTE, _SPACE = chars("\"'"), chars(" ")
_KEY = alt(*[word(w, True) for w in ("password", "passwd", "secret", "token")], seq(word("api", True), maybe(chars("_")), word("key", True)))

#: Rules in the order in which kinds are listed. The first three are the base rules.
RULES: dict[str, tuple] = {
    "assign": seq(_KEY, maybe(_QUOTE), star(_SPACE), chars(":="), star(_SPACE), maybe(_QUOTE), plus(_VALUE)),
    "access": seq(word("AKIA"), plus(chars("A-Z", "0-9"))),
    "hex": at_least(24, chars("0-9", "a-f")),
    "github": seq(word("gh"), chars("pousr"), word("_"), plus(_ALNUM)),
    "slack": seq(word("xox"), chars("abprs"), word("-"), plus(chars("a-z", "A-Z", "0-9", "-"))),
    "awstemp": seq(word("ASIA"), plus(chars("A-Z", "0-9"))),
    "stripe": seq(chars("sr"), word("k_live_"), plus(_ALNUM)),
    "npm": seq(word("npm_"), plus(_ALNUM)),
    "hub": seq(word("hf_"), plus(_ALNUM)),
    "cloud": seq(word("dop_v1_"), plus(chars("0-9", "a-f"))),
    "shop": seq(word("shp"), alt(word("at"), word("ca"), word("pa"), word("ss")), word("_"), plus(chars("0-9", "a-f"))),
    "hook": seq(word("hooks.slack.com/services/"), plus(chars("A-Z", "a-z", "0-9", "/"))),
    "pem": seq(word("-----BEGIN "), star(chars("A-Z", " ")), word("PRIVATE KEY-----")),
}
_TOKEN = chars("a-z", "A-Z", "0-9", "_", "-")
_LOWER_HEX, _DOT = chars("0-9", "a-f"), chars(".")
_USER = chars("a-z", "A-Z", "0-9", "._~%+-")
#: Rules whose matches begin where no byte of ``_TOKEN`` stands before.
BOUNDED: dict[str, tuple] = {
    "jwt": seq(word("eyJ"), plus(_TOKEN), _DOT, plus(_TOKEN), _DOT, plus(_TOKEN)),
    "google": seq(word("AIza"), plus(_TOKEN)),
    "gitlab": seq(word("glpat-"), plus(_TOKEN)),
    "githubpat": seq(word("github_pat_"), plus(chars("a-z", "A-Z", "0-9", "_"))),
    "sk": seq(word("sk-"), plus(_TOKEN)),
    "sendgrid": seq(word("SG."), plus(_TOKEN), _DOT, plus(_TOKEN)),
    "twilio": seq(alt(word("AC"), word("SK")), plus(_LOWER_HEX)),
    "urluser": seq(alt(*map(word, ("http", "https", "ftp", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp"))), word("://"), plus(_USER), chars(":"), plus(_USER), chars("@")),
    "pypi": seq(word("pypi-"), plus(_TOKEN)),
    "slackapp": seq(word("xapp-"), plus(chars("a-z", "A-Z", "0-9", "-"))),
    "square": seq(word("sq0"), alt(word("atp"), word("csp")), chars("-"), plus(_TOKEN)),
    "databricks": seq(word("dapi"), plus(_LOWER_HEX)),
    "mailgun": seq(word("key-"), plus(_LOWER_HEX)),
    "telegram": seq(plus(chars("0-9")), word(":AA"), plus(_TOKEN)),
    "oauth": seq(word("ya29."), plus(_TOKEN)),
    "vault": seq(word("hvs."), plus(_TOKEN)),
    "linear": seq(word("lin_api_"), plus(_ALNUM)),
    "age": seq(word("AGE-SECRET-KEY-1"), plus(chars("A-Z", "0-9"))),
}
BASE = ("assign", "access", "hex")
#: Shorter matches are dropped; for `assign` the value counts. (Counting in the automaton would multiply its states; `hex` has to, or every word ends one.)
LEAST = {"assign": 6, "access": 20, "hex": 24, "github": 40, "slack": 15, "awstemp": 20, "stripe": 32, "npm": 40, "hub": 37, "cloud": 71, "shop": 38, "hook": 45} | {
    "jwt": 40, "google": 39, "gitlab": 26, "githubpat": 50, "sk": 40, "sendgrid": 60, "twilio": 34, "pypi": 60, "slackapp": 30, "square": 29, "databricks": 36, "mailgun": 36, "telegram": 43, "oauth": 30, "vault": 28, "linear": 48, "age": 70,
}
#: What follows the first line of a key block: lines of base64 and headers (with line ends escaped or not) up to the last line.
_BLOCK = re.compile(rb"[A-Za-z0-9+/=\\\s\x22',:.]*+(?:-[A-Za-z0-9][A-Za-z0-9+/=\\\s\x22',:.]*+)*+-----END [A-Z ]*PRIVATE KEY-----")
_VALUE_OF = re.compile(rb"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


class Secrets:
    """The compiled rules; built once per worker."""

    def __init__(self):
        self.kinds = [*RULES, *BOUNDED]
        inside = _TOKEN[1]
        self.inside = np.array([b in inside for b in range(256)])
        # From the start and from every byte outside tokens on a rule may begin.
        lead = star(seq(star(_TOKEN), ("set", frozenset(range(256)) - inside)))
        self.scanners = [Scanner(list(RULES.values())), Scanner([seq(lead, p) for p in BOUNDED.values()], search=False)]
        self.back = []
        for p in (*RULES.values(), *BOUNDED.values()):
            moves, ends = tables([backwards(p)], search=False)
            dead = next((s for s in range(len(ends)) if not ends[s] and (moves[s] == s).all()), -1)
            self.back.append((moves, ends, dead))

    def begins(self, k: int, buf: np.ndarray, end: int, least: int, first: int) -> int:
        """The leftmost start, at ``least`` or later in the text from ``first`` on, of a match of rule ``k`` that ends at ``end``; -1 if there is none."""
        moves, ends, dead = self.back[k]
        bounded = k >= len(RULES)
        state, found = 0, -1
        for i in range(end - 1, least - 1, -1):
            state = moves[state, buf[i]]
            if state == dead:
                break
            if ends[state] and not (bounded and i > first and self.inside[buf[i - 1]]):
                found = i
        return found

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(start, kind, end)`` byte spans, ordered."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        last: dict[tuple[int, int], int] = {}
        whole = memoryview(buf)
        for zero, scanner in zip((0, len(RULES)), self.scanners):
            flags = scanner.flags(buf, offsets)
            following = np.zeros_like(flags)
            following[:-1] = flags[1:]
            following[inner - 1] = 0
            at = np.flatnonzero(flags & ~following)
            of = np.searchsorted(offsets, at, "right") - 1
            for i, doc in zip(at.tolist(), of.tolist()):
                here, first = int(flags[i] & ~following[i]), int(offsets[doc])
                while here:
                    k = zero + (here & -here).bit_length() - 1
                    here &= here - 1
                    start = self.begins(k, buf, i + 1, last.get((doc, k), first), first)
                    if start < 0:
                        continue
                    end = i + 1
                    if self.kinds[k] == "pem" and (block := _BLOCK.match(whole, end, int(offsets[doc + 1]))):
                        end = block.end()
                    last[doc, k] = end
                    found = buf[start:end].tobytes()
                    if self.kinds[k] == "assign":
                        found = _VALUE_OF.fullmatch(found)[1]
                    if len(found) >= LEAST.get(self.kinds[k], 0):
                        out[doc].append((start, k, end))
        return [sorted(x) for x in out]


_compiled: list[Secrets] = []


def _secrets() -> Secrets:
    if not _compiled:
        _compiled.append(Secrets())
    return _compiled[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = _secrets()
    for batch in pieces(batches):
        buf, offsets = text_bytes(batch.column(1))
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        cols: list[list] = [[] for _ in range(5)]
        for doc, found in enumerate(rules.spans(buf, offsets)):
            zero = points[offsets[doc]]
            named = [(rules.kinds[k], int(points[a] - zero), int(points[b] - zero)) for a, k, b in found]
            text = [f"{k}:{a}:{b}" for k, a, b in named]
            base = ",".join(x for x, (k, _, _) in zip(text, named) if k in BASE)
            for i, kind in enumerate(BASE):
                cols[i].append(sum(k == kind for k, _, _ in named))
            cols[3].append(hashlib.sha256(base.encode()).hexdigest())
            cols[4].append(",".join(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` holds ``kind:start:end`` (code points, end exclusive), ordered by start, then kind. Null and empty texts have none. Rows are
    independent: repeats, null ids, ties and extra columns don't matter; an empty table gives an empty result. No shuffle. Texts are scanned whole; of the longest one
    some 25 bytes for each of its bytes are held.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").fields])
    return docs.mapInArrow(_scan, schema)


def _redact(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _secrets()
        for batch in pieces(batches, f"c{at}"):
            column = batch.column(at)
            buf, offsets = text_bytes(column)
            texts = column.to_pylist()
            for doc, found in enumerate(rules.spans(buf, offsets)):
                if found:
                    parts, done = [], int(offsets[doc])
                    for a, k, b in found:
                        if a >= done:
                            parts += [buf[done:a].tobytes(), f"[{rules.kinds[k]}]".encode()]
                        done = max(done, b)
                    texts[doc] = b"".join([*parts, buf[done : offsets[doc + 1]].tobytes()]).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return run


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each found span replaced by its kind in brackets; overlapping spans are replaced together. ``n_chars``, if there is
    such a column, is counted anew. Null texts stay null; repeated rows, an empty table and extra columns, whatever their names, pass through. Texts are scanned whole, as ``secret_spans`` says."""
    ship(docs.sparkSession)
    # Names by place: Spark would read some names as paths or quotes.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = docs.columns.index("text")
    out = plain.mapInArrow(_redact(text), plain.schema)
    if "n_chars" in docs.columns:
        n, text = f"c{docs.columns.index('n_chars')}", f"c{text}"
        out = out.withColumn(n, F.when(F.col(text).isNull(), F.col(n)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.toDF(*docs.columns)
