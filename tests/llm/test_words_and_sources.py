"""Language identification, spelling variants and source divergence against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswright.llm import divergence, language, spelling
from glosswright.llm.words import text_bytes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_phrases(text: bytes, parts: list[bytes]) -> int:
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in p for p in parts):
            end += 1
        n, at = n + 1, end
    return n


def test_cross_parsing():
    rng = random.Random(4)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [make("abé ", 40) for _ in range(6)], "y": [make("bcd", 30) for _ in range(3)], "z": ["q"]}
    model = language.Automata(samples)
    texts = ["", "a", "qqq", "жук", *[make("abcdé q", rng.randint(1, 300)) for _ in range(40)]]
    buf, at = text_bytes(pa.array(texts))
    got = model.phrases(buf, at[:-1], at[1:])
    assert model.langs == ["x", "y", "z"]
    for g, lang in enumerate(model.langs):
        parts = [p.encode() for p in samples[lang]]
        assert got[g].tolist() == [naive_phrases(t.encode(), parts) for t in texts]
    # A table too small for the samples holds whole parts of them, one at least.
    small = language.Automata(samples, cells=1)
    assert len(small.table) <= len(model.table) and small.langs == model.langs


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["schu", "tz", "eb"], "cc": ["éa", "ou", "ñi"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang := rng.choice([*sounds]), rng.randint(3, 40)), lang) for i in range(240)]
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !!", "cc"), (1003, say("aa", 20), None), (None, say("bb", 20), "aa"), (None, say("bb", 20), "aa"), (1004, say("cc", 30_000), "cc"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(*x, 0, "s") for x in rows + extra], "doc_id long, text string, lang string, score int, `a.b` string")


def test_languages(spark, spoken):
    rows = language.languages(spoken).collect()
    assert len(rows) == spoken.count()
    truth = {x.doc_id: x.lang for x in spoken.collect()}
    for x in rows:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1
        if x.doc_id in (1000, 1001, 1002):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif x.doc_id is None:
            assert x.lang_pred == "bb"
        elif x.doc_id == 1003:
            assert x.lang_pred == "aa"
        else:
            assert x.lang_pred == truth[x.doc_id]
    # Neither languages nor ids are inputs of a prediction: those of other rows don't change with them.
    moved = language.languages(spoken.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) > 0, F.col("lang")).otherwise("zz")))
    assert sorted(map(str, rows)) == sorted(map(str, moved.collect()))
    assert {(x.lang_pred, x.score) for x in language.languages(spoken.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert language.languages(spoken.limit(0)).collect() == []


def test_sample_is_bounded(spark, spoken):
    found = language.sample(spoken, rows=7, size=10)
    assert set(found) == {"aa", "bb", "cc"} and all(len(x) == 7 and max(map(len, x)) <= 10 for x in found.values())
    assert found == language.sample(spoken.repartition(5), rows=7, size=10)


def test_automaton_is_exact():
    rng = random.Random(1)
    text = [rng.randint(0, 2) for _ in range(60)]
    moves, parts = language.suffix_automaton(text), {tuple(text[i:j]) for i in range(60) for j in range(i, min(61, i + 7))}
    for n in range(5):
        for code in range(3**n):
            word, state = [code // 3**k % 3 for k in range(n)], 0
            for c in word:
                state = moves[state].get(c) if state is not None else None
            assert (state is not None) == (tuple(word) in parts)
    assert len(moves) <= 2 * len(text)


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_variants(rows) -> dict:
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_variants(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Éclair", "éclair", "ÿÿÿÿÿÿ"]

    def typo(w):
        i, k = rng.randrange(len(w)), rng.randrange(4)
        return [w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abÈ") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]][k]

    pick = lambda: typo(stems[min(int(rng.expovariate(0.15)), len(stems) - 1)])
    rows = [(i, " ".join(pick() if rng.random() < 0.6 else stems[rng.randrange(len(stems))].upper() for _ in range(rng.randint(0, 60))) + "ž,1") for i in range(60)]
    rows += [(None, "aaaaab " * 5), (None, None), (7, ""), (7, "aaaaab aaaaac"), (3, rows[3][1]), (99, "Aaaaab-" * 4000)]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(docs).collect()
    want = naive_variants(rows)
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want and len(got) == len(want)
    assert any(form and root != form for form, root, *_ in want.values())
    assert spelling.variants(docs.limit(0)).collect() == []


def test_near_pairs_meet_once(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(260)})
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    want = {(a, b) for a in words for b in words if one_edit(a, b) and (len(a) < len(b) or len(a) == len(b) and a < b)}
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want


def test_variants_broadcast_nothing(spark):
    """Small tables of words become large ones of keys, whose size Spark doesn't know."""
    found = spelling.near_pairs(spark.createDataFrame([("aaaaa", 3), ("aaaab", 9)], "word string, n long"))
    variants = spelling.variants(spark.createDataFrame([(1, "aaaaa aaaab " * 9)], "doc_id long, text string"))
    for df in (found, variants):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(x.a, x.b) for x in found.collect()] == [("aaaaa", "aaaab")] and variants.count() == 2


def naive_divergence(rows, least_docs, most_terms):
    counts, seen, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [x.translate(LOW) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen.update((lang, x) for x in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (k, t), n in seen.items() if k == lang and n >= least_docs)
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s})
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:most_terms], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("The", "été", "x", "ÉTÉ", "字") for b in "abcdefgh"]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "fr", "", None]), rng.choice(["s1", "s2", "s3", "", None])
        bias = len(source or "") * 3
        rows.append((" ".join(vocabulary[min(int(rng.expovariate(0.1)) + bias, len(vocabulary) - 1)] for _ in range(rng.randint(0, 40))) + ".", lang, source))
    rows += [(None, "en", "s9"), ("", "de", "s1"), ("only here", "de", "s2"), ("alone", "it", "s1"), ("the " * 50_000, "en", "s1"), ("- 12", "xx", None)]
    docs = spark.createDataFrame([(*x, "t", 1, 2) for x in rows], "text string, lang string, source string, term string, value int, `rank` int")
    for least, most in ((5, 4), (1, 50), (10_000, 50)):
        got = divergence.divergence(docs, least_docs=least, most_terms=most).collect()
        assert sorted(tuple(x) for x in got) == naive_divergence(rows, least, most)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_terms_are_counted_by_tasks(spark, monkeypatch):
    """A task hands on a row for each term of a language and source, not for each time that it has it; where it holds too many, in parts that add up."""
    texts = ["The the THE été", "the - É", None, "12", "x" * 300 + " 字"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts]), pa.array(["en"] * len(texts)), pa.array(["a", "b", ""] * 5)], names=["text", "lang", "source"])
    want, documents = Counter(), Counter()
    for t, s in zip(texts, ["a", "b", ""] * 5):
        terms = [x.translate(LOW) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        want.update((s, x) for x in terms)
        documents.update((s, x) for x in set(terms))
    for held in (1 << 20, 1):
        monkeypatch.setattr(divergence, "HELD", held)
        rows = [tuple(x.values()) for b in divergence._counted(iter([batch.slice(0, 7), batch.slice(7)])) for x in b.to_pylist()]
        n, docs = Counter(), Counter()
        for _, source, term, times, of in rows:
            n[source, term] += times
            docs[source, term] += of
        assert n == want and docs == documents and (len(rows) == len(want)) == (held > 1)


def test_shares_are_exact(spark):
    cases = [(9 * 10**17, 9 * 10**18 - 50, 7), (0, 0, 1), (3, 10**15, 12), (5, 5, 0)]
    df = spark.createDataFrame(cases, "c long, t long, v long").select(divergence._share(F.col("c"), F.col("t"), F.col("v"), 5, 1_000_000_000).alias("p"))
    assert [x.p for x in df.collect()] == [1 + 10**9 * (c + 5) // (t + 5 * v) if v else 0 for c, t, v in cases]
