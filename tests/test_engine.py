"""Functions, operators, plans and streaming, on hand-derived cases."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glosswright.functions import boxes as b
from glosswright.functions import ids
from glosswright.functions import similarity as s
from glosswright.functions import text as t
from glosswright.operators import jsontree as j
from glosswright.operators import relational as r
from glosswright.plans import funnel, gate, queries
from glosswright.sources import files

BOX = "array<struct<bbox:array<double>,class:int,conf:double,center_x:double,height:double>>"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def box(*at):
    return (list(map(float, at)), 0, 1.0, (at[0] + at[2]) / 2.0, float(at[3] - at[1]))


def test_text(spark):
    x = F.lit("a福b㐀c")
    assert tuple(one(spark, t.keep_chars(x), t.keep_chars(x, t.HAN), t.keep_chars(F.lit(None)), t.unify_variants(F.lit("図")), t.sorted_chars(F.lit("cab")))) == ("福㐀", "福", "", "圖", "abc")
    assert tuple(one(spark, t.strip_annotations(F.lit("（ 上聯】福")), t.strip(F.lit("　 x\n")), t.folder_name(F.lit(41 + 1)), t.folder_name(F.lit(10001)))) == ("福", "x", "0042", "10001")
    assert tuple(one(spark, t.skip_reason(F.lit("福如")), t.skip_reason(F.lit("每日一字福如東海")), t.skip_reason(F.lit("福如東海")))) == ("too few characters (2)", "pattern 3", None)


def test_ids(spark):
    a, c = "UzpfSTEwMDAwMDAwMDAwMDAwMTpWSzoxMjM0NTY3ODkwMTIzNDU2", "UzpfSTEwMDAwMDAwMDAwMDAwMTpWSzoxMjM0NTY3ODkwMTIzNDU2NzpWSzo5OTk5OTk5OTkxMg=="
    got = one(spark, ids.decode_id(F.lit(a)), ids.decode_id(F.lit(c)), ids.first_post(F.lit(c)), ids.decode_id(F.lit("!"))["post"])
    assert tuple(got.c0) == ("100000000000001", "1234567890123456") and tuple(got.c1) == ("100000000000001", "99999999912")
    assert got.c2 == "12345678901234567" and got.c3 is None
    refs = ["https://h/groups/111111111/posts/222222222/?x=1", "https://h/?a=333333333&b=444444444", "https://h/abc/1234567"]
    assert tuple(one(spark, *[ids.reference_id(F.lit(x)) for x in refs])) == ("222222222", "444444444", None)


@pytest.mark.parametrize(
    ("heights", "n", "counts"),
    [([100, 100], 10, [5, 5]), ([300, 100], 10, [8, 2]), ([1, 1], 3, [1, 2]), ([1] * 5, 2, [2, 0, 0, 0, 0]), ([1] * 10, 16, None)],
)
def test_allocation(spark, heights, n, counts):
    h, text = F.array(*[F.lit(float(x)) for x in heights]), "".join(chr(97 + i) for i in range(n))
    got, lines = one(spark, b.allocation(h, F.lit(n)), b.allocated_lines(F.lit(text), h))
    assert counts is None or got == counts
    assert min(got) >= 0 and sum(got) == n and "".join(lines) == text


@pytest.mark.parametrize(
    ("columns", "signatures", "left"),
    [
        ([(0, 0, 100, 100), (0, 0, 40, 100), (60, 0, 100, 100)], [], [1, 2]),
        ([(0, 0, 100, 100), (10, 10, 90, 90)], [], [0]),
        ([(0, 0, 100, 100), (25, 0, 125, 100)], [], [0]),
        ([(0, 0, 100, 100), (26, 0, 126, 100)], [], [0, 1]),
        ([(0, 0, 40, 100), (50, 0, 90, 40)], [(50, 0, 90, 40)], [0]),
        ([(0, 0, 40, 100), (50, 0, 90, 40)], [(50, 0, 90, 50)], [0, 1]),
        ([(0, 0, 0, 10)], [], [0]),
    ],
)
def test_clean_columns(spark, columns, signatures, left):
    df = spark.createDataFrame([([box(*c) for c in columns], [box(*c) for c in signatures])], f"c {BOX}, s {BOX}")
    got = df.select(b.clean_columns(F.col("c"), F.col("s")).alias("x")).first().x
    assert [tuple(x.bbox) for x in got] == [tuple(map(float, columns[i])) for i in left]


def test_similarity(spark):
    assert round(s.ratio("kitten", "sitting"), 1) == 61.5
    align = lambda a, c, o=None: s.align_all([(a, c, o or c)])[0]
    assert align("床前明月光", "題詩床前明月光疑是") == (100.0, 2, 7, "床前明月光")
    assert align("丁甲乙丙", "地天甲乙丙") == (85.7, 2, 5, "甲乙丙")
    assert align("乙甲丙丁", "天甲乙丙丁") == (85.7, 2, 5, "甲乙丙丁")
    assert align("", "x")[0] == 0.0 and align("ab", "abc", "ab") == (None,) * 4
    rng = random.Random(1)
    rows = [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", s.sorted_similarity(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(x.x - s.ratio("".join(sorted(x.a)), "".join(sorted(x.b)))) < 1e-9 for x in got)
    for a, c in rows:
        if 0 < len(a) < len(c):
            spans = [(i, k) for i in range(len(c)) for k in range(i + 1, len(c) + 1) if k - i == len(a) or k - i < len(a) and (i == 0 or k == len(c))]
            assert s.best_windows([(a, c)])[0][0] == max(s.ratio(a, c[i:k]) for i, k in spans)


def test_gate(spark):
    rows = [("1", "（上聯）福如東海長流水 #書法", "福如東海\n長流水\n【落款：某某】", [box(50, 0, 90, 400), box(0, 0, 40, 300)], []), ("2", "無關文字", "福如東海", [], []), ("3", None, None, None, None)]
    got = {x.post_id: x for x in gate.gate(spark.createDataFrame(rows, f"post_id string, caption string, reply string, columns {BOX}, signatures {BOX}")).collect()}
    assert (got["1"].status, got["1"].leven_score, got["1"].label, got["1"].n_columns) == ("SUCCESS", 100.0, "福如東海\n長流水", 2)
    assert got["2"].status == got["3"].status == "REJECT"


def test_funnel(spark):
    tall = [box(0, 0, 10, 100), box(20, 0, 30, 100)]
    posts = [("a", "福如東海", 1, tall, 300), ("b", "福如東海", 0, tall, 300), ("c", "福如東海", 1, [], 300), ("d", "福如東海", 1, [box(0, 0, 100, 100)], 300), ("e", "福如東海", 1, tall, 300), ("f", "福如東海", 1, tall, 90000)]
    yes = "HAS_CALLIGRAPHY: YES\nCLEAN_TEXT: 福如東海"
    readings = [(k, yes) for k in "af"] + [("e", "HAS_CALLIGRAPHY: no")]
    out = funnel.funnel(spark.createDataFrame(posts, f"post_id string, caption string, n_images int, columns {BOX}, image_height int"), spark.createDataFrame(readings, "post_id string, reply string"), spark.createDataFrame([(k, "HIGH_COUNT: 4") for k in "aef"], "post_id string, reply string"))
    got = {x.post_id: (x.reason, x.label) for x in out.collect()}
    assert got == {"a": (None, "福如\n東海"), "b": ("no images", None), "c": ("no columns", None), "d": ("horizontal layout", None), "e": ("not calligraphy", None), "f": ("too dense", None)}


LINE = {
    "data": {"node": {"id": "A1", "comet_sections": {"content": {"story": {"message": {"text": "福如東海"}, "attachments": [{"i": {"uri": "https://scontent.example/x.jpg", "width": 800, "height": 600}}, {"i": {"uri": "https://scontent.example/y.jpg", "width": 300, "height": 600}}, {"i": {"uri": "https://scontent.example/z.jpg", "width": 900}}]}}}}},
    "page_info": {"end_cursor": "c1"},
}


def test_tree(spark):
    body = json.dumps(LINE) + "\n\n{broken\n"
    lines = files.response_lines(spark.createDataFrame([(1, body)], "r int, body string"), ["r"])
    tree = j.walked(lines, ["r", "line_no"])
    assert [x.post_id for x in j.post_ids(tree, ["r"]).collect()] == ["A1"]
    assert j.end_cursors(tree, ["r"]).first().cursor == "c1"
    nodes = j.walked(j.post_nodes(tree, ["r"]), ["post_id"], "node")
    assert j.images(nodes, ["post_id"]).first().image_urls == ["https://scontent.example/x.jpg"]
    assert len(j.images(nodes, ["post_id"], require_height=False).first().image_urls) == 2


def test_relational(spark):
    seen = ["a", "b"]
    rows = [(i, "s", k) for i, k in enumerate(["a", "b", "b", "c", "a", "d"])]
    got = r.duplicate_streak(spark.createDataFrame(rows, "i int, s string, k string"), "s", ["i"], "k", F.col("k").isin(seen), 2).orderBy("i").collect()
    assert [(x.status, x.streak) for x in got] == [("duplicate", 1), ("duplicate", 2), ("repeated", 2), ("new", 0), ("repeated", 0), ("new", 0)]
    assert [x.stop for x in got] == [False, True, False, False, False, False]
    origin = spark.createDataFrame([("7", "p7", "x"), ("8", "p8", "only"), ("9", "", "y"), ("10", "p10", "twice"), ("11", "p11", "twice")], "folder string, post_id string, caption string")
    merged = spark.createDataFrame([("x/7", "q"), ("catchup_2026", "only"), ("catchup_2026", "twice"), ("x/9", "only")], "source string, caption string")
    got = {(x.source, x.caption): x.resolved_by for x in r.resolve_provenance(merged, origin).collect()}
    assert got == {("x/7", "q"): "source_index", ("catchup_2026", "only"): "caption_match", ("catchup_2026", "twice"): "unresolved", ("x/9", "only"): "unresolved"}


def test_stream(spark, tmp_path):
    from glosswright.streaming.ingest import ingest

    landing = tmp_path / "landing"
    landing.mkdir()
    body = json.dumps(LINE)
    for i in range(2):
        (landing / f"{i}.json").write_text(json.dumps({"method": "POST", "url": "https://h/graphql", "post_data": "Feed", "status": 200, "body": body, "received_at": f"2026-01-0{i + 1}T00:00:00"}) + "\n")
    rows = files.responses(spark, str(landing), "Feed", stream=True)
    for _ in range(2):
        ingest(rows, *[f"file://{tmp_path}/{x}" for x in ("posts", "seen", "cursor", "checkpoint")], "1").awaitTermination(120)
    posts = spark.read.json(f"{tmp_path}/posts").collect()
    assert [(x.post_id, x.caption, x.img_count) for x in posts] == [("A1", "福如東海", 1)]
    assert files.cursor(spark, f"{tmp_path}/cursor/*.txt").where("cursor IS NOT NULL").first().cursor == "c1"


def naive_align(anchor, caption, original):
    """Every window of the text, every shift of the rescue, by definition."""
    if not anchor or not original:
        return 0.0, 0, 0, ""
    if caption is None or len(caption) != len(original):
        return (None,) * 4

    def best(short, long):
        m, n = len(short), len(long)
        spans = [(0, k) for k in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
        return max((s.ratio(short, long[i:k]), -i, k) for i, k in spans)

    if len(anchor) > len(caption):
        score, start, end = best(caption, anchor)[0], 0, len(caption)
    else:
        score, start, end = best(anchor, caption)
        start = -start
        if len(anchor) == len(caption) and best(caption, anchor)[0] > score:
            score, start, end = best(caption, anchor)[0], 0, len(caption)
    bag = lambda i, k: 200 * sum((Counter(anchor) & Counter(caption[i:k])).values()) / (len(anchor) + k - i)
    chosen, missing = (start, end), len(anchor) - (end - start)
    if missing > 0 and end - start < len(caption):
        for before in range(missing + 1):
            shifted = max(0, start - before), min(len(caption), end + missing - before)
            if bag(*shifted) > bag(*chosen):
                chosen = shifted
    return round(score, 1), start, end, original[chosen[0] : chosen[1]]


def test_best_windows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    rows = [(text(rng.randint(0, 12)), text(rng.randint(0, 30))) for _ in range(500)]
    rows += [(text(40), text(41)), (text(70), text(200)), ("", "ab"), ("ab", ""), ("a", "a"), ("\U0001f600é", "xé\U0001f600éy"), ("x" * 300, "y" * 400), ("ab" * 50, "ba" * 60)]
    rows = [(a, c, c.upper()) for a, c in rows] + [(None, "ab", "ab"), ("ab", None, "ab"), ("ab", "ab", None), ("ab", "abc", "ab")]
    assert s.align_all(rows) == [naive_align(*x) for x in rows]
    # However many are compared together, and one after the other.
    together, s.TOGETHER = s.TOGETHER, 1
    try:
        assert s.align_all(rows) == [s.align_all([x])[0] for x in rows]
    finally:
        s.TOGETHER = together
    # A long text: the copy in it is found in one pass over it.
    long = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    assert s.best_windows([(long[30_000:30_050], long)]) == [(100.0, long.index(long[30_000:30_050]), long.index(long[30_000:30_050]) + 50)]


def test_pairs_are_whole(spark, tmp_path):
    rng = random.Random(2)
    words = [rng.choice("abcdef") * rng.randint(1, 2) + rng.choice("xyz") for _ in range(400)]
    docs = [(i, " ".join(words[12 * i : 12 * i + 20]) + ".") for i in range(30)]
    items = [(i, " ".join(words[9 * i : 9 * i + 1 + i % 9])) for i in range(36)] + [(97, words[0][:1]), (98, f"{words[2]} {words[3][:1]}"), (99, None), (100, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.item_id): (x.start, x.label) for x in queries.verbatim_slice(spark, str(tmp_path)).collect()}
    assert got == {(d, i): (a.index(b) + 1, b) for d, a in docs for i, b in items if b is not None and b in a}
    # An answer that holds the turn with a word changed; one that doesn't hold it; an empty one.
    turns = [(1, 1, " ".join(words[:12])), (1, 2, " ".join(words[300:310] + words[:3] + ["changed"] + words[4:20])), (1, 3, "mmm nnn"), (1, 4, None)]
    spark.createDataFrame([(*x, "user") for x in turns], "conv_id long, turn int, text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: x for x in queries.window_align_gate(spark, str(tmp_path)).collect()}
    flat = ["".join(c for c in x[2] or "" if c.isalpha()) for x in turns]
    assert {k: (x.score, x.start, x.end, x.label) for k, x in got.items()} == {k: s.align_all([(flat[k - 1], flat[k], flat[k])])[0] for k in (1, 2, 3)}
    assert [got[k].status for k in (1, 2, 3)] == ["SUCCESS", "REJECT", "REJECT"]


def test_shared_values_are_computed_once_a_row(spark):
    """Inside a lambda an expression of the whole array is computed again for each element: shares, areas and the tallest box are bound before."""
    assert str(b.allocation(F.col("h"), F.col("n"))).count("round(") == 1
    assert str(b.clean_columns(F.col("c"), F.col("s"))).count("array_max(") == 1 and str(b.allocated_lines(F.col("t"), F.col("h"))).count("round(") == 1


def test_small_files_are_dealt_out(spark, tmp_path):
    """A file of one row group is one split; its orders, trees and responses are the work of many tasks."""
    make = lambda name, **c: spark.range(400).select(*[F.expr(x).alias(k) for k, x in c.items()]).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
    make("lineitem", l_orderkey="id div 2", l_linenumber="cast(id % 2 as int)", l_quantity="1.0D + id % 3")
    make("events", event_id="id", props="'{\"k\": 1}'")
    make("customer", c_custkey="id", c_name="'n'", c_nationkey="1", c_mktsegment="'segment'")
    from glosswright.plans import corpus_queries

    at = f"file://{tmp_path}"
    for rows, key in ((queries.queries()["allocated_text"](spark, at), "l_orderkey"), (queries.queries()["json_tree_walk"](spark, at), "event_id"), (corpus_queries._responses(spark, at), "c_custkey")):
        assert rows.count() > 0 and f"RepartitionByExpression [{key}" in rows._jdf.queryExecution().analyzed().toString()
