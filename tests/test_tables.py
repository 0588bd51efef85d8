"""Landed tables and their sinks, pictures, phrases and trees, on small cases and against brute force."""

import io
import json
import os
import random
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.functions.phrases import converted, phrase_trie, simplified
from glosswright.functions.pictures import JPEG, PNG, picture_size
from glosswright.operators import jsontree as j
from glosswright.operators import relational as r
from glosswright.plans import prepared as pr
from glosswright.plans.queries import queries
from glosswright.session import shared_dir
from glosswright.sources import files, sinks
from glosswright.streaming import ingest as ing

BOX = "array<struct<bbox:array<double>,class:int,conf:double,center_x:double,height:double>>"


def png(w, h):
    return PNG + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def jpeg(w, h, *segments):
    frame = b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1)
    return JPEG + b"".join(b"\xff" + bytes([k]) + struct.pack(">H", n + 2) + bytes(n) for k, n in segments) + frame


def test_picture_size():
    cases = {
        png(7, 70_000): (7, 70_000), png(7, 9)[:20]: (None, None), jpeg(640, 480): (640, 480), jpeg(5, 6, (0xE0, 14), (0xE1, 65_000), (0xC4, 9)): (5, 6), jpeg(5, 6, (0xE1, 300))[:50]: (None, None),
        JPEG + b"\xff\xff" + jpeg(3, 4)[2:]: (3, 4), JPEG + b"\xff\x01" + jpeg(3, 4)[2:]: (3, 4), JPEG + b"\0\0" * 9: (None, None), b"GIF89a": (None, None), b"": (None, None),
    }
    assert {k: picture_size(k) for k in cases} == cases and picture_size(None) == (None, None)


def test_pictures_and_samples(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    rows = [("p:1", "福", "a  caption", 9), ("p:2", None, "rejected", 1), ("p:3", "x", None, None)]
    pictures = [("p:1", "b.JPG", jpeg(3, 4)), ("p:1", "c.gif", b"GIF"), ("p:2", "b.png", png(1, 2)), ("p:9", "b.png", png(1, 2))]
    for _ in range(2):  # a repeat writes the same files
        sinks.export_samples(spark.createDataFrame(rows, "post_id string, label string, caption string, score int"), spark.createDataFrame(pictures, "post_id string, name string, content binary"), path)
    found = {str(p.relative_to(tmp_path / "x")): p.read_bytes() for p in Path(tmp_path, "x").rglob("*") if p.is_file()}
    assert set(found) == {f"p_{n}/{f}" for n in "13" for f in ("label.txt", "metadata.txt", "post_info.json")} | {"p_1/images/b.JPG", "p_1/images/c.gif"}
    assert found["p_1/label.txt"].decode() == "福" and found["p_3/metadata.txt"] == b"" and json.loads(found["p_1/post_info.json"]) == {"post_id": "p:1", "label": "福", "caption": "a  caption", "score": 9}
    listed = files.images(spark, path, content=True, sizes=True).collect()
    assert [(x.post_id, x.name, x.width, x.height) for x in listed] == [("p_1", "b.JPG", 3, 4)]
    assert files.images(spark, path).columns == ["post_id", "name"]


def test_pictures_in_archives(spark, tmp_path, monkeypatch):
    """Small files share archives; pictures inside them are read as those beside them, and a repeat writes the same archives."""
    path = f"file://{tmp_path}/x"
    rows = [(f"p {i}/images", f"{i % 3}.{'JPG' if i % 2 else 'png'}", jpeg(i, 9) if i % 2 else png(i, 9)) for i in range(1, 90)]
    rows += [("é/images", "cut.jpg", JPEG), ("é/images", "none.png", None), ("é/images", "png", png(1, 1)), ("é/images", "note.txt", b"x"), rows[5], ("p 7/images", "7.gif", b"GIF")]
    table = spark.createDataFrame(rows, "folder string, name string, content binary")
    before = None
    for part in (7, 2):
        sinks.write_archives(table.repartition(part), path)
        made = {p.name: p.read_bytes() for p in Path(tmp_path, "x").iterdir() if not p.name.endswith(".crc")}
        assert len(made) <= 4 and made == (before or made)
        before = made
    sinks.write_files(spark.createDataFrame([("q/images", "b.jpeg", jpeg(3, 4))], "folder string, name string, content binary"), path)
    want = {(f"p {i}", f"{i % 3}.{'JPG' if i % 2 else 'png'}", i, 9) for i in range(1, 90)} | {("é", "cut.jpg", None, None), ("é", "none.png", None, None), ("q", "b.jpeg", 3, 4)}
    got = files.images(spark, path, content=True, sizes=True).collect()
    assert {(x.post_id, x.name, x.width, x.height) for x in got} == want and len(got) == len(want)
    assert {x.base64 for x in got if x.post_id == "é"} == {"/9g=", ""}
    assert {tuple(x) for x in files.images(spark, path).collect()} == {x[:2] for x in want}
    monkeypatch.setattr(sinks, "ARCHIVED", 20)
    monkeypatch.setattr(sinks, "ARCHIVED_BYTES", 2000)
    held = [zipfile.ZipFile(io.BytesIO(x)) for x in sinks._archives(iter(table.where("content IS NOT NULL").toArrow().to_batches(max_chunksize=11)))]
    assert all(len(x.infolist()) <= 20 for x in held) and len(held) > 4 and sum(len(x.infolist()) for x in held) == len(rows) - 1
    assert list(sinks._archives(iter([]))) == []


def test_picture_queries_make_few_files(spark):
    """A folder and a file for each picture need more inodes than a disk has; and a join with what a few archives hold isn't broadcast."""
    at = Path(shared_dir(spark).removeprefix("file:"), "scratch")
    old = set(at.glob("pictures-*"))
    for name in ("picture_sizes", "picture_density"):
        found = queries()[name](spark, "/root/testdata/sf0.001")
        assert found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() >= 200
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    made = set(at.glob("pictures-*")) - old
    assert len(made) == 2 and 0 < len([p for x in made for p in x.rglob("*")]) < 20


def naive_converted(text, rules):
    out, at = "", 0
    while at < len(text):
        for n in range(len(text) - at, 0, -1):
            if text[at : at + n] in rules:
                out, at = out + rules[text[at : at + n]], at + n
                break
        else:
            out, at = out + text[at], at + 1
    return out


def test_phrases(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abc\U0001f600") for _ in range(n))
    rules = {make(rng.randint(1, 5)): make(rng.randint(0, 3)) for _ in range(30)}
    texts = ["", *[make(rng.randint(1, 60)) for _ in range(60)], "a" * 50_000]
    trie = phrase_trie(rules)
    assert [converted(x, trie) for x in texts[:-1]] == [naive_converted(x, rules) for x in texts[:-1]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string")
    table = spark.createDataFrame([*rules.items(), ("zz", None), (None, "q"), ("", "q")], "phrase string, becomes string")
    got = [x.y for x in simplified(rows, "x", table, "y").orderBy("i").collect()]
    assert got == [*[converted(x, trie) for x in texts], None]
    assert simplified(spark.createDataFrame([("頭發發財zz",)], "x string"), "x", spark.createDataFrame([("頭發", "头发"), ("發", "发"), ("發財", "发财"), ("zz", None)], "phrase string, becomes string")).first().x == "头发发财"
    with pytest.raises(ValueError):
        simplified(rows, "x", table, most=3)


def bucket_files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def row(i, **values):
    return tuple({"post_id_numeric": i, "author_id": "a", "post_url": "u", "v11_folder": "v", "merged_folder": None, "scrape_time": None, "has_label": False}.get(c) if c not in values else values[c] for c in sinks.INDEX_COLUMNS)


def test_index_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    put = lambda rows: sinks.upsert_index(spark.createDataFrame(rows, sinks.INDEX), path)
    assert put([row(str(i)) for i in range(500)]) == sinks.INDEX_BUCKETS
    before = bucket_files(tmp_path / "index")
    changes = [row("7", author_id="b", post_url=None, has_label=None), row("new", merged_folder="m", has_label=True), row("new", merged_folder=None), row(None)]
    touched = put(changes)
    after = bucket_files(tmp_path / "index")
    assert touched <= 2 and len(before.keys() - after.keys()) <= 2 and all(after[p] == before[p] for p in before.keys() & after.keys())
    got = {x.post_id_numeric: x for x in spark.read.parquet(path).collect()}
    assert len(got) == 501 and (got["7"].author_id, got["7"].post_url, got["7"].has_label) == ("b", "u", False) and got["new"].merged_folder == "m"
    put(changes)
    assert {tuple(x) for x in spark.read.parquet(path).collect()} == {tuple(x) for x in got.values()}


def scanned(df):
    """Rows that the scan of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_absent_id_reads_no_row_group(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    address = F.md5(F.col("id").cast("string"))
    index = spark.range(20_000).select(F.col("id").cast("string").alias("post_id_numeric"), F.lit("a").alias("author_id"), address.alias("post_url"), F.lit("v").alias("v11_folder"), F.lit("m").alias("merged_folder"), F.lit("t").alias("scrape_time"), F.lit(True).alias("has_label"))
    sinks.write_index(index, path)
    table = spark.read.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        absent, there = (r.lookup(table, x, "post_url") for x in ("5" * 32, "cfcd208495d565ef66e7dff9f98764da"))
        assert scanned(absent) == 0 and absent.count() == 0
        assert scanned(there) > 0 and there.first().post_id_numeric == "0"
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_prepared(spark):
    posts = spark.createDataFrame([("1", "cap", "ann"), ("2", None, None), ("3", "no picture", None), ("4", "done", None)], "post_id string, caption string, author_name string")
    pictures = spark.createDataFrame([("1", "b.jpg"), ("1", "a.png"), ("1", "c.jpg"), ("2", "x.png"), ("4", "a.jpg")], "post_id string, name string")
    boxes = [([10.0 * i, 0.0, 10.0 * i + 10, 30.0], i % 2, 0.1 if i == 4 else 0.9) for i in range(5)]
    found = spark.createDataFrame([("1", "b.jpg", boxes), ("1", "a.png", boxes[:1])], "post_id string, name string, boxes array<struct<bbox:array<double>,class:int,conf:double>>")
    got = {x.post_id: x for x in pr.prepared(posts, pictures, found, "catchup", posts.where("post_id = '4'")).collect()}
    assert set(got) == {"1", "2"} and (got["1"].image, got["2"].image) == ("b.jpg", "x.png")
    assert [b.center_x for b in got["1"].yolo_columns] == [25.0, 5.0] and [b.center_x for b in got["1"].yolo_signatures] == [35.0, 15.0]
    assert got["2"].original_metadata == "" and got["2"].yolo_columns == [] and got["1"].facebook.author_name == "ann" and got["1"].facebook.post_url is None and got["1"].source == "catchup"


def test_unreadable_documents(spark, tmp_path):
    for name, body in {"a": '{"post_id": "1"}', "b": '{"post_id": '}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "info.json").write_text(body)
    read = lambda how: files.documents(spark, f"file://{tmp_path}/*", "post_id string", how)
    assert [x.post_id for x in read("skip").collect()] == ["1"] and {x.post_id for x in read("default").collect()} == {"1", None}
    assert [x.folder for x in read("quarantine").collect()] == ["b"]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        read("raise").collect()


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    rows = spark.range(120).select(F.concat(F.lit("d "), F.col("id").cast("string")).alias("folder"), F.lit("a.json").alias("name"), F.concat(F.lit('{"post_id": "'), F.col("id").cast("string"), F.lit('"}')).alias("content"))
    sinks.write_files(rows.coalesce(1), path)
    sinks.write_files(rows.limit(3).select(F.concat("folder", F.lit("/images")).alias("folder"), F.lit("p.png").alias("name"), F.lit(png(3, 4)).alias("content")), path)
    (tmp_path / "x" / "none").mkdir()
    (tmp_path / "x" / "d 1" / ".hidden").write_text("h")
    (tmp_path / "x" / "d 1" / "_hidden.json").write_text("h")
    (tmp_path / "x" / "top.txt").write_bytes(b"\xc3\xa9")
    found = files.documents(spark, f"{path}/*", "post_id string", "default")
    assert {(x.folder, x.post_id) for x in found.collect()} == {(f"d {i}", str(i)) for i in range(120)} | {("x", None)}
    # Spark's own listing keeps every file's name and size on the driver.
    assert all(len(x.inputFiles()) < 60 for x in (found, files.captions(spark, f"{path}/*"), files.folders(spark, path), files.images(spark, path, sizes=True)))
    assert {x.folder: x.n_files for x in files.folders(spark, path).collect()} == {"x": 1, "images": 3} | {f"d {i}": 1 for i in range(120)}
    assert [(x.name, x.width, x.height) for x in files.images(spark, path, sizes=True).collect()] == [("p.png", 3, 4)] * 3
    assert [x.caption for x in files.captions(spark, path).collect()] == ["é"] and files.captions(spark, f"{path}/*/*").count() == 123
    assert files.captions(spark, f"{path}/d 1*").count() == 31


def test_deep_and_broken_trees(spark):
    deep = '{"k":' * 500 + '"v"' + "}" * 500
    odd = json.dumps({"post_id": "12", "e": [], "n": None, "f": False, "node": {"id": "p1", "comet_sections": None, "z": 1.5}, "x": [{"node": {"id": "p2", "comet_sections": {"a": 1}}}, {"post_id": 13}, {"post_id": "no"}]})
    rows = spark.createDataFrame([(1, deep), (2, "{broken"), (3, None), (4, odd), (5, "[1]"), (6, "")], "i int, line string")
    tree = j.walked(rows, ["i"]).cache()
    assert {x.i: x.n for x in tree.groupBy("i").agg(F.count("*").alias("n")).collect()} == {1: 501, 4: 19, 5: 2}
    deepest = tree.where("i = 1").orderBy(F.desc("depth")).first()
    assert (deepest.depth, deepest.scalar, deepest.pos, deepest.parent, deepest.path) == (500, "v", 500, 499, "$" + ".k" * 500)
    assert {x.post_id for x in j.post_ids(tree, ["i"]).collect()} == {"12", "13", "p2"} and {x.post_id for x in j.post_ids(tree, ["i"], bare=False).collect()} == {"p2"}
    assert {x.post_id: x.node is not None for x in j.posts(tree, ["i"]).collect()} == {"12": False, "13": False, "p2": True}
    assert {x.post_id for x in j.post_nodes(tree, ["i"]).collect()} == {"p1", "p2"}
    first = lambda key: {x.i: x[key] for x in j.first_value(tree, ["i"], key).collect()}
    assert first("k") == {1: "v"} or first("k") == {1: None}
    assert first("f") == {4: "false"} and first("e") == {} and first("n") == {} and first("z") == {4: "1.5"}


def test_first_arrivals_and_supervision(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:10:00"), ("b", "2026-01-01 00:20:00")]
    spark.createDataFrame(rows, "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{path}/in")
    started = []

    def start(fails=2):
        started.append(1)
        out = ing.first_arrivals(stream, ["k"], "ts")
        late = len(started) <= fails
        writer = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/check{len(started) if late else ''}")
        return (writer.trigger(processingTime="1 hour") if late else writer.trigger(availableNow=True)).start(f"{path}/out{len(started) if late else ''}")

    assert ing.supervise(start, 5, 20) == 3 and len(started) == 3
    assert sorted(x.k for x in spark.read.parquet(f"{path}/out").collect()) == ["a", "b"]
    assert ing.supervise(lambda: start(99), 1, 1) == 1


def test_dispositions_and_stamps(spark):
    images = spark.createDataFrame([([], None), (["x"], None), (["x"], "short"), (None, "short")], "i array<string>, why string")
    got = [tuple(x) for x in images.select(t.disposition(F.col("i"), F.col("why")), t.disposition(F.col("i"), F.col("why"), counted=False)).collect()]
    assert got == [("no_images", "dropped"), ("kept", "kept"), ("skipped", "dropped"), ("no_images", "dropped")]
    now = spark.range(1000).repartition(8).select(t.stamp().alias("s")).distinct().collect()
    assert len(now) == 1 and len(now[0].s) == 19


def test_batch_state_is_a_document_a_job(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    rows = [(f"j{c}", c, o, f"p{c}{o}") for c in range(5) for o in range(3 if c < 4 else 1)]
    sinks.store_batch_state(spark.createDataFrame(rows, "job string, chunk long, ordinal long, post_id string").repartition(7), path)
    assert sorted((x.job, x.ordinal, x.post_id) for x in files.batch_state(spark, path).collect()) == sorted((a, o, p) for a, _, o, p in rows)
    docs = [json.loads(x.value) for x in spark.read.text(path).collect()]
    assert sorted(x["count"] for x in docs) == [1, 3, 3, 3, 3]
    assert os.path.isdir(tmp_path / "state")


def test_cache_documents(spark, tmp_path):
    box = [([0.0, 0.0, 1.0, 2.0], 0, 0.5, 0.5, 2.0)]
    cache = spark.createDataFrame([("a", 1, "a.jpg", box, []), ("b", 0, None, [], []), ("c", None, None, None, None)], f"post_id string, num_columns int, best_image string, columns {BOX}, signatures {BOX}")
    sinks.store_detections(cache, f"file://{tmp_path}/rows")
    assert {x.post_id: x.num_columns for x in files.detection_cache(spark, f"file://{tmp_path}/rows").collect()} == {"a": 1, "b": 0, "c": None}
    (tmp_path / "one.json").write_text(json.dumps({"a": {"num_columns": 1, "best_image": "a.jpg", "columns": [], "signatures": []}}))
    assert files.detection_cache(spark, f"file://{tmp_path}/one.json", one_document=True).first().best_image == "a.jpg"
    assert tuple(r.cache_counts(cache).first()) == (3, 1, 2)


def test_scratch_scopes(spark):
    from glosswright.session import scratch_scope, written

    there = lambda df: sinks.exists(spark, df.scratch_path)
    before = written(spark.range(3), "before")
    with scratch_scope(spark) as keep:
        gone = written(spark.range(3), "gone")
        with scratch_scope(spark) as inner:
            deep, shallow = inner(written(gone, "deep")), written(gone, "shallow")
        assert there(deep) and not there(shallow)
        kept = keep(written(deep.unionByName(before), "kept"))
    assert there(before) and there(kept) and not there(gone) and not there(deep)
    assert kept.count() == 6 and there(written(kept, "after"))
