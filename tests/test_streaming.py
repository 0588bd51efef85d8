"""Streams: ingestion whose batches are begun again, streaks over restarts, silences, the bucketed seen table."""

import json
import random
import time
import tracemalloc

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glosswright.functions import text as t
from glosswright.plans.queries import oracle_sql, queries
from glosswright.sources import files, sinks
from glosswright.streaming import ingest as ing
from glosswright.streaming.sessions import _in_order, feed_sessions, store_sessions


def response(ids):
    lines = [json.dumps({"data": {"node": {"id": i, "comet_sections": {"content": {"story": {"message": {"text": "caption"}, "attachments": [{"i": {"uri": f"https://scontent.h/{i}.jpg", "width": 800, "height": 600}}]}}}}}, "page_info": {"end_cursor": f"c{i}"}}) for i in ids]
    return {"method": "POST", "url": "https://h/graphql", "post_data": "Feed", "status": 200, "body": "\n".join(lines)}


@pytest.fixture
def feed(spark, tmp_path):
    """A function that lands responses and runs the stream, and the table's paths."""
    at = {k: f"file://{tmp_path}/{k}" for k in ("landed", "posts", "seen", "cursor", "checkpoint")}
    (tmp_path / "landed").mkdir()

    def run(*responses, **options):
        for ids in responses:
            n = len(list((tmp_path / "landed").iterdir()))
            (tmp_path / "landed" / f"{n}.json").write_text(json.dumps(response(ids) | {"received_at": f"2026-01-01T00:00:{n:02d}"}) + "\n")
        rows = files.responses(spark, at["landed"], "Feed", stream=True)
        ing.ingest(rows, *[at[k] for k in ("posts", "seen", "cursor", "checkpoint")], "g", kept=t.LETTERS, **options).awaitTermination(300)

    return run, at


def stored(spark, at):
    return sorted(x.post_id for x in files.whole_batches(spark, at["posts"], f"{at['posts']}-batches", "post_id string").collect())


def test_repeated_batch_leaves_no_repeat(spark, feed, monkeypatch):
    run, at = feed
    run(["a", "b"])
    mark, commit = sinks.mark_seen, sinks.commit_batch

    def fails(*_):
        raise OSError("lost")

    # Posts are written, marks aren't; then both are, and the manifest isn't; each time the batch begins again.
    for name in ("mark_seen", "commit_batch"):
        monkeypatch.setattr(sinks, name, fails)
        with pytest.raises(Exception, match="lost"):
            run(["b", "c"])
        assert stored(spark, at) == ["a", "b"]
        monkeypatch.setattr(sinks, "mark_seen", mark)
        monkeypatch.setattr(sinks, "commit_batch", commit)
    run()
    assert stored(spark, at) == ["a", "b", "c"]
    assert sorted(x.post_id for x in spark.read.schema("post_id string").json(at["posts"]).collect()) == ["a", "b", "c"]
    assert sorted(x.post_id for x in files.seen_ids(spark, at["seen"]).collect()) == ["a", "b", "c"]
    assert files.cursor(spark, f"{at['cursor']}/*.txt").where("cursor IS NOT NULL").first().cursor == "cc"


def test_streak_outlives_a_restart(spark, feed):
    run, at = feed
    calls = []
    stop = {"stop": 4, "on_stop": lambda: calls.append(1)}
    run(["a", "b", "c"], **stop)
    run(["a", "b"], **stop)
    assert not calls
    run(["c", "x"], **stop)
    assert not calls
    run(["a", "b", "c"], **stop)
    assert not calls
    run(["x", "a"], **stop)
    assert len(calls) == 1
    assert [x.streak for x in spark.read.parquet(f"{at['checkpoint']}-streak").orderBy("batch").collect()] == [0, 2, 0, 3, 5]


def test_seen_buckets(spark, tmp_path):
    path, small = f"file://{tmp_path}/seen", f"file://{tmp_path}/compact"
    ids = spark.range(2000).select(F.concat(F.lit("p"), F.col("id")).alias("post_id"))
    for n in range(2):
        near = files.seen_near(spark, path, ids)
        sinks.mark_seen(ids.where(f"post_id LIKE '%{n}'"), near, path, f"b{n}")
    few = ids.where("post_id IN ('p10', 'p11', 'p13')")
    near = files.seen_near(spark, path, few)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    assert len({f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}) > 100
    touched = near.select(F.expr("_metadata.file_path").alias("f")).distinct().collect()
    assert 0 < len({f.f.split("bucket=")[1].split("/")[0] for f in touched}) <= 3
    assert {x.post_id for x in near.join(few, "post_id", "left_semi").collect()} == {"p10", "p11"}
    assert {x.post_id for x in files.seen_near(spark, path, few, "b0").join(few, "post_id", "left_semi").collect()} == {"p11"}
    sinks.compact_seen(spark, path, small)
    count = lambda p: files.seen_ids(spark, p).count()
    assert count(small) == count(path) == 400
    assert files.seen_near(spark, f"file://{tmp_path}/none", few).count() == 0


ARRIVALS = "session string, at timestamp, arrival long, post_id string, known boolean"


def land(spark, rows, path):
    spark.createDataFrame([(s, i, p, k) for s, i, p, k in rows], "session string, arrival long, post_id string, known boolean").select(
        "session", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("arrival")).alias("at"), "arrival", "post_id", "known"
    ).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ARRIVALS).parquet(path)


def test_sessions_go_on(spark, tmp_path):
    landed, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("landed", "out", "checkpoint"))
    first = [("s", 1, "a", True), ("s", 2, "b", True), ("s", 3, "a", True), ("z", 1, None, False)]
    then = [("s", 5, "c", True), ("s", 4, "b", True), ("s", 6, "d", False), ("z", 9, None, True), ("s", 7, "e", True)]
    for rows in (first, then):
        store_sessions(feed_sessions(land(spark, rows, landed), stop=3), out, checkpoint).awaitTermination(200)
    got = [(x.session, x.arrival, x.status, x.streak, x.stop) for x in spark.read.parquet(out).orderBy("session", "arrival").collect()]
    assert got == [
        ("s", 1, "duplicate", 1, False), ("s", 2, "duplicate", 2, False), ("s", 3, "repeated", 2, False), ("s", 4, "repeated", 2, False), ("s", 5, "duplicate", 3, True),
        ("s", 6, "new", 0, False), ("s", 7, "duplicate", 1, False), ("z", 1, "new", 0, False), ("z", 9, "repeated", 0, False),
    ]


def test_silence_by_the_clock(spark, tmp_path):
    """A feed that brings nothing more is ended by a timer, once, and what comes then begins anew."""
    landed, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("landed", "out", "checkpoint"))
    stream = land(spark, [("s", 1, "a", True), ("s", 2, "b", True), ("z", 1, "a", False)], landed)
    query = store_sessions(feed_sessions(stream, stop=3, silence=2.0), out, checkpoint, every="500 milliseconds")

    def ended():
        rows = files.results(spark, out, "session string, n long, streak long, status string")
        return {(x.session, x.n, x.streak) for x in rows.where("status = 'silence'").collect()}

    def wait(want):
        until = time.time() + 120
        while ended() != want and time.time() < until:
            assert query.exception() is None
            time.sleep(0.5)
        assert ended() == want

    try:
        wait({("s", 2, 2), ("z", 1, 0)})
        land(spark, [("s", 3, "a", True)], landed)
        wait({("s", 2, 2), ("z", 1, 0), ("s", 1, 1)})
    finally:
        query.stop()
    assert spark.read.parquet(out).where("status = 'silence'").count() == 3


def test_silence_by_events(spark, tmp_path):
    landed, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("landed", "out", "checkpoint"))
    batches = [[("s", 0, "a", True), ("s", 5, "b", True), ("s", 100, "a", True), ("z", 1, "q", False)], [("s", 105, "c", True), ("z", 300, "q", False)]]
    for rows in batches:
        store_sessions(feed_sessions(land(spark, rows, landed), stop=9, silence=20.0, by_events=True), out, checkpoint).awaitTermination(200)
    got = sorted((x.session, int(x.at.timestamp()) - 1_700_000_000, x.n, x.streak) for x in spark.read.parquet(out).where("status = 'silence'").collect())
    assert got == [("s", 5, 2, 2), ("s", 105, 2, 2), ("z", 1, 1, 0)]


def test_silences_of_the_last_seconds(spark, tmp_path):
    """Silences by timer and by gap that ended less than two seconds before the events do aren't taken for ended, as in the SQL."""
    last = 1_700_100_000_000_400
    after = {1: 14_401_500_000, 2: 14_402_500_000, 3: 14_402_000_000, 4: 14_402_000_001, 5: 14_399_000_000}
    rows = [(i, user, last - x) for i, (user, x) in enumerate(after.items())] + [(10, 6, last - 14_401_000_000), (11, 6, last), (12, 7, last - 40_000_000_000), (13, 7, last - 90_000_000_000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, us long").select("event_id", F.expr("cast(timestamp_micros(us) as timestamp_ntz)").alias("ts"), "user_id", F.lit("view").alias("event_type"))
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = queries()["streamed_silences"](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {tuple(x) for x in con.execute(oracle_sql()["streamed_silences"]).fetchall()}
    assert {x[0] for x in want} == {2, 4, 7} and {tuple(x) for x in got.collect()} == want


def test_arrivals_of_a_batch_are_held_as_numbers():
    rng, size = random.Random(3), 100_000
    rows = lambda n: (Row(at_us=rng.randrange(n), arrival=rng.choice([None, rng.randrange(9)]), post_id=rng.choice([None, "", str(rng.randrange(500))]), known=rng.choice([None, True, False])) for _ in range(n))
    some = list(rows(3000))
    want = sorted(((r.at_us, r.arrival, r.post_id, bool(r.known)) for r in some), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    assert list(_in_order(iter(some))) == want and list(_in_order(iter([]))) == []
    tracemalloc.start()
    assert sum(1 for _ in _in_order(rows(size))) == size
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * size
