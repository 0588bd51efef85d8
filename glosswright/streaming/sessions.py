"""Feed sessions as a stateful stream: streaks of already seen posts and silences, whose state outlives a restart."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glosswright.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session string, at_us long, arrival long, post_id string, status string, streak long, n long, stop boolean"


def _in_order(rows: Iterator[Row]) -> Iterator[tuple[int, int | None, str | None, bool]]:
    """``at_us, arrival, post_id, known`` by time and arrival (null first). Rows are held as numbers, 33 bytes each, and each id once."""
    at, arrival, of, flags, codes = array("q"), array("q"), array("q"), bytearray(), {}
    for r in rows:
        at.append(r.at_us)
        arrival.append(0 if r.arrival is None else r.arrival)
        of.append(codes.setdefault(r.post_id, len(codes)))
        flags.append(bool(r.known) + 2 * (r.arrival is not None))
    names, order = list(codes), np.arange(0)
    if at:
        order = np.lexsort((np.frombuffer(arrival, np.int64), np.frombuffer(flags, np.uint8) >= 2, np.frombuffer(at, np.int64)))
    for i in order:
        yield at[i], arrival[i] if flags[i] >= 2 else None, names[of[i]], bool(flags[i] & 1)


class FeedSession(StatefulProcessor):
    """One session's arrivals in order. State: the running streak, how many arrivals there were, the time of the last, and the session's ids.

    Rows are ``at_us`` (microseconds), ``arrival`` (order among equals), ``post_id``, ``known``. A silence of more than ``silence`` seconds ends a session: by a timer, or by the gap between two arrivals where
    the clock is that of the events.
    """

    def __init__(self, stop: int, silence: float | None, by_events: bool):
        self.most, self.silence, self.by_events = stop, None if silence is None else int(silence * 1_000_000), by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "streak long, n long, last long")
        self.ids = handle.getMapState("ids", "post_id string", "n long")

    def _ended(self, session: str, streak: int, n: int, last: int) -> Row:
        self.run.clear()
        self.ids.clear()
        return Row(session=session, at_us=last, arrival=None, post_id=None, status="silence", streak=streak, n=n, stop=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        streak, n, last = self.run.get() if self.run.exists() else (0, 0, None)
        here: set[str] = set()
        for at, arrival, post, known in _in_order(rows):
            if self.silence is not None and self.by_events and last is not None and at - last > self.silence:
                yield self._ended(key[0], streak, n, last)
                streak, n, here = 0, 0, set()
            name = post if post is not None else ""
            if name in here or self.ids.containsKey((name,)):
                status = "repeated"
            else:
                self.ids.updateValue((name,), (n,))
                status = "duplicate" if known else "new"
                streak = streak + 1 if known else 0
            here.add(name)
            n, last = n + 1, at if last is None else max(at, last)
            yield Row(session=key[0], at_us=at, arrival=arrival, post_id=post, status=status, streak=streak, n=n, stop=status == "duplicate" and streak >= self.most)
        self.run.update((streak, n, last))
        if self.silence is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            now = last // 1000 if self.by_events else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.silence // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.run.exists():
            yield self._ended(key[0], *self.run.get())

    def close(self) -> None:
        pass


def feed_sessions(arrivals: DataFrame, stop: int = 300, silence: float | None = None, by_events: bool = False, late: str = "1 second") -> DataFrame:
    """A stream of ``session, at, arrival, post_id, known`` to each arrival's ``status`` (new, duplicate, repeated), running streak and whether it reaches ``stop``.

    With ``silence`` a row of status ``silence`` ends a session that had no arrivals for as many seconds: by the processing-time clock (a feed that has fallen silent brings no events that
    could tell the time), or by the events' watermark. The state is the checkpoint's: a restarted query goes on with its streaks. A task holds the arrivals
    that one batch has of a session; the files a batch takes bound them. A null id is an id.
    """
    spark = arrivals.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "None" if silence is None else "EventTime" if by_events else "ProcessingTime"
    rows = arrivals.select("session", F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.col("arrival").cast("long").alias("arrival"), "post_id", "known")
    if mode == "EventTime":
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("session").transformWithState(FeedSession(stop, silence, by_events), OUT, "Append", mode)
    return out.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def store_sessions(sessions: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends sessions to Parquet, each batch once: until the input is used up, or with ``every`` on and on (processing-time silences need batches without input)."""
    writer = sessions.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)
