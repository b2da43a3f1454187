"""Stories as arriving events: the state machine of `operators.narrative` kept by key across micro-batches.

For each slot of a story the state holds the newest edit and the newest approval, each by its number (seq) and not by
when it arrives, so events may be split into batches, come late or come twice: what has been emitted last for a story is
what `narrative.state` gives for all its events so far. A story that has had no event for some time is closed: its slots
are emitted once more as expired and its state is dropped, so the state grows with the stories that are alive. A later
event of a closed story begins a new one.

The state lives in Spark's state store (RocksDB), with the query's checkpoint; a lost executor's keys are restored there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "story long, slot int, text string, approved boolean, review boolean, version long, expired boolean"
#: Number of an edit or approval that has not been.
NEVER = -1


class Stories(StatefulProcessor):
    """idle_ms: how long after its last event (event time) a story is closed; None: never."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", "text string, edited long, approved_at long")
        self.last = handle.getValueState("last", "at long")

    def _rows(self, story: int, version: int, expired: bool) -> pd.DataFrame:
        """The slots that hold an edit, in order: an edit takes back the approval of its slot and of all later ones."""
        out, touched = [], NEVER
        for (slot,), (text, edited, approved_at) in sorted(self.slots.iterator(), key=lambda x: x[0][0]):
            if edited == NEVER:
                continue
            touched = max(touched, edited)
            out.append((story, slot, text, approved_at > touched, touched > edited and text != "", version, expired))
        return pd.DataFrame(out, columns=["story", "slot", "text", "approved", "review", "version", "expired"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))  # one story's events of one batch
        held: dict[int, list] = {}
        for slot, verb, seq, text in zip(events["slot"].tolist(), events["verb"], events["seq"].tolist(), events["text"]):
            if slot not in held:
                held[slot] = list(self.slots.getValue((slot,))) if self.slots.containsKey((slot,)) else [None, NEVER, NEVER]
            now = held[slot]
            if verb in ("edit", "generate") and seq > now[1]:
                now[0], now[1] = text, seq
            elif verb == "approve" and seq > now[2]:
                now[2] = seq
        for slot, now in held.items():
            self.slots.updateValue((slot,), tuple(now))
        if self.idle_ms is not None:
            latest = int(events["at"].max())
            if self.last.exists():
                before = self.last.get()[0]
                latest = max(latest, before)
                self.handle.deleteTimer(before + self.idle_ms)
            self.last.update((latest,))
            self.handle.registerTimer(latest + self.idle_ms)
        version = max(max(now[1], now[2]) for _, now in self.slots.iterator())
        yield self._rows(key[0], version, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version = max(max(now[1], now[2]) for _, now in self.slots.iterator())
        yield self._rows(key[0], version, True)
        self.slots.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def states(events: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """events: a stream of story, seq, slot, verb, text and, for expiry, ts. A row for each slot of each story that had
    events in a batch. idle and late: intervals such as '30 minutes'; how long a story lives after its last event, and how
    far behind the newest event another may come and still count."""
    seconds = None if idle is None else events.sparkSession.sql(f"SELECT CAST(INTERVAL {idle} AS INTERVAL SECOND)").first()[0].total_seconds()
    idle_ms = None if seconds is None else int(seconds * 1000)
    named = events.select(F.col("story").cast("long").alias("story"), F.col("seq").cast("long").alias("seq"), F.col("slot").cast("int").alias("slot"), "verb", "text", *([] if idle is None else ["ts", F.unix_millis("ts").alias("at")]))
    if idle is not None:
        named = named.withWatermark("ts", late)
    return named.groupBy("story").transformWithStateInPandas(Stories(idle_ms), OUT, "Update", "None" if idle is None else "EventTime")


def newest(emitted: DataFrame) -> DataFrame:
    """Of what a query has emitted, the last of each slot: (story, slot, text, approved, review)."""
    last = emitted.groupBy("story", "slot").agg(F.max_by(F.struct("text", "approved", "review"), F.struct("version", "batch", "expired")).alias("x"))
    return last.select("story", "slot", "x.*")


def run(events: DataFrame, out: str, checkpoint: str, idle: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Write each batch's states under its number, so that a batch that runs twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        return states(events, idle, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
