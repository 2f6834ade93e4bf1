"""Jobs that run at times of their own, as keyed state with event-time timers: alerts for saved searches, and the sweep of dead letters.

What a key holds is bounded: a job keeps the rows that its next run gives, up to the most that
a run gives, and counts by time slot. A run's rows leave the state when its timer fires, and
keys whose slots are empty hold nothing. A stream that goes on from its checkpoint therefore
gives only what has come since.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
INTERVALS = {"hourly": 3600, "daily": 86_400, "weekly": 7 * 86_400}


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the state store that keeps keys in order; the session's setting comes back at the end."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


def slot_end(ms: int, every: int) -> int:
    """The first multiple of `every` after a time."""
    return (ms // every + 1) * every


class Alerts(StatefulProcessor):
    """Of each search the matches since its last run, given when the next one is due."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "due long", "n long, documents array<long>, times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for due, group in part.assign(due=[slot_end(int(t), int(e)) for t, e in zip(part["ms"], part["every_ms"], strict=True)]).groupby("due"):
                if now >= due:
                    continue  # its run has been: what comes so late is in no run
                n, documents, times = self.held.getValue((due,)) if self.held.containsKey((due,)) else (0, [], [])
                best = sorted([*zip(times, documents, strict=True), *zip(group["ms"].astype(int), group["document"].astype(int), strict=True)])[: self.most]
                self.held.updateValue((due,), (n + len(group), [int(d) for _, d in best], [int(t) for t, _ in best]))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        n, documents, _ = self.held.getValue((due,))
        self.held.removeKey((due,))
        yield pd.DataFrame({"search_id": [key[0]], "run_at_ms": [due], "matches": [n], "documents": [documents]})

    def close(self) -> None:
        pass


def matched(documents: DataFrame, searches: DataFrame) -> DataFrame:
    """search_id, document, ms, every_ms of a stream of documents (document, updated_at, text and fields) and the searches they meet.

    searches (search_id, enabled, query, frequency, source): settings, which Spark sends to every
    task if they are few. Blank parts of a search ask for nothing.
    """
    s = searches.where("enabled").select("search_id", F.lower(F.coalesce("query", F.lit(""))).alias("q"), F.coalesce("source", F.lit("")).alias("s"), *[F.coalesce(*[F.when(F.col("frequency") == k, F.lit(v * 1000)) for k, v in INTERVALS.items()], F.lit(INTERVALS["daily"] * 1000)).cast("long").alias("every_ms")])
    on = ((F.col("s") == "") | (F.col("s") == F.col("source"))) & ((F.col("q") == "") | F.contains(F.lower("text"), F.col("q")))
    return documents.join(s, on).select("search_id", "document", "updated_at", F.unix_millis("updated_at").alias("ms"), "every_ms")


def alerts(documents: DataFrame, searches: DataFrame, most: int = 50, late: str = "0 seconds") -> DataFrame:
    """search_id, run_at_ms, matches, documents: each run of a saved search gives what was updated since the run before, the earliest `most`.

    Runs are at the multiples of a search's interval; one without matches gives no row. documents
    is a stream with a time updated_at; what comes more than `late` behind the newest is in no run.
    """
    rows = matched(documents.withWatermark("updated_at", late), searches)
    return rows.groupBy("search_id").transformWithStateInPandas(statefulProcessor=Alerts(most), outputStructType="search_id long, run_at_ms long, matches long, documents array<long>", outputMode="append", timeMode="EventTime")


class Sweep(StatefulProcessor):
    """Of each queue the dead letters that haven't outlived their time, counted by slots; a row for each sweep that removes some."""

    def __init__(self, ttl_ms: int, every_ms: int, alert: int):
        self.ttl, self.every, self.alert = ttl_ms, every_ms, alert

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "due long", "n long")
        self.kept = handle.getValueState("kept", "n long")

    def _kept(self) -> int:
        return self.kept.get()[0] if self.kept.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, added = timerValues.getCurrentWatermarkInMs(), 0
        for part in rows:
            due = (part["ms"].astype("int64") + self.ttl) // self.every * self.every + self.every
            for at, n in due.value_counts().items():
                if at <= now:
                    continue  # older than its time to live when it comes
                old = self.slots.getValue((int(at),))[0] if self.slots.containsKey((int(at),)) else 0
                self.slots.updateValue((int(at),), (old + int(n),))
                self.handle.registerTimer(int(at))
                added += int(n)
        if added:
            self.kept.update((self._kept() + added,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        removed = self.slots.getValue((at,))[0]
        self.slots.removeKey((at,))
        left = self._kept() - removed
        if left:
            self.kept.update((left,))
        else:
            self.kept.clear()
        yield pd.DataFrame({"queue": pd.Series([key[0]], dtype=object), "swept_at_ms": [at], "removed": [removed], "kept": [left], "alert": [left > self.alert]})

    def close(self) -> None:
        pass


def sweeps(letters: DataFrame, ttl: int = 7 * 86_400, every: int = 3600, alert: int = 10, late: str = "0 seconds") -> DataFrame:
    """queue, swept_at_ms, removed, kept, alert: what each sweep of a queue removes, and whether over `alert` letters of those seen so far stay.

    letters (queue, at) is a stream; a sweep runs every `every` seconds and removes what is older than `ttl`.
    """
    rows = letters.withWatermark("at", late).select("queue", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=Sweep(ttl * 1000, every * 1000, alert), outputStructType="queue string, swept_at_ms long, removed long, kept long, alert boolean", outputMode="append", timeMode="EventTime")


def run(stream: DataFrame, path: str) -> DataFrame:
    """Run what is there now, with timers; all rows so far as a table under a path of the shared folder."""
    from .jobs import run_available

    with timer_store(stream.sparkSession):
        return run_available(stream, path)

