"""Structured Streaming forms: windows, deduplication, learning, breakers and change detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def rate_limits(events: DataFrame, quota: int, late: str = "10 minutes", window: str = "60 seconds") -> DataFrame:
    """Events of each user and window, and how many the quota lets through."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "n", F.least(F.col("n"), F.lit(quota)).alias("allowed"))


def once(events: DataFrame, keys: list[str], ttl: str = "24 hours") -> DataFrame:
    """The first event of a key within its time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def feedback_weights(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Feedback sums by event type over sliding windows; clicks count double."""
    factor = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.sum(factor * F.col("value")).alias("weight")).select(F.col("w.end").alias("at"), "event_type", "weight")


def split_bad(rows: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of a stream."""
    return rows.where(ok), rows.where(~F.coalesce(ok, F.lit(False)))


def breaker(events: DataFrame, most: int = 3, seconds: int = 60) -> DataFrame:
    """user_id, state, failures after each batch: closed, open after `most` failures in a row, half-open after a pause.

    events: user_id, ts, ok.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, opened = state.get if state.exists else ("closed", 0, 0.0)
        for b in batches:
            for ts, ok in b.sort_values("ts")[["ts", "ok"]].itertuples(index=False):
                t = pd.Timestamp(ts).timestamp()
                if name == "open" and t >= opened + seconds:
                    name = "half_open"
                if ok:
                    name, failures = ("open", failures) if name == "open" else ("closed", 0)
                else:
                    failures += 1
                    if name == "half_open" or failures >= most:
                        name, opened = "open", t
        state.update((name, failures, opened))
        yield pd.DataFrame({"user_id": [key[0]], "state": [name], "failures": [failures]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, failures int", "name string, failures int, opened double", "update", GroupStateTimeout.NoTimeout)


def changes(docs: DataFrame) -> DataFrame:
    """key, status, version: new, unchanged or changed by the last hash seen of a key. docs: key, at, hash.

    Of what one trigger brings of a key only times and hashes are held, to put them in order; the
    stream's own limit of files or rows a trigger bounds them. A key's state is its last hash and
    version, and stays: a key that was forgotten would be new again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version = state.get if state.exists else (None, 0)
        seen = sorted((at, h) for b in batches for at, h in zip(b["at"], b["hash"], strict=True))
        out = []
        for _, h in seen:
            status = "new" if last is None else "unchanged" if h == last else "changed"
            version += status != "unchanged"
            last = h
            out.append((key[0], status, version))
        state.update((last, version))
        yield pd.DataFrame(out, columns=["key", "status", "version"])

    return docs.groupBy("key").applyInPandasWithState(step, "key long, status string, version int", "last string, version int", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its rows as a Parquet table under a path of the shared folder.

    A batch that is run again writes over its own folder. In mode complete the last batch is the whole result. The
    stream goes on from the path's checkpoint when it is run again.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{'whole' if mode == 'complete' else f'batch={batch}'}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
