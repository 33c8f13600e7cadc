"""Streams of run events: the latest payload per key within a time to live, and windowed counts.

The windowed counts are an addition; the other two mirror progress channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """STR-1: an append-only folder of parquet parts as a stream; nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_per_key(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """STR-2: key, ts and payload whenever a key's latest event changes; keys without events for `ttl` of event time are
    forgotten. events: key string, ts timestamp, payload string, seq long."""
    span = pd.Timedelta(ttl)

    def newest(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = held
        for df in parts:
            row = df.sort_values(["ts", "seq"]).iloc[-1]
            now = (int(row["ts"].value // 1000), int(row["seq"]), row["payload"])
            best = now if best is None or now[:2] > tuple(best[:2]) else best
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000 + int(span.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        if held is None or tuple(best[:2]) != tuple(held[:2]):
            yield pd.DataFrame({"key": [key[0]], "ts": [pd.Timestamp(best[0], unit="us")], "payload": [best[2]]})

    return (
        events.withWatermark("ts", "10 minutes")
        .groupBy("key")
        .applyInPandasWithState(newest, "key string, ts timestamp, payload string", "us long, seq long, payload string", "update", GroupStateTimeout.EventTimeTimeout)
    )


def throttled(ticks: DataFrame, interval: float = 1.0, jump: int = 5) -> DataFrame:
    """STR-3: the ticks that are passed on. ticks: key string, ts timestamp, seq long, percent int, label string.

    A tick passes if it is its key's first, `interval` seconds or more after the last that passed, at 100 percent, or
    `jump` or more above the highest percent that passed. Ticks count in order of ts and seq. Ticks without a
    key are left out. A stream keeps two numbers a key, and late ticks count as they come; a table is sorted by key and
    walked in batches, so a hot key is never held whole.
    """

    out = "key string, ts timestamp, seq long, percent int, label string"

    def passing(df: pd.DataFrame, last: int, peak: int) -> tuple[pd.DataFrame, int, int]:
        passes = []
        for at, percent in zip(df["ts"].astype("datetime64[us]").astype("int64"), df["percent"], strict=True):
            passes.append(peak < 0 or percent == 100 or percent >= peak + jump or at - last >= interval * 1e6)
            if passes[-1]:
                last, peak = int(at), max(peak, int(percent))
        return df[passes], last, peak

    def keep(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts)).sort_values(["ts", "seq"])
        found, *new = passing(df, *(state.get if state.exists else (0, -1)))
        state.update(tuple(new))
        yield found

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, peak = None, 0, -1
        for df in parts:
            for key, own in df.groupby("key", sort=False):
                found, last, peak = passing(own, *((last, peak) if key == at else (0, -1)))
                at = key
                yield found

    rows = ticks.select("key", "ts", "seq", "percent", "label").where("key IS NOT NULL")
    if ticks.isStreaming:
        return rows.groupBy("key").applyInPandasWithState(keep, out, "last long, peak long", "append", GroupStateTimeout.NoTimeout)
    return rows.repartition("key").sortWithinPartitions("key", "ts", "seq").mapInPandas(walk, out)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key in tumbling windows of event time (an addition)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "key", "n")


def stage_events(run_id: str, stage: str, kind: str, at) -> tuple:
    """STR-5: one row of run_events: started, completed or failed."""
    if kind not in ("started", "completed", "failed"):
        raise ValueError(kind)
    return run_id, stage, kind, at
