"""Structured Streaming jobs; each takes a streaming (or batch) frame and leaves source and sink to the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def clusters(events: DataFrame, key: str, ts: str, event_id: str, gap: str = "120 seconds", late: str = "30 seconds", least: int = 2) -> DataFrame:
    """Sessions of a key with at least ``least`` different events, each event counted once within the watermark."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])
    return once.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(events: DataFrame, key: str, ts: str, every: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Events per tumbling window and key."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def confirmations(events: DataFrame, key: str, ts: str, flag: str, streak: int = 3, cooldown_seconds: float = 600, late: str = "30 seconds") -> DataFrame:
    """(key, at, streak): a key whose flag held ``streak`` times in a row, at most once a cooldown.

    State is two numbers a key; it ends once the watermark is a day past the key's last row.
    """

    def run(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1.0)
        out = []
        for row in pd.concat(list(frames)).sort_values(ts).itertuples(index=False) if not state.hasTimedOut else ():
            at = getattr(row, ts).timestamp()
            n = n + 1 if getattr(row, flag) else 0
            if n >= streak and (last < 0 or at - last >= cooldown_seconds):
                out.append((k[0], getattr(row, ts), n))
                last = at
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((n, last))
            state.setTimeoutTimestamp(int(max(at * 1000, state.getCurrentWatermarkMs())) + 86_400_000)
        yield pd.DataFrame(out, columns=[key, "at", "streak"])

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at timestamp, streak int", "n int, last double", "append", GroupStateTimeout.EventTimeTimeout)


def project(index: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of change events to an append-only index, safe to replay.

    A batch goes to a partition of its own and replaces it when it runs again; readers take the
    latest version of each key (``skein.operators.retrieval.live``).
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), version).alias("_v"))
        last.select(key, "_v.*").write.mode("overwrite").parquet(f"{index.rstrip('/')}/batch={number}")

    return write
