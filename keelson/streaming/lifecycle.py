"""Extension, not in the surveyed system: status counts and timeouts of scans over a stream of events.

Late events are bounded by a watermark; a scan's lifecycle is keyed state with an event-time timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "seen long, last_us long"
OUT = "user_id long, events long, outcome string"


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and their value per type and window; a window closes once the watermark passes it."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = held.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("starts_at"), "event_type", "n", "total")


def lifecycles(events: DataFrame, idle: str = "1 day", late: str = "30 minutes") -> DataFrame:
    """One row per user session: completed when an error ends it, expired when nothing follows in time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, _ = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "events": [seen], "outcome": ["expired"]})
            return
        seen, last = state.get if state.exists else (0, 0)
        ended = False
        for frame in frames:
            seen += len(frame)
            last = max(last, int(frame["ts"].max().value // 1000))
            ended = ended or bool((frame["event_type"] == "error").any())
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "events": [seen], "outcome": ["completed"]})
        else:
            state.update((seen, last))
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    held = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return held.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
