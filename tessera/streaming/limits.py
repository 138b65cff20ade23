"""Rate limits, daily budgets and windowed counts on streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.serving import CAPACITY, REFILL, Bucket


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", capacity: float = CAPACITY, refill: float = REFILL, idle: str = "10 minutes") -> DataFrame:
    """(order, key, allowed, wait) of a stream of requests. The state is two numbers a key, dropped after ``idle`` without a request."""
    seconds = float(pd.Timedelta(idle).total_seconds())

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(capacity, refill, *state.get) if state.exists else Bucket(capacity, refill)
        rows = pd.concat(list(batches)).sort_values(["t", "o"])
        out = [bucket.take(t) for t in rows.t]
        state.update((bucket.tokens, bucket.at))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({order: rows.o.to_numpy(), key: k[0], "allowed": [a for a, _ in out], "wait": [w for _, w in out]})

    rows = events.select(F.col(key).alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(order).alias("o"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("o", "k")]
    return rows.groupBy("k").applyInPandasWithState(step, f"`{order}` {kinds[0]}, `{key}` {kinds[1]}, allowed boolean, wait double", "tokens double, at double", "append", "ProcessingTimeTimeout")


def daily_calls(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, n): calls by UTC day; a day closes when the watermark has passed it."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(F.window("__ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def windowed(events: DataFrame, by: str = "event_type", value: str = "value", ts: str = "ts", width: str = "10 minutes", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """(start, by, n, total) over tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window("__ts", width, slide or width)
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
