"""Lockout detection on authentication events.

Per (user in lower case, client address): five failures within 300 seconds of the
first block the key for 900 seconds; attempts while blocked are rejected and change
nothing; a success clears the state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .ops import previous_value

# ---------------------------------------------------------------- fixed values
WINDOW_SECONDS = 300
MAX_FAILURES = 5
BLOCK_SECONDS = 900
# ------------------------------------------------------------------------------
RESULT = "id long, user_key string, ts timestamp, outcome string, blocked_until timestamp"


@dataclass
class Attempts:
    """State of one key; times are seconds, or whole parts of which `unit` make a second."""

    fails: int = 0
    start: float = 0
    blocked_until: float = 0

    def record(self, now: float, success: bool, unit: int = 1) -> str:
        if self.blocked_until > now:
            return "rejected"
        if success:
            self.fails, self.start, self.blocked_until = 0, 0, 0
            return "success"
        if self.fails == 0 or now - self.start > WINDOW_SECONDS * unit:
            self.fails, self.start = 0, now
        self.fails += 1
        if self.fails >= MAX_FAILURES:
            self.blocked_until = now + BLOCK_SECONDS * unit
            return "locked"
        return "failed"


def user_key(username: Column | str, client_ip: Column | str) -> Column:
    name = F.lower(strip(F.coalesce(username, F.lit(""))))
    address = strip(F.coalesce(F.nullif(client_ip, F.lit("")), F.lit("unknown")))
    return F.concat(name, F.lit("|"), address)


def lockouts(events: DataFrame) -> DataFrame:
    """(id, user_key, ts, outcome, blocked_until) for events (id, ts, username,
    client_ip, success).

    After a pause longer than both the window and the block nothing of a key's past
    matters, so a key's history is cut there and the pieces run in parallel. Each piece
    streams through its task in order with a few numbers of state."""
    pause = max(WINDOW_SECONDS, BLOCK_SECONDS)
    keyed = events.select("id", "ts", user_key("username", "client_ip").alias("user_key"), "success")
    timed = previous_value(keyed, "user_key", "ts", "id", F.col("ts"), F.lit(None).cast("timestamp"), "_before")
    starts = F.col("_before").isNull() | (F.unix_micros("ts") - F.unix_micros("_before") > pause * 10**6)
    begun = timed.withColumn("_start", F.when(starts, F.col("ts")))
    pieces = last_value(begun, "user_key", "ts", "id", "_start", "piece")
    ordered = pieces.select("id", "ts", "user_key", "success", "piece").repartition("user_key", "piece").sortWithinPartitions(
        "user_key", "piece", "ts", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Attempts()
        for batch in batches:
            # whole microseconds: a fraction of a second as a float is off by some nanoseconds
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            outcomes, until = [], []
            for key, piece, now, success in zip(
                    batch["user_key"], batch["piece"], micros, batch["success"], strict=True):
                if (key, piece) != current:
                    current, state = (key, piece), Attempts()
                outcomes.append(state.record(now, bool(success), 10**6))
                until.append(state.blocked_until or None)
            yield pd.DataFrame({
                "id": batch["id"], "user_key": batch["user_key"], "ts": batch["ts"],
                "outcome": outcomes, "blocked_until": pd.Series(until, dtype="Int64", index=batch.index).astype("datetime64[us]")})

    return ordered.mapInPandas(run, RESULT)


def last_value(df: DataFrame, key: str, ts: str, tie: str, column: str, name: str, bucket: str = "day") -> DataFrame:
    """Adds the latest non-null `column` up to each row, bucket-wise like
    `previous_value`: one row per (key, bucket) crosses bucket borders."""
    cut = df.withColumn("_b", F.date_trunc(bucket, ts))
    inside = Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    lasts = cut.groupBy(key, "_b").agg(F.max(column).alias("_l"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(key, "_b", F.last("_l", ignorenulls=True).over(before).alias("_c"))
    seen = cut.withColumn("_s", F.last(column, ignorenulls=True).over(inside))
    other = carried.select(F.col(key).alias("_k2"), F.col("_b").alias("_b2"), "_c")
    return (
        seen.join(other, seen[key].eqNullSafe(other["_k2"]) & seen["_b"].eqNullSafe(other["_b2"]))
        .withColumn(name, F.coalesce("_s", "_c")).drop("_b", "_s", "_c", "_k2", "_b2")
    )
