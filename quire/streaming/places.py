"""Reading positions as a stream: latest place by key, idle sessions, and the trail of jumps back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE, IDLE, TRAIL, NEAR = "1 hour", "20 minutes", 32, 0.02


def stream(spark, path: str, schema) -> DataFrame:
    """events as a file stream, ts as a timestamp with a watermark; what comes later than it may be dropped (a rule of our own)."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def latest(events: DataFrame) -> DataFrame:
    """user_id, ts, event_type of the latest save; an update of smaller (ts, event_id) never replaces a larger one."""
    best = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    return events.groupBy("user_id").agg(best).select("user_id", "x.ts", "x.event_type")


def sessions(events: DataFrame) -> DataFrame:
    """Runs of saves with less than IDLE between them."""
    s = events.groupBy("user_id", F.session_window("ts", IDLE).alias("s")).agg(F.count("*").alias("saves"))
    return s.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "saves")


def trail(jumps: DataFrame) -> DataFrame:
    """jumps (user_id, ts, p) to user_id, trail: the last TRAIL places left, without those within NEAR of the one before."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for part in parts:
            for p in part.sort_values("ts")["p"]:
                if not kept or abs(kept[-1] - p) > NEAR:
                    kept = [*kept, float(p)][-TRAIL:]
        state.update((kept,))
        yield pd.DataFrame({"user_id": [key[0]], "trail": [kept]})

    return jumps.groupBy("user_id").applyInPandasWithState(step, "user_id long, trail array<double>", "trail array<double>", "update", GroupStateTimeout.NoTimeout)
