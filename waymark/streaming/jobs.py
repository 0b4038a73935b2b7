"""Structured Streaming forms of the event operators.

The batch operators define the results; these keep the same state event by event. Late events beyond the watermark are
dropped, which is this library's own policy; a batch run over all events folds them in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trajectory import DWELL_M, DWELL_S, THROTTLE_M, THROTTLE_S


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(h)))


def admitted(events: DataFrame, live_sessions: DataFrame, homes: DataFrame) -> DataFrame:
    """Events of live sessions (a static table); at a user's home cell the place is dropped and the cell stays."""
    h = homes.select(F.col("user_id"), F.col("cell").alias("_home"))
    joined = events.join(live_sessions.select("session_id"), "session_id", "left_semi").join(h, "user_id", "left")
    at_home = F.coalesce(F.col("cell") == F.col("_home"), F.lit(False))
    return joined.withColumns({"lat": F.when(~at_home, F.col("lat")), "lng": F.when(~at_home, F.col("lng"))}).drop("_home")


def once_per_place(events: DataFrame, digits: int = 3, horizon: str = "120 seconds") -> DataFrame:
    """Q09/X11: one event per user and rounded position within the horizon."""
    keyed = events.withWatermark("ts", horizon).withColumns({"_lat": F.round("lat", digits), "_lng": F.round("lng", digits)})
    return keyed.dropDuplicatesWithinWatermark(["user_id", "_lat", "_lng"]).drop("_lat", "_lng")


def throttled_stream(fixes: DataFrame, least_m: float = THROTTLE_M, least_s: int = THROTTLE_S) -> DataFrame:
    """fixes(user_id, ts, lat, lng) that differ from the last accepted one; the state is that fix."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        keep = []
        for i, (t, lat, lng) in enumerate(zip(rows["ts"], rows["lat"], rows["lng"], strict=True)):
            now = t.timestamp()
            if last is None or _metres(last[1:], (lat, lng)) >= least_m or abs(now - last[0]) >= least_s:
                last = (now, float(lat), float(lng))
                keep.append(i)
        if last is not None:
            state.update(last)
        yield rows.iloc[keep][["user_id", "ts", "lat", "lng"]]

    own = fixes.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL")
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, lat double, lng double", "t double, lat double, lng double", "append", GroupStateTimeout.NoTimeout)


def dwell_stream(fixes: DataFrame, radius_m: float = DWELL_M, least_s: int = DWELL_S, watermark: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """A dwell when the next fix jumps away or the watermark passes idle_ms after it: (user_id, started, ended, fixes, lat, lng)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def close(s: tuple) -> None:
            if s[1] - s[0] >= least_s:
                out.append((key[0], pd.Timestamp(s[0], unit="s", tz="UTC"), pd.Timestamp(s[1], unit="s", tz="UTC"), int(s[2]), s[3] / s[2], s[4] / s[2]))

        s = state.get if state.exists else None  # start, end, count, sums, last place
        if state.hasTimedOut:
            if s is not None:
                close(s)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for t, lat, lng in zip(rows["ts"], rows["lat"], rows["lng"], strict=True):
                now, lat, lng = t.timestamp(), float(lat), float(lng)
                if s is not None and _metres((s[5], s[6]), (lat, lng)) <= radius_m:
                    s = (s[0], now, s[2] + 1, s[3] + lat, s[4] + lng, lat, lng)
                else:
                    if s is not None:
                        close(s)
                    s = (now, now, 1, lat, lng, lat, lng)
            if s is not None:
                state.update(s)
                state.setTimeoutTimestamp(max(int(s[1] * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "started", "ended", "fixes", "lat", "lng"])

    own = fixes.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL").withWatermark("ts", watermark)
    return own.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, started timestamp, ended timestamp, fixes long, lat double, lng double", "a double, z double, n long, x double, y double, lat double, lng double", "append", GroupStateTimeout.EventTimeTimeout
    )


def idle_stream(serves: DataFrame, watermark: str = "10 minutes", idle: str = "12 hours") -> DataFrame:
    """A session's serves as one session window; it is emitted when the session has been idle for that long."""
    w = F.session_window(F.col("served_at").cast("timestamp"), idle)
    own = serves.withColumn("served_at", F.col("served_at").cast("timestamp")).withWatermark("served_at", watermark)
    return own.groupBy("session_id", w.alias("w")).agg(F.count("*").alias("serves"), F.max("served_at").alias("last_serve")).select("session_id", "serves", "last_serve", F.col("w.end").alias("expired_at"))


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """A13 over time: events by type in tumbling windows."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
