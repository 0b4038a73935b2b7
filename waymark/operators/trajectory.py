"""Position events: dwells, visits, day segments, homes, throttling, trips.

Fixes have, by default, the columns user_id (or another key), ts, lat, lng and an event id that orders equal times.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, haversine, metres
from .folds import accepted

#: Radius and least length of a dwell, how near and how soon a visit counts; segment and throttle limits.
DWELL_M, DWELL_S, VISIT_M = 120.0, 600, 100.0
TRAVEL_M, SPAN_M, CELLS, FULL_EVENTS = 40_000, 2_500, 6, 12
THROTTLE_M, THROTTLE_S = 250.0, 600
NIGHTS, DOMINANCE = 5, 1.8
TRIP_GAP_DAYS, TRIP_RADIUS_M = 4, 150_000


def dwells(fixes: DataFrame, key: str = "user_id", radius_m: float = DWELL_M, least_s: int = DWELL_S, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Maximal runs of fixes each within radius_m of the one before: (key, dwell, started, ended, fixes, lat, lng).

    A jump starts a run; lat and lng are plain means; runs shorter than least_s are left out, as are fixes without a place.
    """
    w = Window.partitionBy(key).orderBy(*order)
    known = fixes.where("lat IS NOT NULL AND lng IS NOT NULL")
    gap = haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    run = known.withColumn("_new", F.when(F.coalesce(gap <= radius_m, F.lit(False)), 0).otherwise(1)).withColumn("dwell", F.sum("_new").over(w))
    out = run.groupBy(key, "dwell").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("fixes"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000
    return out.where(seconds >= least_s)


def visits(found: DataFrame, served: DataFrame, settled: DataFrame, key: str = "user_id", radius_m: float = VISIT_M) -> DataFrame:
    """Recommendations (rec_id, key, served_at, lat, lng), served before a dwell ends and within radius_m of it, unsettled.

    One row per recommendation: its first such dwell.
    """
    r = served.join(settled.select("rec_id").distinct(), "rec_id", "left_anti").select("rec_id", key, "served_at", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    near = found.join(r, key).where((F.col("served_at") < F.col("ended")) & (haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")) <= radius_m))
    first = near.groupBy("rec_id").agg(F.min(F.struct("started", "dwell", "ended", key)).alias("x"))
    return first.select("rec_id", F.col(f"x.{key}").alias(key), F.col("x.dwell").alias("dwell"), F.col("x.started").alias("started"), F.col("x.ended").alias("ended"))


def day_segments(fixes: DataFrame, cell: Column, key: str = "user_id", travel_m: float = TRAVEL_M, span_m: float = SPAN_M, cells: int = CELLS, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each key and UTC day as travel, sightseeing or relaxation, with net displacement, span, cells and confidence."""
    known = fixes.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("day", F.to_date("ts")).withColumn("_cell", cell)
    at = F.struct(*order, "lat", "lng")
    by = known.groupBy(key, "day").agg(
        F.min(at).alias("a"), F.max(at).alias("z"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"),
        F.count_distinct("_cell").alias("cells"), F.count("*").alias("events"),
    )
    by = by.withColumn("net_m", F.round(haversine(F.col("a.lat"), F.col("a.lng"), F.col("z.lat"), F.col("z.lng"))).cast("long"))
    by = by.withColumn("span_m", F.round(haversine(F.col("s"), F.col("w"), F.col("n"), F.col("e"))).cast("long"))
    kind = F.when(F.col("net_m") >= travel_m, "travel").when((F.col("span_m") >= span_m) | (F.col("cells") >= cells), "sightseeing").otherwise("relaxation")
    return by.select(key, "day", kind.alias("kind"), "net_m", "span_m", "cells", "events", F.round(F.least(F.lit(1.0), F.col("events") / FULL_EVENTS), 3).alias("confidence"))


def home_cells(fixes: DataFrame, cell: Column, key: str = "user_id", nights: int = NIGHTS, dominance: float = DOMINANCE, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The cell where a key's days start or end, if on `nights` days at least and `dominance` times the next cell's."""
    known = fixes.withColumn("_cell", cell).where("_cell IS NOT NULL").withColumn("day", F.to_date("ts"))
    at = F.struct(*order, "_cell")
    ends = known.groupBy(key, "day").agg(F.min(at)["_cell"].alias("first"), F.max(at)["_cell"].alias("last"))
    both = ends.select(key, "day", F.col("first").alias("cell")).union(ends.select(key, "day", F.col("last").alias("cell"))).distinct()
    counted = both.groupBy(key, "cell").agg(F.count("*").alias("nights"))
    w = Window.partitionBy(key).orderBy(F.desc("nights"), "cell")
    ranked = counted.withColumn("next", F.coalesce(F.lead("nights").over(w), F.lit(0))).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    good = (F.col("nights") >= nights) & ((F.col("next") == 0) | (F.col("nights") >= dominance * F.col("next")))
    return ranked.where(good).select(key, "cell", "nights", F.round(F.col("nights") / (F.col("nights") + F.col("next")), 3).alias("confidence"))


def throttled(fixes: DataFrame, by: list[str], least_m: float = THROTTLE_M, least_s: int = THROTTLE_S, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The fixes that differ by place or time from the last accepted one; the first of each group always.

    The state is what was accepted last, so this is an ordered fold over each group (a trip, or a key's day).
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, bool]:
        if state is None or metres(state[1], state[2], row[1], row[2]) >= least_m or abs((row[0] - state[0]).total_seconds()) >= least_s:
            return row, True
        return state, False

    known = fixes.where("lat IS NOT NULL AND lng IS NOT NULL").select(*by, *[c for c in order if c not in by], "lat", "lng")
    return accepted(known, by, order, (order[0], "lat", "lng"), step)


def trips(sessions: DataFrame, key: str = "user_id", gap_days: int = TRIP_GAP_DAYS, radius_m: float = TRIP_RADIUS_M) -> DataFrame:
    """sessions(session_id, key, started_at, lat, lng) with their trip number within the key.

    A session joins the open trip if it starts less than gap_days after the trip's last session and lies within radius_m
    of the trip's first origin; otherwise it closes that trip and opens the next. A key's sessions are folded in order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["started_at", "session_id"], kind="stable")
        number, anchor, last, out = 0, None, None, []
        for t, lat, lng in zip(pdf["started_at"], pdf["lat"], pdf["lng"], strict=True):
            joins = False
            if anchor is not None:
                joins = (t - last).total_seconds() < gap_days * 86_400 and metres(*anchor, lat, lng) <= radius_m
            if not joins:
                number, anchor = number + 1, (lat, lng)
            last = t
            out.append(number)
        return pdf.assign(trip=out)[["session_id", key, "trip"]]

    kinds = dict(sessions.dtypes)
    return sessions.groupBy(key).applyInPandas(fold, f"session_id {kinds['session_id']}, {key} {kinds[key]}, trip long")


def idle_sessions(sessions: DataFrame, serves: DataFrame, now: Column, minutes: int = 720) -> DataFrame:
    """Open sessions(session_id, started_at, ended_at) without a serve(session_id, served_at) in the last minutes."""
    recent = serves.where(F.col("served_at") > now - F.make_interval(mins=F.lit(minutes)))
    open_ = sessions.where(F.col("ended_at").isNull() & (F.col("started_at") <= now - F.make_interval(mins=F.lit(minutes))))
    return open_.join(recent.select("session_id").distinct(), "session_id", "left_anti")


def suppress_home(rows: DataFrame, homes: DataFrame, key: str = "user_id", radius_m: float = 300.0) -> DataFrame:
    """Rows without those within radius_m of the key's home(key, lat, lng); rows of keys without one stay."""
    h = homes.select(F.col(key), F.col("lat").alias("_hlat"), F.col("lng").alias("_hlng"))
    joined = rows.join(h, key, "left")
    near = haversine(F.col("lat"), F.col("lng"), F.col("_hlat"), F.col("_hlng"), RADIUS["match"]) <= radius_m
    return joined.where(~F.coalesce(near, F.lit(False))).select(*rows.columns)
