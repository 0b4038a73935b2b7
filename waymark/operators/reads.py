"""Everyday reads: named ranges, lookups, progress, runs, weather predicates, regions of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import SPACING, cell_centre, cell_of, parent_of
from .tables import latest

WET_MM, OVERCAST_PERCENT, WET_FRICTION = 0.2, 70, 0.35


def named_range(name: str, now: Column, zone: str) -> tuple[Column, Column]:
    """(since, until) in UTC of a named range that ends with the zone's day: today, 30d, all, and 7d for any other name."""
    local = F.from_utc_timestamp(now, zone)
    day = F.date_trunc("day", local)
    back = {"today": 0, "30d": 29}.get(name, 6)
    since = F.lit("1970-01-01 00:00:00").cast("timestamp") if name == "all" else F.to_utc_timestamp(day - F.make_interval(days=F.lit(back)), zone)
    return since, F.to_utc_timestamp(day + F.make_interval(days=F.lit(1)) - F.expr("INTERVAL 1 MICROSECOND"), zone)


def lookup(rows: DataFrame, keys: DataFrame, key: str, newest: Column) -> DataFrame:
    """Q03: for each asked key its newest row, or nulls."""
    return keys.select(key).join(latest(rows.join(keys.select(key), key, "left_semi"), [key], [newest]), key, "left")


def batch_progress(batches: DataFrame, prefix: str) -> DataFrame:
    """Q10: (done, total, failed) of the latest batch whose name starts with the prefix; none if it has finished."""
    last = batches.where(F.col("name").startswith(prefix)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    return last.where("finished_at IS NULL").select((F.col("total_jobs") - F.col("pending_jobs")).alias("done"), F.col("total_jobs").alias("total"), F.col("failed_jobs").alias("failed"))


def recent_runs(runs: DataFrame, limit: int = 12) -> DataFrame:
    """Q11: the newest runs."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def is_wet(rain_mm: Column) -> Column:
    """unknown rain is none."""
    return F.coalesce(rain_mm, F.lit(0.0)) >= WET_MM


def light_is_good(known: Column, rain_mm: Column, cloud_percent: Column) -> Column:
    """unknown weather is not overcast."""
    return F.when(~known, True).otherwise(~is_wet(rain_mm) & (F.coalesce(cloud_percent, F.lit(0)) < OVERCAST_PERCENT))


def weather_friction(known: Column, rain_mm: Column, needs_daylight: Column) -> Column:
    return F.when(~known | ~is_wet(rain_mm), 0.0).when(F.coalesce(needs_daylight, F.lit(False)), 1.0).otherwise(WET_FRICTION)


def keys_and_sizes(x: Column) -> Column:
    """struct<keys, sizes> of a map of arrays: its keys in order and how many values each has."""
    entries = F.sort_array(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("k"), F.coalesce(F.size(e["value"]), F.lit(0)).alias("n"))))
    return F.struct(F.transform(entries, lambda e: e["k"]).alias("keys"), F.transform(entries, lambda e: e["n"]).alias("sizes"))


def _once(x: Column, f) -> Column:
    """f(x), x being computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def boundary(cell: Column, spacing: float = SPACING) -> Column:
    """array<struct<lat, lng>> of a cell's corners, counterclockwise from the east, the first one again at the end."""
    return _once(cell_centre(cell, spacing), lambda c: _corners(c, spacing))


def _corners(c: Column, spacing: float) -> Column:
    unit = cell_centre(F.struct(F.lit(1).alias("q"), F.lit(0).alias("r")), spacing)
    rise = cell_centre(F.struct(F.lit(0).alias("q"), F.lit(1).alias("r")), spacing)
    radius = 1 / math.sqrt(3)  # of the corners, in spacings
    corners = [(math.cos(math.radians(60 * k + 30)) * radius, math.sin(math.radians(60 * k + 30)) * radius) for k in (*range(6), 0)]
    return F.array(*[F.struct((c["lat"] + rise["lat"] * (y / (math.sqrt(3) / 2))).alias("lat"), (c["lng"] + unit["lng"] * x).alias("lng")) for x, y in corners])


def box_of(corners: Column) -> Column:
    """struct<south, west, north, east> of a boundary."""
    of = lambda b, f, k: f(F.transform(b, lambda p: p[k]))
    return _once(corners, lambda b: F.struct(of(b, F.array_min, "lat").alias("south"), of(b, F.array_min, "lng").alias("west"), of(b, F.array_max, "lat").alias("north"), of(b, F.array_max, "lng").alias("east")))


def derived_regions(points: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """For points(key, lat, lng) that no known region covers the coarse cell around them and its box; covered has the keys that one covers."""
    todo = points.join(covered.select(key), key, "left_anti")
    parent = _once(cell_of(F.col("lat"), F.col("lng")), parent_of)
    of = lambda p: F.struct(F.concat_ws(":", F.lit("derived"), p["q"], p["r"]).alias("region_key"), box_of(boundary(p, 4 * SPACING)).alias("b"))
    return todo.select(key, _once(parent, of).alias("x")).select(key, "x.region_key", "x.b.*")
