"""Days, quiet hours, horizons, weather and opening hours."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEK = 7 * 24 * 60
_DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000


def in_quiet_hours(hour: Column, start: int, end: int) -> Column:
    """start <= hour < end, or around midnight where start is not below end; equal bounds mean never."""
    if start == end:
        return F.lit(False)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def part_of_day(hour: Column) -> Column:
    return F.when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def last_feasible_start(day_end: Column, closes_at: Column, departs_at: Column) -> Column:
    """The earliest of the limits that are known."""
    return F.least(day_end, closes_at, departs_at)


def first_wet_hour(times: Column, rain_mm: Column, now: Column, least: float = 0.2) -> Column:
    return F.get(F.filter(F.arrays_zip(times.alias("t"), rain_mm.alias("mm")), lambda x: (x["t"] >= now) & (x["mm"] >= least)), F.lit(0))["t"]


#: Notation that is richer than what is read here (fixed value).
_TOO_RICH = re.compile(r"PH|SH|sunrise|sunset|dawn|dusk|week\b|easter|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\|\||\"|\[", re.I)


def _days_of(spec: str) -> list[int] | None:
    """Numbers of the days of a list of days and ranges, Monday 0; a range may run over the week's end."""
    out: list[int] = []
    for part in spec.split(","):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if first not in _DAYS or dash and last not in _DAYS:
            return None
        i = _DAYS.index(first)
        out += [(i + k) % 7 for k in range((_DAYS.index(last) - i) % 7 + 1 if dash else 1)]
    return out


def parse_hours(spec: str | None) -> list[tuple[int, int]] | None:
    """Minute-of-week intervals of the plain part of the opening-hours notation; None for anything richer.

    Each rule adds its intervals, one that says off or closed adds none. Hours past midnight are not read.
    """
    if spec is None or not spec.strip() or _TOO_RICH.search(spec):
        return None
    if spec.strip() == "24/7":
        return [(-WEEK, 2 * WEEK)]
    out: list[tuple[int, int]] = []
    for rule in filter(None, (r.strip() for r in spec.split(";"))):
        m = re.match(r"((?:Mo|Tu|We|Th|Fr|Sa|Su|[,\- ])+?)\s+(\S.*)$", rule)
        days, hours = (_days_of(m[1]), m[2].strip()) if m else (list(range(7)), rule)
        if days is None:
            return None
        if hours in ("off", "closed"):
            continue
        for span in hours.split(","):
            t = re.fullmatch(r"(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})", span.strip())
            a, b = (int(t[1]) * 60 + int(t[2]), int(t[3]) * 60 + int(t[4])) if t else (0, 0)
            if b <= a:
                return None
            out += [(d * 1440 + a, d * 1440 + b) for d in days]
    return out


def open_state(spec: str | None, minute: int, margin: int = 60) -> bool | None:
    """True if one interval holds the whole margin around a minute of the week, False if none touches it, else None: unknown."""
    spans = parse_hours(spec)
    if spans is None:
        return None
    low, high = minute - margin, minute + margin
    spans = [(a + k, b + k) for a, b in spans for k in (-WEEK, 0, WEEK)]
    if any(a <= low and high <= b for a, b in spans):
        return True
    return None if any(low < b and high > a for a, b in spans) else False


@F.pandas_udf(T.BooleanType())
def opening_state(spec: pd.Series, minute: pd.Series) -> pd.Series:
    return pd.Series([open_state(s, int(m)) for s, m in zip(spec, minute, strict=True)], dtype="boolean")


def solar_elevation(lat: Column, lng: Column, at: Column) -> Column:
    """Degrees of the sun above the horizon, by the NOAA approximation; `at` is in UTC."""
    day = F.dayofyear(at)
    hour = F.hour(at) + F.minute(at) / 60 + F.second(at) / 3600
    g = 2 * 3.141592653589793 / 365 * (day - 1 + (hour - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((hour * 60 + eq + 4 * lng) / 4 - 180)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(angle)))


#: Elevations of sunset and of the golden hour (fixed values).
SUNSET, GOLDEN_UPPER, GOLDEN_LOWER = -0.833, 6.0, -4.0
LOOKAHEAD = 16 * 60


def _seconds(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / 1_000_000)


def _sun_of(seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine of the sun's declination, and the equation of time in minutes, at seconds since 1970 (NOAA's full series; fixed values)."""
    t = ((seconds / 86400.0 + 2440587.5) - 2451545.0) / 36525.0
    rad, sin, cos = np.radians, np.sin, np.cos
    mean, anomaly = np.fmod(280.46646 + t * (36000.76983 + t * 0.0003032), 360.0), rad(357.52911 + t * (35999.05029 - 0.0001537 * t))
    centre = sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * anomaly) * (0.019993 - 0.000101 * t) + sin(3 * anomaly) * 0.000289
    node = rad(125.04 - 1934.136 * t)
    seen = mean + centre - 0.00569 - 0.00478 * sin(node)
    tilt = 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(node)
    y, e, m = np.tan(rad(tilt / 2)) ** 2, 0.016708634 - t * (0.000042037 + 0.0000001267 * t), rad(mean)
    equation = 4 * np.degrees(y * sin(2 * m) - 2 * e * sin(anomaly) + 4 * e * y * sin(anomaly) * cos(2 * m) - 0.5 * y * y * sin(4 * m) - 1.25 * e * e * sin(2 * anomaly))
    return sin(rad(tilt)) * sin(rad(seen)), equation


def _elevation_of(lat: np.ndarray, lng: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    decl, equation = _sun_of(seconds)
    angle = np.radians((np.mod(seconds, 86400.0) / 60.0 + equation + 4 * lng) / 4 - 180)
    x = np.sin(np.radians(lat)) * decl + np.cos(np.radians(lat)) * np.sqrt(1 - decl * decl) * np.cos(angle)
    return np.degrees(np.arcsin(np.clip(x, -1.0, 1.0)))


@F.pandas_udf(T.DoubleType())
def _elevation(lat: pd.Series, lng: pd.Series, seconds: pd.Series) -> pd.Series:
    return pd.Series(_elevation_of(*(x.to_numpy(dtype="float64", na_value=np.nan) for x in (lat, lng, seconds))))


def sun_elevation(lat: Column, lng: Column, at: Column) -> Column:
    """degrees of the sun above the horizon, by the full series; `at` is in UTC."""
    return _elevation(lat.cast("double"), lng.cast("double"), _seconds(at).cast("double"))


@F.pandas_udf(T.IntegerType())
def _first_below(lat: pd.Series, lng: pd.Series, seconds: pd.Series, degrees: pd.Series, lookahead: pd.Series) -> pd.Series:
    """Bisection of a whole batch at once: as a lambda, each step would walk the whole series again for every row."""
    lat, lng, start, level, most = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (lat, lng, seconds, degrees, lookahead))
    known = ~np.isnan(lat + lng + start)
    lat, lng, start, level, most = (x[known] for x in (lat, lng, start, level, most))
    high = lambda m: _elevation_of(lat, lng, start + m * 60) > level
    solar = np.mod(np.mod(start, 86400.0) / 60.0 + _sun_of(start)[1] + 4 * lng, 1440.0)
    noon, midnight = np.floor(np.mod(720.0 - solar, 1440.0)), np.ceil(1440.0 - solar)
    a, b = np.where(noon < midnight, noon, 0.0), np.minimum(midnight, most)
    falls = (a < b) & ~high(b)
    while np.any(falls & (b - a > 1)):
        middle = np.floor((a + b) / 2)
        up, more = high(middle), b - a > 1
        a, b = np.where(more & up, middle, a), np.where(more & ~up, middle, b)
    found = np.where(high(np.ones_like(start)), np.where(falls, b, np.nan), 1.0)
    out = np.full(len(known), np.nan)
    out[known] = found
    return pd.Series(out).astype("Int32")


def minutes_until_below(lat: Column, lng: Column, at: Column, degrees: float, lookahead: int = LOOKAHEAD) -> Column:
    """the first whole minute from 1 to lookahead (a day at most) at which the sun is at some elevation or below; null without one.

    The sun falls from noon to midnight only: the crossing is sought by bisection between the next noon, or now in the
    afternoon, and the next midnight, by some fourteen evaluations instead of one a minute.
    """
    return _first_below(lat.cast("double"), lng.cast("double"), _seconds(at).cast("double"), F.lit(float(degrees)), F.lit(lookahead))


def minutes_of_light_left(lat: Column, lng: Column, at: Column, lookahead: int = LOOKAHEAD) -> Column:
    """minutes to sunset; null in the dark, and where the sun does not set within the lookahead."""
    return F.when(sun_elevation(lat, lng, at) > SUNSET, minutes_until_below(lat, lng, at, SUNSET, lookahead))


def golden_minutes_left(lat: Column, lng: Column, at: Column, lookahead: int = LOOKAHEAD) -> Column:
    """minutes of the evening's golden hour that are left; null outside it."""
    now, soon = sun_elevation(lat, lng, at), _elevation(lat.cast("double"), lng.cast("double"), (_seconds(at) + 600).cast("double"))
    return F.when(now.between(GOLDEN_LOWER, GOLDEN_UPPER) & (soon < now), minutes_until_below(lat, lng, at, GOLDEN_LOWER, lookahead))
