"""Distances, bearings and a hexagonal tile grid as column expressions.

The grid is axial: points are projected to metres around a standard parallel, then rounded to the nearest hexagon. It
is not H3 and its ids say so; discs, cones, corridors and coarser parents work on it alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii of the Earth in use, by purpose (fixed values): general distances, matching and home zones, travel.
RADIUS = {"mean": 6_371_008.8, "match": 6_371_000.0, "travel_km": 6_371.0}
#: Travel: metres a minute are speed_kmh * 1000 / 60, over a path longer than the straight line (fixed values).
MODES = {"walk": (4.8, 1.3), "bike": (15.0, 1.3), "drive": (30.0, 1.4)}
#: Centre spacing of cells in metres, and of a grid one step coarser.
SPACING, PARENT_SPACING = 875.0, 4 * 875.0
STANDARD_PARALLEL = 59.3
_M_PER_DEG = 111_194.93


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS["mean"]) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def travel_minutes(lat1: Column, lng1: Column, lat2: Column, lng2: Column, mode: str) -> Column:
    speed, factor = MODES[mode]
    return F.round(haversine(lat1, lng1, lat2, lng2, RADIUS["travel_km"]) * factor / speed * 60, 2)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def turn(a: Column, b: Column | float) -> Column:
    """The smaller angle between two bearings."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs((b - a + 540) % 360 - 180)


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def metres(lat1: float, lng1: float, lat2: float, lng2: float, radius: float = RADIUS["mean"]) -> float:
    """haversine of plain numbers, for folds."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * radius * math.asin(min(1.0, math.sqrt(h)))


def _axial(lat: Column, lng: Column, spacing: float) -> tuple[Column, Column]:
    x = lng * (_M_PER_DEG * math.cos(math.radians(STANDARD_PARALLEL)))
    y = lat * _M_PER_DEG
    q, r = x / spacing - y / (spacing * math.sqrt(3)), y / (spacing * math.sqrt(3) / 2)
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return (
        F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"),
        F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long"),
    )


def cell_of(lat: Column, lng: Column, spacing: float = SPACING) -> Column:
    """struct<q, r>: the hexagon that holds a point; null for an unknown point."""
    q, r = _axial(lat, lng, spacing)
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(q.alias("q"), r.alias("r")))


def cell_name(cell: Column, level: str = "t") -> Column:
    return F.concat_ws(":", F.lit(level), cell["q"], cell["r"])


def cell_centre(cell: Column, spacing: float = SPACING) -> Column:
    """struct<lat, lng> of the middle of a cell."""
    y = cell["r"] * (spacing * math.sqrt(3) / 2)
    x = (cell["q"] + cell["r"] / 2) * spacing
    return F.struct((y / _M_PER_DEG).alias("lat"), (x / (_M_PER_DEG * math.cos(math.radians(STANDARD_PARALLEL)))).alias("lng"))


def cell_steps(a: Column, b: Column) -> Column:
    """Steps from cell to cell."""
    dq, dr = a["q"] - b["q"], a["r"] - b["r"]
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def ring_size(reach_m: Column | float, spacing: float = SPACING, most: int = 48) -> Column:
    reach = reach_m if isinstance(reach_m, Column) else F.lit(float(reach_m))
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(reach / spacing))).cast("int")


def disc(cell: Column, k: Column) -> Column:
    """array<struct<q, r>> of the cells within k steps, nearest rows first by q, then r."""
    return F.flatten(
        F.transform(
            F.sequence(-k, k),
            lambda dq: F.transform(F.sequence(F.greatest(-k, -dq - k), F.least(k, -dq + k)), lambda dr: F.struct((cell["q"] + dq).alias("q"), (cell["r"] + dr).alias("r"))),
        )
    )


def parent_of(cell: Column) -> Column:
    """The coarser cell that holds a cell's middle."""
    c = cell_centre(cell)
    return cell_of(c["lat"], c["lng"], PARENT_SPACING)


def _double(hex16: Column) -> Column:
    """The IEEE double of 16 hex digits, the most significant first; infinities and NaN give null."""
    lead = F.conv(F.substring(hex16, 1, 3), 16, 10).cast("long")
    exponent, mantissa = lead.bitwiseAND(F.lit(2047)), F.conv(F.substring(hex16, 4, 13), 16, 10).cast("long") / float(1 << 52)
    size = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(-1022.0))).when(exponent < 2047, (1.0 + mantissa) * F.pow(F.lit(2.0), exponent - 1023.0))
    return F.when(lead >= 2048, -size).otherwise(size)


def point_of_ewkb(x: Column) -> Column:
    """struct<lat, lng> of a point in hexadecimal EWKB of either byte order, with or without its reference system.

    Null for anything that is too short, of odd length, not hexadecimal or out of range.
    """
    swap = lambda h, n: F.concat(*[F.substr(h, F.lit(2 * k + 1), F.lit(2)) for k in range(n - 1, -1, -1)])
    little = F.substring(x, 1, 2) == "01"
    kind = F.conv(F.when(little, swap(F.substring(x, 3, 8), 4)).otherwise(F.substring(x, 3, 8)), 16, 10).cast("long")
    at = F.when(kind.bitwiseAND(F.lit(0x20000000)) != 0, 19).otherwise(11)
    part = lambda k: F.substr(x, at + 16 * k, F.lit(16))
    number = lambda k: _double(F.when(little, swap(part(k), 8)).otherwise(part(k)))
    good = x.rlike("^(?:[0-9A-Fa-f]{2}){21,}$") & (F.length(x) >= at - 1 + 32)
    p = F.struct(number(1).alias("lat"), number(0).alias("lng"))
    return F.when(good & p["lat"].between(-90, 90) & p["lng"].between(-180, 180), p)


def wkt(lat: Column, lng: Column) -> Column:
    """POINT(longitude latitude), 8 digits each."""
    return F.format_string("POINT(%.8f %.8f)", lng.cast("double"), lat.cast("double"))
