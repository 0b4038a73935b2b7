"""Tile coverage and candidates: disc, cone, corridor, prefilter, scouts, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import SPACING, bearing, cell_centre, cell_of, cell_steps, disc, haversine, parent_of, ring_size, turn
from ..scratch import sent

#: Degrees of the squares over which the boxes of regions are dealt.
SQUARE = 0.25
NEAR_M, INLINE_CAP, PRESCOUT_CAP = 1200.0, 180, 2000
CONE_DEGREES, BEHIND_SHARE = 60.0, 0.4
#: Scouts that read candidates from tiles (fixed values).
_READING = ("nearby", "history", "nature", "practical")
#: Scouts in order, with the domains that each looks for; none means all (fixed values).
SCOUTS = {
    "nearby": (), "history": ("historic_heritage", "religious_sacred", "museum_gallery"), "nature": ("nature_landscape",), "unusualness": (), "curated": (), "route_detour": (), "practical": ("practical",),
}


def disc_cells(origins: DataFrame, reach: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Origins with every cell within reach, one row each."""
    return ring_cells(origins.withColumn("origin_cell", cell_of(F.col(lat), F.col(lng))), reach)


def ring_cells(origins: DataFrame, reach: Column) -> DataFrame:
    """origins(origin_cell) with every cell within reach, one row each. What depends on cells only is made once a
    different origin_cell and joined to all that lie in it."""
    return origins.withColumn("cell", F.explode(disc(F.col("origin_cell"), ring_size(reach))))


def cone_cells(origins: DataFrame, reach: Column, heading: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The disc ahead: cells within CONE_DEGREES of the heading, or near enough behind; the origin's always."""
    cells = disc_cells(origins, reach, lat, lng).withColumn("_c", cell_centre(F.col("cell")))
    d = haversine(F.col(lat), F.col(lng), F.col("_c.lat"), F.col("_c.lng"))
    ahead = turn(bearing(F.col(lat), F.col(lng), F.col("_c.lat"), F.col("_c.lng")), heading) <= CONE_DEGREES
    return cells.where((F.col("cell") == F.col("origin_cell")) | (d <= BEHIND_SHARE * reach) | (ahead & (d <= reach))).drop("_c")


def corridor_cells(routes: DataFrame, width_m: float, lat: str = "lat", lng: str = "lng", to_lat: str = "to_lat", to_lng: str = "to_lng") -> DataFrame:
    """Cells whose middle lies within width_m of the straight way, with their place along it (0 to 1), in order."""
    steps = cell_steps(F.col("_a"), F.col("_b"))
    r = routes.withColumns({"_a": cell_of(F.col(lat), F.col(lng)), "_b": cell_of(F.col(to_lat), F.col(to_lng))})
    k = ring_size(width_m + SPACING)
    r = r.withColumn("_t", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    share = F.when(steps > 0, F.col("_t") / steps).otherwise(0.0)
    on = cell_of(F.col(lat) + (F.col(to_lat) - F.col(lat)) * share, F.col(lng) + (F.col(to_lng) - F.col(lng)) * share)
    r = r.withColumn("_on", on).withColumn("cell", F.explode(disc(F.col("_on"), k))).drop("_t", "_on").distinct().withColumn("_c", cell_centre(F.col("cell")))
    east = F.cos(F.radians(F.col(lat)))
    vx, vy = (F.col(to_lng) - F.col(lng)) * east, F.col(to_lat) - F.col(lat)
    px, py = (F.col("_c.lng") - F.col(lng)) * east, F.col("_c.lat") - F.col(lat)
    along = F.least(F.greatest(F.coalesce(F.try_divide(px * vx + py * vy, vx * vx + vy * vy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    r = r.withColumn("along", along)
    off = haversine(F.col("_c.lat"), F.col("_c.lng"), F.col(lat) + (F.col(to_lat) - F.col(lat)) * F.col("along"), F.col(lng) + (F.col(to_lng) - F.col(lng)) * F.col("along"))
    return r.where(off <= width_m).drop("_a", "_b", "_c")


def occupied(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Cells whose coarser parent holds a place; places(lat, lng)."""
    parents = places.select(cell_of(F.col("lat"), F.col("lng")).alias("_c")).distinct().select(parent_of(F.col("_c")).alias("_p")).distinct()
    return cells.withColumn("_p", parent_of(F.col("cell"))).join(parents, "_p", "left_semi").drop("_p")


def coverage(origins: DataFrame, reach: Column, key: str = "session_id") -> DataFrame:
    """Each session's cells as near, far (up to INLINE_CAP by distance) and pending (up to PRESCOUT_CAP)."""
    cells = disc_cells(origins, reach).withColumn("_c", cell_centre(F.col("cell")))
    cells = cells.withColumn("distance_m", haversine(F.col("lat"), F.col("lng"), F.col("_c.lat"), F.col("_c.lng")))
    ranked = cells.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("distance_m", "cell"))).where(F.col("_n") <= INLINE_CAP + PRESCOUT_CAP)
    kind = F.when(F.col("distance_m") <= NEAR_M, "near").when(F.col("_n") <= INLINE_CAP, "far").otherwise("pending")
    return ranked.select(key, "cell", F.round("distance_m").cast("long").alias("distance_m"), kind.alias("part"))


def _by_scout(places: DataFrame) -> DataFrame:
    """Places beside every scout that looks for them; practical places go to their scout only."""
    table = places.sparkSession.createDataFrame([(s, i, list(d)) for i, (s, d) in enumerate(SCOUTS.items()) if s in _READING], "scout string, ordinal int, domains array<string>")
    fits = F.when(F.col("scout") == "practical", F.col("type_domain") == "practical").otherwise(~F.col("type_domain").eqNullSafe("practical") & ((F.size("domains") == 0) | F.array_contains("domains", F.col("type_domain"))))
    return places.crossJoin(F.broadcast(table)).where(fits).drop("domains")  # one row per scout


def scouted(cells: DataFrame, places: DataFrame, key: str = "session_id") -> DataFrame:
    """Candidates of all scouts in one pass: (key, scout, ordinal, place_id, ...); practical places go to their scout only."""
    return _by_scout(cells.select(key, "cell").join(places, "cell"))


def scout_counts(cells: DataFrame, places: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, scout, n): how many candidates scouted finds. Each cell's places are counted once by scout and the counts
    added up, so candidates, of which there are sessions times the places around them, are never made."""
    domains = places.groupBy("cell", "type_domain").agg(F.count("*").alias("_n"))
    found = _by_scout(domains).groupBy("cell", "scout").agg(F.sum("_n").alias("_n"))
    return cells.select(key, "cell").join(found, "cell").groupBy(key, "scout").agg(F.sum("_n").alias("n"))


def scout_runs(cells: DataFrame, places: DataFrame, cached: DataFrame, now: Column, version: str, ttl_hours: int = 24, key: str = "session_id") -> DataFrame:
    """Per session and scout: tiles, hits, filled, candidates, hit_rate (3 digits).

    A tile is a hit if cached(scout, cell, version, filled_at) has it in this version and within ttl_hours of now; the others
    are filled. Candidates are those that the scout finds in all of its tiles.
    """
    fresh = cached.where((F.col("version") == version) & (F.col("filled_at") > now - F.make_interval(hours=F.lit(ttl_hours)))).select("scout", "cell").distinct()
    asked = cells.select(key, "cell").distinct()
    tiles = asked.groupBy(key).agg(F.count("*").alias("tiles")).withColumn("scout", F.explode(F.array(*[F.lit(s) for s in _READING])))
    hits = asked.join(fresh, "cell").groupBy(key, "scout").agg(F.count("*").alias("hits"))
    found = scout_counts(asked, places, key).withColumnRenamed("n", "candidates")
    out = tiles.join(hits, [key, "scout"], "left").join(found, [key, "scout"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(key, "scout", "tiles", "hits", (F.col("tiles") - F.col("hits")).alias("filled"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.round(F.col("hits") / F.col("tiles"), 3).alias("hit_rate"))


def rare_types(places: DataFrame, cells: DataFrame, most: int = 2) -> DataFrame:
    """(origin, type, n) for types that the neighbourhood of an origin has `most` times at most; cells(origin, cell)."""
    return cells.join(places, "cell").groupBy("origin", "type").agg(F.count("*").alias("n")).where(F.col("n") <= most)


#: Types (under 100 bytes each) whose counts may be sent to every executor.
BROADCAST_KINDS = 50_000


def local_rarity(places: DataFrame, cell: str = "cell", kind: str = "type") -> DataFrame:
    """G11 u3: how much rarer a type is in its cell than everywhere, Laplace-smoothed, 4 digits."""
    here, all_here = F.count("*").over(Window.partitionBy(cell, kind)), F.count("*").over(Window.partitionBy(cell))
    by = places.groupBy(kind).agg(F.count("*").alias("_n"))
    whole = by.agg(F.sum("_n").alias("_all"), F.count("*").alias("_kinds"))
    local = (here + 1) / (all_here + F.col("_kinds"))
    world = (F.col("_n") + 1) / (F.col("_all") + F.col("_kinds"))
    u3 = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - world / (world + local))), 4)
    return places.join(sent(by, BROADCAST_KINDS), kind).crossJoin(F.broadcast(whole)).select(*places.columns, u3.alias("u3"))


def facet_rarity(places: DataFrame, cell: str = "cell", alike: float = 0.5) -> DataFrame:
    """G11 u6/F27: 1 - (number of places of the cell whose facets are alike, itself included) / (places of the cell), by facet sets.

    Places of one facet set are counted together, so a crowded cell costs its different sets squared, not its places.
    """
    p = places.withColumn("facets", F.sort_array(F.array_distinct("facets")))
    sets = p.where(F.size("facets") > 0).groupBy(cell, "facets").agg(F.count("*").alias("_n"))
    a, b = sets.select(cell, F.col("facets").alias("_fa")), sets.select(cell, F.col("facets").alias("_fb"), "_n")
    like = F.size(F.array_intersect("_fa", "_fb")) / F.size(F.array_union("_fa", "_fb")) >= alike
    near = a.join(b, cell).where(like).groupBy(cell, "_fa").agg(F.sum("_n").alias("_near"))
    size = p.groupBy(cell).agg(F.count("*").alias("_all"))
    out = p.join(near, (p[cell] == near[cell]) & (p["facets"] == near["_fa"]), "left").drop(near[cell]).join(size, cell)
    return out.select(*places.columns, F.when(F.col("_near").isNotNull(), F.round(1 - F.col("_near") / F.col("_all"), 4)).alias("u6"))


def region_grids(regions: DataFrame, cell: float = 0.05, most: int = 24) -> DataFrame:
    """S14 of many regions(region_key, south, west, north, east): (region_key, row, col, south, west, north, east), each region's
    cell being doubled until at most `most` boxes are needed."""
    c = F.col
    count = lambda low, high, side: F.greatest(F.lit(1), F.ceil((c(high) - c(low)) / side - 1e-9))
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: cell * F.pow(F.lit(2.0), i)), lambda side: count("south", "north", side) * count("west", "east", side) <= most)
    g = regions.withColumn("_side", F.get(fits, F.lit(0)))
    g = g.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), count("south", "north", c("_side")).cast("long") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), count("west", "east", c("_side")).cast("long") - 1)))
    edge = lambda low, i, high: F.least(c(high), c(low) + i * c("_side"))
    return g.select("region_key", "row", "col", edge("south", c("row"), "north").alias("south"), edge("west", c("col"), "east").alias("west"), edge("south", c("row") + 1, "north").alias("north"), edge("west", c("col") + 1, "east").alias("east"))


def nearest_boxes(boxes: DataFrame, lat: float, lng: float) -> DataFrame:
    """Boxes by the squared planar distance of their middle, nearest first."""
    d = F.pow((F.col("south") + F.col("north")) / 2 - lat, 2) + F.pow((F.col("west") + F.col("east")) / 2 - lng, 2)
    return boxes.withColumn("distance2", d).orderBy("distance2", "row", "col")


def region_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points with region_key, that of the first region, in catalogue order, whose box holds them; null if none does.

    regions(ordinal, region_key, south, west, north, east). Boxes are dealt over squares, so points meet those of their own.
    """
    at = lambda x: F.floor(x / SQUARE)
    squares = regions.withColumn("_y", F.explode(F.sequence(at(F.col("south")), at(F.col("north"))))).withColumn("_x", F.explode(F.sequence(at(F.col("west")), at(F.col("east")))))
    own = points.select("lat", "lng").distinct().withColumns({"_y": at(F.col("lat")), "_x": at(F.col("lng"))})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))
    hit = own.join(squares, ["_y", "_x"]).where(inside).groupBy(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).agg(F.min(F.struct("ordinal", "region_key"))["region_key"].alias("region_key"))
    return points.join(hit, (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng")), "left").drop("_lat", "_lng")
