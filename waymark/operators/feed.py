"""The feed of many sessions at once: gates, scores, selection, verification, trace, and slices of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import rank
from .trajectory import suppress_home

FEED_SIZE, ROUNDS = 10, 2


def without(candidates: DataFrame, excluded: DataFrame, on: tuple[str, ...] = ("session_id", "place_id")) -> DataFrame:
    """Candidates that are not on the exclusion list (dismissed, or in the batch already)."""
    return candidates.join(excluded.select(*on).distinct(), list(on), "left_anti")


def gated(candidates: DataFrame, mode: str = "walk", context: str = "radius", excluded: DataFrame | None = None, homes: DataFrame | None = None) -> DataFrame:
    """The candidates of plan() before selection, one row a place: with status unreachable, held (and its reason) or null for
    what may be served, and composite, which is null where unreachable. Excluded ones and those at home are gone."""
    first = Window.partitionBy("session_id", "place_id").orderBy("ordinal")
    c = candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    c = c if excluded is None else without(c, excluded)
    near = F.coalesce(rank.reachable(F.col("lat"), F.col("lng"), F.col("from_lat"), F.col("from_lng"), F.col("visit_minutes"), F.col("remaining"), mode), F.lit(False))
    c = c.withColumns({"total_minutes": F.col("visit_minutes").cast("double"), "_near": near})
    if homes is not None:  # what is out of reach stays in the trace wherever it is
        c = suppress_home(c.where("_near"), homes).unionByName(c.where("NOT _near"))
    reason = F.when(F.col("_near"), rank.hold_reason(F.col("tiers"), F.col("confidence")))
    whole = rank.composite({t: F.col(t) for t in rank.WEIGHTS["warm"][context]}, context, F.col("alpha"), F.col("friction_raw"), F.lit(0.0))
    return c.withColumns({"reason": reason, "composite": F.when(F.col("_near"), whole), "status": F.when(~F.col("_near"), "unreachable").when(reason.isNotNull(), "held")}).drop("_near")


def plan(candidates: DataFrame, now, mode: str = "walk", context: str = "radius", k: int = FEED_SIZE, excluded: DataFrame | None = None, homes: DataFrame | None = None, horizon_minutes: int = 120) -> DataFrame:
    """What becomes of every candidate of every session: (session_id, place_id, status, reason, position, ranking, composite).

    candidates(session_id, user_id, place_id, ordinal, lat, lng, from_lat, from_lng, remaining, visit_minutes, type_domain,
    facets, tiers, closes_at, is_open, alpha, friction_raw and a column per sub-score). In order: one row per place (the
    smallest ordinal), exclusions, reachability, the user's home zone (dropped without trace), the evidence gate, the
    selection verified in ROUNDS rounds, the urgent slot. status is served, near_miss, closed, held or unreachable; ranking
    is the place among all that may be served, by composite without diversity. Candidates are gated once, and written.
    """
    keys = ["session_id", "place_id"]
    every = written(gated(candidates, mode, context, excluded, homes), "gated")
    pool = every.where("status IS NULL")
    picks = written(rank.select_verified(pool, k, context, rounds=ROUNDS), "picks")
    closed = picks.where("shut").select(*keys)
    slots = picks.where("NOT shut").join(pool.select(*keys, "closes_at"), keys)
    slots = rank.urgent_first(slots, now, horizon_minutes).select(*keys, F.col("composite").alias("_picked"), F.col("position").cast("long").alias("position"))
    ranked = rank.rank_all(without(pool, closed)).select(*keys, F.col("position").cast("long").alias("ranking"))
    out = pool.select(*keys, "composite").join(slots, keys, "left").join(ranked, keys, "left")
    out = out.select(*keys, F.when(F.col("position").isNotNull(), "served").when(F.col("ranking").isNull(), "closed").otherwise("near_miss").alias("status"), F.lit(None).cast("string").alias("reason"), "position", "ranking", F.coalesce("_picked", "composite").alias("composite"))
    none = F.lit(None).cast("long")
    return out.unionByName(every.where("status IS NOT NULL").select(*keys, "status", "reason", none.alias("position"), none.alias("ranking"), "composite"))


def slice_of(ranked: DataFrame, limit: int, offset: int = 0, key: str = "session_id", position: str = "ranking") -> DataFrame:
    """A page of each key's ranked rows, with their total."""
    total = F.count(position).over(Window.partitionBy(key))
    return ranked.withColumn("total", total).where((F.col(position) > offset) & (F.col(position) <= offset + limit))


def appended(batch: DataFrame, more: DataFrame, key: str = "session_id") -> DataFrame:
    """More rows, placed after those of the batch: position is the batch's size plus their own."""
    size = batch.groupBy(key).agg(F.count("*").alias("_size"))
    return more.join(size, key, "left").withColumn("position", F.coalesce("_size", F.lit(0)) + F.col("position")).drop("_size")
