"""Queries of folds with a state: serves, breakers, latches, quotas, incremental refolding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guards, serves
from ..scratch import new_path
from ..streaming import refold
from .base import fixes, table


def serve_acts(s, d):
    """Acts of sessions, a session being a fortieth of the users for a week: each event is a fix and then, a minute later, an act."""
    e = fixes(s, d).withColumns({"sec": F.unix_timestamp(F.col("ts").cast("timestamp")), "k": F.col("event_id")})
    week = F.floor(F.col("sec") / 604_800)
    e = e.withColumn("session_id", F.col("user_id") % 40 + week * 100)
    ranked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (F.col("session_id") * 31 + F.floor(F.col("sec") / 14_400) * 7 + i * i) % 400))
    e = e.withColumn("ranked", F.when(F.col("k") % 23 == 0, F.slice(ranked, 1, 3)).otherwise(ranked))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("k")) == 1
    kind = F.element_at(F.array(*[F.lit(a) for a in ("pull", "pull", "dismiss", "pull", "more", "dismiss", "pull", "refresh", "browse", "pull")]), (F.col("k") % 10 + 1).cast("int"))
    place = F.when(kind == "dismiss", F.try_element_at("ranked", (F.col("k") % 12 + 1).cast("int"))).when(kind == "browse", F.try_element_at("ranked", F.lit(25)))
    none = lambda t: F.lit(None).cast(t)
    act = lambda at, seq, what, lat, lng, p: F.struct(at.cast("double").alias("at"), seq.alias("seq"), what.alias("act"), lat.alias("lat"), lng.alias("lng"), F.when(F.col("k") % 7 == 0, 900.0).alias("accuracy"), p.alias("place_id"))
    sec, k = F.col("sec"), F.col("k")
    fix = act(sec, k * 3 + 1, F.lit("fix"), F.col("lat"), F.col("lng"), none("long"))
    start = act(sec, k * 3, F.lit("start"), F.col("lat"), F.col("lng"), none("long"))
    does = act(sec + 60, k * 3 + 2, kind, none("double"), none("double"), place)
    rows = e.withColumn("_first", first).select("session_id", "ranked", F.explode(F.when(F.col("_first"), F.array(start, fix, does)).otherwise(F.array(fix, does))).alias("x"))
    return rows.select("session_id", "x.*", "ranked")


def r16(s, d):
    return serves.replayed(serve_acts(s, d))


def _calls(s, d):
    """Calls of a hundred sources; one in a hundred seconds of an event's time, so that runs of failures occur."""
    e = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    source = F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 600).cast("double")
    return e.select(source.alias("source"), F.col("event_id").alias("seq"), at.alias("at"), (F.coalesce("value", F.lit(0.0)) % 10 < 3).alias("ok"))


_CALLS = "calls AS (SELECT event_type || '-' || user_id % 20 AS source, event_id AS seq, CAST(floor(epoch_us(ts) / 1000000 / 600) AS DOUBLE) AS sec, coalesce(value, 0) % 10 < 3 AS ok FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_STEPS = "n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM calls)"


def x09_breaker(s, d):
    return guards.decided(_calls(s, d), ["source"], ("seq",), ("at", "ok"), guards.breaker, "string").select("seq", "decision")


_BREAKER = f"""WITH RECURSIVE {_CALLS}, {_STEPS}, f AS (
  SELECT source, 0::BIGINT AS i, -1::BIGINT AS seq, 0 AS failures, 0.0::DOUBLE AS forget, 0.0::DOUBLE AS until, '' AS decision FROM (SELECT DISTINCT source FROM n)
  UNION ALL
  SELECT source, i, seq, CASE decision WHEN 'skipped' THEN failures WHEN 'failed' THEN failed ELSE 0 END, CASE decision WHEN 'skipped' THEN forget WHEN 'failed' THEN sec + 120 ELSE 0 END, CASE decision WHEN 'opened' THEN sec + 120 ELSE until END, decision
  FROM (SELECT *, CASE WHEN sec < until THEN 'skipped' WHEN ok THEN 'called' WHEN failed >= 5 THEN 'opened' ELSE 'failed' END AS decision
    FROM (SELECT n.source, n.i, n.seq, n.sec, n.ok, f.failures, f.forget, f.until, CASE WHEN n.sec < f.forget THEN f.failures ELSE 0 END + 1 AS failed FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1))
) SELECT seq, decision FROM f WHERE i > 0"""


def x09_failures(s, d):
    return guards.failures_within(_calls(s, d), "source", "at", ~F.col("ok")).select("seq", "recent_failures")


def x09_latch(s, d):
    fired = guards.decided(_calls(s, d), ["source"], ("seq",), ("at",), lambda state, at: guards.latch(state, at, 30.0), "boolean", "fires")
    return fired.select("seq", "fires")


_LATCH = f"""WITH RECURSIVE {_CALLS}, {_STEPS}, f AS (
  SELECT source, 0::BIGINT AS i, -1::BIGINT AS seq, -1e18::DOUBLE AS last, false AS fires FROM (SELECT DISTINCT source FROM n)
  UNION ALL SELECT n.source, n.i, n.seq, CASE WHEN n.sec >= f.last + 30 THEN n.sec ELSE f.last END, n.sec >= f.last + 30 FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1
) SELECT seq, fires FROM f WHERE i > 0"""


def x09_quota(s, d):
    granted = guards.decided(_calls(s, d), ["source"], ("seq",), ("at",), lambda state, at: guards.quota(state, at, 3, 200.0), "boolean", "granted")
    return granted.select("seq", "granted")


_QUOTA = f"""WITH RECURSIVE {_CALLS}, {_STEPS}, f AS (
  SELECT source, 0::BIGINT AS i, -1::BIGINT AS seq, []::DOUBLE[] AS times, false AS granted FROM (SELECT DISTINCT source FROM n)
  UNION ALL SELECT source, i, seq, CASE WHEN len(recent) < 3 THEN list_append(recent, sec) ELSE recent END, len(recent) < 3
  FROM (SELECT n.source, n.i, n.seq, n.sec, list_filter(f.times, lambda t: t >= n.sec - 200) AS recent FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1)
) SELECT seq, granted FROM f WHERE i > 0"""


def daily(rows):
    """Per user and day: events, the last one's type, and the sum of values."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), last.alias("last_type"), F.round(F.sum("value"), 2).alias("value"))


def x10(s, d):
    """Events in three batches, of which two are late: a third of the days' rows, the rest, and the first again."""
    e = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", "ts", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    raw, result = new_path(s, "raw"), new_path(s, "daily")
    merge = refold.refolded(raw, result, ["event_id"], "ts", "day", daily)
    for k, part in enumerate(("event_id % 3 = 1", "event_id % 3 <> 1", "event_id % 3 = 1")):
        merge(e.where(part), k)
    return s.read.schema("user_id long, n long, last_type string, value double, day string").parquet(result)


ENTRIES = [
    ("r16_serves", r16, None),
    ("x09_breaker", x09_breaker, _BREAKER),
    ("x09_failures", x09_failures, f"WITH {_CALLS} SELECT seq, count(*) FILTER (NOT ok) OVER (PARTITION BY source ORDER BY sec RANGE BETWEEN 120 PRECEDING AND CURRENT ROW) AS recent_failures FROM calls"),
    ("x09_latch", x09_latch, _LATCH),
    ("x09_quota", x09_quota, _QUOTA),
    ("x10_refold", x10, "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max_by(event_type, struct_pack(t := ts, i := event_id)) AS last_type, round(sum(value), 2) AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL"),
]
