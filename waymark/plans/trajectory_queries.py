"""Queries over position fixes and feedback events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import in_quiet_hours, part_of_day
from ..operators import feedback, trajectory
from .base import FIXES, fixes, hav, table

_GAP = hav("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")
_DWELLS = f"""g AS (SELECT *, CASE WHEN coalesce({_GAP} <= 120.0, false) THEN 0 ELSE 1 END AS is_new FROM fixes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dwell FROM g),
dwells AS (SELECT user_id, CAST(dwell AS BIGINT) AS dwell, min(ts) AS started, max(ts) AS ended, count(*) AS fixes, avg(lat) AS lat, avg(lng) AS lng FROM s GROUP BY user_id, dwell HAVING epoch(max(ts)) - epoch(min(ts)) >= 600)"""
_CELL = "concat(floor(lat * 100)::BIGINT, ':', floor(lng * 100)::BIGINT)"


def _cell():
    return F.concat(F.floor(F.col("lat") * 100), F.lit(":"), F.floor(F.col("lng") * 100))


def x03_sessions(spark, d):
    x = trajectory.dwells(fixes(spark, d))
    return x.select("user_id", "dwell", "started", "ended", "fixes", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _served(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL")
    k = F.col("user_id")
    return e.select(F.col("event_id").alias("rec_id"), "user_id", F.col("ts").alias("served_at"), (59.22 + k * 7919 % 2100 / 10000.0).alias("lat"), (17.76 + k * 104729 % 4400 / 10000.0).alias("lng"))


def x04_visits(spark, d):
    settled = table(spark, d, "events").where("event_type = 'signup' AND event_id % 3 = 0").select(F.col("event_id").alias("rec_id"))
    return trajectory.visits(trajectory.dwells(fixes(spark, d)), _served(spark, d), settled).select("rec_id", "user_id", "dwell", "started", "ended")


def x05_segments(spark, d):
    return trajectory.day_segments(fixes(spark, d), _cell(), travel_m=10_000).withColumn("day", F.col("day").cast("string"))


def x06_home(spark, d):
    return trajectory.home_cells(fixes(spark, d), _cell())


def x02_throttle(spark, d):
    return trajectory.throttled(fixes(spark, d).withColumn("day", F.to_date("ts")), ["user_id", "day"]).select("user_id", "day", "ts", "event_id")


def g14_trips(spark, d):
    s = fixes(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("started_at"), "lat", "lng")
    return trajectory.trips(s)


_PAIRS = {"kept": ("click", "view"), "hidden": ("purchase", "error")}


def a23_toggle_fold(spark, d):
    return feedback.toggle_states(table(spark, d, "events"), ["user_id"], _PAIRS)


def a24_contradictions(spark, d):
    return feedback.contradictions(table(spark, d, "events"), ["user_id"], *_PAIRS.values())


_FOLD = "arg_max(event_type, {{'t': ts, 'i': event_id}}) FILTER (event_type IN ('{}', '{}'))"


def r15_learning(spark, d):
    name = F.create_map(*[F.lit(x) for x in ("view", "ignored", "click", "accepted", "signup", "saved", "purchase", "visited", "error", "dismissed")])
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("event_id", "ts", "user_id", F.concat(F.lit("f"), F.col("event_id") % 5).alias("facet"), F.try_element_at(name, F.col("event_type")).alias("event"))
    return feedback.taste_profiles(e, event="event")


_R15 = """WITH e AS (SELECT user_id, 'f' || event_id % 5 AS facet, list(CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1008 WHEN 'signup' THEN 1015 WHEN 'purchase' THEN 1030 ELSE 25 END AS DOUBLE) ORDER BY ts, event_id) AS l
  FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click', 'signup', 'purchase', 'error') GROUP BY 1, 2)
SELECT user_id, facet, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), l), lambda a, x: CAST(round(CAST(CAST(a + (x % 1000) / 100 * (floor(x / 1000) - a) AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)) AS weight FROM e"""


def x07_idle_sessions(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ended_at"))
    serves = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("served_at"))
    return trajectory.idle_sessions(s, serves, F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")).select("session_id")


def x08_ignored(spark, d):
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    served = e.where("event_type = 'view'").select(F.col("event_id").alias("rec_id"), F.col("user_id").alias("session_id"))
    given = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("rec_id"))
    ends = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("ended_at"))
    return feedback.ignored_at_close(served, given, ends)


def f21_quiet_hours(spark, d):
    h = F.hour("ts")
    return table(spark, d, "events").groupBy(in_quiet_hours(h, 22, 8).alias("quiet"), part_of_day(h).alias("part")).agg(F.count("*").alias("n"))


def p14_home_suppression(spark, d):
    f = fixes(spark, d)
    k = F.col("user_id")
    homes = f.where(k % 2 == 0).select("user_id").distinct().select("user_id", (59.22 + k * 7919 % 2100 / 10000.0).alias("lat"), (17.76 + k * 104729 % 4400 / 10000.0).alias("lng"))
    return trajectory.suppress_home(f, homes).groupBy("user_id").agg(F.count("*").alias("n"))


ENTRIES = [
    ("w01_dwell_gaps", lambda s, d: trajectory.dwells(fixes(s, d), least_s=0).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("fixes").alias("longest")), f"WITH {FIXES}, {_DWELLS.replace('>= 600', '>= 0')} SELECT user_id, count(*) AS runs, max(fixes) AS longest FROM dwells GROUP BY 1"),
    ("x03_sessions", x03_sessions, f"WITH {FIXES}, {_DWELLS} SELECT user_id, dwell, started, ended, fixes, round(lat, 6) AS lat, round(lng, 6) AS lng FROM dwells"),
    ("x04_visits", x04_visits, f"""WITH {FIXES}, {_DWELLS}, r AS (SELECT event_id AS rec_id, user_id, ts AS served_at, 59.22 + user_id * 7919 % 2100 / 10000.0 AS rlat, 17.76 + user_id * 104729 % 4400 / 10000.0 AS rlng FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL AND event_id % 3 <> 0),
n AS (SELECT rec_id, user_id, dwell, started, ended, row_number() OVER (PARTITION BY rec_id ORDER BY started, dwell) AS k FROM dwells JOIN r USING (user_id) WHERE served_at < ended AND {hav('lat', 'lng', 'rlat', 'rlng')} <= 100.0) SELECT rec_id, user_id, dwell, started, ended FROM n WHERE k = 1"""),
    ("x05_segments", x05_segments, f"""WITH {FIXES}, a AS (SELECT user_id, CAST(ts AS DATE) AS day, first(lat ORDER BY ts, event_id) AS a1, first(lng ORDER BY ts, event_id) AS a2, last(lat ORDER BY ts, event_id) AS z1, last(lng ORDER BY ts, event_id) AS z2,
  min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e, count(DISTINCT {_CELL}) AS cells, count(*) AS events FROM fixes GROUP BY ALL),
b AS (SELECT *, CAST(round({hav('a1', 'a2', 'z1', 'z2')}) AS BIGINT) AS net_m, CAST(round({hav('s', 'w', 'n', 'e')}) AS BIGINT) AS span_m FROM a)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN net_m >= 10000 THEN 'travel' WHEN span_m >= 2500 OR cells >= 6 THEN 'sightseeing' ELSE 'relaxation' END AS kind, net_m, span_m, cells, events, round(least(1.0, events / 12), 3) AS confidence FROM b"""),
    ("x06_home", x06_home, f"""WITH {FIXES}, e AS (SELECT user_id, CAST(ts AS DATE) AS day, first({_CELL} ORDER BY ts, event_id) AS f, last({_CELL} ORDER BY ts, event_id) AS l FROM fixes GROUP BY ALL),
u AS (SELECT user_id, day, f AS cell FROM e UNION SELECT user_id, day, l FROM e), c AS (SELECT user_id, cell, count(*) AS nights FROM u GROUP BY ALL),
r AS (SELECT *, coalesce(lead(nights) OVER w, 0) AS next, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY nights DESC, cell))
SELECT user_id, cell, nights, round(nights / (nights + next), 3) AS confidence FROM r WHERE n = 1 AND nights >= 5 AND (next = 0 OR nights >= 1.8 * next)"""),
    ("x02_throttle", x02_throttle, f"""WITH RECURSIVE {FIXES}, o AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM fixes),
w AS (SELECT user_id, day, n, ts, event_id, lat AS slat, lng AS slng, ts AS sts, true AS go FROM o WHERE n = 1
UNION ALL SELECT user_id, day, n, ts, event_id, CASE WHEN go THEN lat ELSE slat END, CASE WHEN go THEN lng ELSE slng END, CASE WHEN go THEN ts ELSE sts END, go
  FROM (SELECT o.*, w.slat, w.slng, w.sts, {hav('w.slat', 'w.slng', 'o.lat', 'o.lng')} >= 250 OR epoch_us(o.ts) - epoch_us(w.sts) >= 600000000 AS go FROM w JOIN o ON o.user_id = w.user_id AND o.day = w.day AND o.n = w.n + 1))
SELECT user_id, day, ts, event_id FROM w WHERE go"""),
    ("g14_trips", g14_trips, f"""WITH RECURSIVE {FIXES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM fixes WHERE event_type = 'click'),
w AS (SELECT user_id, n, event_id, lat AS alat, lng AS alng, ts, CAST(1 AS BIGINT) AS trip FROM o WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN joins THEN alat ELSE lat END, CASE WHEN joins THEN alng ELSE lng END, ts, trip + CASE WHEN joins THEN 0 ELSE 1 END
  FROM (SELECT o.*, w.alat, w.alng, w.trip, epoch_us(o.ts) - epoch_us(w.ts) < 4 * 86400000000 AND {hav('w.alat', 'w.alng', 'o.lat', 'o.lng')} <= 150000 AS joins FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))
SELECT event_id AS session_id, user_id, trip FROM w"""),
    ("a23_toggle_fold", a23_toggle_fold, f"SELECT user_id, coalesce({_FOLD.format('click', 'view')} = 'click', false) AS kept, coalesce({_FOLD.format('purchase', 'error')} = 'purchase', false) AS hidden FROM events GROUP BY 1"),
    ("a24_contradictions", a24_contradictions, f"""WITH s AS (SELECT user_id, {_FOLD.format('click', 'view')} AS a, {_FOLD.format('purchase', 'error')} AS b, max({{'t': ts, 'i': event_id}}) FILTER (event_type = 'click') AS ta, max({{'t': ts, 'i': event_id}}) FILTER (event_type = 'purchase') AS tb FROM events GROUP BY 1)
SELECT user_id, CASE WHEN ta > tb THEN 'error' ELSE 'view' END AS undo FROM s WHERE a = 'click' AND b = 'purchase'"""),
    ("r15_learning", r15_learning, _R15),
    ("x07_idle_sessions", x07_idle_sessions, "SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '2001-08-01 12:00:00' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > TIMESTAMP '2001-08-01 12:00:00')"),
    ("x08_ignored", x08_ignored, "SELECT v.event_id AS rec_id, 'ignored' AS event, m.t AS occurred_at FROM events v JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) m USING (user_id) WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id IS NOT NULL AND c.event_id - 1 = v.event_id)"),
    ("f21_quiet_hours", f21_quiet_hours, "SELECT hour(ts) >= 22 OR hour(ts) < 8 AS quiet, CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n FROM events GROUP BY ALL"),
    ("p14_home_suppression", p14_home_suppression, f"WITH {FIXES} SELECT user_id, count(*) AS n FROM fixes WHERE user_id % 2 <> 0 OR {hav('lat', 'lng', '(59.22 + user_id * 7919 % 2100 / 10000.0)', '(17.76 + user_id * 104729 % 4400 / 10000.0)', 6371000.0)} > 300 GROUP BY 1"),
]
