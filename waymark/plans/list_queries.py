"""Queries of smaller reads, dates, weather, identifiers and predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, time
from ..operators import curation, lists, tables
from ..sources import taxonomy
from .base import FIXES, PLACES, fixes, hav, places, table


def _e(s, d):
    return table(s, d, "events")


def j02(s, d):
    o = table(s, d, "orders").where("o_orderstatus IN ('O', 'P')").select(F.col("o_orderkey").alias("opp"), (F.col("o_custkey") % 2000).alias("place_id"))
    return o.join(places(s, d), "place_id").where(geo.haversine(F.col("lat"), F.col("lng"), F.lit(59.33), F.lit(18.06)) <= 3000).select("opp", "place_id")


def j05(s, d):
    l = table(s, d, "lineitem")
    a = l.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    return l.where("l_returnflag = 'R'").join(a, ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


def j17(s, d):
    c = table(s, d, "customer")
    first = table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first"))
    return c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("first", F.lit("-")).alias("first"))


def j19(s, d):
    x = F.transform("facets", lambda f, i: F.when(f == "f1", F.concat(f, F.lit("!"))).otherwise(f))
    return places(s, d).select("place_id", F.array_join(x, ",").alias("facets"))


def a16(s, d):
    f = fixes(s, d).groupBy("user_id").agg(
        F.count_distinct(F.to_date("ts")).alias("days"), F.round(F.avg("lat"), 3).alias("lat"), F.round(F.avg("lng"), 3).alias("lng"),
        F.round(geo.haversine(F.min("lat"), F.min("lng"), F.max("lat"), F.max("lng"))).cast("long").alias("span_m"), F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9, 3).alias("hours"),
    )
    return f.where("hours >= 24")


def f02(s, d):
    v = (F.col("p_partkey") - 1000) / 8
    return table(s, d, "part").select("p_partkey", F.round(v, 0).alias("r0"), F.round(v, 2).alias("r2"))


def j03(s, d):
    """Per user the pairs of a click and a later purchase, counted as they pass: never made."""
    earlier = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    clicks = F.count_if(F.col("event_type") == "click").over(earlier)
    e = _e(s, d).where("event_type IN ('click', 'purchase') AND user_id IS NOT NULL AND ts IS NOT NULL").withColumn("n", clicks)
    return e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum("n").alias("n")).where("n > 0")


def f08(s, d):
    return fixes(s, d).select("event_id", (F.round(time.solar_elevation(F.col("lat"), F.col("lng"), F.col("ts")), 2) + 0.0).alias("elevation"))


_G = "(2 * 3.141592653589793 / 365 * (dayofyear(ts) - 1 + (hour(ts) + minute(ts) / 60 + second(ts) / 3600 - 12) / 24))"
_F08 = f"""WITH {FIXES}, a AS (SELECT event_id, lat, lng, {_G} AS g, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h FROM fixes),
b AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
  0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dc FROM a)
SELECT event_id, round(degrees(asin(sin(radians(lat)) * sin(dc) + cos(radians(lat)) * cos(dc) * cos(radians((h * 60 + eq + 4 * lng) / 4 - 180)))), 2) + 0.0 AS elevation FROM b"""


def f08_light(s, d):
    """Fixes moved over all latitudes, so that polar days and nights occur."""
    lat = F.col("event_id") % 17 * 10 - 80.0
    at = (lat + F.col("lat") - 59.0, F.col("lng"), F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 365).cast("int")))
    left = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return fixes(s, d).select("event_id", F.round(time.sun_elevation(*at), 3).alias("elevation"), left(time.minutes_of_light_left(*at)).alias("light"), left(time.golden_minutes_left(*at)).alias("golden"))


_SUN = """t0 AS (SELECT *, ((sec / 86400.0 + 2440587.5) - 2451545.0) / 36525.0 AS t FROM x),
t1 AS (SELECT *, (280.46646 + t * (36000.76983 + t * 0.0003032)) % 360.0 AS ml, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS an, radians(125.04 - 1934.136 * t) AS nd FROM t0),
t2 AS (SELECT *, radians(ml + sin(an) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * an) * (0.019993 - 0.000101 * t) + sin(3 * an) * 0.000289 - 0.00569 - 0.00478 * sin(nd)) AS al,
  radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(nd)) AS ob, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ec, radians(ml) AS m FROM t1),
t3 AS (SELECT *, asin(sin(ob) * sin(al)) AS dc, pow(tan(ob / 2), 2) AS y FROM t2),
t4 AS (SELECT *, 4 * degrees(y * sin(2 * m) - 2 * ec * sin(an) + 4 * ec * y * sin(an) * cos(2 * m) - 0.5 * y * y * sin(4 * m) - 1.25 * ec * ec * sin(2 * an)) AS eq FROM t3),
el AS (SELECT event_id, k, 90 - degrees(acos(greatest(-1.0, least(1.0, sin(radians(la)) * sin(dc) + cos(radians(la)) * cos(dc) * cos(radians(((sec % 86400) / 60.0 + eq + 4 * ln) / 4 - 180)))))) AS e FROM t4)"""
_F08_LIGHT = f"""WITH {FIXES}, x AS (SELECT event_id, event_id % 17 * 10 - 80.0 + lat - 59.0 AS la, lng AS ln, k, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 365 * 86400 + k * 60 AS sec FROM fixes, range(0, 961) r(k)), {_SUN},
g AS (SELECT event_id, max(e) FILTER (k = 0) AS now, max(e) FILTER (k = 10) AS soon, min(k) FILTER (k > 0 AND e <= -0.833) AS sunset, min(k) FILTER (k > 0 AND e <= -4.0) AS dusk FROM el GROUP BY 1)
SELECT event_id, round(now, 3) AS elevation, CASE WHEN now > -0.833 THEN coalesce(sunset, -1) ELSE -1 END AS light, CASE WHEN now BETWEEN -4.0 AND 6.0 AND soon < now THEN coalesce(dusk, -1) ELSE -1 END AS golden FROM g"""


#: Names in special letters, one composed of marks, and what they fold to.
_SPECIAL = {"Straße": "strasse", "Ødegård": "odegard", "Łódź": "lodz", "Þingvellir": "thingvellir", "Œuvre": "oeuvre", "ÆRØ": "aero", "đak": "dak", "Ísafjörður": "isafjordur", "Diyarbakır": "diyarbakir", "ﬁn": "fin", "Cafe\u0301": "cafe", "Ŋaŋ": "nan"}


def f11(s, d):
    name = F.element_at(F.array(*[F.lit(n) for n in _SPECIAL]), (F.col("doc_id") % len(_SPECIAL) + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", text.fold(F.concat_ws(" ", "text", name)).alias("folded"))


def f16(s, d):
    n = table(s, d, "part").select("p_partkey", "p_name")
    url = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.regexp_replace("p_name", " ", "_"), F.lit("?x=1"))
    return n.select("p_partkey", text.sitelink(url).alias("a"), text.sitelink(F.concat(F.lit("sv:"), "p_name")).alias("b"), text.settlement(F.concat(F.lit("City of "), "p_name", F.lit(" Kommun"))).alias("c"))


def f19(s, d):
    t = F.col("ts")
    return _e(s, d).select("event_id", F.date_trunc("day", t).cast("string").substr(1, 10).alias("day"), F.date_format(F.date_sub(F.to_date(t), 7), "yyyy-MM-dd").alias("week_ago"), F.round(time.seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), t) / 60, 3).alias("minutes"))


def f20(s, d):
    spec = F.element_at(F.array(*[F.lit(x) for x in ("24/7", "Mo-Fr 09:00-17:00", "Sa,Su 10:00-14:00", "sunrise-sunset", "Mo-Su 22:00-02:00", "PH off")]), (F.col("event_id") % 6 + 1).cast("int"))
    minute = F.weekday("ts") * 1440 + F.hour("ts") * 60 + F.minute("ts")
    return _e(s, d).select(spec.alias("spec"), time.opening_state(spec, minute).alias("open")).groupBy("spec", "open").agg(F.count("*").alias("n"))


def f22(s, d):
    t = F.col("o_orderdate")
    h = lambda n: t + F.make_dt_interval(hours=n)
    k = F.col("o_orderkey")
    x = time.last_feasible_start(h(F.lit(20)), F.when(k % 2 == 0, h((k % 24).cast("int"))), F.when(k % 3 == 0, h((k % 11).cast("int"))))
    return table(s, d, "orders").select("o_orderkey", F.round(time.seconds_between(t, x) / 3600, 2).alias("hours"))


def f24(s, d):
    p = F.col("p_partkey")
    times, rain = F.sequence(F.lit(0), F.lit(11)), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((p * 7 + i * 13) % 29) / 100)
    return table(s, d, "part").select("p_partkey", F.coalesce(time.first_wet_hour(times, rain, F.col("p_size") % 8), F.lit(-1)).alias("at"))


_TABLES = {"tag": {f"{k}={v}": t for k, m in taxonomy.TAGS.items() for v, t in m.items()}, "category": taxonomy.CATEGORIES, "class": taxonomy.CLASSES, "denomination": taxonomy.DENOMINATIONS, "ontology": taxonomy.ONTOLOGY}


def f32(s, d):
    """Every entry of every map, dealt over the parts, and what is in none."""
    entries = [(n, k) for n, m in _TABLES.items() for k in m] + [("category", "other")]
    at = (F.col("p_partkey") % len(entries) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in entries]), at)
    p = table(s, d, "part").select(pick(0).alias("map"), pick(1).alias("value"))
    pair = F.split("value", "=")
    kind = (
        F.when(F.col("map") == "tag", taxonomy.type_of_tags(F.create_map(pair[0], pair[1]))).when(F.col("map") == "category", taxonomy.mapped(F.col("value"), taxonomy.CATEGORIES)).when(F.col("map") == "class", taxonomy.mapped(F.col("value"), taxonomy.CLASSES))
        .when(F.col("map") == "denomination", taxonomy.type_of_denomination(F.col("value"))).otherwise(taxonomy.type_of_classes(F.array(F.lit("Thing"), F.col("value"))))
    )
    return p.groupBy("map", F.coalesce(kind, F.lit("-")).alias("type")).agg(F.count("*").alias("n"))


def _f32_sql() -> str:
    rows = [(n, t) for n, m in _TABLES.items() for t in m.values()] + [("category", "-")]
    return f"SELECT map, type, count(*) AS n FROM part JOIN (VALUES {', '.join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(rows))}) v(i, map, type) ON p_partkey % {len(rows)} = i GROUP BY ALL"


def p02(s, d):
    out = table(s, d, "orders")
    for column, wanted in {"o_orderstatus": ["F", "O"], "o_orderpriority": [], "o_custkey": list(range(50))}.items():
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return out.where(F.col("o_orderdate").between(t("1995-06-01 00:00:00"), t("1997-06-01 00:00:00"))).select("o_orderkey")


def p05(s, d):
    v = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    return _e(s, d).where(~v.eqNullSafe("view")).groupBy(F.coalesce(v, F.lit("-")).alias("kind")).agg(F.count("*").alias("n"))


def p17(s, d):
    x = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("value", "event_id")), asc=False), 1, 3), lambda i: i["event_id"].cast("string"))
    return _e(s, d).where("value IS NOT NULL").groupBy("user_id").agg(F.array_join(x, ",").alias("top"))


def t02(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.lower("p_name").startswith("s").alias("starts"), F.round(text.word_similarity(F.col("p_name"), F.lit("small ring")), 6).alias("sim"))
    return p.where("sim >= 0.3 OR starts").orderBy(F.desc("starts"), F.desc("sim"), "name", "p_partkey").limit(40).select("p_partkey", "sim")


def u06(s, d):
    o = table(s, d, "orders").withColumn("reason", F.when(F.col("o_totalprice") < 50000, "cheap").when(F.col("o_orderstatus") == "P", "pending"))
    return o.groupBy(F.coalesce("reason", F.lit("served")).alias("part")).agg(F.count("*").alias("n"))


def e01(s, d):
    i = places(s, d).select(F.col("place_id").alias("id"), "source", (F.col("size") % 10).alias("cell"), F.when(F.col("place_id") % 3 == 0, F.lit("official")).otherwise(F.lit("open")).alias("tier"))
    dec = i.where("id % 4 = 0").select("id", F.lit("v2").alias("resolver_version"))
    return lists.unresolved(i, dec, "v2", {"official": 0, "reference": 1}).where("turn <= 5").select("id", F.col("turn").cast("long").alias("turn"))


def e12(s, d):
    l = table(s, d, "lineitem")
    old = l.where("l_linenumber = 1").groupBy(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("external_id")).agg(F.min("l_suppkey").alias("place_id"))
    new = l.where("l_linenumber = 2").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("external_id"), F.col("l_suppkey").alias("place_id"), (F.col("l_orderkey") % 2 == 0).alias("direct"), (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("at"))
    return lists.claimed_ids(old, new)


def e13(s, d):
    p = places(s, d).select("place_id", "name", "facets")
    m = p.where("place_id % 5 = 0").select(F.col("place_id").alias("merged_id"), (F.col("place_id") - 1).alias("canonical_id"))
    return lists.merged_places(p, m).select("place_id", "name", F.array_join("facets", ",").alias("facets"))


def r17(s, d):
    return lists.drift_anchors(fixes(s, d)).select("event_id")


def r18(s, d):
    return lists.explained(table(s, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"]).select("p_partkey", "term", "value", F.col("place").cast("long").alias("place"))


def r19(s, d):
    t = _e(s, d).where("user_id IS NOT NULL AND event_type = 'view'").select("user_id", "ts", F.array(F.struct((F.col("event_id") % 40).alias("place_id"), F.lit("held").alias("reason"))).alias("items"))
    live = places(s, d).where("type_domain <> 'practical'").select("place_id")
    return lists.digest(t, live).select("user_id", "place_id", F.col("position").cast("long").alias("position"))


def r20(s, d):
    e = _e(s, d).where("user_id IS NOT NULL")
    ev = e.select((F.col("event_id") % 300).alias("rec_id"), "ts", "event_id", F.col("event_type").alias("event"))
    rec = s.range(300).select(F.col("id").alias("rec_id"), (F.col("id") % 50).alias("place_id"))
    img = places(s, d).select((F.col("place_id") % 60).alias("place_id"), F.col("place_id").alias("image_id"), F.col("name").alias("url"))
    return lists.kept_list(rec, ev, img, "click", "view").select("rec_id", F.coalesce("image", F.lit("-")).alias("image"))


def q05(s, d):
    u = _e(s, d).where("user_id IS NOT NULL").select("user_id").distinct()
    pairs = s.range(1, 10).select(F.col("id").alias("pair"))
    a = _e(s, d).where("user_id IS NOT NULL AND event_id % 3 = 0").select("user_id", (F.col("event_id") % 9 + 1).alias("pair")).distinct()
    return lists.next_unanswered(pairs, a, u).select("user_id", F.coalesce("next_pair", F.lit(-1)).alias("next_pair"))


def q06(s, d):
    ok = lists.consent("A", F.when(F.col("event_id") % 3 != 0, F.col("ts")), F.when(F.col("event_id") % 2 == 0, F.lit("A")).otherwise(F.lit("B")))
    return _e(s, d).groupBy(ok.alias("granted")).agg(F.count("*").alias("n"))


def c04(s, d):
    region = (F.col("place_id") % 5).alias("region")
    items = places(s, d).select(region, F.col("place_id").alias("id"), F.concat("name", F.lit(" "), "type").alias("title"))
    return curation.grounded(items, places(s, d).select(region, "place_id", "name"))


def c05(s, d):
    packs = s.range(10).select(F.col("id").alias("pack_id"), F.lit(1).alias("version"))
    items = table(s, d, "part").select((F.col("p_partkey") % 12).alias("pack_id"), F.when(F.col("p_size") > 25, F.lit("approved")).otherwise(F.lit("draft")).alias("status"), F.col("p_type").alias("cell"), F.col("p_size").alias("effort_minutes"))
    return curation.published(packs, items).select("pack_id", F.col("version").cast("long").alias("version"), F.size("tiles").cast("long").alias("tiles"), F.col("effort_minutes").cast("long").alias("effort"), "items")


def g13(s, d):
    p = places(s, d).withColumn("m", geo.haversine(F.col("lat"), F.col("lng"), F.lit(59.33), F.lit(18.06))).where("m <= 4000")
    return tables.top_n(p.where("type_domain = 'practical'"), ["source"], [F.col("m"), F.col("place_id")], 3).select("source", "place_id")


def m02(s, d):
    l = table(s, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("items"))
    return tables.latest(l, ["l_partkey"], [F.desc("l_linenumber")]).select("l_partkey", "items")


_TG = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))))"
_J = "(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))))"

ENTRIES = [
    ("j02_corridor_join", j02, f"WITH {PLACES} SELECT o_orderkey AS opp, place_id FROM orders JOIN places ON o_custkey % 2000 = place_id WHERE o_orderstatus IN ('O', 'P') AND {hav('lat', 'lng', '59.33', '18.06')} <= 3000"),
    ("j03_feedback_join", j03, "SELECT a.user_id, count(*) AS n FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts GROUP BY 1"),
    ("j05_composite_key", j05, "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL"),
    ("j17_first_image", j17, "SELECT c_custkey, coalesce((SELECT arg_min(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '-') AS first FROM customer"),
    ("j19_array_rewrite", j19, f"WITH {PLACES} SELECT place_id, array_to_string(list_transform(facets, lambda f: CASE WHEN f = 'f1' THEN 'f1!' ELSE f END), ',') AS facets FROM places"),
    ("a16_extents", a16, f"WITH {FIXES} SELECT * FROM (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, round(avg(lat), 3) AS lat, round(avg(lng), 3) AS lng, CAST(round({hav('min(lat)', 'min(lng)', 'max(lat)', 'max(lng)')}) AS BIGINT) AS span_m, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000, 3) AS hours FROM fixes GROUP BY 1) WHERE hours >= 24"),
    ("f02_half_away", f02, "SELECT p_partkey, round((p_partkey - 1000) / 8, 0) AS r0, round(CAST((p_partkey - 1000) / 8 AS DECIMAL(18, 6)), 2)::DOUBLE AS r2 FROM part"),
    ("f08_solar_elevation", f08, _F08),
    ("f08_light", f08_light, _F08_LIGHT),
    ("f11_fold", f11, f"SELECT doc_id, concat_ws(' ', replace(lower(strip_accents(text)), 'ß', 'ss'), {list(_SPECIAL.values())!r}[doc_id % {len(_SPECIAL)} + 1]) AS folded FROM documents"),
    ("f16_identifiers", f16, "SELECT p_partkey, 'en:' || replace(p_name, ' ', '_') AS a, 'sv:' || replace(p_name, ' ', '_') AS b, p_name AS c FROM part"),
    ("f19_dates", f19, "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(CAST(ts AS DATE) - 7, '%Y-%m-%d') AS week_ago, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 / 60, 3) AS minutes FROM events"),
    ("f20_opening_hours", f20, """WITH e AS (SELECT ['24/7', 'Mo-Fr 09:00-17:00', 'Sa,Su 10:00-14:00', 'sunrise-sunset', 'Mo-Su 22:00-02:00', 'PH off'][event_id % 6 + 1] AS spec, isodow(ts) AS day, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT spec, CASE spec WHEN '24/7' THEN true WHEN 'Mo-Fr 09:00-17:00' THEN CASE WHEN day > 5 OR m + 60 <= 540 OR m - 60 >= 1020 THEN false WHEN m - 60 >= 540 AND m + 60 <= 1020 THEN true END
  WHEN 'Sa,Su 10:00-14:00' THEN CASE WHEN day < 6 OR m + 60 <= 600 OR m - 60 >= 840 THEN false WHEN m - 60 >= 600 AND m + 60 <= 840 THEN true END END AS open, count(*) AS n FROM e GROUP BY ALL"""),
    ("f22_stay_horizon", f22, "SELECT o_orderkey, round(CAST(least(20, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 24 END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END) AS DOUBLE), 2) AS hours FROM orders"),
    ("f24_first_wet_hour", f24, "SELECT p_partkey, coalesce(list_min(list_filter(range(0, 12), lambda i: i >= p_size % 8 AND ((p_partkey * 7 + i * 13) % 29) / 100 >= 0.2)), -1) AS at FROM part"),
    ("f32_taxonomy", f32, _f32_sql()),
    ("p02_optional_filters", p02, "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey BETWEEN 0 AND 49 AND o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1997-06-01'"),
    ("p05_null_predicates", p05, "SELECT coalesce(v, '-') AS kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN event_type END AS v FROM events) WHERE v IS DISTINCT FROM 'view' GROUP BY 1"),
    ("p17_snapshot_sample", p17, "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id DESC) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 3 GROUP BY 1"),
    ("t02_ranked_search", t02, f"WITH x AS (SELECT p_partkey, p_name, lower(p_name) LIKE 's%' AS st, round({_J.format(_TG.format('p_name'), _TG.format(chr(39) + 'small ring' + chr(39)))}, 6) AS sim FROM part) SELECT p_partkey, sim FROM x WHERE sim >= 0.3 OR st ORDER BY st DESC, sim DESC, p_name, p_partkey LIMIT 40"),
    ("t04_page", lambda s, d: table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(30).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 100"),
    ("u06_partition", u06, "SELECT CASE WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'served' END AS part, count(*) AS n FROM orders GROUP BY 1"),
    ("e01_unresolved", e01, f"WITH {PLACES}, r AS (SELECT place_id AS id, row_number() OVER (PARTITION BY size % 10 ORDER BY CASE WHEN place_id % 3 = 0 THEN 0 ELSE 2 END, source, place_id) AS turn FROM places WHERE place_id % 4 <> 0) SELECT id, turn FROM r WHERE turn <= 5"),
    ("e12_claimed_ids", e12, """WITH o AS (SELECT l_returnflag AS source, l_partkey AS external_id, min(l_suppkey) AS place_id FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
n AS (SELECT l_returnflag AS source, l_partkey AS external_id, l_orderkey % 2 = 0 AS direct, arg_max(l_suppkey, l_orderkey * 1000 + l_suppkey) FILTER (l_orderkey % 2 = 0) AS hi, arg_min(l_suppkey, l_orderkey * 1000 + l_suppkey) FILTER (l_orderkey % 2 <> 0) AS lo FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL),
k AS (SELECT source, external_id, max(hi) AS hi, max(lo) AS lo FROM n GROUP BY ALL) SELECT source, external_id, coalesce(k.hi, o.place_id, k.lo) AS place_id FROM o FULL JOIN k USING (source, external_id)"""),
    ("e13_merge", e13, f"""WITH {PLACES}, m AS (SELECT CASE WHEN place_id % 5 = 0 THEN place_id - 1 ELSE place_id END AS own, * FROM places), f AS (SELECT own, string_agg(DISTINCT x, ',' ORDER BY x) AS facets FROM (SELECT own, unnest(facets) AS x FROM m) GROUP BY 1)
SELECT own AS place_id, first(name ORDER BY place_id) AS name, any_value(f.facets) AS facets FROM m JOIN f USING (own) GROUP BY 1"""),
    ("r17_drift", r17, f"""WITH RECURSIVE {FIXES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM fixes),
w AS (SELECT user_id, n, event_id, lat AS slat, lng AS slng, ts AS sts, 1 AS serves, true AS go FROM o WHERE n = 1
UNION ALL SELECT user_id, n, event_id, CASE WHEN go THEN lat ELSE slat END, CASE WHEN go THEN lng ELSE slng END, CASE WHEN go THEN ts ELSE sts END, serves + CASE WHEN go THEN 1 ELSE 0 END, go
  FROM (SELECT o.user_id, o.n, o.event_id, o.lat, o.lng, o.ts, w.slat, w.slng, w.sts, w.serves, w.serves < 20 AND epoch_us(o.ts) - epoch_us(w.sts) >= 120000000 AND {hav('w.slat', 'w.slng', 'o.lat', 'o.lng')} >= 400 AS go FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))
SELECT event_id FROM w WHERE go"""),
    ("r18_explanation", r18, "WITH u AS (SELECT p_partkey, 'p_size' AS term, CAST(p_size AS DOUBLE) AS value, 0 AS o FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, 1 FROM part) SELECT p_partkey, term, value, row_number() OVER (PARTITION BY p_partkey ORDER BY value DESC, o) AS place FROM u"),
    ("r19_digest", r19, """WITH t AS (SELECT user_id, event_id % 40 AS place_id, min(ts) AS ts FROM events WHERE user_id IS NOT NULL AND event_type = 'view' AND event_id % 40 IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 4) GROUP BY ALL)
SELECT user_id, place_id, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, place_id) AS position FROM t) WHERE position <= 5"""),
    ("r20_kept_list", r20, f"""WITH {PLACES}, e AS (SELECT event_id % 300 AS rec_id, arg_max(event_type, {{'t': ts, 'i': event_id}}) AS l FROM events WHERE user_id IS NOT NULL AND event_type IN ('click', 'view') GROUP BY 1), i AS (SELECT place_id % 60 AS p, arg_min(name, place_id) AS image FROM places GROUP BY 1)
SELECT rec_id, coalesce(image, '-') AS image FROM e LEFT JOIN i ON rec_id % 50 = p WHERE l = 'click'"""),
    ("q01_dashboard", lambda s, d: _e(s, d).agg(F.count_distinct("user_id").alias("users"), F.count_if(F.col("ts") >= F.lit("2024-01-23 00:00:00").cast("timestamp_ntz")).alias("recent"), F.count("*").alias("n")), "SELECT count(DISTINCT user_id) AS users, count(*) FILTER (ts >= TIMESTAMP '2024-01-23') AS recent, count(*) AS n FROM events"),
    ("q05_next_pair", q05, "WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), a AS (SELECT DISTINCT user_id, event_id % 9 + 1 AS pair FROM events WHERE event_id % 3 = 0) SELECT user_id, coalesce((SELECT min(p) FROM range(1, 10) t(p) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = u.user_id AND a.pair = p)), -1) AS next_pair FROM u"),
    ("q06_consent", q06, "SELECT event_id % 3 <> 0 AND event_id % 2 = 0 AS granted, count(*) AS n FROM events GROUP BY 1"),
    ("c04_grounding", c04, f"""WITH {PLACES}, i AS (SELECT place_id, {_TG.format("name || ' ' || type")} AS g FROM places), p AS (SELECT place_id, {_TG.format('name')} AS g FROM places), x AS (SELECT i.place_id AS id, p.place_id, round({_J.format('i.g', 'p.g')}, 4) AS similarity FROM i JOIN p ON i.place_id % 5 = p.place_id % 5)
SELECT id, place_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, place_id) AS n FROM x WHERE similarity >= 0.4) WHERE n = 1"""),
    ("c05_publish", c05, "SELECT p_partkey % 12 AS pack_id, 2 AS version, count(DISTINCT p_type) AS tiles, CAST(sum(p_size) AS BIGINT) AS effort, count(*) AS items FROM part WHERE p_size > 25 AND p_partkey % 12 < 10 GROUP BY 1"),
    ("g13_essentials", g13, f"WITH {PLACES} SELECT source, place_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {hav('lat', 'lng', '59.33', '18.06')}, place_id) AS n FROM places WHERE type_domain = 'practical' AND {hav('lat', 'lng', '59.33', '18.06')} <= 4000) WHERE n <= 3"),
    ("m02_tile_state", m02, "SELECT l_partkey, arg_max(items, l_linenumber) AS items FROM (SELECT l_partkey, l_linenumber, count(*) AS items FROM lineitem GROUP BY ALL) GROUP BY 1"),
]
