"""Queries of joins, aggregates, windows, sorts, set operations and writes on the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tables
from .base import PLACES, places, table


def _t(name):
    return lambda s, d: table(s, d, name)


_customer, _orders, _lineitem, _nation, _supplier, _part, _events = (_t(n) for n in ("customer", "orders", "lineitem", "nation", "supplier", "part", "events"))


def j01(s, d):
    j = _orders(s, d).join(_customer(s, d), F.col("o_custkey") == F.col("c_custkey")).join(_nation(s, d), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.where("o_totalprice > 100000").groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def j04(s, d):
    a, b = _supplier(s, d), _customer(s, d)
    pair = a.alias("a").join(b.alias("b"), F.col("a.s_nationkey") == F.col("b.c_nationkey")).where(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) < 5)
    return pair.join(_nation(s, d), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "c_custkey", "n_name", F.round(F.abs(F.col("s_acctbal") - F.col("c_acctbal")), 2).alias("gap"))


def j06(s, d):
    o = _orders(s, d).where("o_orderpriority = '1-URGENT'")
    return _customer(s, d).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


def j08(s, d):
    return _customer(s, d).join(_orders(s, d).where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def j09(s, d):
    return _customer(s, d).join(_orders(s, d).where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def j10(s, d):
    big = _orders(s, d).where("o_totalprice > 200000").select("o_custkey").distinct().withColumn("b", F.lit(True))
    return _customer(s, d).join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("b", F.lit(False)).alias("has_big"))


def j11(s, d):
    n = _nation(s, d).where("n_regionkey = 1")
    j = _customer(s, d).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("c_custkey", F.when(F.col("n_name").isNotNull(), F.concat_ws("/", "n_name", "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"))


def j12(s, d):
    return tables.latest(_orders(s, d), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey")


def j13(s, d):
    m = _customer(s, d).where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("merged_id"), (F.col("c_custkey") - 1).alias("canonical_id"))
    return tables.redirected(_orders(s, d), m, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


def j15(s, d):
    """Pairs of places of one tile and different sources."""
    p = places(s, d).select("place_id", "source", F.floor(F.col("lat") * 100).alias("y"), F.floor(F.col("lng") * 50).alias("x"))
    a, b = (p.select(F.col("place_id").alias(k), F.col("source").alias(f"{k}s"), "x", "y") for k in "ab")
    return a.join(b, ["x", "y"]).where(F.col("a") < F.col("b")).where(F.col("as") != F.col("bs")).select("a", "b")


def j16(s, d):
    """Pairs of orders that name one part from different suppliers, and how often they do.

    An order's partners over one part travel together as a sorted list to the task of that order, which counts them: half
    the bytes of a row a pair.
    """
    l = _lineitem(s, d).select("l_orderkey", "l_partkey", "l_suppkey").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").distinct()
    l = l.repartition("l_partkey")
    named = l.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_suppkey"))).alias("_by"))
    other = F.filter("_by", lambda x: (x["l_orderkey"] > F.col("l_orderkey")) & (x["l_suppkey"] != F.col("l_suppkey")))
    lists = l.join(named.hint("merge"), "l_partkey").select(F.col("l_orderkey").alias("a"), F.transform(other, lambda x: x["l_orderkey"]).alias("_b")).where(F.size("_b") > 0)
    return lists.repartition("a").select("a", F.explode("_b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def j18(s, d):
    cells = s.createDataFrame([(["A", "N", "R", "A"],)], "cells array<string>").select(F.posexplode("cells").alias("ord", "cell"))
    n = _lineitem(s, d).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return cells.join(n, F.col("cell") == F.col("l_returnflag")).select("ord", "cell", "n")


def j20(s, d):
    e = _events(s, d).where("user_id IS NOT NULL")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.col("event_id").alias("last_view"))
    return tables.as_of(left, right, "user_id", "ts", "at", "last_view", "tie", 86_400 * 2).select("event_id", F.coalesce("last_view", F.lit(-1)).alias("last_view"))


def a12(s, d):
    e = _events(s, d)
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))


def a14(s, d):
    return _events(s, d).agg(F.count_distinct(F.struct(F.to_date("ts"), "user_id")).alias("pairs"), F.count_distinct("user_id").alias("users"))


def a21(s, d):
    e = _events(s, d)
    return e.groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.get_json_object("props", "$.k").cast("int") > 50).alias("wet"), F.count("*").alias("n"))


def a22(s, d):
    r = _lineitem(s, d).where("l_shipdate >= '2001-01-01'").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    return r.select(F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("hit_rate"))


def a25(s, d):
    j = _lineitem(s, d).join(_part(s, d), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_suppkey", "p_type").agg(F.count_distinct("p_partkey").alias("parts"))


def a26(s, d):
    p = places(s, d)
    return p.groupBy("type").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("facets")))), ",").alias("facets"))


def a28(s, d):
    l = _lineitem(s, d)
    return l.groupBy("l_shipdate").agg(F.count_if(F.col("l_returnflag") == "A").alias("served"), F.count_if(F.col("l_returnflag") == "R").alias("held"), F.count_if(F.col("l_discount") > 0.09).alias("near_miss"), F.size(F.slice(F.collect_list("l_orderkey"), 1, 25)).cast("long").alias("sample")).withColumn("l_shipdate", F.col("l_shipdate").cast("date").cast("string"))


def w04(s, d):
    near = _supplier(s, d).orderBy(F.abs(F.col("s_acctbal") - 1000), "s_suppkey").limit(60)
    return tables.top_n(near, ["s_nationkey"], [F.abs(F.col("s_acctbal") - 1000), F.col("s_suppkey")], 3).select("s_nationkey", "s_suppkey")


def w05(s, d):
    return _orders(s, d).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


def w06(s, d):
    return _part(s, d).select("p_partkey", F.coalesce(tables.percentile_of("p_retailprice", ["p_size"]), F.lit(-1.0)).alias("pct"))


def w07(s, d):
    w = Window.partitionBy("p_size")
    return _part(s, d).select("p_partkey", F.round((F.rank().over(w.orderBy("p_retailprice")) - 1) / F.count("*").over(w), 6).alias("pct"))


def w09(s, d):
    c = _events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return c.withColumn("next", F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "n", "next")


def w10(s, d):
    p = places(s, d).withColumns({"region": F.col("place_id") % 4, "cell": F.col("size"), "best": -F.col("price")})
    return tables.interleaved(p.select("region", "type_domain", "cell", "best", "place_id"), "region", "type_domain", "cell", ["best", "place_id"], 40).select("region", "place_id", "position")


def t03(s, d):
    e = _events(s, d).withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return e.orderBy(F.col("v").asc_nulls_last(), "event_id").limit(50).select("event_id"), None


def t05(s, d):
    return _customer(s, d).orderBy(F.abs(F.col("c_acctbal") - 2500), "c_custkey").limit(25).select("c_custkey", F.round(F.abs(F.col("c_acctbal") - 2500), 2).alias("distance"))


def u01(s, d):
    return _customer(s, d).select(F.col("c_nationkey").alias("k")).union(_supplier(s, d).select("s_nationkey")).distinct()


def u02(s, d):
    a = _nation(s, d).select(F.lower("n_name").alias("name"), F.lit(0).alias("list"), F.col("n_nationkey").alias("pos"))
    b = table(s, d, "region").select(F.lower("r_name").alias("name"), F.lit(1).alias("list"), F.col("r_regionkey").alias("pos"))
    return tables.latest(a.unionByName(b).unionByName(a.withColumn("list", F.lit(2))), ["name"], [F.col("list"), F.col("pos")]).select("name", "list", "pos")


def u04(s, d):
    l = _lineitem(s, d).select("l_partkey", "l_suppkey", "l_returnflag", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("disc"), F.col("l_linenumber").alias("ordinal"))
    own = tables.latest(l, ["l_partkey", "ordinal"], [F.col("l_suppkey"), F.col("l_returnflag"), F.col("disc").asc_nulls_last()])
    return tables.merged_candidates(own, "l_partkey", ["disc"], "l_returnflag", "ordinal").select("l_partkey", F.coalesce("disc", F.lit(-1.0)).alias("disc"), F.array_join("sources", ",").alias("sources"))


def u05(s, d):
    near, far = _orders(s, d).where("o_totalprice > 300000").select("o_custkey").distinct(), _orders(s, d).where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return near.intersect(far).withColumn("part", F.lit("both")).unionByName(near.exceptAll(far).withColumn("part", F.lit("near"))).unionByName(far.exceptAll(near).withColumn("part", F.lit("far")))


def m01(s, d):
    o = _orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice")).unionByName(o.where("o_orderkey % 100 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_totalprice"))
    return tables.upsert(o, new, ["o_orderkey"], [F.col("o_totalprice")]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def m04(s, d):
    c = _customer(s, d).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    new = _customer(s, d).select((F.col("c_custkey") + 10).alias("c_custkey"), F.lower("c_mktsegment").alias("seg"))
    return tables.fill_if_null(c, new, ["c_custkey"], ["seg"]).select("c_custkey", F.coalesce("seg", F.lit("?")).alias("seg"))


def m05(s, d):
    o = _orders(s, d)
    stay, gone = tables.archive_expired(o, o.where("o_orderkey % 7 = 0"), F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderstatus") != "P", ["o_orderkey"])
    return stay.select("o_orderkey", F.lit("kept").alias("part")).unionByName(gone.select("o_orderkey", F.lit("archived").alias("part")))


def m06(s, d):
    p = places(s, d).select("place_id", "lat", "lng", F.when(F.col("place_id") % 2 == 0, F.lit("known")).alias("cell"))
    out = tables.coarsen(p, F.col("place_id") % 3 == 0, F.concat_ws(":", F.floor(F.col("lat") * 100), F.floor(F.col("lng") * 100)))
    return out.select("place_id", F.coalesce("lat", F.lit(-1.0)).alias("lat"), F.coalesce("lng", F.lit(-1.0)).alias("lng"), F.coalesce("cell", F.lit("-")).alias("cell"))


def m07(s, d):
    o = _orders(s, d).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    who = _customer(s, d).where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.erase(o, who, ["o_custkey"], ["o_orderpriority"]).groupBy(F.coalesce("o_orderpriority", F.lit("erased")).alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def p09(s, d):
    return _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("none")).where("k > 90")


def q02(s, d):
    n = _orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _customer(s, d).join(n, F.col("c_custkey") == F.col("o_custkey"), "left").orderBy(F.desc_nulls_last("n"), "c_custkey").offset(20).limit(25).select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def q08(s, d):
    p = _part(s, d)
    item = lambda i, c, k: F.struct(c.alias("v"), F.lit(-i).alias("o"), F.lit(k).alias("k"))
    best = F.array_max(F.array(item(0, F.col("p_size").cast("double"), "size"), item(1, F.col("p_retailprice") / 50, "price"), item(2, F.col("p_partkey") % 40 * 1.0, "key")))
    return p.select("p_partkey", best["k"].alias("why"))


def q13(s, d):
    a = _nation(s, d).select("n_nationkey", F.col("n_regionkey").alias("ours_a"), (F.col("n_nationkey") % 5).alias("ours_b"))
    b = _nation(s, d).select("n_nationkey", (F.col("n_nationkey") % 5).alias("a"), (F.col("n_nationkey") % 4).alias("b"))
    return a.join(b, "n_nationkey", "left").select("n_nationkey", F.expr("stack(2, 'a', ours_a, a, 'b', ours_b, b) AS (field, ours, theirs)")).where("NOT ours <=> theirs")


def s16(s, d):
    u = F.col("user_id") == 7
    return _events(s, d).where(u).select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("doc"))


def s18(s, d):
    got = _lineitem(s, d).select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _part(s, d).join(got.where("p_partkey % 3 <> 0"), "p_partkey", "left_anti").orderBy("p_partkey").limit(100).select("p_partkey")


ENTRIES = [
    ("j01_three_way", j01, "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 GROUP BY 1"),
    ("j04_review_queue", j04, "SELECT s_suppkey, c_custkey, n_name, round(abs(s_acctbal - c_acctbal), 2) AS gap FROM supplier JOIN customer ON s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey WHERE abs(s_acctbal - c_acctbal) < 5"),
    ("j06_left_outer", j06, "SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    ("j08_semi", j08, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    ("j09_anti", j09, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    ("j10_existence", j10, "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS has_big FROM customer"),
    ("j11_update_from", j11, "SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN n_name || '/' || c_mktsegment ELSE c_mktsegment END AS segment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey"),
    ("j12_dedupe_slot", j12, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1"),
    ("j13_redirect", j13, "SELECT CASE WHEN o_custkey % 10 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey - 1 ELSE o_custkey END AS o_custkey, count(*) AS n FROM orders GROUP BY 1"),
    ("j15_tile_pairs", j15, f"WITH {PLACES} SELECT a.place_id AS a, b.place_id AS b FROM places a JOIN places b ON floor(a.lat * 100) = floor(b.lat * 100) AND floor(a.lng * 50) = floor(b.lng * 50) AND a.place_id < b.place_id AND a.source <> b.source"),
    ("j16_shared_id_pairs", j16, "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT a.o AS a, b.o AS b, count(*) AS shared FROM l a JOIN l b USING (p) WHERE a.o < b.o AND a.s <> b.s GROUP BY ALL"),
    ("j18_unnest_ordinality", j18, "WITH c AS (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['A', 'N', 'R', 'A']) AS cell) SELECT ord, cell, (SELECT count(*) FROM lineitem WHERE l_returnflag = cell) AS n FROM c"),
    ("j20_as_of", j20, """WITH r AS (SELECT p.event_id, v.event_id AS v, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n, epoch(p.ts) - epoch(v.ts) AS age FROM events p LEFT JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' AND p.user_id IS NOT NULL)
SELECT event_id, CASE WHEN age <= 172800 THEN v ELSE -1 END AS last_view FROM r WHERE n = 1"""),
    ("a12_filtered", a12, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1"),
    ("a13_group_counts", lambda s, d: _events(s, d).groupBy("event_type").count().withColumnRenamed("count", "n"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    ("a14_distinct_pairs", a14, "SELECT (SELECT count(*) FROM (SELECT DISTINCT CAST(ts AS DATE), user_id FROM events)) AS pairs, count(DISTINCT user_id) AS users FROM events"),
    ("a21_weather_rollup", a21, "SELECT user_id, min(value) AS low, max(value) AS high, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 50) AS wet, count(*) AS n FROM events GROUP BY 1"),
    ("a22_hit_rate", a22, "SELECT round(sum(l_discount) / (sum(l_discount) + sum(l_tax)), 6) AS hit_rate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'"),
    ("a25_distinct_exposure", a25, "SELECT l_suppkey, p_type, count(DISTINCT p_partkey) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"),
    ("a26_set_union", a26, f"WITH {PLACES}, u AS (SELECT DISTINCT type, unnest(facets) AS f FROM places) SELECT type, string_agg(f, ',' ORDER BY f) AS facets FROM u GROUP BY 1"),
    ("a28_funnel", a28, "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, count(*) FILTER (l_returnflag = 'A') AS served, count(*) FILTER (l_returnflag = 'R') AS held, count(*) FILTER (l_discount > 0.09) AS near_miss, least(count(*), 25) AS sample FROM lineitem GROUP BY 1"),
    ("w04_topn_per_type", w04, "WITH n AS (SELECT * FROM supplier ORDER BY abs(s_acctbal - 1000), s_suppkey LIMIT 60), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal - 1000), s_suppkey) AS k FROM n) SELECT s_nationkey, s_suppkey FROM r WHERE k <= 3"),
    ("w05_latest", w05, "SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order FROM orders GROUP BY 1"),
    ("w06_percentile", w06, "SELECT p_partkey, coalesce(CASE WHEN count(*) OVER w >= 2 AND min(p_retailprice) OVER w <> max(p_retailprice) OVER w THEN round(percent_rank() OVER (PARTITION BY p_size ORDER BY p_retailprice), 6) END, -1.0) AS pct FROM part WINDOW w AS (PARTITION BY p_size)"),
    ("w07_percentile_of_population", w07, "SELECT p_partkey, round((rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) - 1) / count(*) OVER (PARTITION BY p_size), 6) AS pct FROM part"),
    ("w09_runner_up", w09, "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, coalesce(lead(n) OVER w, 0) AS next, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)) SELECT user_id, event_type, n, next FROM r WHERE k = 1"),
    ("w10_interleave", w10, None),
    ("t03_nulls_last", lambda s, d: t03(s, d)[0], "SELECT event_id FROM events ORDER BY CASE WHEN event_id % 5 <> 0 THEN value END NULLS LAST, event_id LIMIT 50"),
    ("t05_nearest_k", t05, "SELECT c_custkey, round(abs(c_acctbal - 2500), 2) AS distance FROM customer ORDER BY abs(c_acctbal - 2500), c_custkey LIMIT 25"),
    ("u01_union", u01, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("u02_deduped_lists", u02, "WITH u AS (SELECT lower(n_name) AS name, 0 AS list, n_nationkey AS pos FROM nation UNION ALL SELECT lower(r_name), 1, r_regionkey FROM region UNION ALL SELECT lower(n_name), 2, n_nationkey FROM nation) SELECT name, list, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY list, pos) AS n FROM u) WHERE n = 1"),
    ("u03_distinct", lambda s, d: _lineitem(s, d).select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    ("u04_merged_candidates", u04, """WITH r AS (SELECT l_partkey, l_returnflag AS f, CASE WHEN l_discount > 0.05 THEN l_discount END AS disc, l_linenumber AS o, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_suppkey, l_returnflag, CASE WHEN l_discount > 0.05 THEN l_discount END NULLS LAST) AS n FROM lineitem)
SELECT l_partkey, coalesce(first(disc ORDER BY o) FILTER (disc IS NOT NULL), -1.0) AS disc, string_agg(f, ',' ORDER BY o) AS sources FROM r WHERE n = 1 GROUP BY 1"""),
    ("u05_set_algebra", u05, "WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000), f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, CASE WHEN n.o_custkey IS NULL THEN 'far' WHEN f.o_custkey IS NULL THEN 'near' ELSE 'both' END AS part FROM n FULL JOIN f USING (o_custkey)"),
    ("m01_upsert", m01, "SELECT o_orderkey, o_custkey, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, o_custkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0"),
    ("m04_fill_if_null", m04, "WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer), n AS (SELECT c_custkey + 10 AS c_custkey, lower(c_mktsegment) AS seg FROM customer) SELECT c_custkey, coalesce(o.seg, n.seg, '?') AS seg FROM o FULL JOIN n USING (c_custkey)"),
    ("m05_archive", m05, "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'archived' ELSE 'kept' END AS part FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' AND (o_orderstatus = 'P' OR o_orderkey % 7 = 0))"),
    ("m06_coarsen", m06, f"WITH {PLACES} SELECT place_id, CASE WHEN place_id % 3 = 0 THEN -1.0 ELSE lat END AS lat, CASE WHEN place_id % 3 = 0 THEN -1.0 ELSE lng END AS lng, CASE WHEN place_id % 2 = 0 THEN 'known' WHEN place_id % 3 = 0 THEN CAST(floor(lat * 100) AS BIGINT) || ':' || CAST(floor(lng * 100) AS BIGINT) ELSE '-' END AS cell FROM places"),
    ("m07_erase", m07, "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'erased' ELSE o_orderpriority END AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    ("p09_json", p09, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.none'), '-') AS none FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 90"),
    ("q02_paged_list", q02, "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey ORDER BY n DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 20"),
    ("q08_arg_max", q08, "SELECT p_partkey, CASE WHEN p_size >= p_retailprice / 50 AND p_size >= p_partkey % 40 THEN 'size' WHEN p_retailprice / 50 >= p_partkey % 40 THEN 'price' ELSE 'key' END AS why FROM part"),
    ("q13_price_drift", q13, "SELECT n_nationkey, field, ours, theirs FROM (SELECT n_nationkey, 'a' AS field, n_regionkey AS ours, n_nationkey % 5 AS theirs FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey % 5, n_nationkey % 4 FROM nation) WHERE ours IS DISTINCT FROM theirs"),
    ("s16_export", s16, """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS doc FROM events WHERE user_id = 7"""),
    ("s18_work_queue", s18, "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND p_partkey % 3 <> 0) ORDER BY 1 LIMIT 100"),
]
