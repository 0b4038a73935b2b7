"""Queries of harvested pages, personal data, review queues, gold files and novelty."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lists, privacy, rank, resolve, tiles
from ..scratch import new_path
from ..sources import paged, readers
from .base import PLACES, hav, places, table


def s09(s, d):
    """Monuments written as pages of 100 and harvested again."""
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("reference"), F.col("p_name").alias("titre"), F.col("p_partkey").alias("n"))
    path = new_path(s, "pages")
    paged.write_pages(p, path, "results", F.floor(F.col("n") / 100), F.col("n"))
    got = paged.read_pages(s, path, paged.Adapter("results", 100, 1_000_000, True))
    return got.select("page", F.col("at").cast("long").alias("at"), F.get_json_object("record", "$.reference").alias("reference"), F.get_json_object("record", "$.titre").alias("titre"))


def s10(s, d):
    """Objects in pages of 30 that say how many there are."""
    p = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("uuid"), F.col("s_suppkey").alias("n"))
    path = new_path(s, "objects")
    paged.write_pages(p, path, "objects", F.floor(F.col("n") / 30), F.col("n"), meta=F.lit(p.agg(F.floor(F.max("n") / 30) + 1).first()[0]))
    got = paged.read_pages(s, path, paged.Adapter("objects", None, 1_000_000, True, "total_pages"))
    return got.groupBy("page").agg(F.count("*").alias("n"), F.min(F.get_json_object("record", "$.uuid").cast("long")).alias("first"))


def s13_observed(s, d):
    """What an ingest says of itself, beside a second pass over what it wrote."""
    p = places(s, d)
    base = lambda x, source: x.select(F.lit(source).alias("source"), F.when(F.col("place_id") % 9 != 0, F.col("place_id").cast("string")).alias("external_id"), "name", "lat", "lng")
    known = base(p.where("size <= 25 AND place_id % 9 <> 0"), "osm").withColumn("cell", F.lit("-"))
    items, said = readers.ingested(base(p.where("size >= 20"), "osm").unionByName(base(p, "news")), known, F.lit("c"), new_path(s, "items"))
    return items.agg(F.count("*").alias("items"), F.count_if(F.col("cell") == "c").alias("new")).select("*", *[F.lit(v).cast("long").alias(k) for k, v in sorted(said.items())])


def s14(s, d):
    """The region around the places of each domain, as a grid of boxes."""
    regions = places(s, d).groupBy(F.col("type_domain").alias("region_key")).agg(F.min("lat").alias("south"), F.min("lng").alias("west"), F.max("lat").alias("north"), F.max("lng").alias("east"))
    return tiles.region_grids(regions).select("region_key", "row", "col", F.round("south", 6).alias("south"), F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), F.round("east", 6).alias("east"))


_S14 = f"""WITH {PLACES}, r AS (SELECT type_domain AS region_key, min(lat) AS s, min(lng) AS w, max(lat) AS n, max(lng) AS e FROM places GROUP BY 1),
k AS (SELECT *, (SELECT min(i) FROM range(0, 12) t(i) WHERE greatest(1, ceil((n - s) / (0.05 * pow(2, i)) - 1e-9)) * greatest(1, ceil((e - w) / (0.05 * pow(2, i)) - 1e-9)) <= 24) AS i FROM r),
c AS (SELECT *, 0.05 * pow(2, i) AS cell FROM k), g AS (SELECT *, CAST(greatest(1, ceil((n - s) / cell - 1e-9)) AS BIGINT) AS rows, CAST(greatest(1, ceil((e - w) / cell - 1e-9)) AS BIGINT) AS cols FROM c),
b AS (SELECT *, unnest(range(0, rows)) AS row FROM g), x AS (SELECT *, unnest(range(0, cols)) AS col FROM b)
SELECT region_key, row, col, round(least(n, s + row * cell), 6) AS south, round(least(e, w + col * cell), 6) AS west, round(least(n, s + (row + 1) * cell), 6) AS north, round(least(e, w + (col + 1) * cell), 6) AS east FROM x"""


def s16(s, d):
    """One document a customer: the account, its orders with their items, and its events; read back for its counts."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_mktsegment")
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("at"))
    l = table(s, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber")
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    docs = privacy.exported(c, {"orders": (o, "o_custkey", [F.col("o_orderkey")]), "items": (l, "o_custkey", [F.col("l_orderkey"), F.col("l_linenumber")]), "events": (e, "user_id", [F.col("event_id")])})
    size = lambda k: F.size(F.from_json(F.get_json_object("document", f"$.{k}"), "array<struct<a:int>>")).cast("long").alias(k)
    return docs.select("user_id", F.get_json_object("document", "$.account.name").alias("name"), size("orders"), size("items"), size("events"), F.get_json_object("document", "$.orders[0].o_orderkey").cast("long").alias("first_order"))


def s17_gold(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"))
    pair = [F.concat(F.lit("osm:"), "k").alias("a"), F.concat(F.lit("merimee:"), F.col("k") + 1).alias("b")]
    sampled = p.select(*pair, F.when(F.col("k") % 3 == 0, "match").when(F.col("k") % 3 == 1, "distinct").alias("label"), F.when(F.col("k") % 3 < 2, "auto").alias("labeled_by"))
    before = p.where("k % 4 = 0").select(pair[1].alias("a"), pair[0].alias("b"), F.when(F.col("k") % 8 == 0, "distinct").otherwise("match").alias("label"), F.when(F.col("k") % 5 < 3, "human").otherwise("auto").alias("labeled_by"))
    path = new_path(s, "gold")
    resolve.gold_labels(sampled, before).write.json(path)
    back = s.read.schema("key string, label string, labeled_by string, todo boolean").json(path)
    return back.select("key", F.coalesce("label", F.lit("-")).alias("label"), F.coalesce("labeled_by", F.lit("-")).alias("labeled_by"), "todo")


_S17 = """WITH p AS (SELECT 'merimee:' || (p_partkey + 1) || '|osm:' || p_partkey AS key, p_partkey AS k FROM part),
x AS (SELECT key, CASE k % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'distinct' END AS l, CASE WHEN k % 3 < 2 THEN 'auto' END AS b, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'distinct' ELSE 'match' END END AS ol, CASE WHEN k % 5 < 3 THEN 'human' ELSE 'auto' END AS ob FROM p),
y AS (SELECT *, ol IS NOT NULL AND (ob = 'human' OR l IS NULL) AS keep FROM x)
SELECT key, coalesce(CASE WHEN keep THEN ol ELSE l END, '-') AS label, coalesce(CASE WHEN keep THEN ob ELSE b END, '-') AS labeled_by, CASE WHEN keep THEN ol ELSE l END IS NULL AS todo FROM y"""


def s17_traces(s, d):
    o = table(s, d, "orders")
    sessions = table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("mode"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    served = o.select(F.col("o_custkey").alias("session_id"), F.row_number().over(w).alias("position"), F.col("o_orderkey").alias("place_id"), F.col("o_totalprice").alias("composite"), F.col("o_orderdate").alias("served_at"))
    path = new_path(s, "traces")
    resolve.trace_documents(sessions, served).select(F.col("document").alias("value")).write.text(path)
    doc = s.read.text(path).select(F.from_json("value", "session struct<session_id:long,mode:string>, served array<struct<position:int,place_id:long>>").alias("x"))
    return doc.select("x.session.session_id", "x.session.mode", F.size("x.served").cast("long").alias("n"), F.array_join(F.transform("x.served", lambda c: c["place_id"].cast("string")), ",").alias("places"))


def m07_traces(s, d):
    e = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    inputs = F.to_json(F.struct(F.struct((F.col("event_id") % 9).alias("place_id"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng")).alias("candidate"), F.col("event_id").alias("k")))
    traces = e.select("event_id", "user_id", F.col("ts").alias("served_at"), F.lit(59.0).alias("anchor_lat"), F.lit(18.0).alias("anchor_lng"), inputs.alias("score_inputs"))
    users = e.select("user_id", (F.col("user_id") % 3 == 0).alias("research_consent")).distinct()
    out = privacy.coarsened_traces(traces, users, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    j = lambda p: F.coalesce(F.get_json_object("score_inputs", p).cast("double"), F.lit(-1.0))
    return out.select("event_id", F.coalesce("anchor_lat", F.lit(-1.0)).alias("anchor"), j("$.candidate.lat").alias("lat"), j("$.candidate.place_id").alias("place"), j("$.k").alias("k"))


def m07_costs(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_totalprice")
    out = privacy.deidentified(o, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), "at", ["o_custkey"])
    return out.groupBy(F.col("o_custkey").isNull().alias("gone")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("money"))


def m07_account(s, d):
    c = table(s, d, "customer")
    left = privacy.account_deleted(
        {"customer": c, "orders": table(s, d, "orders"), "events": table(s, d, "events")}, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), {"customer": "c_custkey", "events": "user_id"}, {"orders": ("o_custkey", ["o_custkey"])}
    )
    rows = [left[k].agg(F.lit(k).alias("name"), F.count("*").alias("n"), F.count(u).alias("owned")) for k, u in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def f30(s, d):
    e = table(s, d, "events").select("event_id", "props")
    more = privacy.json_set(F.col("props"), "n", F.col("event_id").cast("string"))
    e = e.withColumns({"more": more, "less": privacy.json_without(more, "k"), "kind": privacy.json_kind(F.get_json_object("props", "$.k"))})
    get = lambda c, k: F.coalesce(F.get_json_object(c, f"$.{k}").cast("long"), F.lit(-1))
    return e.select("event_id", get("more", "k").alias("k"), get("more", "n").alias("n"), get("less", "k").alias("gone"), get("less", "n").alias("kept"), F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce(privacy.json_kind(F.col("props")), F.lit("-")).alias("whole"))


def f30_listed(s, d):
    o = table(s, d, "orders")
    doc = F.to_json(privacy.listed([-F.col("o_orderkey")], F.col("o_orderkey").alias("id")))
    return o.groupBy("o_custkey").agg(doc.alias("doc"))


def j04_queue(s, d):
    p = places(s, d)
    k, n = F.col("place_id"), p.count()
    source = F.when(k % 2 == 0, "osm").otherwise("overture")
    items = p.select((k + 100_000).alias("id"), source.alias("source"), k.cast("string").alias("external_id"))
    concordance = p.select(source.alias("source"), k.cast("string").alias("external_id"), F.when(k % 10 == 0, (k * 7) % n + 1).otherwise(k).alias("place_id"))
    decisions = p.select(
        k.alias("id"), (k + 100_000).alias("source_item_id"), ((k * 7) % n + 1).alias("place_id"), F.when(k % 3 == 0, "review").otherwise("high").alias("band"), F.when(k % 5 == 0, "human").otherwise("auto").alias("decided_by"),
        F.when(k % 11 == 0, "v1").otherwise("v2").alias("resolver_version"), (k % 97 / 97).alias("score"),
    )
    return resolve.review_queue(decisions, items, concordance, p, "v2", 60).select("decision_id", "candidate_id", "compared_id", "candidate_name", "compared_name", "distance_m")


_J04 = f"""WITH {PLACES}, c AS (SELECT place_id AS k, (SELECT count(*) FROM places) AS n FROM places), q AS (SELECT k, (k * 7) % n + 1 AS compared_id, CASE WHEN k % 10 = 0 THEN (k * 7) % n + 1 ELSE k END AS candidate_id, k % 97 / 97 AS score FROM c WHERE k % 3 = 0 AND k % 5 <> 0 AND k % 11 <> 0)
SELECT k AS decision_id, candidate_id, compared_id, a.name AS candidate_name, b.name AS compared_name, CAST(round({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS BIGINT) AS distance_m
FROM q JOIN places a ON a.place_id = candidate_id JOIN places b ON b.place_id = compared_id WHERE candidate_id <> compared_id ORDER BY score DESC, k LIMIT 60"""


def r07(s, d):
    """Novelty of every place for five trips, from what happened to places of its domain there."""
    e = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    p = places(s, d).select("place_id", "type", "type_domain")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in (("view", "ignored"), ("click", "accepted"), ("purchase", "visited"), ("signup", "saved"), ("error", "other")) for x in kv]), F.col("event_type"))
    h = e.select((F.col("user_id") % 5).alias("trip_id"), (F.col("event_id") % 200 + 1).alias("place_id"), kind.alias("event"), (F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")) - 20).cast("double").alias("age_days")).join(p, "place_id")
    c = p.crossJoin(F.broadcast(s.range(5).select(F.col("id").alias("trip_id"))))  # five rows
    return rank.with_novelty(c, h).select("trip_id", "place_id", F.round("novelty", 3).alias("novelty"))


_R07 = f"""WITH {PLACES}, h AS (SELECT user_id % 5 AS trip_id, type, type_domain, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.7 WHEN 'signup' THEN 0.3 ELSE 0.0 END * pow(2, -greatest(0, datediff('day', CAST(ts AS DATE), DATE '2024-02-01') - 20) / 4.0) AS w
  FROM events JOIN places ON place_id = event_id % 200 + 1 WHERE user_id IS NOT NULL AND ts IS NOT NULL),
a AS (SELECT trip_id, type_domain, sum(w) AS w FROM h GROUP BY ALL), t AS (SELECT trip_id, type_domain, type, sum(w) AS w FROM h GROUP BY ALL)
SELECT r.trip_id, place_id, round(round(pow(0.6, coalesce(t.w, 0)) * pow(0.9, greatest(coalesce(a.w, 0) - coalesce(t.w, 0), 0)), 4), 3) AS novelty
FROM places CROSS JOIN range(5) r(trip_id) LEFT JOIN a USING (trip_id, type_domain) LEFT JOIN t USING (trip_id, type_domain, type)"""


def q01_roles(s, d):
    users, roles = table(s, d, "customer"), table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lists.dashboard(users, roles, "c_custkey", F.col("c_acctbal") > 5000)


def q02_related(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    page = lists.page_with(table(s, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 20, 40, o, "c_custkey", "o_custkey", [F.col("o_orderkey")])
    return page.select("c_custkey", "total", F.array_join(F.transform("related", lambda r: F.concat_ws(":", r["o_orderkey"], r["o_orderpriority"])), ",").alias("orders"))


ENTRIES = [
    ("s09_harvest", s09, "SELECT CAST(p_partkey // 100 AS INT) AS page, p_partkey % 100 AS at, CAST(p_partkey AS VARCHAR) AS reference, p_name AS titre FROM part"),
    ("s10_harvest_total", s10, "SELECT CAST(s_suppkey // 30 AS INT) AS page, count(*) AS n, min(s_suppkey) AS first FROM supplier GROUP BY 1"),
    ("s13_observed", s13_observed, f"WITH {PLACES}, n AS (SELECT * FROM places WHERE size >= 20 AND place_id % 9 <> 0), k AS (SELECT * FROM places WHERE size <= 25 AND place_id % 9 <> 0) SELECT (SELECT count(*) FROM (SELECT place_id FROM n UNION SELECT place_id FROM k)) AS items, (SELECT count(*) FROM n) AS new, (SELECT count(*) FROM places) + (SELECT count(*) FROM places WHERE size >= 20) AS fetched, (SELECT count(*) FROM places WHERE size >= 20 AND place_id % 9 = 0) AS incomplete, (SELECT count(*) FROM places) AS refused, (SELECT count(*) FROM (SELECT place_id FROM n UNION SELECT place_id FROM k)) AS written"),
    ("s14_region_grids", s14, _S14),
    ("s16_export_all", s16, "SELECT c_custkey AS user_id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS items, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer"),
    ("s17_gold_file", s17_gold, _S17),
    ("s17_gold_traces", s17_traces, "SELECT c_custkey AS session_id, c_mktsegment AS mode, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS places FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"),
    ("m07_traces", m07_traces, "SELECT event_id, CASE WHEN old THEN -1.0 ELSE 59.0 END AS anchor, CASE WHEN old THEN -1.0 ELSE 1.5 END AS lat, CAST(event_id % 9 AS DOUBLE) AS place, CAST(event_id AS DOUBLE) AS k FROM (SELECT event_id, user_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-15' AS old FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"),
    ("m07_costs", m07_costs, "SELECT o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AS gone, count(*) AS n, round(sum(o_totalprice), 2) AS money FROM orders GROUP BY 1"),
    ("m07_account", m07_account, "WITH g AS (SELECT c_custkey AS u FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'customer' AS name, count(*) AS n, count(*) AS owned FROM customer WHERE c_custkey NOT IN (SELECT u FROM g) UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_custkey NOT IN (SELECT u FROM g)) FROM orders UNION ALL SELECT 'events', count(*), count(user_id) FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT u FROM g)"),
    ("f30_json", f30, "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN props IS NULL THEN -1 ELSE event_id END AS n, -1::BIGINT AS gone, CASE WHEN props IS NULL THEN -1 ELSE event_id END AS kept, coalesce(CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' END, '-') AS kind, coalesce(lower(json_type(props)), '-') AS whole FROM events"),
    ("f30_listed", f30_listed, """SELECT o_custkey, '[' || string_agg('{"id":' || o_orderkey || '}', ',' ORDER BY o_orderkey DESC) || ']' AS doc FROM orders GROUP BY 1"""),
    ("j04_composite_queue", j04_queue, _J04),
    ("r07_decayed_novelty", r07, _R07),
    ("q01_roles", q01_roles, "SELECT count(*) AS users, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS with_role, count(*) FILTER (c_acctbal > 5000) AS recent FROM customer"),
    ("q02_related", q02_related, "SELECT c_custkey, (SELECT count(*) FROM customer) AS total, coalesce((SELECT string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40)"),
]
