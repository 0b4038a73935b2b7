"""Queries of the cost ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost
from ..scratch import written
from .base import FACTS, facts, table

_DIMS = ["actor", "category", "vendor", "resource", "region_key", "user_id"]
_SUMS = "CAST(sum(billed) AS BIGINT) AS micros, CAST(sum(would - billed) AS BIGINT) AS saved, CAST(sum(calls) AS BIGINT) AS calls"


def _prices(spark):
    return spark.createDataFrame([("O", "R", 150_000, 600_000, 15_000, 1200), ("F", "A", 75_000, 300_000, 7_500, 700), ("F", "R", 40_000, 90_000, 3_000, 0)], "vendor string, model string, input long, output long, cached_input long, per_call long")


def m08_price_entries(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("vendor"), F.col("l_returnflag").alias("model"), F.round(F.col("l_extendedprice") * 10).cast("long").alias("input_tokens"),
        (F.col("l_quantity") * 37).cast("long").alias("output_tokens"), F.lit(1234).cast("long").alias("cached_input_tokens"), F.lit(1).cast("long").alias("calls"), (F.col("l_discount") > 0.08).alias("cached"),
    )
    return cost.priced(li, _prices(spark)).groupBy("vendor", "model").agg(F.sum("would").alias("would"), F.sum("billed").alias("billed"), F.count("*").alias("n"))


_M08 = """WITH price(vendor, model, i, o, c, p) AS (VALUES ('O', 'R', 150000, 600000, 15000, 1200), ('F', 'A', 75000, 300000, 7500, 700), ('F', 'R', 40000, 90000, 3000, 0)),
e AS (SELECT l_linestatus AS vendor, l_returnflag AS model, CAST(round(l_extendedprice * 10) AS BIGINT) AS t1, CAST(l_quantity * 37 AS BIGINT) AS t2, l_discount > 0.08 AS cached FROM lineitem),
x AS (SELECT vendor, model, cached, CAST(t1 * coalesce(i, 0) // 1000000 + t2 * coalesce(o, 0) // 1000000 + 1234 * coalesce(c, 0) // 1000000 + coalesce(p, 0) AS BIGINT) AS would FROM e LEFT JOIN price USING (vendor, model))
SELECT vendor, model, CAST(sum(would) AS BIGINT) AS would, CAST(sum(CASE WHEN cached THEN 0 ELSE would END) AS BIGINT) AS billed, count(*) AS n FROM x GROUP BY ALL"""


def a03_rollup(spark, d):
    # the rollup reads the facts six times: they are joined and written once, or every reading shuffles all of lineitem again
    f = facts(spark, d, True).select("day", "user_id", "actor", "category", "vendor", "resource", "region_key", "billed", "would", "calls", "cpu_ms")
    return cost.rollup(written(f, "facts")).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("billed", "saved", "amortized", "capex_share")])


_AMORT = """own AS (SELECT * FROM facts WHERE actor = 'user' AND user_id IS NOT NULL),
pool AS (SELECT day, vendor, resource, sum(billed) AS spend, sum(would) AS total FROM own GROUP BY ALL),
used AS (SELECT day, vendor, resource, user_id, sum(would) AS consumed FROM own GROUP BY ALL HAVING sum(would) > 0),
share AS (SELECT day, user_id, vendor, CAST(CAST(spend AS HUGEINT) * CAST(consumed AS HUGEINT) // CAST(total AS HUGEINT) AS BIGINT) AS share FROM used JOIN pool USING (day, vendor, resource))"""
_CAPEX = """spend AS (SELECT day, region_key, CAST(sum(billed) AS BIGINT) AS spend FROM facts WHERE actor = 'system' AND user_id IS NULL GROUP BY ALL),
active AS (SELECT DISTINCT day, region_key, user_id FROM facts WHERE actor = 'user' AND user_id IS NOT NULL),
capex AS (SELECT day, region_key, user_id, spend // count(*) OVER (PARTITION BY day, region_key) AS capex_share FROM active JOIN spend USING (day, region_key))"""


def a04_denominators(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 300).cast("int"))).alias("ended_at"), (F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(90))).alias("expires_at"))
    return cost.denominators(s)


def a09_unit_cost(spark, d):
    return cost.unit_costs(facts(spark, d), F.col("cpu_ms"), F.when(F.col("category") == "N", F.col("calls")).otherwise(0))


def a10_month_projection(spark, d):
    return cost.month_projection(facts(spark, d), F.lit("1998-02-13").cast("date"))


def a15_rates(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count("*").alias("n"))
    from ..functions.num import rate

    return e.select("event_type", "high", "n", rate(F.col("high"), F.col("n")).alias("rate"))


def x09_budget_crossings(spark, d):
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("event_id", "user_id", "ts", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"))
    return cost.crossings(e, ["ts", "event_id"], "cents", "user_id", [50_000, 100_000, 200_000]).select("event_id", "user_id", "crossed")


def _plain(df):
    """Days as text and -1 for no user, which compare alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c == "day"} | {c: F.coalesce(c, F.lit(-1)) for c in df.columns if c == "user_id"})


ENTRIES = [
    ("a01_daily_buckets", lambda s, d: _plain(cost.daily_buckets(facts(s, d))), f"WITH {FACTS} SELECT CAST(day AS VARCHAR) AS day, coalesce(user_id, -1) AS user_id, actor, category, vendor, CAST(sum(billed) AS BIGINT) AS billed, CAST(sum(would - billed) AS BIGINT) AS saved, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms FROM facts GROUP BY ALL"),
    ("a02_amortise", lambda s, d: _plain(cost.amortised(facts(s, d))), f"WITH {FACTS}, {_AMORT} SELECT CAST(day AS VARCHAR) AS day, user_id, vendor, CAST(sum(share) AS BIGINT) AS amortized FROM share GROUP BY ALL"),
    ("a03_capex", lambda s, d: _plain(cost.capex_shares(facts(s, d, True))), f"WITH {FACTS}, {_CAPEX} SELECT CAST(day AS VARCHAR) AS day, region_key, user_id, CAST(capex_share AS BIGINT) AS capex_share FROM capex"),
    ("a03_rollup_by_user", lambda s, d: _plain(a03_rollup(s, d)), f"""WITH {FACTS}, {_AMORT}, {_CAPEX},
b AS (SELECT user_id, sum(billed) AS billed, sum(would - billed) AS saved, sum(CASE WHEN actor = 'user' THEN 0 ELSE billed END) AS amortized, 0 AS capex_share FROM facts GROUP BY ALL
  UNION ALL SELECT user_id, 0, 0, sum(share), 0 FROM share GROUP BY ALL UNION ALL SELECT user_id, 0, 0, 0, sum(capex_share) FROM capex GROUP BY ALL)
SELECT coalesce(user_id, -1) AS user_id, CAST(sum(billed) AS BIGINT) AS billed, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(amortized) AS BIGINT) AS amortized, CAST(sum(capex_share) AS BIGINT) AS capex_share FROM b GROUP BY ALL"""),
    ("a04_denominators", lambda s, d: _plain(a04_denominators(s, d)), """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_custkey AS user_id, CAST(round(sum(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 300 ELSE 90 END)) AS INT) AS minutes FROM orders GROUP BY ALL"""),
    ("a05_totals", lambda s, d: cost.totals(facts(s, d)), f"WITH {FACTS} SELECT CAST(coalesce(sum(billed), 0) AS BIGINT) AS billed, CAST(coalesce(sum(would), 0) AS BIGINT) AS would, count(*) AS entries, count(*) FILTER (cached) AS hits, round(100.0 * count(*) FILTER (cached) / count(*), 1) AS hit_percent FROM facts"),
    ("a06_breakdown_sets", lambda s, d: cost.breakdowns(facts(s, d, True), _DIMS), f"""WITH {FACTS}, u AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS dim, CAST({x} AS VARCHAR) AS key, {_SUMS} FROM facts GROUP BY 2" for x in _DIMS) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY micros DESC, key) AS n FROM u WHERE key IS NOT NULL)
SELECT dim, key, micros, saved, calls, round(micros / (SELECT sum(billed) FROM facts), 4) AS share FROM r WHERE n <= 20"""),
    ("a07_top_users", lambda s, d: cost.top_users(facts(s, d)), f"WITH {FACTS} SELECT user_id, CAST(sum(billed) AS BIGINT) AS micros, CAST(sum(calls) AS BIGINT) AS calls FROM facts WHERE actor = 'user' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    ("a08_daily", lambda s, d: _plain(cost.daily_series(facts(s, d))), f"WITH {FACTS} SELECT CAST(day AS VARCHAR) AS day, CAST(sum(billed) AS BIGINT) AS micros, CAST(sum(would - billed) AS BIGINT) AS saved FROM facts GROUP BY 1"),
    ("a09_unit_cost", a09_unit_cost, f"WITH {FACTS}, s AS (SELECT CAST(sum(billed) AS BIGINT) AS micros, sum(cpu_ms) AS m, sum(CASE WHEN category = 'N' THEN calls ELSE 0 END) AS n FROM facts) SELECT micros, round(micros / (m / 60.0), 2) AS per_hour, round(micros / n, 2) AS per_served FROM s"),
    ("a10_month_projection", a10_month_projection, f"WITH {FACTS} SELECT CAST(coalesce(sum(billed), 0) AS BIGINT) AS to_date, CAST(coalesce(sum(billed), 0) * 28 // 13 AS BIGINT) AS projected FROM facts WHERE day BETWEEN DATE '1998-02-01' AND DATE '1998-02-13'"),
    ("a11_session_spend", lambda s, d: _plain(cost.session_spend(facts(s, d), "user_id")), f"WITH {FACTS} SELECT coalesce(user_id, -1) AS user_id, CAST(sum(billed) AS BIGINT) AS billed, CAST(sum(billed + would) AS BIGINT) AS uncached, count(*) AS entries FROM facts GROUP BY 1"),
    ("a15_rates", a15_rates, "SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 3) AS rate FROM events GROUP BY 1"),
    ("m08_price_entries", m08_price_entries, _M08),
    ("q12_free_tier", lambda s, d: facts(s, d).where("NOT cached AND resource IN ('1-URGENT', '2-HIGH') AND day BETWEEN '1998-02-01' AND '1998-02-28'").groupBy("resource").agg(F.sum("calls").alias("calls")), f"WITH {FACTS} SELECT resource, CAST(sum(calls) AS BIGINT) AS calls FROM facts WHERE NOT cached AND resource IN ('1-URGENT', '2-HIGH') AND day BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY 1"),
    ("x09_budget_crossings", x09_budget_crossings, """WITH e AS (SELECT event_id, user_id, ts, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents FROM events WHERE user_id IS NOT NULL),
r AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT event_id, user_id, crossed FROM r, (VALUES (50000), (100000), (200000)) l(crossed) WHERE s - cents < crossed AND s >= crossed"""),
]
