"""Shared inputs of the registered queries, in Spark and in DuckDB SQL: cost facts, position fixes, places, toggles.

The driver's tables carry no places or coordinates, so both sides derive them by the same integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, d: str, region: bool = False) -> DataFrame:
    """Cost facts: lineitems of orders; line 7 is the system's own spend, without a user. Customers and nations are joined where the region is read."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if region:
        j = j.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    system, cached = F.col("l_linenumber") == 7, F.col("l_discount") > 0.08
    would = F.round(F.col("l_extendedprice") * 1_000_000).cast("long")
    return j.select(
        F.to_date("l_shipdate").alias("day"), F.when(~system, F.col("o_custkey")).alias("user_id"), F.when(system, "system").otherwise("user").alias("actor"), F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("vendor"), F.col("o_orderpriority").alias("resource"), *([F.col("n_name").alias("region_key")] if region else []), F.when(cached, F.lit(0)).otherwise(would).cast("long").alias("billed"), would.alias("would"),
        cached.alias("cached"), F.col("l_linenumber").cast("long").alias("calls"), F.col("l_quantity").cast("long").alias("cpu_ms"), F.col("o_orderkey").alias("session_id"), "o_orderdate",
    )


FACTS = """facts AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber <> 7 THEN o_custkey END AS user_id, CASE WHEN l_linenumber = 7 THEN 'system' ELSE 'user' END AS actor,
    l_returnflag AS category, l_linestatus AS vendor, o_orderpriority AS resource, n_name AS region_key,
    CASE WHEN l_discount > 0.08 THEN 0 ELSE CAST(round(l_extendedprice * 1000000) AS BIGINT) END AS billed, CAST(round(l_extendedprice * 1000000) AS BIGINT) AS would,
    l_discount > 0.08 AS cached, CAST(l_linenumber AS BIGINT) AS calls, CAST(l_quantity AS BIGINT) AS cpu_ms, o_orderkey AS session_id, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """Position fixes: nights at a user's home, days at a place that changes every four days."""
    e = table(spark, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    home = (F.hour("ts") < 9) | (F.hour("ts") >= 18)
    step = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")), F.lit(4))
    lat = F.when(home, F.col("user_id") * 7919 % 2100).otherwise((F.col("user_id") * 7919 + step * 5171) % 2100)
    lng = F.when(home, F.col("user_id") * 104729 % 4400).otherwise((F.col("user_id") * 104729 + step * 9173) % 4400)
    return e.select("event_id", "ts", "user_id", "event_type", "value", (59.22 + lat / 10000.0).alias("lat"), (17.76 + lng / 10000.0).alias("lng"))


FIXES = """fixes AS (
  SELECT event_id, ts, user_id, event_type, value,
    59.22 + (CASE WHEN hour(ts) < 9 OR hour(ts) >= 18 THEN user_id * 7919 % 2100 ELSE (user_id * 7919 + (datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 4) * 5171) % 2100 END) / 10000.0 AS lat,
    17.76 + (CASE WHEN hour(ts) < 9 OR hour(ts) >= 18 THEN user_id * 104729 % 4400 ELSE (user_id * 104729 + (datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 4) * 9173) % 4400 END) / 10000.0 AS lng
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def hav(a: str, b: str, c: str, d: str, radius: float = 6_371_008.8) -> str:
    return f"(2 * {radius} * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def places(spark: SparkSession, d: str) -> DataFrame:
    """Places: parts with derived coordinates, type, domain and facets."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    facets = F.array(F.concat(F.lit("f"), k % 7), F.concat(F.lit("f"), k % 5), F.concat(F.lit("f"), F.col("p_size") % 3))
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (k % len(DOMAINS) + 1).cast("int"))
    return p.select(
        k.alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), domain.alias("type_domain"), (59.22 + k * 7919 % 2100 / 10000.0).alias("lat"), (17.76 + k * 104729 % 4400 / 10000.0).alias("lng"),
        facets.alias("facets"), F.col("p_brand").alias("source"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


DOMAINS = ("historic_heritage", "museum_gallery", "nature_landscape", "food_drink", "practical")
PLACES = """places AS (
  SELECT p_partkey AS place_id, p_name AS name, p_type AS type, ['historic_heritage', 'museum_gallery', 'nature_landscape', 'food_drink', 'practical'][p_partkey % 5 + 1] AS type_domain,
    59.22 + p_partkey * 7919 % 2100 / 10000.0 AS lat, 17.76 + p_partkey * 104729 % 4400 / 10000.0 AS lng,
    ['f' || p_partkey % 7, 'f' || p_partkey % 5, 'f' || p_size % 3] AS facets, p_brand AS source, p_size AS size, p_retailprice AS price FROM part)"""


def cell_sql(lat: str, lng: str, spacing: float = 875.0, name: str = "c") -> str:
    """SELECT list of {name}q, {name}r from columns q0, r0 that a subquery of axial_sql makes."""
    rq, rr, rs = "round(q0)", "round(r0)", "round(-q0 - r0)"
    dq, dr, ds = f"abs({rq} - q0)", f"abs({rr} - r0)", f"abs({rs} + q0 + r0)"
    return (
        f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rr} - {rs} ELSE {rq} END AS BIGINT) AS {name}q, "
        f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN {rr} WHEN {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END AS BIGINT) AS {name}r"
    )


def axial_sql(lat: str, lng: str, spacing: float = 875.0) -> str:
    x, y = f"({lng} * (111194.93 * cos(radians(59.3))))", f"({lat} * 111194.93)"
    return f"{x} / {spacing} - {y} / ({spacing} * sqrt(3)) AS q0, {y} / ({spacing} * sqrt(3) / 2) AS r0"
