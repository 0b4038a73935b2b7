"""Connected components of an edge table by alternating star contraction, and joins whose key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


#: Keys over which the rows of one key are dealt, so no task gets all rows of a hub.
SALTS = 64


def dealt_join(df: DataFrame, key: str, by: str, labels: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with labels, which has each key once; the rows of a key are dealt out by a hash of the column `by`."""
    salted = df.withColumn("_salt", F.pmod(F.hash(by), F.lit(SALTS)))
    keys = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct().join(labels, key)
    return salted.join(keys, [key, "_salt"], how).drop("_salt")


def _with_low(e: DataFrame) -> DataFrame:
    """e(u, v) with m, the least v of each u."""
    return dealt_join(e.select("u", "v"), "u", "v", e.groupBy("u").agg(F.min("v").alias("m")))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges(u, v), root being the smallest node that it reaches.

    Large-star and small-star steps alternate until no edge changes. Each is a grouped minimum and a join with it, keyed
    by node and salt, and nodes only ever move to smaller ones. Null ends and loops are ignored; an empty table gives an
    empty one.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state, was = _digest(e), None
    while state[0] and state != was:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        large = written(large.distinct(), name)
        small = _with_low(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct(), name)
        was, state = state, _digest(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
