"""Retention, erasure and export of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEIDENTIFY_DAYS = 90


def json_without(x: Column, *keys: str) -> Column:
    """a JSON object without some keys; other JSON is left as it is. Keys come in order."""
    v = F.parse_json(x)
    fields = F.map_filter(v.cast("map<string,variant>"), lambda k, _: ~k.isin(*keys))
    return F.when(json_kind(x) == "object", F.to_json(F.to_variant_object(fields))).otherwise(x)


def json_set(x: Column, key: str, value: Column) -> Column:
    """a JSON object with a key set to the JSON text `value`, which is added where it is missing; null is set as JSON null."""
    kept = F.map_filter(F.parse_json(x).cast("map<string,variant>"), lambda k, _: k != key)
    own = F.create_map(F.lit(key), F.parse_json(F.coalesce(value, F.lit("null"))))
    return F.when(json_kind(x) == "object", F.to_json(F.to_variant_object(F.map_concat(kept, own)))).otherwise(x)


def json_kind(x: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; null for what is none."""
    kind = F.schema_of_variant(F.try_parse_json(x))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def listed(order: list[Column], *fields: Column | str) -> Column:
    """an aggregate: the rows of a group as an array of structs in some order."""
    keys = [c.alias(f"_{k}") for k, c in enumerate(order)]
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, F.struct(*fields).alias("_row")))), lambda x: x["_row"])


def coarsened_traces(traces: DataFrame, users: DataFrame, cutoff: Column, inputs: str = "score_inputs") -> DataFrame:
    """traces(user_id, served_at, anchor_lat, anchor_lng, score_inputs) of users(user_id, research_consent): of those that do not
    consent, what was served before the cutoff loses its anchor and the coordinates in its candidate, which keeps all else.
    Traces of unknown users are left alone."""
    asked = users.groupBy("user_id").agg(F.max("research_consent").alias("_ok"))
    df = traces.join(asked, "user_id", "left").withColumn("_old", F.coalesce(~F.col("_ok") & (F.col("served_at") < cutoff), F.lit(False)))
    candidate = F.get_json_object(inputs, "$.candidate")
    plain = F.when(candidate.isNotNull(), json_set(F.col(inputs), "candidate", json_without(candidate, "lat", "lng"))).otherwise(F.col(inputs))
    out = {"anchor_lat": F.when(~F.col("_old"), F.col("anchor_lat")), "anchor_lng": F.when(~F.col("_old"), F.col("anchor_lng")), inputs: F.when(F.col("_old"), plain).otherwise(F.col(inputs))}
    return df.withColumns(out).select(*traces.columns)


def deidentified(costs: DataFrame, now: Column, at: str, columns: list[str], days: int = DEIDENTIFY_DAYS, who: Column | None = None) -> DataFrame:
    """Cost rows older than `days`, or those of `who`, lose the columns that point to a person; money stays."""
    gone = F.coalesce(F.col(at) < now - F.make_dt_interval(days=F.lit(days)) if who is None else who, F.lit(False))
    return costs.withColumns({c: F.when(~gone, F.col(c)) for c in columns})


def account_deleted(tables: dict[str, DataFrame], who: DataFrame, owned: dict[str, str], kept: dict[str, tuple[str, list[str]]]) -> dict[str, DataFrame]:
    """What is left of each table when the users of who(user_id) go: rows of the owned tables (name to the column of the
    user) are deleted, rows of the kept ones (name to that column and those to clear) stay without what points to the user."""
    ids = who.select(F.col("user_id").alias("_gone")).distinct()
    out = dict(tables)
    for name, column in owned.items():
        out[name] = tables[name].join(ids, F.col(column) == F.col("_gone"), "left_anti")
    for name, (column, clear) in kept.items():
        marked = tables[name].join(ids, F.col(column) == F.col("_gone"), "left")
        out[name] = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in clear else F.col(c) for c in tables[name].columns])
    return out


def exported(users: DataFrame, tables: dict[str, tuple[DataFrame, str, list[Column]]], key: str = "user_id") -> DataFrame:
    """(key, document): for each user one JSON document of its account and of its rows in every personal table.

    tables: name to (rows, their column of the user, their order). Each table is grouped by user once; a document holds what
    one user has. A user without rows has empty lists.
    """
    out = users.select(key, F.struct(*users.columns).alias("account"))
    for name, (rows, column, order) in tables.items():
        own = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_u")).agg(listed(order, *rows.columns).alias(name))
        out = out.join(own, F.col(key) == F.col("_u"), "left").drop("_u").withColumn(name, F.coalesce(name, F.array()))
    return out.select(key, F.to_json(F.struct("account", *tables)).alias("document"))
