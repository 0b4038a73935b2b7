"""Relational building blocks: latest rows, as-of joins, top-n, upserts, de-duplicated unions, interleaving."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def top_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """W04."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, ties: str, max_age_s: int | None = None) -> DataFrame:
    """Left with the last value of right at or before its time, by one union and one window, never pairs.

    Equal times go to the largest of `ties`; beyond max_age_s, or without one, the value is null.
    """
    a = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[ties]).alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(ties).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_t", "_v")), ignorenulls=True).over(w))
    age = (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_last._t").cast("timestamp"))) / 1_000_000
    fresh = F.lit(True) if max_age_s is None else age <= max_age_s
    return both.where("_side = 1").select("_row.*", F.when(fresh, F.col("_last._v")).alias(value))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column], first_write_wins: bool = False) -> DataFrame:
    """One row per key; new rows replace old ones (or not), `order` settles repeated new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    side = F.col("_new").asc() if first_write_wins else F.col("_new").desc()
    return latest(both, key, [side, *order]).drop("_new")


def fill_if_null(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Old rows with their unknown columns taken from new, and the rows of keys that old lacks."""
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = old.join(n, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def archive_expired(rows: DataFrame, archived: DataFrame, expired: Column, archivable: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to append to the archive); what the archive has already is not appended again."""
    gone = rows.where(F.coalesce(expired, F.lit(False)))
    return rows.where(~F.coalesce(expired, F.lit(False))), gone.where(archivable).join(archived.select(*key), key, "left_anti")


def coarsen(rows: DataFrame, expired: Column, cell: Column, lat: str = "lat", lng: str = "lng", cell_col: str = "cell") -> DataFrame:
    """Expired rows lose their coordinates and keep the cell, taken from them where it was unknown."""
    old = F.coalesce(expired, F.lit(False))
    return rows.withColumns({cell_col: F.when(old, F.coalesce(F.col(cell_col), cell)).otherwise(F.col(cell_col)), lat: F.when(~old, F.col(lat)), lng: F.when(~old, F.col(lng))})


def erase(rows: DataFrame, who: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns set to null in the rows of `who`; all else, money above all, stays."""
    mark = who.select(*key).distinct().withColumn("_gone", F.lit(True))
    out = rows.join(mark, key, "left")
    return out.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def redirected(df: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Ids of merged rows (merged_id, canonical_id) replaced, one step."""
    m = merges.select(F.col("merged_id").alias("_from"), F.col("canonical_id").alias("_to"))
    return df.join(m, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def percentile_of(value: str, by: list[str]) -> Column:
    """Share of other values below; null for a lone row and where all values are equal."""
    w = Window.partitionBy(*by)
    rank = F.percent_rank().over(w.orderBy(value))
    flat = F.min(value).over(w) == F.max(value).over(w)
    return F.when((F.count("*").over(w) >= 2) & ~flat, F.round(rank, 6))


def merged_candidates(df: DataFrame, key: str, columns: list[str], source: str, ordinal: str) -> DataFrame:
    """One row per key: for each column the first known value in the sources' order, and the list of sources."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(ordinal, F.col(c).alias("_v"))))["_v"].alias(c) for c in columns]
    names = F.transform(F.array_distinct(F.sort_array(F.collect_list(F.struct(ordinal, F.col(source).alias("_s"))))), lambda x: x["_s"])
    return df.groupBy(key).agg(*firsts, names.alias("sources"))


def interleaved(df: DataFrame, region: str, group: str, cell: str, order: list[str], limit: int, per_cell: int = 3) -> DataFrame:
    """Per region, groups take turns in the order of their best row; a cell gives per_cell rows at most."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        queues = [list(g.index) for _, g in pdf.groupby(group, sort=False)]
        used: dict[object, int] = {}
        out: list[object] = []
        while any(queues) and len(out) < limit:
            for q in queues:
                while q and len(out) < limit:
                    i = q.pop(0)
                    c = pdf.at[i, cell]
                    if used.get(c, 0) < per_cell:
                        used[c] = used.get(c, 0) + 1
                        out.append(i)
                        break
        return pdf.loc[out].assign(position=range(1, len(out) + 1))

    return df.groupBy(region).applyInPandas(take, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, position long")
