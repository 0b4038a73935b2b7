"""Results kept right while rows come late and out of order, by folding again what they touch.

Raw rows are appended to a store, partitioned by day; a result table is partitioned by the same day. Each micro-batch
overwrites, in both, the partitions of the days that it touches, and nothing else; so the result is that of a batch run over
all rows, whatever the order in which they came, and a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not written yet
        return spark.createDataFrame([], schema)


def _overwrite(df: DataFrame, path: str, day: str) -> None:
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def refolded(raw: str, result: str, key: list[str], version: str, day: str, fold: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merges a batch into the rows at `raw` and folds the touched days anew into `result`.

    Of rows of one (key, day) the one of the largest version stays, so repeated and corrected rows are harmless. A version that
    moves a row to another day must be written as a row of that day and a removal of the other. fold takes all rows of some whole
    days and gives rows with the day column. Both tables are read by day, so a batch costs what it touches.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.persist()
        days = own.select(day).distinct().persist()
        try:
            if days.isEmpty():
                return
            there = _read(spark, raw, batch.schema).join(F.broadcast(days), day, "left_semi") if days.count() <= 10_000 else _read(spark, raw, batch.schema).join(days, day, "left_semi")
            newest = Window.partitionBy(*key, day).orderBy(F.desc(version))
            merged = there.select(*own.columns).unionByName(own).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
            staged = f"{raw}-staged"
            merged.write.mode("overwrite").parquet(staged)  # what is read may not be overwritten at once
            merged = spark.read.schema(batch.schema).parquet(staged)
            _overwrite(merged, raw, day)
            _overwrite(fold(merged), result, day)
        finally:
            own.unpersist()
            days.unpersist()

    return run
