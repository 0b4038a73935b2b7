"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets: `share` times all words is split over the sources by weight; a target stops at `most` times its source's words
and the excess is shared again by weight. A source's weight moves through the training: its schedule
1 + slope * (2t - 1), t in [0, 1], integrates to W(t) = t + slope * (t*t - t), so it has given target * W(t) words by t.
Documents of a source lie on its word line in the order of a hash, pass after pass; the copy whose middle is at offset c
is trained where target * W(t) = c, and the position is the sum of what all sources have given by then.

Prefix sums are taken in two steps, over hash buckets of a source and within a bucket, so a hot source is spread over
BUCKETS tasks. A pass ends between whole documents, at the one whose middle lies nearest; then the one document whose
change brings the source nearest to its target is taken once more or once less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights and schedule slopes, repeating over the sources in code point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)
BUCKETS = 4096
#: Sources (under 200 bytes each) whose targets may be sent to every executor.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """(source, source_size, weight, slope, target) of sizes(source, size); one row per source."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(F.col("_rank") - 1, F.lit(len(values))) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # over one row per source
    by = by.withColumn("_rank", F.row_number().over(ordered)).select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope"))
    by = by.withColumn("_cap", most * F.col("source_size")).withColumn("_full_at", F.col("_cap") / F.col("weight"))
    filled = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("_level", level)
    by = by.withColumn("_final", F.min(F.when(F.col("_full_at") > F.col("_level"), F.struct("_full_at", "_level"))).over(everything)["_level"])
    return by.select("source", "source_size", "weight", "slope", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("weight")), F.col("_cap")).alias("target"))


def _when_given(u: Column, slope: Column) -> Column:
    """t with W(t) = u."""
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * u, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, u).otherwise((root - b) / (2 * slope))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: float = 2.0, **how) -> DataFrame:
    """For each row of docs: (id, key, tie, source, size, source_size, target, copies, taken, positions).

    key is a hash of id and text, tie of the text; copies is how often the mix takes the document, taken = copies * size; positions are
    those of the copies in words of training, ascending. A null text has size 0 and is not taken, a null source is a
    source. Reruns agree; of repeated rows, equal in id, source and text, any may be the one that is taken once more.
    An empty table gives none; other columns are ignored.
    """
    own = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.xxhash64(text_col).alias("tie"),
    )
    sizes = written(own.withColumn("hash", F.xxhash64(F.lit("mix"), "key")).withColumn("bucket", F.pmod(F.shiftright("hash", 40), F.lit(BUCKETS)).cast("int")), "sizes")
    targets = written(source_targets(sizes, most=most, **how), "targets")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    total = targets.agg(F.sum("target").alias("_a"), F.sum(F.col("target") * F.col("slope")).alias("_b"))
    targets = targets.crossJoin(F.broadcast(total)).withColumnRenamed("source", "_source")  # one row

    bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select(F.col("source").alias("_of"), F.col("bucket").alias("_in"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size")
    df = sizes.withColumn("_own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).withColumn("row", F.row_number().over(inside))
    df = df.join(bucket, F.col("source").eqNullSafe(F.col("_of")) & (F.col("bucket") == F.col("_in")))
    df = df.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source")))
    df = df.withColumn("offset", F.col("_own") + F.col("_before")).withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    df = df.withColumn("copies", F.col("passes") + ((F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 <= rest)).cast("int"))
    df = df.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).drop("_own", "_before", "_of", "_in", "_source")
    df = written(df, "dealt")

    off = df.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short")).withColumnRenamed("source", "_source")
    step = F.when(F.col("copies") > F.col("passes"), -F.col("size")).when(F.col("copies") + 1 <= most, F.col("size"))
    change = df.where("size > 0").withColumn("step", step).where("step IS NOT NULL")
    change = change.join(F.broadcast(off) if small else off, F.col("source").eqNullSafe(F.col("_source"))).withColumn("left", F.abs(F.col("short") - F.col("step")))
    change = change.where(F.col("left") < F.abs("short")).groupBy("source").agg(F.min(F.struct("left", "bucket", "row", "step")).alias("x"))
    change = change.select(F.col("source").alias("_source"), F.col("x.bucket").alias("_bucket"), F.col("x.row").alias("_row"), F.signum("x.step").cast("int").alias("_more"))
    df = df.join(F.broadcast(change) if small else change, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")) & (F.col("row") == F.col("_row")), "left")
    df = df.withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0)))

    def position(j: Column) -> Column:
        u = F.least((F.col("offset") + F.col("size") / 2 + j * F.col("source_size")) / F.col("target"), F.lit(1.0))
        t = _when_given(u, F.col("slope"))
        return F.col("_a") * t + F.col("_b") * (t * t - t)

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.expr("cast(array() as array<double>)"))
    return df.select("id", "key", "tie", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The copies that the mix takes, with the columns of docs, range-sorted by their positions.

    Of rows equal in id, source and text one carries the copies of all.
    """
    mix = mixture(docs, id_col, source_col, text_col, **how).where("copies > 0")
    mix = written(mix.select(F.col("id").alias("__wm_id"), F.col("tie").alias("__wm_of"), F.col("source").alias("__wm_source"), F.explode("positions").alias("__wm_position")), "taken")
    names = ("__wm_id", "__wm_of", "__wm_source")
    keyed = docs.withColumn("__wm_tie", F.xxhash64(text_col))
    own = (F.col(f"`{id_col}`"), F.col("__wm_tie"), F.col(f"`{source_col}`"))

    def on(right: DataFrame):
        return own[0].eqNullSafe(right[names[0]]) & own[1].eqNullSafe(right[names[1]]) & own[2].eqNullSafe(right[names[2]])

    rows = keyed.groupBy(*own).agg(F.count("*").alias("__wm_rows")).where("__wm_rows > 1").toDF(*names, "__wm_rows")
    again = written(rows, "again")
    if again.isEmpty():
        copies = keyed.join(mix, on(mix))
    else:  # one of the equal rows, as a table, so that the planner can split the copies of one that is repeated very often
        lone = keyed.join(again, on(again), "left_anti")
        one = written(keyed.join(again, on(again), "left_semi").dropDuplicates([id_col, "__wm_tie", source_col]), "one")
        copies = lone.unionByName(one).join(mix, on(mix))
    ordered = copies.repartitionByRange("__wm_position", "__wm_tie").sortWithinPartitions("__wm_position", "__wm_tie")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def in_training_order(mix: DataFrame) -> DataFrame:
    """mixture's rows range-sorted by the first position, those that are not taken last."""
    first = F.get("positions", F.lit(0))
    return mix.repartitionByRange(first.asc_nulls_last(), "key").sortWithinPartitions(first.asc_nulls_last(), "key")
