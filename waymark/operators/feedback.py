"""Folds over feedback events: toggles, contradictions, learning, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets and rates of learning from an event (fixed values).
LEARNING = {"visited": (1.0, 0.30), "dismissed": (0.0, 0.25), "saved": (1.0, 0.15), "accepted": (1.0, 0.08), "ignored": (0.0, 0.02)}
UNDO, UNDOES = "undismissed", "dismissed"
CALIBRATION = {"chosen": (1.0, 0.20), "rejected": (0.0, 0.10)}


def last_of(event: str, on: str, off: str, order: tuple[str, ...] = ("ts", "event_id")) -> Column:
    """An aggregate: whether the last of two opposite events is `on`; null without either."""
    return F.max(F.when(F.col(event).isin(on, off), F.struct(*order, F.col(event).alias("_e"))))["_e"] == on


def toggle_states(events: DataFrame, key: list[str], pairs: dict[str, tuple[str, str]], event: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """For each key and each independent pair (on, off) its state after all events, late ones included."""
    return events.groupBy(*key).agg(*[F.coalesce(last_of(event, on, off, order), F.lit(False)).alias(name) for name, (on, off) in pairs.items()])


def contradictions(events: DataFrame, key: list[str], one: tuple[str, str], other: tuple[str, str], event: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Keys that are on in both pairs, with the event that undoes the older state."""
    last = lambda e: F.max(F.when(F.col(event) == e, F.struct(*order)))
    both = events.groupBy(*key).agg(last_of(event, *one, order).alias("_a"), last_of(event, *other, order).alias("_b"), last(one[0]).alias("_ta"), last(other[0]).alias("_tb"))
    return both.where("_a AND _b").select(*key, F.when(F.col("_ta") > F.col("_tb"), F.lit(other[1])).otherwise(F.lit(one[1])).alias("undo"))


def learned_weight(events: Column, start: float = 0.5) -> Column:
    """Fold of an ordered array of event names into a weight, rounded to 4 digits at each step.

    Events that teach nothing change nothing; an undo divides what a dismissal took away, to 1 at most, and is void before
    anything was learned.
    """

    def step(a: Column, e: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, (target, rate) in LEARNING.items():
            was = F.coalesce(a, F.lit(start))
            out = F.when(e == name, F.round(was + rate * (target - was), 4)).otherwise(out)
        undone = F.when(a.isNotNull(), F.round(F.least(F.lit(1.0), a / (1 - LEARNING[UNDOES][1])), 4))
        return F.when(e == UNDO, undone).otherwise(F.coalesce(out, a))

    return F.aggregate(events, F.lit(None).cast("double"), step)


def taste_profiles(events: DataFrame, user: str = "user_id", facet: str = "facet", event: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(user, facet, weight) from events that name a facet; a user's events of one facet are folded in order."""
    lists = events.groupBy(user, facet).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("_e")))), lambda x: x["_e"]).alias("_all"))
    return lists.select(user, facet, learned_weight(F.col("_all")).alias("weight")).where("weight IS NOT NULL")


def ignored_at_close(served: DataFrame, feedback: DataFrame, session_ends: DataFrame) -> DataFrame:
    """An `ignored` event at its session's end for every recommendation without feedback."""
    return served.join(feedback.select("rec_id").distinct(), "rec_id", "left_anti").join(session_ends, "session_id").select("rec_id", F.lit("ignored").alias("event"), F.col("ended_at").alias("occurred_at"))
