"""Circuit breaker, latches and quotas as step functions over a key's events, and their batch folds.

Each step takes a state (None at first) and the time of an event in seconds, with its kind where that counts, and gives the
next state and a decision. The stream forms (streaming.state) run the same steps with timers that clear what has expired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failures in a row, each within the window after the one before, that open a breaker, and for how long; requests a day (fixed values).
FAILURES, FAILURE_WINDOW_S, OPEN_S, DAY_S, REQUESTS_A_DAY = 5, 120, 120, 86_400, 3


def breaker(state: tuple | None, at: float, ok: bool) -> tuple[tuple, str]:
    """A call of a source: called, failed, opened (the failure that opens it) or skipped while open.

    The state is the failures in a row, when they are forgotten, and until when the breaker is open.
    """
    failures, forget, until = state or (0, 0.0, 0.0)
    if at < until:
        return (failures, forget, until), "skipped"
    if ok:
        return (0, 0.0, until), "called"
    failures = (failures if at < forget else 0) + 1
    if failures >= FAILURES:
        return (0, 0.0, at + OPEN_S), "opened"
    return (failures, at + FAILURE_WINDOW_S, until), "failed"


def latch(state: tuple | None, at: float, ttl_s: float) -> tuple[tuple, bool]:
    """Whether an event fires: the first, and then the first after ttl_s since the last that fired."""
    if state is not None and at < state[0] + ttl_s:
        return state, False
    return (at,), True


def quota(state: tuple | None, at: float, most: int = REQUESTS_A_DAY, window_s: float = DAY_S) -> tuple[tuple, bool]:
    """Whether a request is granted: fewer than `most` were granted within window_s before; the state are their times."""
    recent = tuple(t for t in state or () if t >= at - window_s)
    return ((*recent, at), True) if len(recent) < most else (recent, False)


def decided(events: DataFrame, by: list[str], order: tuple[str, ...], reads: tuple[str, ...], step: Callable, kind: str, name: str = "decision") -> DataFrame:
    """events with step's decision on each, the rows of a key being read in order as a stream with a state of constant size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            keys = list(zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in by], strict=True))
            out = []
            for own, row in zip(keys, pdf[list(reads)].itertuples(index=False, name=None), strict=True):
                if own != key:
                    key, state = own, None
                state, said = step(state, *row)
                out.append(said)
            yield pdf.assign(**{name: out})

    fields = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return events.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{fields}, `{name}` {kind}")


def failures_within(events: DataFrame, key: str, at: str, failed: Column, window_s: int = FAILURE_WINDOW_S) -> DataFrame:
    """events with recent_failures: those of the key in the window_s up to each event, both ends included, by a range frame."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-window_s, Window.currentRow)
    return events.withColumn("recent_failures", F.count_if(failed).over(w))
