"""Stateful stream forms of folds (R16, X09) on transformWithStateInPandas: the steps are those of the batch operators.

Rows of one key in a micro-batch are taken in order; a row that comes in a later batch is taken as it comes, so a stream
equals the batch fold when each key's rows arrive in order. For rows that come late see streaming.refold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import guards
from ..operators.serves import SERVED, Session, acts_of, step

_PLACE = "place_id long"


class _Serves(StatefulProcessor):
    """State variables: the menu's numbers, its cards, the anchor and fix, the dismissed places, and the dry latch, which
    expires by itself."""

    def __init__(self, session: str) -> None:
        self.session = session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "live boolean, grp int, serves int, counted double, opened double, last double")
        self.cards = handle.getMapState("cards", "position int", _PLACE)
        self.points = handle.getMapState("points", "name string", "at double, lat double, lng double, accuracy double")  # origin, anchor, fix
        self.dismissed = handle.getMapState("dismissed", _PLACE, "at double")
        self.dry = handle.getValueState("dry", "until double")

    def _load(self) -> Session:
        s = Session()
        if self.numbers.exists():
            s.live, s.group, s.serves, s.counted, s.opened_at, s.last_at = self.numbers.get()
        s.cards = sorted((k[0], v[0]) for k, v in self.cards.iterator())
        for k, v in self.points.iterator():
            at, lat, lng, accuracy = v
            if k[0] == "fix":
                s.fix = (at, lat, lng, accuracy)
            else:
                setattr(s, k[0], (lat, lng))
        s.dismissed = {k[0] for k in self.dismissed.keys()}
        s.dry_until = self.dry.get()[0] if self.dry.exists() else None
        return s

    def _save(self, was: Session, s: Session) -> None:
        self.numbers.update((s.live, s.group, s.serves, s.counted, s.opened_at, s.last_at))
        if s.cards != was.cards:
            if s.group != was.group:
                self.cards.clear()
            for position, place in s.cards:
                self.cards.updateValue((position,), (place,))
        for name in ("origin", "anchor"):
            point = getattr(s, name)
            if point is not None and point != getattr(was, name):
                self.points.updateValue((name,), (0.0, *point, None))
        if s.fix is not None and s.fix != was.fix:
            self.points.updateValue(("fix",), s.fix)
        for place in s.dismissed - was.dismissed:
            self.dismissed.updateValue((place,), (0.0,))
        if s.dry_until != was.dry_until:
            self.dry.update((s.dry_until,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was, s = self._load(), self._load()
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [(key[0], seq, *card) for seq, act in zip(pdf["seq"], acts_of(pdf), strict=True) for card in step(s, *act)]
        self._save(was, s)
        yield pd.DataFrame(out, columns=[self.session, "seq", *SERVED])

    def close(self) -> None:
        pass


def served_stream(acts: DataFrame, session: str = "session_id") -> DataFrame:
    """R16 over a stream of acts (see serves.replayed): the same cards."""
    kinds = dict(acts.dtypes)
    own = acts.select(session, "at", "seq", "act", "lat", "lng", "accuracy", F.col("place_id").cast("long").alias("place_id"), F.col("ranked").cast("array<long>").alias("ranked"))
    return own.groupBy(session).transformWithStateInPandas(_Serves(session), f"{session} {kinds[session]}, seq {kinds['seq']}, at double, reason string, serve_group int, position int, place_id long", "Append", "None")


class _Breaker(StatefulProcessor):
    """A source's breaker; a timer on the watermark clears the state of a source when nothing in it can count any more."""

    def __init__(self, key: str, order: str) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures int, forget double, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        said = []
        for at, ok in zip(pdf["at"], pdf["ok"], strict=True):
            state, what = guards.breaker(state, float(at), bool(ok))
            said.append(what)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(1000 * max(state[1], state[2])), timerValues.getCurrentWatermarkInMs()) + 1)
        yield pdf.assign(decision=said)[[self.key, self.order, "at", "ok", "decision"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def guarded_stream(calls: DataFrame, key: str = "source", order: str = "seq", watermark: str = "1 hour") -> DataFrame:
    """X09 over a stream of calls(key, order, at seconds, ok): each with the breaker's decision (guards.breaker). Calls that come
    later than the watermark are dropped."""
    kinds = dict(calls.dtypes)
    own = calls.select(key, order, F.col("at").cast("double").alias("at"), "ok", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", watermark)
    return own.groupBy(key).transformWithStateInPandas(_Breaker(key, order), f"{key} {kinds[key]}, {order} {kinds[order]}, at double, ok boolean, decision string", "Append", "EventTime")
